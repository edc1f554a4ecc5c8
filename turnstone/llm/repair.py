"""Token-id files compressed by Re-Pair grammars.

Documents are put in ascending order of their id (nulls first, equal ids by
their token ids) and written as blocks. A block has a grammar of its own:
in rounds, all frequent pairs of neighbouring symbols get nonterminals and
are replaced wherever they stand, left to right without overlap, until no pair
is frequent (LEAST times in the block). A pair never spans two documents, so a document is a
range of symbols; the block stores its rules, the length each symbol expands to
and the place of each document, so that one document can be decoded alone.

The file format is a Parquet table in a folder that driver and executors share
(its commit protocol copes with tasks that run twice), one row for each block:

    shard, block            place in the order
    doc_ids                 little-endian int64; has_id: a byte for each
    symbol_ends, token_ends little-endian int64: where each document ends in the block
    rules                   little-endian uint32 pairs; rule r makes symbol BASE + r
    lengths                 little-endian uint32: ids that each rule expands to
    symbols                 little-endian 24-bit symbols

Defined cases: a null or empty text has the end id alone; equal rows are each
written; an empty table gives no block; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import KNOWN, pretokens
from .common import key_and_text, shared_dir, slices

#: First nonterminal: above the ids of any 16-bit vocabulary.
BASE = 1 << 16
#: Ids after which a block is closed; a longer document makes a longer block.
BLOCK = 2_000_000
#: The least count of a pair worth a rule.
LEAST = 24
#: Pre-tokens that a worker remembers: the first ones met, which are the most frequent; some 300 MB. Longest one remembered.
CACHE, LONGEST = 1_500_000, 48
#: Bytes of text for a shard, and most shards; there are at least as many as shuffle partitions.
SHARD, MOST_SHARDS = 64_000_000, 10_000

#: Blocks up to which their first places are broadcast (24 bytes each).
MOST_BLOCKS = 200_000

SCHEMA = "shard long, block long, doc_ids binary, has_id binary, symbol_ends binary, token_ends binary, rules binary, lengths binary, symbols binary"


class Encoder:
    """Ids of texts as the tokenizers library makes them, added tokens with them.

    Of files with the plain byte-level pre-tokeniser each pre-token is encoded once by the library's model, and its ids are remembered.
    Texts with an added token in them, and files with another pre-tokeniser, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > BASE:
            raise ValueError(f"more than {BASE} ids")
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre = said.get("pre_tokenizer") or {}
        self.plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and not said.get("normalizer")
        self.added = [x["content"] for x in said.get("added_tokens") or []]
        self.find, self.pieces = pretokens(KNOWN), Pieces(self.tokenizer.model)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 16-bit ids of each text."""
        out, of, find = [], self.pieces.__getitem__, self.find
        for text in texts:
            if self.plain and not any(x in text for x in self.added):
                out.append(b"".join(map(of, find(text))))
            else:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes())
        return out


class Pieces(dict):
    """Pre-token -> ids, encoded by the library's model when first asked for; the first CACHE ones met are remembered, unless long."""

    def __init__(self, model):
        super().__init__()
        self.tokenize = model.tokenize
        # the characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.packed = [k.to_bytes(2, "little") for k in range(BASE)]

    def __missing__(self, piece: str) -> bytes:
        out = b"".join([self.packed[t.id] for t in self.tokenize(piece.encode().decode("latin-1").translate(self.shown))])
        if len(self) < CACHE and len(piece) <= LONGEST:
            self[piece] = out
        return out


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One in a worker, for all its tasks."""
    return Encoder(path)


def members(keys: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """For each key its place in chosen (distinct), or -1: by a table of hashes; keys that meet another on their slot go to a next table."""
    out, left, turn = np.full(len(keys), -1, np.int32), np.arange(len(chosen), dtype=np.int32), 0
    open_ = None  # places of keys that may still be found; None: all
    while len(left):
        factor, fold = keys.dtype.type(0x9E3779B1 + 2 * turn), keys.dtype.type(29 if keys.itemsize == 8 else 15)
        hashed = lambda k: (((k ^ (k >> fold)) * factor) >> keys.dtype.type(12)) & keys.dtype.type(0xFFFFF)  # noqa: B023, E731
        slot = np.full(1 << 20, -1, np.int32)
        taken = hashed(chosen[left])
        slot[taken] = left
        own = keys if open_ is None else keys[open_]
        found = slot[hashed(own)]
        some = np.flatnonzero(found >= 0)
        met, at = found[some], some if open_ is None else open_[some]
        same = chosen[met] == keys[at]
        out[at[same]] = met[same]
        left, open_, turn = left[slot[taken] != left], at[~same], turn + 1
    return out


def grammar(symbols: np.ndarray, ends: np.ndarray, rounds: int | None = None, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replaced symbols, where each document ends among them, and the rules (n x 2).

    ends: where each document, none of them empty, ends in symbols. rounds: at most so many; None goes on until no pair is frequent enough.
    After a round each pair that was frequent is gone, and no other can have become so but with a symbol made in it, so only those are counted again.
    """
    seq, rules = symbols.astype(np.int32), [np.empty((0, 2), np.int64)]
    last = np.zeros(len(seq), bool)
    last[ends - 1] = True
    made, before = 0, 0
    for turn in count() if rounds is None else range(rounds):
        inner = ~last[:-1]
        if turn:
            new = seq >= BASE + before
            inner &= new[:-1] | new[1:]
            at = np.flatnonzero(inner)
            keys = (seq[at].astype(np.int64) << 32) | seq[at + 1]
            half = 32
        else:  # two ids make a number of 32 bits
            wide = seq.view(np.uint32)
            at = np.flatnonzero(inner)
            keys = ((wide[:-1] << np.uint32(16)) | wide[1:])[inner]
            half = 16
        if not len(at):
            break
        ranked = np.sort(keys)
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        chosen = ranked[first[np.diff(np.r_[first, len(ranked)]) >= least]]
        if not len(chosen):
            break
        rule = members(keys, chosen)
        hit = rule >= 0
        at, rule, chosen = at[hit], rule[hit], chosen.astype(np.int64)
        # of places next to each other take the first, third, ...
        opens = np.r_[True, np.diff(at) != 1]
        nth = np.arange(len(at)) - np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
        at, rule = at[nth % 2 == 0], rule[nth % 2 == 0]
        used = np.flatnonzero(np.bincount(rule, minlength=len(chosen)))
        number = np.zeros(len(chosen), np.int64)
        number[used] = np.arange(len(used))
        rules.append(np.stack([chosen[used] >> half, chosen[used] & ((1 << half) - 1)], 1))
        before = made
        seq[at] = BASE + made + number[rule]
        last[at] = last[at + 1]
        made += len(used)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
    return seq.astype(np.int64), np.flatnonzero(last) + 1, np.concatenate(rules)


def expansions(rules: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rules one after another, and the length of each."""
    own: list[bytes] = []
    for x, y in rules.tolist():
        own.append((own[x - BASE] if x >= BASE else x.to_bytes(4, "little")) + (own[y - BASE] if y >= BASE else y.to_bytes(4, "little")))
    return np.frombuffer(b"".join(own), "<u4").astype(np.int64), np.array([len(x) // 4 for x in own], np.int64)


def expand(symbols: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of symbols; ids and lengths as expansions() has them."""
    nonterminal = symbols >= BASE
    rule = np.where(nonterminal, symbols - BASE, 0)
    starts = np.r_[0, np.cumsum(lengths)]
    n = np.ones(len(symbols), np.int64)
    n[nonterminal] = lengths[rule[nonterminal]]
    out = np.repeat(symbols, n)
    where = np.repeat(starts[rule] - np.r_[0, np.cumsum(n)[:-1]] if len(n) else n, n) + np.arange(len(out))
    inner = np.repeat(nonterminal, n)
    out[inner] = ids[where[inner]]
    return out


def pack(symbols: np.ndarray) -> bytes:
    return symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel().astype(np.int64)


def block(shard: int, number: int, docs: list[tuple[int | None, bytes]]) -> tuple:
    """A row of the format. docs: id and little-endian 16-bit ids, none empty."""
    ids = np.frombuffer(b"".join(x for _, x in docs), "<u2")
    token_ends = np.cumsum([len(x) // 2 for _, x in docs])
    seq, symbol_ends, rules = grammar(ids, token_ends)
    lengths: list[int] = []
    for pair in rules.tolist():
        lengths.append(sum(lengths[x - BASE] if x >= BASE else 1 for x in pair))
    return (
        shard, number, np.array([i or 0 for i, _ in docs], "<i8").tobytes(), np.array([i is not None for i, _ in docs], np.uint8).tobytes(),
        symbol_ends.astype("<i8").tobytes(), token_ends.astype("<i8").tobytes(), rules.astype("<u4").tobytes(), np.array(lengths, "<u4").tobytes(), pack(seq),
    )


def documents_of(row: dict, only: list[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Id, first token in the block and ids of each document, or of those at the given places, from the stored bytes."""
    doc_ids, has_id = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["has_id"], np.uint8)
    s_ends, t_ends = (np.frombuffer(row[k], "<i8") for k in ("symbol_ends", "token_ends"))
    ids, lengths = expansions(np.frombuffer(row["rules"], "<u4").astype(np.int64).reshape(-1, 2))
    if only is None:
        out = expand(unpack(row["symbols"]), ids, lengths)
    for j in range(len(doc_ids)) if only is None else only:
        t0 = int(t_ends[j - 1]) if j else 0
        own = out[t0 : t_ends[j]] if only is None else expand(unpack(row["symbols"][3 * int(s_ends[j - 1] if j else 0) : 3 * int(s_ends[j])]), ids, lengths)
        yield (int(doc_ids[j]) if has_id[j] else None), t0, own


def write(df: DataFrame, tokenizer_path: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Encode, append end_id to each document, and write the blocks to path.

    The bounds of the shards come from quantiles of the id column; their number grows with the bytes of text. Rows without an id, and
    those of an id that takes up several quantiles, are shards of their own by the first byte of their ids, which keeps their order. The
    texts are encoded where they are read, and only ids are dealt out.
    """
    docs = key_and_text(df, id_col, text_col)
    n = shards
    if n is None:
        held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_SHARDS, -(-held // SHARD)))
    bounds = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / n) for k in range(1, n)]), F.lit(20 * n))).first()[0] if n > 1 else None
    edges, times = np.unique(np.array(bounds or [], np.int64), return_counts=True)
    often = set(edges[times > 1].tolist())

    def shard(doc_id: int | None, ids: bytes) -> tuple[int, int]:
        """Place in the order of shards, and the partition."""
        k = -1 if doc_id is None else int(np.searchsorted(edges, doc_id))
        if doc_id is None or doc_id in often:
            return k * 257 + 1 + ids[0], (k + 1 + ids[0]) % n
        return k * 257, k % n

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path), np.array([end_id], "<u2").tobytes()
        for b in slices(batches):
            ids = [x + end for x in enc.ids(b.column(1).to_pylist())]
            placed = [shard(i, x) for i, x in zip(b.column(0).to_pylist(), ids)]
            yield pa.RecordBatch.from_arrays([pa.array([p[1] for p in placed], pa.int32()), pa.array([p[0] for p in placed], pa.int32()), b.column(0), pa.array(ids, pa.binary())], ["part", "shard", "doc_id", "ids"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            own, size, shard, number = [], 0, None, 0
            for b in batches:
                for s, i, x in zip(*(c.to_pylist() for c in b.columns)):
                    if own and (s != shard or size >= 2 * BLOCK):
                        yield block(shard, number, own)
                        own, size, number = [], 0, number + 1
                    number = number if s == shard else 0
                    shard = s
                    own.append((i, x))
                    size += len(x)
            if own:
                yield block(shard, number, own)

        for row in made():
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[2:])], [f.split()[0] for f in SCHEMA.split(", ")])

    dealt = docs.mapInArrow(encoded, "part int, shard int, doc_id long, ids binary").repartitionById(n, F.col("part")).drop("part")
    dealt.sortWithinPartitions("shard", "doc_id", "ids").mapInArrow(blocks, SCHEMA).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32 bits) of each document in the files; with digest their ids_crc32 instead of ids."""
    files = spark.read.parquet(path)
    last = "ids_crc32" if digest else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for row in b.to_pylist():
                docs = list(documents_of(row))
                for k in range(0, len(docs), 500):
                    own = docs[k : k + 500]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.int64()), pa.array([row["base"] + x[1] for x in own], pa.int64()), pa.array([len(x[2]) for x in own], pa.int64()), pa.array([zlib.crc32(x[2].astype("<u4").tobytes()) for x in own], pa.int64()) if digest else pa.array([x[2].astype("<u4").tobytes() for x in own], pa.binary())], ["doc_id", "start", "n_tokens", last])


    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([int(np.frombuffer(x[-8:], "<i8")[0]) for x in b.column(2).to_pylist()], pa.int64())], ["shard", "block", "n"])

    total = files.select("shard", "block", "token_ends").mapInArrow(sizes, "shard long, block long, n long")
    before = F.sum("n").over(Window.orderBy("shard", "block").rowsBetween(Window.unboundedPreceding, -1))
    base = total.select("shard", "block", F.coalesce(before, F.lit(0)).alias("base"))
    # one row a block, some two million ids, so one task adds them up; joined to the blocks, not to their documents: broadcast while it is surely small
    base = F.broadcast(base) if files.count() <= MOST_BLOCKS else base
    return files.join(base, ["shard", "block"]).mapInArrow(run, f"doc_id long, start long, n_tokens long, {last} {'long' if digest else 'binary'}")


def round_trip(df: DataFrame, tokenizer_path: str, end_id: int = 2, digest: bool = True) -> DataFrame:
    path = shared_dir(df.sparkSession)
    write(df, tokenizer_path, end_id, path)
    return read(df.sparkSession, path, digest)
