"""Byte-level BPE by overlapping chunks, and decoding by concatenating raw bytes.

A text longer than a chunk is cut into chunks that overlap. Each chunk is
pre-tokenised on its own, in whichever task has room. Two neighbours are
stitched at the first boundary of pre-tokens in their overlap that both found:
the pattern never looks back, so from a common boundary on both read the same
pre-tokens. If an overlap holds no common boundary (one run of letters longer
than it, say), the left side goes on token by token until it meets a boundary of
a later chunk. The pieces so found are those of the whole text, and each is
encoded alone.

Defined cases: a null or empty text has no ids; a document of any length is one
output row; rows that are equal in id and text are encoded each; an empty table
gives an empty table; columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_and_text, slices

#: Characters of a chunk and of its overlap with the next.
CHUNK, OVERLAP = 32_768, 512
#: A token is final in a chunk if so many characters follow it there: a
#: contraction ('re) looks two characters past the token before it.
LOOKAHEAD = 3
#: Encoded pieces that a task remembers.
CACHE = 150_000


#: The pattern that has a faster form, and that form: for texts of Latin-1 characters on whose classes Python's re agrees.
KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SAME = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
ODD = bytes(b for b in range(256) if any(bool(re.match(x, chr(b))) != bool(regex.match(y, chr(b))) for x, y in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s"))))


def pretokens(pattern: str) -> Callable[[str], list[str]]:
    """text -> the matches of the pattern, in order."""
    slow = regex.compile(pattern).findall
    if pattern != KNOWN:
        return slow
    fast = re.compile(SAME).findall

    def find(text: str) -> list[str]:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return slow(text)
        return fast(text) if len(raw.translate(None, ODD)) == len(raw) else slow(text)

    return find


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Pieces(dict):
    """Piece of text -> its ids as little-endian bytes, computed when first asked for."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def __missing__(self, piece: str) -> bytes:
        out = self[piece] = np.array(self.encode(piece), "<u4").tobytes()
        return out

    def ids(self, pieces: list[str]) -> bytes:
        if len(self) > CACHE:
            self.clear()
        return b"".join(map(self.__getitem__, pieces))


@lru_cache(1)
def pieces_of(ranks_path: str, pattern: str) -> Pieces:
    """One in a worker, for all its tasks."""
    return Pieces(read_ranks(ranks_path), pattern)


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    return [text[i : i + size + overlap] for i in range(0, max(len(text), 1), size)]


def boundaries(pattern: regex.Pattern, chunk: str, last: bool) -> np.ndarray:
    """Ends of the chunk's pre-tokens that text after the chunk can't change; 0 leads them."""
    ends = np.fromiter((m.end() for m in pattern.finditer(chunk)), np.int64)
    return np.concatenate([[0], ends if last else ends[ends <= len(chunk) - LOOKAHEAD]])


def stitch(pattern: regex.Pattern, parts: list[tuple[str, np.ndarray]], size: int) -> Iterator[list[str]]:
    """The pieces of the whole text. parts: each chunk and its boundaries, in order."""
    k, at = 0, 0  # at: a boundary of the whole text and of chunk k
    while True:
        chunk, ends = parts[k]
        start = k * size
        own = ends[ends >= at - start]
        final = k + 1 == len(parts)
        common = own[:0] if final else own[np.isin(own + start, parts[k + 1][1] + start + size)]
        own = own[own <= common[0]] if len(common) else own
        cut = own.tolist()
        yield [chunk[a:b] for a, b in zip(cut, cut[1:])]
        at = start + cut[-1]
        if final:
            return
        if len(common):
            k += 1
            continue
        # no common boundary in the overlap: go on token by token over the joined chunks until a later chunk agrees
        upto, known, joined = k, {}, chunk  # joined: chunks k to upto
        more: list[str] = []
        while True:
            met = None
            for m in pattern.finditer(joined, at - start):
                if upto + 1 < len(parts) and m.end() > len(joined) - LOOKAHEAD:
                    break
                more.append(m.group())
                at = start + m.end()
                met = known.get(at)
                if met is not None:
                    break
            if met is not None or upto + 1 == len(parts):
                break
            far = min(len(parts) - 1, upto + max(1, upto - k))  # twice as far each time: a run of any length is read and copied a few times at most
            more_chunks = [parts[j][0] if j == far else parts[j][0][:size] for j in range(upto + 1, far + 1)]
            joined = "".join([joined[: (upto + 1 - k) * size], *more_chunks])
            known |= {int(e) + j * size: j for j in range(upto + 1, far + 1) for e in parts[j][1]}
            upto = far
            if (met := known.get(at)) is not None:
                break
        yield more
        if met is None:
            return
        k = met


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK, overlap: int = OVERLAP, digest: bool = False) -> DataFrame:
    """doc_id, ids: binary of little-endian unsigned 32-bit ids, one row for each row of df; with digest what digests() makes of them instead.

    Texts of one chunk are encoded where they are read, so only the chunks of
    longer ones are dealt out. The second exchange brings the chunks of a
    document together in order; they are read as a stream.
    """
    docs = key_and_text(df, id_col, text_col)
    schema = DIGESTS if digest else "doc_id long, ids binary"

    def made(doc_ids: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
        return digested(doc_ids, ids, ranks_path) if digest else pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.binary())], ["doc_id", "ids"])

    def one_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, pieces = pretokens(pattern), pieces_of(ranks_path, pattern)
        for b in slices(batches):
            yield made(b.column(0), [pieces.ids(find(t)) for t in b.column(1).to_pylist()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts, key = chunks(t, size, overlap), hashlib.sha256(t.encode()).digest()
                for k in range(0, len(parts), 64):
                    own = parts[k : k + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(own), pa.int64()), pa.array([key] * len(own), pa.binary()), pa.array(range(k, k + len(own)), pa.int64()), pa.array([k + j + 1 == len(parts) for j in range(len(own))]), pa.array(own)], ["doc_id", "key", "k", "last", "chunk"])

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pat = regex.compile(pattern)
        for b in batches:
            ends = [boundaries(pat, c, last).astype("<i4").tobytes() for c, last in zip(b.column(4).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array(ends, pa.binary())], ["doc_id", "key", "k", "chunk", "ends"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pat, pieces = regex.compile(pattern), pieces_of(ranks_path, pattern)
        rows = (r for b in batches for r in zip(*(b.column(j).to_pylist() for j in range(5))))
        for (i, _), own in groupby(rows, key=lambda r: r[:2]):
            parts, copies = [], 0
            for r in own:
                copies += r[2] == 0
                if r[2] == len(parts):  # equal rows bring each chunk again
                    parts.append((r[3], np.frombuffer(r[4], "<i4").astype(np.int64)))
            ids = b"".join(pieces.ids(p) for p in stitch(pat, parts, size))
            for _ in range(copies):
                yield made(pa.array([i], pa.int64()), [ids])

    whole = docs.filter(F.length("text") <= size).mapInArrow(one_chunk, schema)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.filter(F.length("text") > size).mapInArrow(cut, "doc_id long, key binary, k long, last boolean, chunk string").repartition(n, "doc_id", "key", "k")
    ready = dealt.mapInArrow(pretokenise, "doc_id long, key binary, k long, chunk string, ends binary")
    long = ready.repartition(n, "doc_id", "key").sortWithinPartitions("doc_id", "key", "k").mapInArrow(encoded, schema)
    return whole.unionByName(long)


def decode(df: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids, decoded: the raw bytes of each row's ids, concatenated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = raw_bytes(ranks_path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([raw(np.frombuffer(x, "<u4")) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "ids", "decoded"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


@lru_cache(1)
def raw_bytes(ranks_path: str) -> Callable[[np.ndarray], bytes]:
    table = {v: k for k, v in read_ranks(ranks_path).items()}
    return lambda ids: b"".join(map(table.__getitem__, ids.tolist()))


@lru_cache(1)
def names_of(ranks_path: str) -> dict[int, str]:
    return {v: str(v) for v in read_ranks(ranks_path).values()}


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digested(doc_ids: pa.Array, ids: list[bytes], ranks_path: str) -> pa.RecordBatch:
    """A row of DIGESTS for each document: of its ids, and of the bytes that they decode to."""
    raw, name = raw_bytes(ranks_path), names_of(ranks_path).__getitem__
    counts, of_ids, of_text = [], [], []
    for x in ids:
        own = np.frombuffer(x, "<u4")
        counts.append(len(own))
        of_ids.append(hashlib.sha256(",".join(map(name, own.tolist())).encode()).hexdigest())
        of_text.append(hashlib.sha256(raw(own)).hexdigest())
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode returns, decoded as in decode but not kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield digested(b.column(0), b.column(1).to_pylist(), ranks_path)

    return encoded.select("doc_id", "ids").mapInArrow(run, DIGESTS)
