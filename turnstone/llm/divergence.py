"""How the sources of a language differ in their words: distances between all pairs, and each one's own terms.

Terms are counted in tasks that hold a bounded number of terms at a time. A
language keeps the terms of at least LEAST_DOCS of its documents; a group
(language, source) gives each of them the smoothed share
``1 + floor(10**9 * (count + 5) / (N + 5 * V))``, in integers.

Pairs are computed in tiles: groups are dealt into blocks of about GROUPS by a hash of
their name, kept terms into chunks of about CHUNK; the counts of a block in a chunk are
one packed row, which goes to every tile (block, block) that needs it. A task
runs through the chunks of a slab of a tile in turn, holds two packed rows and one
matrix of sums at a time, and Spark adds up the slabs. So neither a language with a
third of all rows nor one with many sources is one task, and the rows shuffled are
packed vectors times the number of blocks.

Defined cases: null text, language and source count as empty strings, which are
values like others; a group without terms has all pairs; a language without kept terms
has pairs of value 0 and no terms; equal rows count as often as they stand; ties
rank by UTF-8; empty tables give no rows. Other columns are ignored. Counts are
64 bits; shares are exact up to 9 * 10**15 terms in a group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, slices, small_batches, stored

LEAST_DOCS, TOP, SMOOTHING, UNIT = 30, 50, 5, 10**9
#: Groups of a block, terms of a chunk, chunks of a slab.
GROUPS, CHUNK, SLAB = 64, 256, 64
#: Terms that a task holds before it hands their counts on; bytes of a text that are split at once.
HELD, PIECE = 200_000, 1 << 22

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, lists of those of some megabytes at a time."""
    raw = text.encode().translate(_LETTERS)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", min(at + PIECE, len(raw)))
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text to counts by term; the empty term stands for the group itself and counts its documents."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in slices(batches):
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            seen: set[bytes] = set()
            for words in terms(text):
                n.update(words)
                seen.update(words)
            docs.update(seen)
            docs[b""] += 1
            size += len(n)
            if size > HELD:
                yield from _emitted(held)
                held, size = {}, 0
    yield from _emitted(held)


def _emitted(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        words = list(docs)
        columns = [pa.array([lang] * len(words)), pa.array([source] * len(words)), pa.array(words, pa.binary()).cast(pa.string()), pa.array([n[w] for w in words], pa.int64()), pa.array([docs[w] for w in words], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, schema=_COUNTS)


def counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n, docs; the empty term counts the documents of a group."""
    small_batches(df)
    rows = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    found = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, d: str) -> Column:
    """1 + floor(UNIT * (n + SMOOTHING) / d), exact."""
    return F.expr(f"1L + (cast({UNIT} as decimal(10,0)) * cast({n} + {SMOOTHING} as decimal(19,0))) div cast({d} as decimal(19,0))")


def _shares(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The same by long division in base 1000, as UNIT * n may not fit 64 bits; d stands for rows."""
    q, r = np.divmod(n + SMOOTHING, d[:, None])
    for _ in range(3):
        digit, r = np.divmod(r * 1000, d[:, None])
        q = q * 1000 + digit
    return q + 1


def _dealt(key: str, parts: str) -> Column:
    return F.expr(f"cast(pmod(xxhash64({key}), {parts}) as int)")


def measured(df: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of kept counts (lang, source, term, n, total, chunk, t), groups (lang, source, block, blocks, g, d) and chunks (lang, chunk, width, d).

    t numbers the terms of a chunk, g the groups of a block, d is the denominator of the shares.
    """
    all_counts = stored(counts(df, **columns))
    words = all_counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= LEAST_DOCS)
    words = stored(words.select("lang", "term", "total"))
    sizes = words.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("total_n"))
    in_chunk = Window.partitionBy("lang", "chunk").orderBy("term")
    chunked = words.join(few(sizes), "lang").withColumn("chunk", _dealt("term", f"ceil(v / {CHUNK})")).withColumn("t", F.row_number().over(in_chunk) - 1)
    chunked = stored(chunked.select("lang", "term", "total", "chunk", "t"))
    kept = stored(all_counts.filter("term <> ''").drop("docs").join(chunked, ["lang", "term"]))
    names = all_counts.filter("term = ''").select("lang", "source")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    per_lang = names.groupBy("lang").agg(F.count("*").alias("s")).join(sizes, "lang", "left").select("lang", F.expr(f"ceil(s / {GROUPS})").alias("blocks"), F.expr(f"coalesce(total_n + {SMOOTHING} * v, 0L)").alias("lang_d"), F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    per_lang = stored(per_lang)
    groups = names.join(few(per_lang), "lang").join(own, ["lang", "source"], "left").withColumn("block", _dealt("source", "blocks"))
    in_block = Window.partitionBy("lang", "block").orderBy("source")
    groups = stored(groups.select("lang", "source", "block", "blocks", (F.row_number().over(in_block) - 1).alias("g"), F.expr(f"coalesce(n, 0L) + {SMOOTHING} * v").alias("d"), "lang_d"))
    chunks = chunked.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("width"))
    chunks = stored(chunks.unionByName(per_lang.filter("v = 0").select("lang", F.lit(0).alias("chunk"), F.lit(0).alias("width"))))
    return kept, groups, chunks


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of packed counts, in the order of tile, slab, chunk and side, to one matrix of sums for each tile and slab."""
    key, sums, first, before = None, None, None, None
    for batch in slices(batches):
        columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        cells = columns["cells"]
        for k in range(batch.num_rows):
            at = lambda name: columns[name][k].as_py()  # noqa: B023, E731
            row_key = (at("lang"), at("i"), at("j"), at("slab"))
            d = columns["ds"][k].values.to_numpy(zero_copy_only=False)
            n = np.zeros((len(d), at("width")), np.int64)
            if cells[k].is_valid:
                found = cells[k].values
                g, t, c = (x.to_numpy(zero_copy_only=False) for x in found.flatten())
                n[g, t] = c
            p = _shares(n, d) if n.shape[1] else n
            if row_key != key:
                if key is not None:
                    yield _matrix(key, sums)
                key, sums = row_key, None
            diagonal = row_key[1] == row_key[2]
            if not diagonal and at("side") == 0:
                first, before = p, at("chunk")
                continue
            if diagonal:
                first, before = p, at("chunk")
            if before != at("chunk"):
                raise ValueError("the sides of a tile belong to different chunks")
            if sums is None:
                sums = np.zeros((len(first), len(p)), np.int64)
            for a in range(len(first)):
                sums[a] += np.abs(p - first[a]).sum(1)
    if key is not None:
        yield _matrix(key, sums)


def _matrix(key: tuple, sums: np.ndarray) -> pa.RecordBatch:
    lang, i, j, _ = key
    a, b = np.triu_indices(len(sums), 1) if i == j else (x.ravel() for x in np.indices(sums.shape))
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, i, np.int32)), pa.array(np.full(n, j, np.int32)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(sums[a, b])], names=["lang", "i", "j", "a", "b", "value"])


def pairs(kept: DataFrame, groups: DataFrame, chunks: DataFrame) -> DataFrame:
    """lang, source, item, value for each ordered pair of a language's sources."""
    place = groups.select("lang", "source", "block", "g")
    packed = kept.join(few(place), ["lang", "source"]).groupBy("lang", "block", "chunk").agg(F.collect_list(F.struct("g", "t", "n")).alias("cells"))
    blocks = groups.groupBy("lang", "block", "blocks").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]).alias("ds"))
    full = chunks.join(few(blocks), "lang").join(packed, ["lang", "block", "chunk"], "left")
    sent = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    sent = sent.join(few(blocks.select("lang", F.col("block").alias("other"))), ["lang", "other"])  # blocks that the hash left empty have no tiles
    sent = sent.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.expr(f"cast(chunk div {SLAB} as int)").alias("slab"), "chunk", (F.col("block") > F.col("other")).cast("int").alias("side"), "width", "ds", "cells")
    order = ["lang", "i", "j", "slab"]
    sums = sent.repartition(*order).sortWithinPartitions(*order, "chunk", "side").mapInArrow(_tiles, "lang string, i int, j int, a int, b int, value long")
    sums = sums.groupBy("lang", "i", "j", "a", "b").agg(F.sum("value").alias("value"))
    named = lambda block, g, name: place.select("lang", F.col("block").alias(block), F.col("g").alias(g), F.col("source").alias(name))
    both = sums.join(few(named("i", "a", "one")), ["lang", "i", "a"]).join(few(named("j", "b", "two")), ["lang", "j", "b"])
    return both.select("lang", F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))).alias("x"), "value").select("lang", "x.source", "x.item", "value")


def own_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for the terms of a group whose share is above the language's."""
    rows = kept.join(few(groups.select("lang", "source", "d", "lang_d")), ["lang", "source"])
    rows = rows.select("lang", "source", F.col("term").alias("item"), (_share("n", "d") - _share("total", "lang_d")).alias("value"))
    return rows.filter("value > 0")


def audit(df: DataFrame, **columns: str) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: all pairs, and the TOP terms of each group."""
    kept, groups, chunks = measured(df, **columns)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    of_pairs = pairs(kept, groups, chunks).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    of_terms = own_terms(kept, groups).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP).withColumn("part", F.lit("term"))
    columns_out = ["lang", "source", "part", "item", "value", "rank"]
    return of_pairs.select(*columns_out).unionByName(of_terms.select(*columns_out))
