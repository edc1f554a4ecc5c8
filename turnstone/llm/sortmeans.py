"""Clusters of vectors by sort-means: k-means whose scans end early, in exact integers.

Each round orders all centroids by their distance from each centroid. A vector
scans them in the order of the centroid it was assigned to before, and stops at
the first one that is strictly more than twice as far from that centroid as the vector is:
by the triangle inequality none from there on can be nearer, or as near. Squared
distances are compared as integers, so ties are found as such and go to the smaller number.

Vectors are packed into blocks of BLOCK rows, two bytes a component where all of a
block fit. Each round is one pass over the blocks that writes them anew with the
new assignments and sums, which are the next round's start and all that a lost executor
needs to repeat; the round before is deleted. Tasks add up their blocks, Spark
adds up the tasks, and k x dimension sums reach the driver. Rounds that no longer
move a centroid are left out, as they would change nothing.

Defined cases: null vectors and those of another length, or with null or
non-finite components, are left out; a null id is kept, and is chosen as a start last;
rows with equal ids and vectors each count; of starts with equal hashes the smaller
vector comes first; fewer vectors than k give as many clusters; empty tables
give no rows. A component of more than LARGEST after scaling raises an error, as a
squared distance must fit 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, stored

#: Vectors of a block.
BLOCK = 8192
#: Largest component: 64 squares of twice that are below 2**63.
LARGEST = 2**27
_BLOCKS = "ids array<long>, cells binary, width int, cluster binary, distance binary, counts array<long>, sums array<long>"


def start(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids, with the seed, have the smallest sha256, in the order of these hashes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def kept(df: DataFrame, id_col: str, vector_col: str, dimension: int, scale: int) -> DataFrame:
    """id, v: the vectors of that dimension without null or non-finite components, as integers floor(scale * x)."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter((F.size("v") == dimension) & F.forall("v", sound))
    whole = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))))
    fits = F.forall("v", lambda x: F.abs(x * F.lit(float(scale))) <= F.lit(float(LARGEST)))
    return rows.select("id", F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component is larger than {LARGEST} after scaling"))).alias("v"))


def nearest(points: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each point's nearest centroid, scanned from the one it had before."""
    k = len(centroids)
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(-1)
    number, best = before.copy(), np.empty(len(points), np.int64)
    for a in range(k):
        at = np.flatnonzero(before == a)
        if not len(at):
            continue
        own = _squares(points[at], centroids[a])
        best[at] = own
        for j in np.argsort(apart[a], kind="stable"):
            if j == a:
                continue
            # strictly beyond twice the distance: apart > 4 * own, without overflow
            going = own > (apart[a, j] - 1) // 4
            at, own = at[going], own[going]
            if not len(at):
                break
            d = _squares(points[at], centroids[j])
            better = (d < best[at]) | ((d == best[at]) & (j < number[at]))
            best[at[better]], number[at[better]] = d[better], j
    return number, best


def _squares(points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = points - centroid
    return np.einsum("ij,ij->i", apart, apart)


def _round(ids: list, points: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> dict:
    """A block after a round: its rows, their clusters and distances, and its sums by cluster."""
    number, distance = nearest(points, before, centroids)
    k, dimension = centroids.shape
    sums = np.zeros((k, dimension), np.int64)
    for c in np.unique(number):
        sums[c] = points[number == c].sum(0)
    small = points.size == 0 or np.abs(points).max() < 2**15
    cells = points.astype(np.int16 if small else np.int32)
    return {
        "ids": ids, "cells": cells.tobytes(), "width": cells.itemsize, "cluster": number.astype(np.int32).tobytes(), "distance": distance.tobytes(),
        "counts": np.bincount(number, minlength=k).tolist(), "sums": sums.ravel().tolist(),
    }


_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), ("cells", pa.binary()), ("width", pa.int32()), ("cluster", pa.binary()), ("distance", pa.binary()), ("counts", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))])


def _packed(centroids: np.ndarray):
    """id, v into blocks, after their first round."""
    dimension = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        parts: list[np.ndarray] = []
        for batch in slices(batches):
            v = batch.column(1)
            parts.append(v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimension))
            ids += batch.column(0).to_pylist()
            if len(ids) >= BLOCK:
                yield _one(ids, parts)
                ids, parts = [], []
        if ids:
            yield _one(ids, parts)

    def _one(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        points = np.concatenate(parts)
        return pa.RecordBatch.from_pylist([_round(ids, points, np.zeros(len(ids), np.int64), centroids)], schema=_SCHEMA)

    return run


def _points(row: dict, dimension: int) -> np.ndarray:
    return np.frombuffer(row["cells"], np.int16 if row["width"] == 2 else np.int32).reshape(-1, dimension).astype(np.int64)


def _moved(centroids: np.ndarray):
    """Blocks after a round with these centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for row in batch.to_pylist():
                before = np.frombuffer(row["cluster"], np.int32).astype(np.int64)
                yield pa.RecordBatch.from_pylist([_round(row["ids"], _points(row, centroids.shape[1]), before, centroids)], schema=_SCHEMA)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a task: its counts, then its sums."""
    total = None
    for batch in batches:
        for counts, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            row = np.array(counts + sums, np.int64)
            total = row if total is None else total + row
    if total is not None:
        yield pa.RecordBatch.from_pydict({"total": [total.tolist()]})


def _next(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The exact floor of each cluster's mean; empty clusters stay."""
    rows = blocks.select("counts", "sums").mapInArrow(_added, "total array<long>").select(F.posexplode("total").alias("at", "n"))
    total = {r.at: int(r.n) for r in rows.groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()}
    k, dimension = centroids.shape
    out = centroids.copy()
    for c in range(k):
        if count := total.get(c, 0):
            out[c] = [total[k + c * dimension + d] // count for d in range(dimension)]
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(np.frombuffer(row["cluster"], np.int32)), pa.array(np.frombuffer(row["distance"], np.int64))], names=["id", "cluster", "distance"])


def cluster(df: DataFrame, k: int, rounds: int, seed: int, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int = 64, scale: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """id, cluster, distance (squared) for each kept vector, and the final centroids.

    k and dimension are parameters; k x dimension numbers pass through the driver each round.
    """
    vectors = kept(df, id_col, vector_col, dimension, scale)
    centroids = start(vectors, k, seed)
    if not len(centroids):
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids
    conf = vectors.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BLOCK:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK))
    blocks = stored(vectors.mapInArrow(_packed(centroids), _BLOCKS))
    for _ in range(rounds):
        moved = _next(blocks, centroids)
        if (moved == centroids).all():
            break
        centroids, last = moved, blocks
        blocks = stored(last.mapInArrow(_moved(centroids), _BLOCKS))
        discard(last, sweep=False)
    out = stored(blocks.select("ids", "cluster", "distance").mapInArrow(_rows, "id long, cluster int, distance long"))
    discard(blocks)
    return out, centroids


def report(df: DataFrame, k: int, rounds: int, seed: int, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each kept vector."""
    rows, centroids = cluster(df, k, rounds, seed, **options)
    spark = rows.sparkSession
    sums = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, d, sum(sums.values()), marks[c]) for c, d in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
