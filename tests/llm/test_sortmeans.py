"""Sort-means against plain k-means in Python integers, and its query against SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from turnstone.llm import catalog, sortmeans

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.StringType()), T.StructField("distance", T.StringType())])


def brute(rows, k, rounds, seed, dimension, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centroids


def check(spark, rows, k=3, rounds=4, seed=3, dimension=2):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    out, centroids = sortmeans.cluster(df, k, rounds, seed, dimension=dimension)
    want, final = brute(rows, k, rounds, seed, dimension)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(want, key=key)
    assert centroids.tolist() == final
    return df


def test_random_vectors(spark):
    rng = np.random.default_rng(4)
    check(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 5)))], k=7, rounds=6, dimension=5)


def test_ties_repeated_rows_and_grids(spark):
    rows = [(i % 40, [float(i % 4), float(i // 4 % 4)]) for i in range(96)]
    check(spark, rows, k=6, rounds=5)
    check(spark, [(1, [0.5, 0.5])] * 30 + [(2, [0.5, 0.5])], k=4, rounds=2)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [0.3, -0.4]), (None, [0.3, 0.9]), (8, [-1e4, 3e4]), (9, [9e4, -9e4])]
    df = check(spark, rows)
    got = {r.vec_id: r for r in sortmeans.report(df, 8, 10, 3, dimension=2).filter("vec_id is not null").collect()}
    assert set(got) == {1, 8, 9}
    assert check(spark, [], k=3).sparkSession
    assert sortmeans.report(df.limit(0), 8, 10, 3, dimension=2).collect() == []


def test_a_component_that_does_not_fit_is_refused(spark):
    df = spark.createDataFrame([(1, [1e6, 0.0], "", "")], SCHEMA)
    with pytest.raises(Exception, match="larger than"):
        sortmeans.cluster(df, 2, 2, 3, dimension=2)


def test_the_scan_stops_and_is_exact():
    rng = np.random.default_rng(5)
    points, centroids = rng.integers(-50, 50, (500, 3)), rng.integers(-50, 50, (20, 3))
    full = ((points[:, None] - centroids[None]) ** 2).sum(-1)
    for before in (np.zeros(500, np.int64), full.argmin(1), rng.integers(0, 20, 500)):
        number, distance = sortmeans.nearest(points, before, centroids)
        assert (distance == full.min(1)).all() and (number == full.argmin(1)).all()
    seen = []
    sortmeans._squares, keep = lambda p, c: seen.append(len(p)) or ((p - c) ** 2).sum(1), sortmeans._squares
    try:
        sortmeans.nearest(points, full.argmin(1), centroids)
    finally:
        sortmeans._squares = keep
    assert sum(seen) < 0.6 * full.size


def test_query_against_sql(spark):
    duckdb.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = duckdb.execute(catalog.oracle_sql()["op11_sortmeans"])
    names = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in names) for r in catalog.op11_sortmeans(spark, SF).collect()) == sorted(want.fetchall())
