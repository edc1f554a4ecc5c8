"""Sequential acceptance against a loop over the rows."""

import random
from datetime import datetime, timedelta

from turnstone.operators import occupancy, requests, scenes

T0 = datetime(2024, 1, 1, 12)


def at(minutes):
    return None if minutes is None else T0 + timedelta(minutes=minutes)


def brute(rows):
    """(agent, start, end, ord, id) in order of start and ord; ids of those that begin."""
    free, begun = {}, set()
    for agent, start, end, _, k in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[3], r[2] if r[2] is not None else 1e9)):
        if agent not in free or free[agent] <= start:
            free[agent] = max(start, 1e9 if end is None else end)
            begun.add(k)
    return begun


def judged(spark, rows):
    df = spark.createDataFrame([(a, at(s), at(e), o, k, "x") for a, s, e, o, k in rows], "agent long, start timestamp_ntz, end timestamp_ntz, ord long, id long, accepted_by string").repartition(3)
    got = requests.busy(df)
    assert got.columns == [*df.columns, "rejected"]
    out = [(r.id, r.rejected) for r in got.collect()]
    assert sorted(k for k, _ in out) == sorted(r[4] for r in rows)
    return {k for k, rejected in out if not rejected}


def test_a_rejected_run_keeps_nobody_waiting(spark):
    assert judged(spark, [(1, 0, 6, 0, 0), (1, 3, 9, 1, 1), (1, 7, 13, 2, 2)]) == {0, 2}


def test_cases(spark):
    rows = [(1, 0, 5, 0, 0), (1, 5, 5, 1, 1), (1, 5, 9, 2, 2), (1, 8, 8, 3, 3), (1, 9, 7, 4, 4), (1, 9, 10, 5, 5), (1, None, 3, 6, 6), (None, 0, 5, 7, 7), (None, 2, 3, 8, 8), (2, 0, None, 9, 9), (2, 9000, 9001, 10, 10)]
    assert judged(spark, rows) == brute(rows) == {0, 1, 2, 4, 5, 7, 9}
    assert judged(spark, []) == set()


def test_random_chains_over_many_days(spark):
    rng = random.Random(9)
    rows = []
    for k in range(1500):
        start = rng.randint(0, 9 * 1440)
        rows.append((rng.choice([1, 1, 1, 2, 3]), start, start + rng.choice([0, 1, 30, 200, 3000]) if rng.random() < 0.999 else None, k, k))
    assert judged(spark, rows) == brute(rows)


def test_one_long_chain(spark):
    rows = [(1, 10 * k, 10 * k + 15, k, k) for k in range(700)]
    assert judged(spark, rows) == {k for k in range(700) if k % 2 == 0}


def test_equal_rows_one_begins(spark):
    assert len(judged(spark, [(1, 0, 5, 0, k) for k in range(6)])) == 1


def test_admission(spark):
    """A frame that comes while the service speaks or answers, or looks at another frame, occupies nothing."""
    frames = spark.createDataFrame([(1, at(t), k) for k, t in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 8, 9])] + [(2, at(4), 10)], "stream_id long, ts timestamp_ntz, ord long")
    spoken = spark.createDataFrame([(1, at(2), at(5)), (1, at(20), None), (3, at(0), None)], "stream_id long, since timestamp_ntz, until timestamp_ntz")
    from pyspark.sql import functions as F

    got = scenes.admitted(frames, spoken, F.col("ts") + F.expr("INTERVAL 2 MINUTES"))
    assert sorted(r.ord for r in got.filter("processed").collect()) == [0, 5, 7, 9, 10] and got.count() == 11


def test_during(spark):
    points = spark.createDataFrame([(k % 3, at(k)) for k in range(3000)] + [(1, None)], "key long, ts timestamp_ntz")
    held = [(0, 10, 20), (0, 15, 2000), (1, 0, 1), (1, 700, 700), (2, 2900, None), (2, None, 5)]
    intervals = spark.createDataFrame([(k, at(a), at(b)) for k, a, b in held], "key long, since timestamp_ntz, until timestamp_ntz")
    got = {(r.key, r.ts) for r in occupancy.during(points, intervals, "key", "ts").filter("during").collect()}
    want = {(k % 3, at(k)) for k in range(3000) for key, a, b in held if key == k % 3 and a is not None and a <= k and (b is None or k < b)}
    assert got == want
