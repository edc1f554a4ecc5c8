"""Streams give the rows of the batch forms."""

import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from turnstone.operators import memory, properties, requests, scenes, tools
from turnstone.sources.tables import v_frame, v_mem, v_tool
from turnstone.streaming import stateful

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def staged(spark, tmp_path):
    """A table as files in order of time, one a micro-batch, and its stream."""

    def stage(df, parts=3):
        rows = df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})
        edges = rows.approxQuantile("ord", [k / parts for k in range(1, parts)], 0.0)
        for k, (lo, hi) in enumerate(zip([-1, *edges], [*edges, 1e18])):
            rows.filter((F.col("ord") > lo) & (F.col("ord") <= hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
        return stateful.files(spark, str(tmp_path / "in"), schema)

    return stage


def run(stream, tmp_path, mode="append", each=None):
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True)
    q = (w.foreachBatch(each) if each else w.format("memory").queryName("out")).start()
    q.awaitTermination()


def by_time(df):
    """Arrival order is that of time, as it is on one device."""
    return df.withColumn("ts", F.timestamp_seconds(F.col("ord") + 1000))


def test_scene_changes(spark, staged, tmp_path):
    frames = by_time(v_frame(spark, SF))
    run(stateful.scene_changes(staged(frames)), tmp_path)
    got = {tuple(r) for r in spark.sql("SELECT stream_id, ord, name FROM out").collect()}
    assert got == {tuple(r) for r in scenes.changes(frames).select("stream_id", "ord", "name").collect()}


def test_last_values(spark, staged, tmp_path):
    checked = tools.checked(tools.looked_up(v_tool(spark, SF), tools.registry(spark))).filter("accepted and field is not null").select("vehicle", "field", "value", "ts", "ord")
    run(stateful.last_values(staged(checked)), tmp_path, "update")
    got = {}
    for r in spark.sql("SELECT * FROM out").collect():
        got[r.vehicle, r.field] = (r.ord, r.value)
    want = {(r.vehicle, r.field): r.value for r in tools.state(checked.withColumn("accepted", F.lit(True))).collect()}
    assert {k: v for k, (_, v) in got.items()} == want


def test_memories(spark, staged, tmp_path):
    writes = v_mem(spark, SF)
    table = stateful.MemoryTable(spark, str(tmp_path / "memories"))
    seen = []

    def each(batch, number):
        table.merge(batch, number)
        table.merge(batch, number)  # a batch that runs again
        seen.append(number)

    run(staged(writes), tmp_path, each=each)
    assert len(seen) > 1
    columns = [*memory.KEY, "value_text", "confidence"]
    got = sorted(map(str, table.read().select(*columns, F.date_format("created_at", "yyyyMMddHHmmss").alias("c")).collect()))
    want = memory.upsert(writes).select(*columns, F.date_format("created_at", "yyyyMMddHHmmss").alias("c"))
    assert got == sorted(map(str, want.collect()))
    few = v_mem(spark, SF).limit(1).withColumn("ts", F.lit("2030-01-01 00:00:00").cast("timestamp"))
    n = table.ledger.latest() + 1
    assert table.merge(few, 0, "a stream with a new checkpoint") and not table.merge(few, 0, "a stream with a new checkpoint")
    assert len(list((tmp_path / "memories" / "data" / f"version={n}").glob("bucket=*"))) == 1  # only the bucket of that user is written
    assert table.read().count() == len(got) and len(list((tmp_path / "memories" / "data").glob("version=*/bucket=*"))) <= 2 * table.buckets


def test_samples(spark, staged, tmp_path):
    values = by_time(v_frame(spark, SF).select((F.col("k") % 5).alias("prop"), F.lit(0).alias("area_id"), "ts", "ord", F.col("k").cast("double").alias("value")))
    run(stateful.sampled(staged(values), "30 seconds"), tmp_path)
    got = {tuple(r) for r in spark.sql("SELECT prop, slot, ord FROM out").collect()}
    closed = values.agg(F.max("ts")).first()[0] - timedelta(seconds=60)
    want = {tuple(r) for r in properties.sampled(values, "30 seconds").select("prop", "slot", "ord").collect()}
    assert got and got == {r for r in want if r[1] + timedelta(seconds=30) <= closed}


@pytest.fixture()
def mixed_up(spark, tmp_path):
    """A table whose rows come up to 20 places late, in several micro-batches, and its stream."""

    def stage(df, parts=4):
        last = df.agg(F.max("ord")).first()[0]
        part = F.floor((F.col("ord") + F.pmod(F.xxhash64("ord"), F.lit(20))) * parts / (last + 21))
        for k in range(parts):
            df.filter(part == k).orderBy(F.xxhash64(F.lit(1), "ord")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return stateful.files(spark, str(tmp_path / "in"), ", ".join(f"{c} {t}" for c, t in df.dtypes))

    return stage


def passed(rows, column, seconds):
    """The rows that the watermark has surely passed."""
    return rows.agg(F.max(column)).first()[0] - timedelta(seconds=seconds)


def test_scene_changes_out_of_order(spark, mixed_up, tmp_path):
    frames = by_time(v_frame(spark, SF)).withColumn("stream_id", F.col("stream_id") % 5).withColumn("reset", F.col("k") < 20).drop("k")
    run(stateful.scene_changes(mixed_up(frames), "30 seconds"), tmp_path)
    got = {tuple(r) for r in spark.sql("SELECT stream_id, ord, name FROM out").collect()}
    want = scenes.changes(frames, F.col("reset")).filter(F.col("ts") < passed(frames, "ts", 31)).select("stream_id", "ord", "name")
    late = {tuple(r) for r in scenes.changes(frames, F.col("reset")).select("stream_id", "ord", "name").collect()}
    want = {tuple(r) for r in want.collect()}
    assert len(want) > 100 and want <= got <= late


def test_first_responses_out_of_order(spark, mixed_up, tmp_path):
    r = by_time(v_frame(spark, SF)).select((F.col("ord") / 3).cast("long").cast("string").alias("request_id"), F.col("ts").alias("arrival"), "ord", F.col("name").alias("text"))
    run(stateful.first_responses(mixed_up(r), "30 seconds"), tmp_path)
    rows = spark.sql("SELECT request_id, arrival, ord, text FROM out").collect()
    got, end = {tuple(x) for x in rows}, passed(r, "arrival", 31)
    want = {tuple(x) for x in requests.first_response(r, "text").select("request_id", "arrival", "ord", "text").collect()}
    assert len(rows) == len(got) and got <= want and {x for x in want if x[1] < end} <= got and len(got) > 100


def test_answers_with_timeouts(spark, mixed_up, tmp_path):
    """Every third row asks; its answers are the next two, some of them over 15 s later."""
    f = by_time(v_frame(spark, SF))
    request = F.floor(F.col("ord") / 3)
    shift = F.when((F.col("ord") % 3 > 0) & (request % 4 == 0), 16).otherwise(0)
    rows = f.select(request.cast("string").alias("request_id"), F.when(F.col("ord") % 3 == 0, "request").otherwise("response").alias("kind"), F.timestamp_seconds(F.col("ord") + 1000 + shift).alias("ts"), "ord", F.col("name").alias("text"))
    run(stateful.answers(mixed_up(rows), "60 seconds"), tmp_path)
    got = {tuple(x) for x in spark.sql("SELECT request_id, ts, text, error_type FROM out").collect()}
    asked = rows.filter("kind = 'request'").select("request_id", F.col("ts").alias("enqueued"))
    want = requests.answered(asked, rows.filter("kind = 'response'").withColumnRenamed("ts", "arrival"))
    want = {tuple(x) for x in want.select("request_id", "ts", "text", "error_type").collect()}
    end = passed(rows, "ts", 80)
    assert {x for x in want if x[1] < end} <= got <= want and sum(x[3] == "TIMEOUT" for x in got) > 20 and sum(x[3] is None for x in got) > 50


def test_captures(spark, tmp_path):
    q = stateful.captures(spark, 50, 0).writeStream.format("memory").queryName("ticks").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        until = time.time() + 30
        while time.time() < until and spark.sql("SELECT count(*) FROM ticks").first()[0] < 10:
            time.sleep(0.5)
    finally:
        q.stop()
    nth = sorted(r.nth for r in spark.sql("SELECT nth FROM ticks").collect())
    assert len(nth) >= 10 and nth == list(range(len(nth)))
