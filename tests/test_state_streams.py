"""State kept by transformWithState: equal to the batch forms on rows that come shuffled and late."""

import random

import pytest
from pyspark.sql import functions as F

from turnstone.operators import safety, tools
from turnstone.sources.tables import v_tool
from turnstone.streaming import stateful

SF = "/root/testdata/sf0.001"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def staged(spark, path, rows, schema, batches):
    """rows by the number of the batch in which they come."""
    for k in range(max(batches) + 1):
        spark.createDataFrame([r for r, b in zip(rows, batches, strict=True) if b == k], schema).coalesce(1).write.parquet(f"{path}/{k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def run(stream, tmp_path, mode):
    got = []
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).foreachBatch(lambda b, n: got.extend(b.collect())).start()
    q.awaitTermination()
    return got


def test_vehicle_states(rocks, tmp_path):
    spark = rocks
    rng = random.Random(3)
    checked = tools.checked(tools.looked_up(v_tool(spark, SF), tools.registry(spark))).filter("accepted and field is not null and vehicle < 12")
    rows = [tuple(r) for r in checked.select("vehicle", "field", "value", F.col("ts").cast("timestamp").alias("ts"), "ord").collect()]
    rows += [r for r in rows if r[4] % 7 == 0]  # some come twice
    rng.shuffle(rows)
    schema = "vehicle long, field string, value string, ts timestamp, ord long"
    stream = staged(spark, str(tmp_path / "in"), rows, schema, [rng.randint(0, 3) for _ in rows])
    start = [(v, "底盘行驶模式", "越野模式") for v in range(12)]
    first = spark.createDataFrame(start, "vehicle long, field string, value string")
    got = {}
    for r in run(stateful.vehicle_states(stream, first), tmp_path, "update"):
        got[r.vehicle] = tuple(r)
    states = tools.state(spark.createDataFrame(rows, schema).withColumn("accepted", F.lit(True))).unionByName(first)
    want = {r.vehicle: tuple(r) for r in tools.snapshots(states).filter(F.col("vehicle").isin([r[0] for r in rows])).collect()}
    assert got == want and len(next(iter(want.values()))) == 9


def test_guarded_calls(rocks, tmp_path):
    """Calls and speeds in two streams, each up to a minute late; what the watermark hasn't passed isn't out yet."""
    spark = rocks
    rng = random.Random(4)
    calls, speeds = [], []
    for k in range(160):
        at = 1_700_000_000 + 5 * k
        if rng.random() < 0.5:
            calls.append((rng.randint(1, 3), at, k, "set_door_lock", rng.choice(["{arg0:false}", '{"arg0": "FALSE"}', "{}", "broken", '{"arg0": true}'])))
        else:
            speeds.append((rng.randint(1, 3), at, k, rng.choice([0, 5, 6, 80])))
    speeds.append((calls[0][0], calls[0][1], calls[0][2], 3))  # at the moment of a call: it counts
    late = lambda rows: [min(7, max(0, (r[1] - 1_700_000_000 + rng.randint(0, 55)) // 100)) for r in rows]
    end = (2, 1_700_000_000 + 5 * 160 + 3600, 999)
    call_in, speed_in = "vehicle long, s long, ord long, name string, arguments string", "vehicle long, s long, ord long, speed int"
    call_rows, speed_rows = [*calls, (*end, "set_ac_status", "{}")], [*speeds, (*end, 0)]
    a = staged(spark, str(tmp_path / "calls"), call_rows, call_in, [*late(calls), 8]).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    b = staged(spark, str(tmp_path / "speeds"), speed_rows, speed_in, [*late(speeds), 8]).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = run(stateful.guarded_calls(a, b, "3 minutes"), tmp_path, "append")
    batch = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s"))
    from turnstone.functions import jsonx

    joined = jsonx.once(tools.as_of(batch(calls, call_in), batch(speeds, speed_in), "speed", F.lit(safety.DEFAULT_SPEED)), "given", jsonx.parsed(F.col("arguments")))
    want = joined.withColumn("veto", safety.door_guard(F.col("name"), F.col("given"), F.col("speed"))).collect()
    assert sorted((r.vehicle, r.ord, r.speed, r.veto_reason, r.vetoed) for r in got) == sorted(((r.vehicle, r.ord, r.speed, r.veto, r.veto is not None) for r in want), key=lambda x: x[:2])
    assert any(r.vetoed for r in got) and any(not r.vetoed for r in got)
