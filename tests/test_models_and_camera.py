"""Model calls, the camera tool, frames, batches of spans, subscriptions."""

import base64
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from turnstone import models
from turnstone.operators import properties, spans, tools
from turnstone.sources import tables
from turnstone.streaming import stateful

T0 = datetime(2024, 1, 1)


def answering(log):
    """A caller that writes down what it is asked and fails on some prompts."""
    import json

    class NoNetwork(RuntimeError):
        pass

    def caller(prompts):
        with open(log, "a") as f:
            f.writelines(json.dumps(p) + "\n" for p in prompts)
        if any("fail" in p for p in prompts):
            raise NoNetwork("network down")
        return [p.upper() for p in prompts]

    return caller


def test_equal_prompts_are_called_once(spark, tmp_path):
    log = tmp_path / "asked"
    prompts = ["a", "b", "a", None, "fail 1", "a", "", "b", "c", "fail 1"] * 5
    df = spark.createDataFrame(list(enumerate(prompts)), "id long, prompt string").repartition(4)
    got = models.called(df, answering(log), batch=3)
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == len(prompts) and got.count() == len(prompts)
    for k, p in enumerate(prompts):
        failed = p is not None and "fail" in p
        assert rows[k].answer == (None if p is None or failed else p.upper())
        assert rows[k].error_message == ("network down" if failed else None) and (rows[k].error_class or "").endswith("NoNetwork" if failed else "")
        assert failed or rows[k].error_class is None
    asked = [json.loads(x) for x in log.read_text().splitlines()]
    assert set(asked) == {"a", "b", "c", "", "fail 1"} and all(asked.count(p) <= 2 for p in set(asked))  # twice only beside a failure
    span = spans.failed(got.withColumn("attrs", F.create_map(F.lit("a"), F.lit("1")))).filter("prompt = 'fail 1'").first()
    assert span.status == "ERROR" and span.status_text == "network down" and span.attrs["error.type"].endswith("NoNetwork")


def test_other_numbers_of_answers_are_errors(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string").coalesce(1)
    got = models.called(df, lambda ps: ps if len(ps) == 1 else ps[:1])
    assert sorted((r.prompt, r.answer) for r in got.collect()) == [("a", "a"), ("b", "b")]


def test_camera_tool(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    frames = spark.createDataFrame([(1, at(10), 1, "p1"), (1, at(20), 2, "p2"), (2, at(5), 3, "gone"), (3, at(1), 4, "p1")], "vehicle long, ts timestamp, ord long, path string")
    images = spark.createDataFrame([("p1", b"one"), ("p2", b"two"), ("default", b"car")], "path string, content binary")
    calls = [(1, at(5), 1, "what"), (1, at(10), 9, "what"), (1, at(19), 10, "what"), (1, at(30), 11, "what"), (2, at(9), 12, "what"), (3, at(9), 13, "what"), (4, at(0), 14, "fail"), (1, at(31), 15, None), (1, at(31), 16, "what")]
    df = spark.createDataFrame(calls, "vehicle long, ts timestamp, ord long, question string")
    log = tmp_path / "asked"
    got = {r.ord: r for r in tools.camera_answers(df, frames, images, lambda p: models.called(p, answering(log), batch=1), "default").collect()}
    said = lambda image, q="what": json.dumps({"question": q, "image": base64.b64encode(image).decode()}, separators=(",", ":")).upper()
    warning = spark.range(1).select(tools.text.with_vision_warning(F.lit("")).alias("w")).first().w
    assert got[1].output == said(b"car") + warning and got[9].output == got[10].output == got[13].output == said(b"one") + warning and got[11].output == got[16].output == said(b"two") + warning
    assert got[12].output == "" and got[14].output == "工具执行失败: network down" and got[14].error_class.endswith("NoNetwork")
    assert '"IMAGE"' in got[15].output and len(got) == len(calls)
    assert len(log.read_text().splitlines()) <= 6  # 5 different inputs, one again for its failure


def test_frames(spark, tmp_path):
    folder = tmp_path / "frames"
    folder.mkdir()
    for name, content in {"1_0.jpg": b"a", "2_3.jpeg": b"b", "x_1.jpg": b"no", "3.jpg": b"no", "notes.txt": b"no"}.items():
        (folder / name).write_bytes(content)
    want = {(1, 0, b"a"), (2, 3, b"b")}
    assert {(r.seqid, r.mode, bytes(r.content)) for r in tables.frames(spark, str(folder)).collect()} == want
    got = []
    for more in ({}, {"4_1.jpg": b"d"}, {}):
        for name, content in more.items():
            (folder / name).write_bytes(content)
        q = tables.frames(spark, str(folder), stream=True, per_trigger=1).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda b, n: got.extend(b.collect())).start()
        q.awaitTermination()
    assert sorted((r.seqid, r.mode, bytes(r.content)) for r in got) == sorted(want | {(4, 1, b"d")})  # each once over three runs


def test_span_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(5)
    rows, at = [], 0
    for k in range(400):
        at += rng.choice([0, 0, 1, 40, 300, 900]) if k < 300 else 2500
        rows.append((rng.randint(0, 1), T0 + timedelta(milliseconds=at), k, f"s{k}"))
    schema = "exporter long, ts timestamp, ord long, name string"
    end = [(e, T0 + timedelta(days=1), 1000 + e, "end") for e in (0, 1)]
    order = sorted(rows, key=lambda r: (r[1] + timedelta(seconds=rng.uniform(0, 20)), r[2]))
    for k in range(4):
        spark.createDataFrame(order[k * 100 : (k + 1) * 100], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    spark.createDataFrame(end, schema).coalesce(1).write.parquet(str(tmp_path / "in/9"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = []
    q = stateful.span_batches(stream, size=7, late="60 seconds").writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda b, n: got.extend(b.collect())).start()
    q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = []
    for e in (0, 1):
        first, n, batch = None, 0, 0
        for _, ts, k, name in sorted((r for r in rows if r[0] == e), key=lambda r: (r[1], r[2])):
            if first is None or n == 7 or ts >= first + timedelta(seconds=2):
                first, n, batch = ts, 0, batch + (first is not None)
            n += 1
            want.append((e, k, batch, name))
    assert sorted((r.exporter, r.ord, r.batch, r.name) for r in got) == sorted(want)


def test_subscriptions(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    told = [("c", 1, at(0), 0, None, 0.1, False), ("c", 1, at(35), 1, [2], 0.0, False), ("c", 1, at(50), 2, None, None, True), ("d", 1, at(0), 3, [1, 3], None, False), ("d", 2, at(0), 4, None, None, True)]
    registered = properties.subscriptions(spark.createDataFrame(told, "client string, prop int, ts timestamp, ord long, area_ids array<int>, rate double, off boolean"))
    values = spark.createDataFrame([(1, 1 + k % 2, at(3 * k), k, float(k)) for k in range(30)] + [(2, 1, at(1), 99, 1.0), (1, 1, at(200_000), 100, 9.0)], "prop int, area_id int, ts timestamp, ord long, value double")
    want = set()
    for area in (1, 2):
        for slot in range(4):
            mine = [k for k in range(30) if 1 + k % 2 == area and 10 * slot <= 3 * k < min(10 * slot + 10, 35)]
            want |= {("c", area, max(mine))} if mine else set()
    want |= {("c", 2, k) for k in range(30) if k % 2 and 35 <= 3 * k < 50} | {("d", 1, k) for k in range(30) if not k % 2} | {("d", 1, 100)}
    for most in (10_000, 1):  # broadcast, and by day
        assert {(r.client, r.area_id, r.ord) for r in properties.delivered(values, registered, most).collect()} == want


def test_answers_to_requests(spark):
    rows = [("c", 1, [5, 6], 1, 1), ("c", 1, [7], 2, 2), ("c", None, [8], 3, 3), ("c", 2, [], 4, 4), ("d", 1, None, 5, 5)]
    df = spark.createDataFrame(rows, "client string, request_id long, int_values array<int>, ts long, ord long")
    assert sorted(map(tuple, properties.by_request(df).collect()), key=str) == [("c", 1, 7), ("c", 2, None), ("d", 1, None)]
