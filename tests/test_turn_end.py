"""The end of turns: two tables that count together, exact when a batch fails in between and runs again."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from turnstone.operators import memory, messages
from turnstone.streaming.stateful import BucketTable, MessageTable, TurnEnd

RULE = messages.Compaction(tokens=10, messages=4, keep=2)
TURNS = "turn_id long, user_id string, memory_id string, ts timestamp, ord long, user_message string, ai_response string, messages_json string"


def turn(n, user, memory_id, said, n_messages, text="12345678"):
    listed = [{"type": "system", "text": "s"}] + [{"type": "user" if k % 2 else "ai", "text": f"{text}{k}"} for k in range(n_messages - 1)]
    return (n, user, memory_id, datetime(2024, 1, 1) + timedelta(seconds=n), n, said, "ok", json.dumps(listed))


BATCHES = [
    [turn(1, "u", "m1", "[{key:a, value:1}]", 3), turn(2, "v", "m2", "nothing", 9), turn(3, "u", "m1", "", 6)],
    [turn(4, "u", "m1", "[{key:a, value:2}, {key:b, value:3}]", 8), turn(5, "w", None, "[{key:c, value:4}]", 3)],
    [turn(6, "v", "m2", "[{'key':'d','value':'5'}]", 5, "x"), turn(7, "u", "m3", None, 9), turn(8, "u", "m3", "[]", 9, "blank")],
]


def made(spark, path):
    asked = []
    extract = lambda t: (asked.append([r.turn_id for r in t.collect()]), t.select("turn_id", F.col("user_message").alias("model_output")))[1]
    summarise = lambda p: p.select("memory_id", F.when(F.contains("summary_lines", F.lit("blank")), " ").otherwise(F.concat(F.lit("about "), F.length("summary_lines").cast("string"))).alias("summary"))
    return TurnEnd(spark, str(path), extract, summarise, RULE, buckets=4), asked


def batch(spark, k):
    return spark.createDataFrame(BATCHES[k], TURNS)


def state(end):
    m, lists = end.memories.read(), end.lists.read()
    rows = sorted((r.user_id, r.key_text, r.value_text, r.created_at, r.updated_at) for r in m.collect()) if m is not None else []
    return rows, sorted((r.memory_id, r.messages_json) for r in lists.collect()) if lists is not None else []


def test_turns_in_batches(spark, tmp_path):
    end, asked = made(spark, tmp_path / "t")
    for k in range(3):
        assert end.merge(batch(spark, k), k, "s")
    memories, lists = state(end)
    every = spark.createDataFrame([r for b in BATCHES for r in b], TURNS)
    answers = every.select("turn_id", F.col("user_message").alias("model_output"))
    want = memory.upsert(memory.extracted(every, answers))
    assert memories == sorted((r.user_id, r.key_text, r.value_text, r.created_at, r.updated_at) for r in want.collect())
    assert [r[:3] for r in memories] == [("u", "a", "2"), ("u", "b", "3"), ("v", "d", "5"), ("w", "c", "4")]
    assert asked == [[1, 2], [4, 5], [6, 8]]  # without a user's message there is no call
    got = {m: [(x["type"], x["text"]) for x in json.loads(j)] for m, j in lists}
    # m2: last compacted in the first batch, since short; m3: a blank summary leaves it as it is, nothing to write
    assert set(got) == {"m1", "m2"} and got["m1"][0] == ("system", "s") and got["m1"][1][1].startswith("【对话摘要】about ") and got["m1"][2:] == [("user", "123456785"), ("ai", "123456786")]


@pytest.mark.parametrize("where", ["between the tables", "before the record"])
def test_a_failure_in_between(spark, tmp_path, monkeypatch, where):
    clean, _ = made(spark, tmp_path / "clean")
    end, _ = made(spark, tmp_path / "t")
    for k in range(3):
        assert clean.merge(batch(spark, k), k, "s")
        seen = state(end)
        with monkeypatch.context() as m:
            if where == "between the tables":
                m.setattr(MessageTable, "stage", lambda *a: (_ for _ in ()).throw(OSError("lost")))
            else:
                m.setattr(end.ledger, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                end.merge(batch(spark, k), k, "s")
        assert state(end) == seen  # neither table shows half a batch
        assert end.merge(batch(spark, k), k, "s") and not end.merge(batch(spark, k), k, "s")
    assert state(end) == state(clean)


def test_a_stream_that_starts_anew_keeps_the_tables(spark, tmp_path):
    class Kept(BucketTable):
        def merged(self, old, new):
            return old.unionByName(new)

    table = Kept(spark, str(tmp_path / "k"), 3)
    write = lambda keys, n, stream: table.merge(spark.createDataFrame([(k,) for k in keys], "key long"), n, stream)
    assert write([1, 2], 0, "a") and write([3], 1, "a") and not write([3], 1, "a")
    assert write([4], 0, "b") and not write([4], 0, "b") and write([5], 2, "a")
    assert sorted(r.key for r in table.read().collect()) == [1, 2, 3, 4, 5]


def test_as_a_stream_with_two_checkpoints(spark, tmp_path):
    end, _ = made(spark, tmp_path / "t")
    for k in range(3):
        batch(spark, k).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    for part, inputs in (("one", (0, 1)), ("two", (2,))):
        for k in inputs:
            stream = spark.readStream.schema(TURNS).parquet(str(tmp_path / f"in{k}"))
            stream.writeStream.option("checkpointLocation", str(tmp_path / f"{part}{k}")).trigger(availableNow=True).foreachBatch(lambda b, n: end.merge(b, n) and None).start().awaitTermination()
    clean, _ = made(spark, tmp_path / "clean")
    for k in range(3):
        clean.merge(batch(spark, k), k, "s")
    assert state(end) == state(clean)
