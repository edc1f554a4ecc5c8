"""Sources, sinks and model calls."""

import base64

from pyspark.sql import functions as F

from turnstone import models
from turnstone.functions import text
from turnstone.operators import memory, requests, scenes, sessions, spans, tools
from turnstone.sources import tables


def test_templates_and_images(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "vehicle_status.txt").write_text("车辆状态：{{vehicle_status}}\nline two", encoding="utf-8")
    (tmp_path / "p" / "a.jpg").write_bytes(b"\xff\xd8\xff")
    got = tables.templates(spark, str(tmp_path / "p" / "*.txt")).first()
    assert got.template == "vehicle_status" and got.body.endswith("line two")
    image = tables.images(spark, str(tmp_path / "p" / "*.jpg")).first()
    assert base64.b64decode(image["base64"]) == bytes(image.content) == b"\xff\xd8\xff"


def test_broken_message_lists_give_no_rows(spark):
    df = spark.createDataFrame([(1, '[{"type":"user","text":"a"},{"type":"ai"}]'), (2, "broken"), (3, None)], "memory_id long, messages_json string")
    assert [(r.memory_id, r.seq, r.type) for r in tables.packed_messages(df).orderBy("seq").collect()] == [(1, 0, "user"), (1, 1, "ai")]


def test_model_calls(spark):
    def caller(prompts):
        if any("fail" in p for p in prompts):
            raise RuntimeError("no network")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "abc")], "id long, prompt string")
    assert models.called(df, caller).first().answer == "ABC"
    assert models.called(df.withColumn("prompt", F.lit("fail")), caller).first().answer is None


def test_upsert_is_idempotent_and_latest_wins(spark):
    rows = [("u", "preference", "t", "24", 0.9, 1, 1), ("u", "preference", "t", "25", 0.3, 2, 2), ("u", "odd", "t", "x", 0.5, 1, 3)]
    w = spark.createDataFrame(rows, "user_id string, category string, key_text string, value_text string, confidence double, ts long, ord long")
    once = sorted(map(str, memory.upsert(w).collect()))
    assert once == sorted(map(str, memory.upsert(w.unionByName(w)).collect())) and len(once) == 2
    best = memory.top_per_user(memory.upsert(w))
    assert [r.value_text for r in best.orderBy("rank").collect()] == ["x", "25"]
    assert memory.prompt_text(best).first().prompt_text == "\n\n【长期记忆】\n已知事实：\n  · x\n用户偏好："
    assert memory.prompt_text(best.limit(0)).count() == 0


def test_tombstones_of_a_key_and_of_a_user(spark):
    schema = "user_id string, key_text string, ts long, ord long"
    w = spark.createDataFrame([("u", "a", 1, 1, "1"), ("u", "b", 5, 5, "2"), ("v", "a", 1, 2, "3")], schema + ", value_text string")
    gone = spark.createDataFrame([("u", None, 3, 3), ("v", "a", 1, 1)], schema)
    assert sorted((r.user_id, r.key_text) for r in memory.surviving(w, gone).collect()) == [("u", "b"), ("v", "a")]


def test_session_rules(spark):
    e = spark.createDataFrame([("u", "s", "end", 0, 0), ("u", "s", "create", 1, 1), ("u", "s", "create", 2, 2), ("u", "t", "create", 3, 3), ("u", "t", "end", 4, 4), ("u", "x", "end", 5, 5)], "user_id string, session_id string, action string, ts long, ord long")
    life = {r.session_id: r for r in sessions.lifecycle(e).collect()}
    assert set(life) == {"s", "t"} and life["s"].is_active and life["s"].created_at == 1 and not life["t"].is_active
    assert sessions.latest_active(sessions.lifecycle(e)).first().session_id == "s"


def test_run_outcomes(spark):
    rows = [("ok", 0, 0.0, 1, False), ("ok", 1, 1.0, 0, False), ("late", 0, 0.0, 1, False), ("late", 1, 31.0, 0, False), ("veto", 0, 0.0, 2, True), *[("max", k, 0.0, 1, False) for k in range(3)], ("on", 0, 0.0, 1, False)]
    df = spark.createDataFrame(rows, "run_id string, iteration long, start_s double, n_calls int, all_vetoed boolean")
    got = {r.run_id: (r.iterations_used, r.outcome) for r in requests.outcomes(df, 3, 30).collect()}
    assert got == {"ok": (2, "SUCCESS"), "late": (1, "TIMEOUT"), "veto": (1, "SUCCESS"), "max": (3, "MAX_ITERATIONS_REACHED"), "on": (1, "RUNNING")}


def test_spans_are_written_and_maps_merge_to_the_right(spark, tmp_path):
    r = spark.createDataFrame([("q", "s", "app", "TEXT", "chat", None, "手机号 13812345678")], "request_id string, session_id string, source_app string, input_type string, persona string, user_id string, text string")
    span = spans.request_span(r)
    spans.exported(span, str(tmp_path / "spans"))
    attrs = spark.read.parquet(str(tmp_path / "spans")).first().attrs
    assert attrs["user.input"] == "手机号 138****5678" and attrs["user.input.length"] == "15" and "user.input" not in spans.request_span(r, "OFF").first().attrs
    assert attrs["agent.persona"] == "chat" and "user.id" not in attrs
    silent = spans.request_span(r.withColumn("text", F.lit(None).cast("string")).withColumn("user_id", F.lit("u"))).first().attrs
    assert silent["user.input.length"] == "0" and "user.input" not in silent and silent["user.id"] == "u"
    m = spark.range(1).select(spans.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("a"), F.lit(3))).alias("m")).first().m
    assert m == {"a": 3, "b": 2}


def test_scene_tools(spark):
    rules, allowed = tools.registry(spark), scenes.whitelist(spark)
    assert [r.name for r in scenes.tools_of(rules, allowed, "雨雪天气").collect()] == ["set_window_f_defrosting"]
    assert scenes.tools_of(rules, allowed, "驾驶员疲劳").count() == scenes.tools_of(rules, allowed, "其他").count() == 0
    assert scenes.missing_tools(allowed, rules).count() == 33
    assert scenes.optional_subset(rules, None).count() == 47 and scenes.optional_subset(rules, []).count() == 0


def test_texts(spark):
    assert spark.range(1).select(text.with_vision_warning(F.lit("x")).alias("t")).first().t.startswith("x（")
    assert spark.range(1).select(text.elapsed_ms(F.lit(1), F.lit(2_999_999)).alias("t")).first().t == 2


def test_documents_and_replaced_lists(spark, tmp_path):
    from turnstone.streaming.stateful import MessageTable

    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "a.txt").write_text("你好\nb")
    (tmp_path / "docs" / "sub" / "c.md").write_text("")
    got = {r.document: r.body for r in tables.documents_at(spark, str(tmp_path / "docs")).collect()}
    assert got["a.txt"] == "你好\nb" and got.get("c.md", "") == ""

    table = MessageTable(spark, str(tmp_path / "lists"), 4)
    write = lambda rows, n: table.merge(spark.createDataFrame(rows, "memory_id string, messages_json string, ord long"), n)
    write([("a", "[1]", 1), ("b", "[2]", 1), ("a", "[3]", 2)], 0)
    write([("b", "[4]", 1), ("c", "[5]", 1)], 1)
    write([("b", "[4]", 1), ("c", "[5]", 1)], 1)  # again
    assert sorted((r.memory_id, r.messages_json) for r in table.read().collect()) == [("a", "[3]"), ("b", "[4]"), ("c", "[5]")]


def test_spans_are_written_in_batches(spark, tmp_path):
    from turnstone.streaming import stateful

    spark.range(200).selectExpr("cast(id as string) AS span_id", "'x' AS name").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stateful.files(spark, str(tmp_path / "in"), "span_id string, name string")
    stateful.exported(stream, str(tmp_path / "out"), str(tmp_path / "c"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200 and len(list((tmp_path / "out").glob("part-*"))) == 4
