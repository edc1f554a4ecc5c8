"""Literal cases of what the operators must give."""

import pytest
from pyspark.sql import functions as F

from turnstone.functions import jsonx, props, text
from turnstone.operators import messages, requests, scenes, spans, tools


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("given, want", [("请联系 13812345678 确认行程", "请联系 138****5678 确认行程"), ("+8613812345678", "+86138****5678"), ("9913812345678", "99138****5678"), ("12012345678", "12012345678"), (None, None), ("", "")])
def test_phones(spark, given, want):
    assert one(spark, text.redact_user_input(F.lit(given).cast("string"))) == want


def test_limits(spark):
    assert one(spark, text.redact_user_input(F.lit("a" * 520))) == "a" * 500 + "… (truncated)"
    assert one(spark, text.redact_user_input(F.lit("a" * 500))) == "a" * 500
    image = '{"image":"data:image/png;base64,iVBOR' + "A" * 260 + "13812345678" + '"}'
    assert one(spark, text.redact_arguments(F.lit(image))) == image[:100] + "… (base64 truncated)"
    assert one(spark, text.redact_arguments(F.lit('{"phone":"13812345678"}'))) == '{"phone":"138****5678"}'
    assert one(spark, text.cut_format(F.lit("a" * 120), 40)) == "a" * 40 + "... (truncated)"
    assert one(spark, text.cut_format(F.lit("a" * 30), 5)) == "a" * 20 + "... (truncated)"


@pytest.mark.parametrize("mode, want", [("OFF", None), ("REDACTED", "手机号 138****5678"), ("FULL_DEBUG", "手机号 13812345678")])
def test_capture_modes(spark, mode, want):
    assert one(spark, text.captured(F.lit("手机号 13812345678"), F.lit("text"), F.lit(mode))) == want


def test_formats(spark):
    f = lambda k, t, n=None, c=None: one(spark, text.format_message(F.lit(k), F.lit(t), F.lit(n), F.array(*map(F.lit, c or [])).cast("array<string>")))
    assert f("system", "你是车机助手") == "system:你是车机助手" and f("user", "打开空调") == "user:打开空调"
    assert f("ai", "空调已打开") == "assistant:空调已打开" and f("ai", "x", None, ["a", "b"]) == "assistant_tool_calls:a, b"
    assert f("tool", "温度已设置为 24 度", "set_ac_temperature") == "tool:set_ac_temperature:温度已设置为 24 度"
    s = lambda k, t, n=None, c=None: one(spark, text.summary_line(F.lit(k), F.lit(t).cast("string"), F.lit(n), F.array(*map(F.lit, c or [])).cast("array<string>")))
    assert s("user", "好") == "用户：好" and s("ai", "好", None, ["a"]) == "AI：好" and s("ai", "", None, ["a", "b"]) == "AI：调用了工具 a"
    assert s("tool", "r" * 81, "t") == "工具[t]：" + "r" * 80 + "…" and s("system", "x") is None


CASES = [
    ('[{"category":"preference","key":"temperature","value":"24 度","confidence":0.9}]', [("preference", "temperature", "24 度", 0.9)]),
    ('```json\n[{"key":"a","value":1}]\n```', [("fact", "a", "1", 0.5)]), ("不是 JSON", []), ('{"key":"a","value":"b"}', []), ("[1, 2", []), (None, []),
    ('[7, null, "x", {"key":"a","value":{"b":1}}, {"category":"rule","key":"k","value":"v","confidence":"0.31"}]', [("rule", "k", "v", 0.31)]),
    ('[{"key":"a","value":"b","confidence":0.29}, {"category":"Rule","key":"a","value":"b","confidence":"abc"}]', [("fact", "a", "b", 0.5)]),
    # lenient
    ("[{key:a,value:b}]", [("fact", "a", "b", 0.5)]), ("[{'key':'a\\'s';\"value\"=>\"b\"},]", [("fact", "a's", "b", 0.5)]), ("// x\n[{key:a /*y*/, value=b}] # z", [("fact", "a", "b", 0.5)]),
    ("[{1:2, key:a, value:b}]", [("fact", "a", "b", 0.5)]), ("[{key:a, value:b}] tail", []), ("[{key:a, value:b,}]", []), ("[,{key:a, value:TRUE}]", [("fact", "a", "true", 0.5)]),
    ("[{key:a, value:010}, {key:b, value:1.50}, {key:c, value:1e3}, {key:d, value:12345678901234567890}]", [("fact", "a", "010", 0.5), ("fact", "b", "1.50", 0.5), ("fact", "c", "1e3", 0.5), ("fact", "d", "12345678901234567890", 0.5)]),
    ("[{key:a, value:b, confidence:NaN}, {key:c, value:d, confidence:Infinity}]", [("fact", "c", "d", float("inf"))]), ('[{"key":"a","value":"x\ny \\" z"}]', [("fact", "a", 'x\ny " z', 0.5)]),
    # arrays as values
    ('[{"key":"a","value":[1,2]}, {"key":"b","value":["x"]}, {"key":["c"],"category":["rule"],"value":[["y"]],"confidence":["0.9"]}, {"key":"d","value":[]}, {"key":"e","value":[null]}, {"key":"f","value":[{}]}, {"key":"g","value":"[1]"}]',
     [("fact", "b", "x", 0.5), ("rule", "c", "y", 0.9), ("fact", "g", "[1]", 0.5)]),
]


def test_candidates(spark):
    df = spark.createDataFrame([(k, given) for k, (given, _) in enumerate(CASES)], "id int, model_output string")
    got = [[] for _ in CASES]
    for r in jsonx.candidates(df).orderBy("id", "pos").collect():
        got[r.id].append(tuple(r)[2:])
    for (given, want), found in zip(CASES, got, strict=True):
        assert found == want, given


def test_arguments_and_speed(spark):
    assert one(spark, jsonx.int_argument(jsonx.parsed(F.lit('{"arg0": "25"}')))) == 25 and one(spark, jsonx.bool_argument(jsonx.parsed(F.lit('{"arg0": "true"}')))) is True
    assert one(spark, jsonx.missing_argument(jsonx.parsed(F.lit("{}")), F.lit("m"))) == "缺少参数: arg0 (方法: m)" and one(spark, jsonx.missing_argument(jsonx.parsed(F.lit("broken")), F.lit("m"))) is not None
    assert one(spark, jsonx.speed(F.lit('{"车速":60}'))) == 60 and one(spark, jsonx.speed(F.lit("broken"))) == 0
    assert one(spark, jsonx.scene(F.lit("broken"))).name == "其他"


def test_render_is_sequential(spark):
    out = one(spark, text.render(F.lit("{{a}}-{{b}}-{{a}}"), {"a": F.lit("x{{b}}"), "b": F.lit("y")}))
    assert out == "xy-y-xy"
    assert one(spark, text.missing_placeholders(F.lit("{{a}} {{c}}"), ["a"])) == ["c"]


def test_property_bits(spark):
    assert one(spark, props.decode(F.lit(291504647))).asDict() == {"group": "SYSTEM", "area": "GLOBAL", "type": "FLOAT", "number": 0x0207}
    assert one(spark, props.decode(F.lit(0x21400170))).asDict() == {"group": "VENDOR", "area": "GLOBAL", "type": "INT32", "number": 0x0170}


def _dialog(n, extra=()):
    rows = [("c", 0, "system", "sys")]
    for i in range(n):
        rows += [("c", 2 * i + 1, "user", f"第 {i} 轮消息，手机号 13812345678"), ("c", 2 * i + 2, "ai", f"第 {i} 轮回答")]
    return rows + list(extra)


def test_compaction(spark):
    schema = "memory_id string, seq long, type string, text string"
    small = spark.createDataFrame(_dialog(1), schema)
    assert not messages.plan(small).first().compact
    rows = spark.createDataFrame(_dialog(8), schema)
    rule = messages.Compaction(tokens=100)
    plan = messages.plan(rows, rule)
    p = plan.first()
    assert p.compact and p.n_region == 6 and p.n_kept == 10 and "用户：第 0 轮消息" in p.summary_lines
    said = lambda s: plan.select("memory_id", F.lit(s).cast("string").alias("summary"))
    out = messages.compacted(rows, plan, said("用户喜欢 24 度空调"), rule).orderBy("pos").collect()
    assert len(out) == 12 and [r.text for r in out[:2]] == ["sys", "【对话摘要】用户喜欢 24 度空调"] and out[1].type == "user"
    for s in ("   ", None):
        assert messages.compacted(rows, plan, said(s), rule).count() == 17
    assert not messages.plan(rows).first().compact  # 4000 tokens are not reached
    asked = rows.withColumn("calls", F.when(F.col("seq") == 6, F.array(F.lit("t"))))
    assert not messages.plan(asked, rule, "calls").first().compact


def test_window_keeps_the_system_row_inside_the_budget(spark):
    rows = spark.createDataFrame([(*r, None) for r in _dialog(3)] + [("c", 7, "tool", "late", "gone"), ("c", 8, "ai", "x", "k"), ("c", 9, "tool", "r", "k")], "memory_id string, seq long, type string, text string, call_id string")
    assert [r.seq for r in messages.window_last(rows.drop("call_id"), 4).orderBy("seq").collect()] == [0, 7, 8, 9]
    assert [r.seq for r in messages.window_last(rows, 4).orderBy("seq").collect()] == [0, 8, 9]


def test_tool_cases(spark):
    calls = [("v", 1, "set_ac_drive_temp", '{"arg0": 22}'), ("v", 2, "set_ac_drive_temp", '{"arg0": 45}'), ("v", 3, "set_door_lock", '{"arg0": false}'), ("v", 4, "set_vehicle_spd", '{"arg0": 5}'), ("v", 5, "set_door_lock", '{"arg0": false}'), ("v", 6, "set_door_lock", "{}"), ("v", 7, "nothing", "{}")]
    df = spark.createDataFrame(calls, "vehicle string, ord long, name string, arguments string").withColumn("ts", F.col("ord").cast("timestamp"))
    from turnstone.operators import safety

    rules = tools.registry(spark)
    out = {r.ord: r for r in safety.guarded(df, rules).collect()}
    assert out[1].accepted and not out[2].accepted and out[2].success and not out[2].vetoed
    assert out[3].vetoed and not out[3].success and "70 km/h" in out[3].output and out[3].output.startswith("[SAFETY VETO] ")
    assert out[5].accepted and not out[6].vetoed and out[7].output == "无效的工具调用: nothing"
    state = {r.field: r.value for r in tools.state(safety.guarded(df, rules), df.select("vehicle").distinct()).collect()}
    assert len(state) == 45 and state["主驾侧温度（摄氏度）"] == "22" and state["车速"] == "5" and state["车门闭锁"] == "false"
    assert len(tools.RULES) == 47 and sum(map(len, tools.SNAPSHOTS.values())) == 49


def test_first_response_and_scenes(spark):
    r = spark.createDataFrame([("q", 15.0, 1, "TIMEOUT"), ("q", 16.0, 2, "late answer")], "request_id string, arrival double, ord int, text string")
    assert requests.first_response(r, "text").first().text == "TIMEOUT"
    frames = lambda names: spark.createDataFrame([(1, k, k, n) for k, n in enumerate(names)], "stream_id long, ts long, ord long, name string")
    a, b = scenes.SCENES[:2]
    assert scenes.changes(frames([a, "其他", "", a])).count() == 1 and scenes.changes(frames([a, b, a])).count() == 3
    assert scenes.changes(frames([a, a, a]), F.col("ord") == 0).count() == 2


def test_null_attributes_are_skipped(spark):
    assert one(spark, spans.attributes(a__b=F.lit(1), c=F.lit(None).cast("string"))) == {"a.b": "1"}


def test_personas():
    import pytest

    from turnstone.operators import personas

    chat, scene, vision = (personas.PERSONAS[k] for k in ("chat", "scene", "vision_qa"))
    assert (chat.iterations, chat.window, chat.timeout_s, chat.tools, chat.ends_on) == (10, 50, 30, None, ("no_calls", "vetoed"))
    assert (scene.iterations, scene.timeout_s, scene.memory, scene.model) == (2, 20, "EPHEMERAL", "qwen-flash")
    assert (vision.iterations, vision.window, vision.memory, vision.tools, vision.before) == (1, 2, "NONE", "none", ())
    assert personas.Persona("x", "p", "").model == "unknown"
    for bad in ({"name": "", "prompt": "p"}, {"name": "x", "prompt": ""}, {"name": "x", "prompt": "p", "ends_on": ()}):
        with pytest.raises(ValueError):
            personas.Persona(**bad)


def test_a_turn_without_a_message_is_not_extracted(spark):
    from turnstone.operators import memory, safety

    turns = spark.createDataFrame([(1, "u", "", 1), (2, "u", None, 2), (3, "u", "暖一点", 3)], "turn_id long, user_id string, user_message string, ts long")
    said = spark.createDataFrame([(k, f'[{{"category":"preference","key":"temperature","value":"{k}","confidence":0.9}}]') for k in (1, 2, 3)], "turn_id long, model_output string")
    assert [(r.value_text, r.ord.turn_id) for r in memory.extracted(turns, said).collect()] == [("3", 3)]
    rows = spark.createDataFrame(_dialog(8), "memory_id string, seq long, type string, text string")
    summary = spark.createDataFrame([("c", "s")], "memory_id string, summary string")
    stored, after = memory.turn_completed(turns, said, rows, summary, messages.Compaction(tokens=100))
    assert stored.count() == 1 and after.count() == 12
    assert one(spark, safety.chain(safety.allow_all(), F.lit("no"))) == "no"


def test_listeners_beyond_the_broadcast_bound(spark):
    when = lambda x: F.col(x).cast("timestamp_ntz")
    who = spark.createDataFrame([("a", "2024-01-01 10:00:00", None), ("b", "2024-01-02", "2024-01-02 12:00:00"), ("c", "2025-01-01", None), ("d", "2024-01-03", "2024-01-02")], "listener string, since string, until string").withColumns({c: when(c) for c in ("since", "until")})
    r = spark.createDataFrame([(1, "2024-01-01 09:00:00"), (2, "2024-01-02 11:00:00"), (3, "2024-01-02 12:00:00"), (4, "2024-02-01")], "response long, arrival string").withColumn("arrival", when("arrival"))
    few, many = (sorted((x.response, x.listener) for x in requests.fan_out(r, who, most).collect()) for most in (10, 2))
    assert few == many == [(2, "a"), (2, "b"), (3, "a"), (4, "a")]
