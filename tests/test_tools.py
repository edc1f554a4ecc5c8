"""Literal expectations for every tool: one value that it takes and one that it rejects, and what it answers."""

import pytest
from pyspark.sql import functions as F

from turnstone.functions import jsonx
from turnstone.operators import safety, tools

ON_OFF = {
    "set_ac_status": "空调", "set_ac_eco_mode": "空调经济模式", "set_ac_anion_status": "负离子", "set_ac_drive_sweep_auto": "主驾自动扫风功能", "set_ac_assist_sweep_auto": "副驾自动扫风功能",
    "set_ac_drive_left_air_outlet": "主驾左侧出风口功能", "set_ac_drive_right_air_outlet": "主驾右侧出风口功能", "set_ac_assist_left_air_outlet": "副驾左侧出风口功能", "set_ac_assist_right_air_outlet": "副驾右侧出风口功能",
    "set_window_f_defrosting": "前风挡除霜", "set_window_r_heat": "后风挡加热", "set_mirror_l_heat": "左后视镜加热", "set_mirror_r_heat": "右后视镜加热", "set_no_window_opening_passengers": "乘员禁止开窗功能",
    "set_seat_fl_heat": "左前座椅加热", "set_seat_fr_heat": "右前座椅加热", "set_seat_rl_heat": "左后座椅加热", "set_seat_rr_heat": "右后座椅加热", "set_steering_heat": "方向盘加热",
}
PERCENT = {
    "set_fl_window_status": "左前车窗", "set_fr_window_status": "右前车窗", "set_rl_window_status": "左后车窗", "set_rr_window_status": "右后车窗", "set_top_window_status": "天窗", "set_sun_shadow_status": "遮阳帘",
    "set_seat_fl_air": "左前座椅通风", "set_seat_fr_air": "右前座椅通风", "set_seat_rl_air": "左后座椅通风", "set_seat_rr_air": "右后座椅通风",
}
#: tool, value taken, answer, value rejected, answer (beginning of it where a list of values follows)
OTHERS = [
    ("set_ac_drive_temp", 31, "主驾温度调节成功", 45, "主驾温度16-31摄氏度，当前值：45"), ("set_ac_assist_temp", 16, "副驾温度调节成功", 15, "副驾温度16-31摄氏度，当前值：15"), ("set_ac_fan_intensity", 7, "风量挡位调节成功", 0, "风量挡位1-7，当前值：0"),
    ("set_vehicle_spd", 240, "车速大小调节成功", -1, "车速范围0-240 km/h，当前值：-1"), ("set_door_lock", True, "车门闭锁成功", None, None),
    ("set_ac_clean_mode", "深度清洁", "空调干燥除味模式成功设置为：深度清洁", "x", "无效的干燥除味模式：x，可选："), ("set_ac_cyc_mode", "外循环", "空调内外循环模式成功设置为：外循环", "x", "无效的循环模式：x，可选："),
    ("set_ac_assist_air_outlet_mode", "One way", "副驾电动出风口模式：One way", "x", "无效的副驾出风口模式：x"), ("set_seat_massage_mode", "揉捏", "主驾座椅按摩模式成功设置为：揉捏", "x", "无效的按摩模式：x，可选："),
    ("set_seat_massage_intensity", "弱", "主驾座椅按摩强度成功设置为：弱", "x", "无效的按摩强度：x，可选："), ("set_chassis_mode", "雪地模式", "底盘行驶模式成功设置为：雪地模式", "x", "无效的底盘行驶模式：x，可选："),
    ("set_frag_type", "午夜橙香", "车载香氛类型成功设置为：午夜橙香", "x", "无效的香氛类型：x，可选："), ("set_frag_intensity", "高", "车载香氛强度成功设置为：高", "x", "无效的香氛强度：x，可选："),
    ("set_dms_drive_fatigue", "重度", "驾驶员疲劳等级成功设置为：重度", "x", "无效的疲劳等级：x，可选："), ("set_dms_drive_distractionlevel", "专注", "驾驶员分心等级成功设置为：专注", "x", "无效的分心等级：x，可选："),
    ("set_dms_drive_emotion", "愤怒", "驾驶员情绪成功设置为：愤怒", "x", "无效的情绪：x，可选："),
]


def run(spark, calls, doors=None):
    import json

    rows = [("v", k, name, given if isinstance(given, str) else json.dumps({"arg0": given[0]}, ensure_ascii=False)) for k, (name, given) in enumerate(calls)]
    df = spark.createDataFrame(rows, "vehicle string, ord long, name string, arguments string").withColumn("ts", F.col("ord").cast("timestamp"))
    return [r for r in safety.guarded(df, tools.registry(spark), doors).orderBy("ord").collect()]


def test_replies_of_all_tools(spark):
    want = [(t, v, f"{n}{'开启' if v else '关闭'}成功", True) for t, n in ON_OFF.items() for v in (True, False)]
    want += [(t, 100, f"{n}控制成功", True) for t, n in PERCENT.items()] + [(t, 101, f"{n}范围 0-100%，当前值：101", False) for t, n in PERCENT.items()]
    want += [(t, v, a, True) for t, v, a, _, _ in OTHERS] + [(t, v, a, False) for t, _, _, v, a in OTHERS if a]
    assert len({t for t, *_ in want}) == 45
    got = run(spark, [(t, (v,)) for t, v, _, _ in want])
    for (tool, value, answer, taken), r in zip(want, got):
        assert r.accepted == taken and r.success and not r.vetoed, (tool, value)
        assert r.output.startswith(answer) and (answer.endswith("可选：") or r.output == answer), (tool, value, r.output)
        if answer.endswith("可选："):
            allowed = next(x[5] for x in tools.RULES if x[0] == tool)
            assert sorted(r.output[len(answer) + 1 : -1].split(", ")) == sorted(allowed)


def test_order_of_listed_values():
    # strings of one letter hash to its code: slots 1, 2, 3 for a, b, c (97, 98, 99)
    assert tools._listed(["c", "a", "b"]) == "[a, b, c]" and tools._listed(["q", "a"]) == "[q, a]"


CASES = [
    # arguments, as int, as bool, error of an int tool, error of a bool tool
    ('{"arg0": 0}', 0, None, None, "Value 0 at arg0 of type java.lang.Integer cannot be converted to boolean"), ('{"arg0": 1}', 1, None, None, "Value 1 at arg0 of type java.lang.Integer cannot be converted to boolean"),
    ('{"arg0": "yes"}', None, None, "Value yes at arg0 of type java.lang.String cannot be converted to int", "Value yes at arg0 of type java.lang.String cannot be converted to boolean"),
    ('{"arg0": 22.7}', 22, None, None, "Value 22.7 at arg0 of type java.lang.Double cannot be converted to boolean"), ('{"arg0": -22.7}', -22, None, None, "Value -22.7 at arg0 of type java.lang.Double cannot be converted to boolean"),
    ('{"arg0": "25"}', 25, None, None, "Value 25 at arg0 of type java.lang.String cannot be converted to boolean"), ('{"arg0": "25.9"}', 25, None, None, "Value 25.9 at arg0 of type java.lang.String cannot be converted to boolean"),
    ('{"arg0": "TRUE"}', None, True, "Value TRUE at arg0 of type java.lang.String cannot be converted to int", None), ('{"arg0": false}', None, False, "Value false at arg0 of type java.lang.Boolean cannot be converted to int", None),
    ('{"arg0": null}', None, None, "Value null at arg0 of type org.json.JSONObject$1 cannot be converted to int", "Value null at arg0 of type org.json.JSONObject$1 cannot be converted to boolean"),
    ('{"arg0": [1]}', None, None, "Value [1] at arg0 of type org.json.JSONArray cannot be converted to int", "Value [1] at arg0 of type org.json.JSONArray cannot be converted to boolean"),
    ('{"arg0": 4294967297}', 1, None, None, "Value 4294967297 at arg0 of type java.lang.Long cannot be converted to boolean"), ('{"arg0": 1e300}', 2**31 - 1, None, None, None),
    ("{}", None, None, "缺少参数: arg0 (方法: setAcDriveTemp)", "缺少参数: arg0 (方法: setDoorLock)"), ('{"arg1": 1}', None, None, "缺少参数: arg0 (方法: setAcDriveTemp)", "缺少参数: arg0 (方法: setDoorLock)"),
    ("broken", None, None, "Value broken of type java.lang.String cannot be converted to JSONObject", "Value broken of type java.lang.String cannot be converted to JSONObject"),
    # as the device's lenient parser reads them
    ("{arg0:22}", 22, None, None, None), ("{'arg0':'true'}", None, True, None, None), ("{arg0=25}", 25, None, None, None), ('{arg0=>"25";b:c} tail}', 25, None, None, None), ("{arg0:0x1F}", 31, None, None, None), ("{arg0:010}", 8, None, None, None),
    ("{arg0:+5}", 5, None, None, None), ("{arg0:09}", 9, None, None, "Value 9.0 at arg0 of type java.lang.Double cannot be converted to boolean"), ("/* x */{arg0: TRUE # y\n}", None, True, None, None), ("{arg0:Null}", None, None, "Value null at arg0 of type org.json.JSONObject$1 cannot be converted to int", None),
    ("{arg0:yes}", None, None, "Value yes at arg0 of type java.lang.String cannot be converted to int", None), ("{arg0:[1,,'a']}", None, None, 'Value [1,null,"a"] at arg0 of type org.json.JSONArray cannot be converted to int', None),
    ("{arg0:NaN}", None, None, "Value {arg0:NaN} of type java.lang.String cannot be converted to JSONObject", None), ("{1:2}", None, None, "Value {1:2} of type java.lang.String cannot be converted to JSONObject", None), ("{arg0:1,}", None, None, "Value {arg0:1,} of type java.lang.String cannot be converted to JSONObject", None),
    ("", None, None, "End of input at character 0 of ", None), (" // x", None, None, "End of input at character 5 of  // x", None), ("5", None, None, "Value 5 of type java.lang.Integer cannot be converted to JSONObject", None), ("not json {", None, None, "Value not of type java.lang.String cannot be converted to JSONObject", None),
    ("null", None, None, "Value null of type org.json.JSONObject$1 cannot be converted to JSONObject", None), ("{'arg0':'\\x\\u0035'}", None, None, "Value x5 at arg0 of type java.lang.String cannot be converted to int", None),
    ("[1]", None, None, "Value [1] of type org.json.JSONArray cannot be converted to JSONObject", "Value [1] of type org.json.JSONArray cannot be converted to JSONObject"),
]


def test_arguments(spark):
    a = jsonx.parsed(F.col("given"))
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "k int, given string")
    read = df.select("k", jsonx.int_argument(a).alias("i"), jsonx.bool_argument(a).alias("b")).orderBy("k").collect()
    calls = run(spark, [(name, c[0]) for c in CASES for name in ("set_ac_drive_temp", "set_door_lock")])
    for r, (given, number, flag, int_error, bool_error) in zip(read, CASES, strict=True):
        assert (r.i, r.b) == (number, flag), given
        number_call, flag_call = calls[2 * r.k], calls[2 * r.k + 1]
        if int_error:
            assert number_call.output == "工具执行失败: " + int_error and not number_call.accepted and number_call.success, given
        if bool_error:
            assert flag_call.output == "工具执行失败: " + bool_error and not flag_call.vetoed, given
        assert flag_call.vetoed == (flag is False), given  # at 70 km/h, the default


def test_open_doors(spark):
    doors = spark.createDataFrame([("v", 1, "左前门开启", True), ("v", 3, "右前门开启", True), ("v", 5, "左前门开启", False), ("v", 7, "右前门开启", False), ("w", 0, "左前门开启", True)], "vehicle string, ord long, field string, open boolean").withColumn("ts", F.col("ord").cast("timestamp"))
    got = run(spark, [("set_door_lock", (True,)), ("set_ac_status", (True,)), ("set_door_lock", (True,)), ("set_ac_status", (True,)), ("set_vehicle_spd", (0,)), ("set_door_lock", (False,)), ("set_door_lock", (True,)), ("set_ac_status", (True,)), ("set_door_lock", (True,))], doors)
    assert [(r.accepted, r.output) for r in got if r.name == "set_door_lock"] == [(True, "车门闭锁成功"), (False, "车门未关闭，车门闭锁失败"), (True, "车门解锁成功"), (False, "车门未关闭，车门闭锁失败"), (True, "车门闭锁成功")]
