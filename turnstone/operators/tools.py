"""Tools as a table of rules: lookup, arguments, validation, state.

No tool is a Python function: a call is joined with its rule and checked by
native expressions. Every check looks at the call alone, but for the door lock,
which also needs the doors (refused) and the speed (see safety).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jsonx, text

# Tool names, rules, state fields, defaults and reply texts that results must match.
#: tool, field, default, what replies call it
_BOOLS = [
    ("set_ac_status", "空调开启", "false", "空调"), ("set_ac_eco_mode", "空调经济模式开启", "false", "空调经济模式"), ("set_ac_anion_status", "负离子开启", "false", "负离子"),
    ("set_ac_drive_sweep_auto", "主驾自动扫风开启", "false", "主驾自动扫风功能"), ("set_ac_assist_sweep_auto", "副驾自动扫风开启", "false", "副驾自动扫风功能"),
    ("set_ac_drive_left_air_outlet", "主驾左侧出风口开关", "false", "主驾左侧出风口功能"), ("set_ac_drive_right_air_outlet", "主驾右侧出风口开关", "false", "主驾右侧出风口功能"),
    ("set_ac_assist_left_air_outlet", "副驾左侧出风口开关", "false", "副驾左侧出风口功能"), ("set_ac_assist_right_air_outlet", "副驾右侧出风口开关", "false", "副驾右侧出风口功能"),
    ("set_window_f_defrosting", "前风挡除霜开启", "false", "前风挡除霜"), ("set_window_r_heat", "后风挡加热开启", "false", "后风挡加热"), ("set_mirror_l_heat", "左后视镜加热开启", "false", "左后视镜加热"),
    ("set_mirror_r_heat", "右后视镜加热开启", "false", "右后视镜加热"), ("set_no_window_opening_passengers", "乘员禁止开窗功能", "false", "乘员禁止开窗功能"),
    ("set_seat_fl_heat", "左前座椅加热开启", "false", "左前座椅加热"), ("set_seat_fr_heat", "右前座椅加热开启", "false", "右前座椅加热"), ("set_seat_rl_heat", "左后座椅加热开启", "false", "左后座椅加热"),
    ("set_seat_rr_heat", "右后座椅加热开启", "false", "右后座椅加热"), ("set_steering_heat", "方向盘加热开启", "false", "方向盘加热"),
]
DOOR_LOCK, DOOR_OPEN = "set_door_lock", "车门未关闭，车门闭锁失败"
_DOOR_REPLIES = ("车门闭锁成功", "车门解锁成功")
#: tool, field, least, most, default, reply, what a rejection says before the value
_RANGES = [
    ("set_ac_drive_temp", "主驾侧温度（摄氏度）", 16, 31, "26", "主驾温度调节成功", "主驾温度16-31摄氏度，当前值："), ("set_ac_assist_temp", "副驾侧温度（摄氏度）", 16, 31, "26", "副驾温度调节成功", "副驾温度16-31摄氏度，当前值："),
    ("set_ac_fan_intensity", "空调风量挡位（1-7递增）", 1, 7, "1", "风量挡位调节成功", "风量挡位1-7，当前值："),
    ("set_vehicle_spd", "车速", 0, 240, "70", "车速大小调节成功", "车速范围0-240 km/h，当前值："),
]
#: tool, field and what replies call it, of percentages
_PERCENTS = [
    ("set_fl_window_status", "左前车窗开度百分比", "左前车窗"), ("set_fr_window_status", "右前车窗开度百分比", "右前车窗"), ("set_rl_window_status", "左后车窗开度百分比", "左后车窗"), ("set_rr_window_status", "右后车窗开度百分比", "右后车窗"),
    ("set_top_window_status", "天窗开度百分比", "天窗"), ("set_sun_shadow_status", "遮阳帘开度百分比", "遮阳帘"), ("set_seat_fl_air", "左前座椅通风百分比", "左前座椅通风"), ("set_seat_fr_air", "右前座椅通风百分比", "右前座椅通风"),
    ("set_seat_rl_air", "左后座椅通风百分比", "左后座椅通风"), ("set_seat_rr_air", "右后座椅通风百分比", "右后座椅通风"),
]
#: tool, field, values, default, reply before the value, what a rejection says before the value, whether it lists the values
_ENUMS = [
    ("set_ac_clean_mode", "空调干燥除味模式", ["关闭", "标准清洁", "深度清洁"], "关闭", "空调干燥除味模式成功设置为：", "无效的干燥除味模式：", True),
    ("set_ac_cyc_mode", "空调循环模式", ["内循环", "外循环", "自动"], "自动", "空调内外循环模式成功设置为：", "无效的循环模式：", True),
    ("set_ac_assist_air_outlet_mode", "副驾电动出风口模式", ["AirManual OFF", "Air Vertical", "Air Horizontal", "Air Point", "Mirror Wind", "One way", "AirnoVent", "AirToVent", "AirAuto", "AirOFF"], "关闭", "副驾电动出风口模式：", "无效的副驾出风口模式：", False),
    ("set_seat_massage_mode", "主驾座椅按摩模式", ["波浪", "脉冲", "揉捏", "震动", "腰部聚焦"], "波浪", "主驾座椅按摩模式成功设置为：", "无效的按摩模式：", True),
    ("set_seat_massage_intensity", "主驾座椅按摩强度", ["关闭", "弱", "中等", "强力"], "关闭", "主驾座椅按摩强度成功设置为：", "无效的按摩强度：", True),
    ("set_chassis_mode", "底盘行驶模式", ["普通模式", "越野模式", "雪地模式"], "普通模式", "底盘行驶模式成功设置为：", "无效的底盘行驶模式：", True),
    ("set_frag_type", "车载香氛类型", ["晨间松木", "正午丁香", "午夜橙香"], "晨间松木", "车载香氛类型成功设置为：", "无效的香氛类型：", True),
    ("set_frag_intensity", "车载香氛浓度", ["关闭", "低", "中", "高"], "关闭", "车载香氛强度成功设置为：", "无效的香氛强度：", True),
    ("set_dms_drive_fatigue", "驾驶员疲劳等级", ["清醒", "轻度", "中度", "重度"], "清醒", "驾驶员疲劳等级成功设置为：", "无效的疲劳等级：", True),
    ("set_dms_drive_distractionlevel", "驾驶员分心等级", ["专注", "轻度分心", "中度分心", "重度分心"], "专注", "驾驶员分心等级成功设置为：", "无效的分心等级：", True),
    ("set_dms_drive_emotion", "驾驶员情绪", ["中性", "高兴", "惊讶", "悲伤", "愤怒", "厌恶", "恐惧"], "中性", "驾驶员情绪成功设置为：", "无效的情绪：", True),
]
_OTHERS = [("front_camera_interaction", "text"), ("getWeatherForecast", "unknown")]
#: Methods whose names don't follow from the tool's.
_METHODS = {"set_dms_drive_distractionlevel": "setDmsDriveDistractionLevel"}
SNAPSHOTS = {
    "ac": ["空调开启", "主驾侧温度（摄氏度）", "副驾侧温度（摄氏度）", "空调风量挡位（1-7递增）", "空调经济模式开启", "负离子开启", "空调干燥除味模式", "空调循环模式", "主驾自动扫风开启", "副驾自动扫风开启", "主驾左侧出风口开关", "主驾右侧出风口开关", "副驾电动出风口模式", "副驾左侧出风口开关", "副驾右侧出风口开关"],
    "door": ["左前门开启", "右前门开启", "左后门开启", "右后门开启", "车门闭锁"],
    "window": ["左前车窗开度百分比", "右前车窗开度百分比", "左后车窗开度百分比", "右后车窗开度百分比", "天窗开度百分比", "遮阳帘开度百分比", "前风挡除霜开启", "后风挡加热开启", "左后视镜加热开启", "右后视镜加热开启", "乘员禁止开窗功能"],
    "seat": ["左前座椅加热开启", "右前座椅加热开启", "左后座椅加热开启", "右后座椅加热开启", "左前座椅通风百分比", "右前座椅通风百分比", "左后座椅通风百分比", "右后座椅通风百分比", "主驾座椅按摩模式", "主驾座椅按摩强度", "方向盘加热开启"],
    "speed": ["车速"], "chassis": ["底盘行驶模式"], "frag": ["车载香氛类型", "车载香氛浓度"], "dms": ["驾驶员疲劳等级", "驾驶员分心等级", "驾驶员情绪"],
}
DOORS = ["左前门开启", "右前门开启", "左后门开启", "右后门开启"]
INVALID_TOOL, RUN_FAILED, DONE = "无效的工具调用: ", "工具执行失败: ", "Success"



def _method(tool: str) -> str:
    first, *rest = tool.split("_")
    return _METHODS.get(tool) or first + "".join(x.capitalize() for x in rest)


def _listed(values: list[str]) -> str:
    """Values as a hash set of Java strings prints them: by the low four bits of the folded hash, as they came where these are equal."""

    def slot(x: str) -> int:
        h = 0
        for unit in memoryview(x.encode("utf-16-le")).cast("H"):
            h = (31 * h + unit) & 0xFFFFFFFF
        return (h ^ (h >> 16)) & 15

    return "[" + ", ".join(sorted(values, key=slot)) + "]"


#: tool, field, kind, lo, hi, allowed, default, method, reply (of true; before the value of an enum), reply of false, rejection before and after the value
RULES = (
    [(t, f, "bool", None, None, None, d, _method(t), f"{n}开启成功", f"{n}关闭成功", None, None) for t, f, d, n in _BOOLS]
    + [(DOOR_LOCK, "车门闭锁", "bool", None, None, None, "false", _method(DOOR_LOCK), *_DOOR_REPLIES, None, None)]
    + [(t, f, "range", lo, hi, None, d, _method(t), ok, None, bad, "") for t, f, lo, hi, d, ok, bad in _RANGES]
    + [(t, f, "range", 0, 100, None, "0", _method(t), f"{n}控制成功", None, f"{n}范围 0-100%，当前值：", "") for t, f, n in _PERCENTS]
    + [(t, f, "enum", None, None, a, d, _method(t), ok, None, bad, f"，可选：{_listed(a)}" if lists else "") for t, f, a, d, ok, bad, lists in _ENUMS]
    + [(t, None, k, None, None, None, None, _method(t), None, None, None, None) for t, k in _OTHERS]
)
_SCHEMA = "name string, field string, kind string, lo int, hi int, allowed array<string>, default string, method string, ok string, off string, bad string, bad_end string"
#: State fields that no tool sets.
FIXED_FIELDS = {d: "false" for d in DOORS}


def registry(spark: SparkSession, rules: list[tuple] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, _SCHEMA)


def specs(registries: list[tuple[str, DataFrame]]) -> DataFrame:
    """manager, nth, name of the tools of all managers one after another: two of one name are both listed, though calls go to the last (last_registered)."""
    out = None
    for k, (manager, tools) in enumerate(registries):
        own = tools.select(F.lit(manager).alias("manager"), F.lit(k).alias("nth"), "name")
        out = own if out is None else out.unionByName(own)
    return out


def last_registered(registrations: DataFrame) -> DataFrame:
    """Of tools registered under one name (column nth tells the order) the last."""
    return registrations.groupBy("name").agg(F.max_by(F.struct(*[c for c in registrations.columns if c != "name"]), "nth").alias("r")).select("name", "r.*")


def looked_up(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Calls with their rules (null where there is none) and the error text of names that nothing answers to. Spark broadcasts the rules by their size."""
    return calls.join(rules, "name", "left").withColumn("lookup_error", F.when(F.col("kind").isNull(), F.concat(F.lit(INVALID_TOOL), F.col("name"))))


def checked(calls: DataFrame) -> DataFrame:
    """looked_up() rows with value (the argument as text, normalised), error (of lookup, of arguments that can't be read or lack one, or of one of another type) and accepted; given is what jsonx.parsed() read."""
    given, kind = F.col("given"), F.col("kind")
    number, flag = jsonx.int_argument(given), jsonx.bool_argument(given)
    value = F.when(kind == "range", number.cast("string")).when(kind == "bool", flag.cast("string")).otherwise(given["raw"])
    wrong = F.when(kind.isin("range", "bool") & F.col("value").isNull(), jsonx.mistyped(given, F.when(kind == "bool", "boolean").otherwise("int")))
    failed = F.concat(F.lit(RUN_FAILED), F.coalesce(given["failure"], jsonx.missing_argument(given, F.col("method")), wrong))
    ok = F.when(kind == "range", F.col("value").try_cast("int").between(F.col("lo"), F.col("hi"))).when(kind == "enum", F.array_contains("allowed", F.col("value"))).otherwise(kind.isNotNull())
    out = jsonx.once(calls, "given", jsonx.parsed(F.col("arguments"))).withColumn("value", value).withColumn("error", F.coalesce("lookup_error", failed))
    return out.withColumn("accepted", F.coalesce(ok, F.lit(False)) & F.col("error").isNull())


def refused(calls: DataFrame, doors: DataFrame) -> DataFrame:
    """checked() calls (vehicle, ts, ord) with door_open: whether a door stands open then (doors: vehicle, ts, ord, field, open). Locking is not accepted while one does."""
    names = calls.columns
    both = calls.withColumn("_call", F.lit(True)).unionByName(doors.select("vehicle", "ts", "ord", F.col("field").alias("_door"), F.col("open").alias("_open"), F.lit(False).alias("_call")), allowMissingColumns=True)
    order = Window.partitionBy("vehicle").orderBy("ts", "ord", "_call").rowsBetween(Window.unboundedPreceding, 0)
    stands = F.lit(False)
    for d in DOORS:
        stands = stands | F.coalesce(F.last(F.when(F.col("_door") == d, F.col("_open")), ignorenulls=True).over(order), F.lit(False))
    out = both.withColumn("door_open", stands).filter("_call").select(*names, "door_open")
    return out.withColumn("accepted", F.col("accepted") & ~((F.col("name") == DOOR_LOCK) & (F.col("value") == "true") & F.col("door_open")))


def reply(door_open: Column | None = None) -> Column:
    """What the tool of a checked() call answers: its success or why it rejects the value; null for tools that answer by other means."""
    value, kind = F.col("value"), F.col("kind")
    taken = F.when(kind == "bool", F.when(value == "true", F.col("ok")).otherwise(F.col("off"))).when(kind == "enum", F.concat("ok", value)).otherwise(F.col("ok"))
    if door_open is not None:
        taken = F.when((F.col("name") == DOOR_LOCK) & (value == "true") & door_open, F.lit(DOOR_OPEN)).otherwise(taken)
    fits = F.when(kind == "range", value.try_cast("int").between(F.col("lo"), F.col("hi"))).when(kind == "enum", F.array_contains("allowed", value)).otherwise(F.lit(True))
    return F.when(fits, taken).otherwise(F.concat("bad", value, "bad_end"))


def result_text(returned: Column, error: Column) -> Column:
    return F.coalesce(error, returned, F.lit(DONE))


def state(accepted: DataFrame, vehicles: DataFrame | None = None, rules: list[tuple] = RULES) -> DataFrame:
    """vehicle, field, value: the last accepted value of each; rejected calls change nothing. With vehicles, fields never set have their defaults."""
    last = accepted.filter("accepted and field is not null").groupBy("vehicle", "field").agg(F.max_by("value", F.struct("ts", "ord")).alias("value"))
    if vehicles is None:
        return last
    defaults = F.array(*[F.struct(F.lit(r[1]).alias("field"), F.lit(r[6]).alias("default")) for r in rules if r[1]])
    seed = vehicles.select("vehicle", F.inline(defaults))
    return seed.join(last, ["vehicle", "field"], "left").select("vehicle", "field", F.coalesce("value", "default").alias("value"))


def snapshots(states: DataFrame, parts: list[str] | None = None) -> DataFrame:
    """vehicle and one JSON text for each part of the vehicle, from vehicle, field, value rows. At most 49 fields a vehicle."""
    values = F.map_from_entries(F.collect_list(F.struct("field", "value")))
    return states.groupBy("vehicle").agg(values.alias("v")).select("vehicle", *snapshot_texts(F.col("v"), parts))


def snapshot_texts(values: Column, parts: list[str] | None = None) -> list[Column]:
    """One JSON text for each part, from a map of field to value; fields that it lacks have their defaults."""
    kinds = {f: k for _, f, k, *_ in RULES if f}
    default = {r[1]: r[6] for r in RULES if r[1]} | FIXED_FIELDS

    def typed(f: str) -> Column:
        x = F.coalesce(F.element_at(values, F.lit(f)), F.lit(default[f]))
        return (x.cast("int") if kinds.get(f) == "range" else x if kinds.get(f) == "enum" else x.cast("boolean")).alias(f)

    return [F.to_json(F.struct(*[typed(f) for f in SNAPSHOTS[p]])).alias(p) for p in parts or SNAPSHOTS]


def any_door_open(fields: DataFrame) -> DataFrame:
    return fields.filter(F.col("field").isin(*DOORS)).groupBy("vehicle").agg(F.bool_or(F.col("value") == "true").alias("any_door_open"))


def as_of(calls: DataFrame, updates: DataFrame, value: str, default: Column) -> DataFrame:
    """Calls with the last update's value at or before them (ts, ord), per vehicle: one sort of the union instead of a range join."""
    names = calls.columns
    both = calls.withColumn("_v", F.lit(None).cast(updates.schema[value].dataType)).withColumn("_call", F.lit(True)).unionByName(updates.select("vehicle", "ts", "ord", F.col(value).alias("_v"), F.lit(False).alias("_call")), allowMissingColumns=True)
    order = Window.partitionBy("vehicle").orderBy("ts", "ord", "_call").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_last", F.last("_v", ignorenulls=True).over(order)).filter("_call").select(*names, F.coalesce("_last", default).alias(value))


def camera_answers(calls: DataFrame, frames: DataFrame, images: DataFrame, ask: Callable[[DataFrame], DataFrame], default_image: str) -> DataFrame:
    """calls (vehicle, ts, ord, question) with what the camera tool answers: output, and error_class and error_message where the model failed.

    frames: vehicle, ts, ord, path; images: path, content. The last frame at or before a call counts, the image at
    default_image where there is none; only its path goes through the sort by time, the bytes are fetched afterwards, once for each
    question about an image. ask: from prompt to prompt, answer, error_class, error_message (see models.called); the prompt is
    JSON with question and image (base64). An image that isn't there gives an empty answer.
    """
    seen = as_of(calls, frames, "path", F.lit(default_image))
    asked = seen.select("question", "path").distinct().join(images.select("path", "content"), "path")
    prompt = F.to_json(F.struct("question", text.base64_plain(F.col("content")).alias("image")))
    said = ask(asked.select("question", "path", prompt.alias("prompt"))).select("question", "path", "answer", "error_class", "error_message", F.lit(True).alias("_asked"))
    same = seen["path"].eqNullSafe(said["path"]) & seen["question"].eqNullSafe(said["question"])
    joined = seen.join(said, same, "left").drop(said["path"]).drop(said["question"])
    return joined.withColumn("output", F.when(F.col("error_class").isNotNull(), F.concat(F.lit(RUN_FAILED), F.coalesce("error_message", F.lit("null")))).when(F.col("_asked"), text.with_vision_warning(F.col("answer"))).otherwise(F.lit(""))).drop("_asked", "answer")
