"""Camera scenes: normalising, change detection, admission, tools and actions of a scene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import occupancy

# Scenes, their tools and their actions.
OTHER = "其他"
SCENES = ["雨雪天气", "工程施工", "舱外浓烟", "驾驶员疲劳", "乘客休息"]
SCENE_TOOLS = {
    "雨雪天气": ["set_window_f_defrosting", "set_window_r_defrosting", "set_seat_pos", "set_seat_heat", "set_steer_heat", "set_ac_temperature", "set_ac_air_volume", "set_ac_mode", "set_ac_circulation", "set_ac_ac", "set_ac_auto", "set_drive_mode"],
    "工程施工": ["set_window_f_defrosting", "set_window_r_defrosting", "set_ac_temperature", "set_ac_ac", "set_ac_circulation"],
    "舱外浓烟": ["set_window_f_defrosting", "set_window_r_defrosting", "set_ac_temperature", "set_ac_ac", "set_ac_circulation", "set_ac_air_volume"],
    "驾驶员疲劳": ["set_frag_switch", "set_frag_level", "set_seat_pos", "set_seat_heat", "set_steer_heat", "set_ac_temperature", "set_ac_air_volume"],
    "乘客休息": ["set_frag_switch", "set_frag_level", "set_window_f_defrosting", "set_window_r_defrosting", "set_ac_temperature", "set_ac_air_volume", "set_ac_mode"],
}
ACTIONS = {
    "驾驶员疲劳": "方向盘震动已开启，并开启驾驶辅助。",
    "舱外浓烟": "已打开双闪提醒后车。",
    "雨雪天气": "已打开雾灯、示廓灯，已切换到雪地模式。",
    "乘客休息": "已降低座舱系统音量。",
    "工程施工": "已开双闪提醒后车，已关闭驾驶辅助。",
}
NO_PROMPT_SCENES = ["", OTHER, "无效场景"]


def normalised(name: Column) -> Column:
    return F.when(name.isin(*SCENES), name).otherwise(F.lit(OTHER))


def changes(frames: DataFrame, reset: Column | None = None) -> DataFrame:
    """Frames (stream_id, ts, ord, name) at which a stream's scene becomes another one. Scenes without a name or 其他 are
    dropped first and so don't count as a change. reset: rows after which the same scene may be announced again."""
    order = Window.partitionBy("stream_id").orderBy("ts", "ord")
    rows = frames
    key = ["stream_id"]
    if reset is not None:
        resets = F.count_if(reset).over(order.rowsBetween(Window.unboundedPreceding, -1))
        rows, key = rows.withColumn("_segment", F.coalesce(resets, F.lit(0))), ["stream_id", "_segment"]
    rows = rows.filter(~F.coalesce(F.col("name"), F.lit("")).isin("", OTHER))
    before = F.lag("name").over(Window.partitionBy(*key).orderBy("ts", "ord"))
    return rows.withColumn("_before", before).filter(~F.col("name").eqNullSafe(F.col("_before"))).drop("_before", "_segment")


def latest(frames: DataFrame, *key: str) -> DataFrame:
    """The last frame of each key: earlier ones are overwritten, never queued."""
    rest = [c for c in frames.columns if c not in (*key, "ts", "ord")]
    return frames.groupBy(*key).agg(F.max(F.struct("ts", "ord", *rest)).alias("f")).select(*key, "f.*")


def admitted(frames: DataFrame, occupied: DataFrame, until: Column) -> DataFrame:
    """All frames (stream_id, ts, ord) with processed: whether the scene is looked at.

    Not while the service answers a request or speaks (occupied: stream_id, since, until), nor while it still looks at an
    earlier frame, which it does until ``until``. Frames that come meanwhile are only stored and occupy nothing.
    """
    rows = occupancy.during(frames, occupied, "stream_id", "ts", "_occupied").withColumn("_until", until)
    looked = occupancy.accepted(rows.filter("not _occupied"), "stream_id", "ts", "_until", "ord", "processed")
    stored = rows.filter("_occupied").withColumn("processed", F.lit(False))
    return looked.unionByName(stored).select(*frames.columns, "processed")


def whitelist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, t) for s, ts in SCENE_TOOLS.items() for t in ts], "scene string, name string")


def tools_of(rules: DataFrame, allowed: DataFrame, scene: str | None = None) -> DataFrame:
    """Tools that a scene may use, none for a scene without a whitelist; without a scene, a row for each scene and tool of it. Spark broadcasts by size."""
    if scene is None:
        return allowed.join(rules, "name", "left_semi")
    return rules.join(allowed.filter(F.col("scene") == scene), "name", "left_semi")


def missing_tools(allowed: DataFrame, rules: DataFrame) -> DataFrame:
    """Whitelisted names that no tool has."""
    return allowed.join(rules, "name", "left_anti")


def optional_subset(rules: DataFrame, names: list[str] | None) -> DataFrame:
    """All tools where no subset is given; none where it is empty."""
    return rules if names is None else rules.filter(F.col("name").isin(*names)) if names else rules.limit(0)


def action(name: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), name), F.lit(""))


def prompt_name(scene_type: Column, *earlier: Column) -> Column:
    """The first selector that answers, else by the scene."""
    own = F.when(scene_type.isNull() | scene_type.isin(*NO_PROMPT_SCENES), F.lit("system/assistant_default")).otherwise(F.lit("system/assistant_scene"))
    return F.coalesce(*earlier, own)


def merged(model_text: Column, hard_action: Column, summary: Column) -> Column:
    """The text as it is where there is no action, else the summary of both."""
    return F.when(F.coalesce(hard_action, F.lit("")) == "", model_text).otherwise(summary)
