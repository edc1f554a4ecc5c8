"""Guards over tool calls: a guard is a column with the reason of its veto, or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from . import tools

# Limits, defaults and texts that results must match.
MOST_SPEED, DEFAULT_SPEED = 5, 70
VETO, ALL_VETOED = "[SAFETY VETO] ", "安全原因已阻止所有工具调用。"
REASON = ("出于安全考虑，车速 ", " km/h 时不允许解锁车门。请先停车。")


def door_guard(name: Column, given: Column, speed: Column) -> Column:
    """Unlocking is vetoed above MOST_SPEED. Only a false that is a boolean or its text unlocks: what is missing, of another type or unreadable lets the call pass. given: of jsonx.parsed()."""
    return F.when((name == tools.DOOR_LOCK) & ~F.coalesce(jsonx.bool_argument(given), F.lit(True)) & (speed > MOST_SPEED), F.concat(F.lit(REASON[0]), speed.cast("string"), F.lit(REASON[1])))


def chain(*reasons: Column) -> Column:
    """The first veto wins."""
    return F.coalesce(*reasons)


def allow_all() -> Column:
    return F.lit(None).cast("string")


def guarded(calls: DataFrame, rules: DataFrame, doors: DataFrame | None = None) -> DataFrame:
    """Calls (vehicle, ts, ord, name, arguments) with the speed as of each, veto_reason, vetoed, and what their results say: vetoed calls don't run.

    doors: vehicle, ts, ord, field, open; without them all doors are shut.
    """
    done = tools.checked(tools.looked_up(calls, rules))
    speeds = done.filter("name = 'set_vehicle_spd' and accepted").select("vehicle", "ts", "ord", F.col("value").cast("int").alias("speed"))
    out = tools.as_of(done, speeds, "speed", F.lit(DEFAULT_SPEED))
    stands = None
    if doors is not None:
        out, stands = tools.refused(out, doors), F.col("door_open")
    out = out.withColumn("veto_reason", chain(door_guard(F.col("name"), F.col("given"), F.col("speed")))).withColumn("vetoed", F.col("veto_reason").isNotNull())
    out = out.withColumn("accepted", F.col("accepted") & ~F.col("vetoed"))
    # success means that no guard stopped the call: a value out of range is a success, too
    said = tools.result_text(tools.reply(stands), F.col("error"))
    return out.withColumn("success", ~F.col("vetoed")).withColumn("output", F.when(F.col("vetoed"), F.concat(F.lit(VETO), F.col("veto_reason"))).otherwise(said))


def iterations(calls: DataFrame, *key: str) -> DataFrame:
    """n_calls, n_vetoed and all_vetoed of each iteration; one in which all calls were vetoed ends the run with a fixed text."""
    out = calls.groupBy(*key).agg(F.count("*").alias("n_calls"), F.count_if("vetoed").alias("n_vetoed"))
    out = out.withColumn("all_vetoed", (F.col("n_calls") == F.col("n_vetoed")) & (F.col("n_vetoed") > 0))
    return out.withColumn("ends_with", F.when(F.col("all_vetoed"), F.lit(ALL_VETOED)))
