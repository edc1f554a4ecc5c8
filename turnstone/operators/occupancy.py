"""Who may begin while others are going on: verdicts that depend on earlier verdicts.

A run that is refused occupies nothing, so whether a run begins depends on which of
those before it did. Runs are first cut into islands: where nothing, refused or not, reaches over
a start, that run begins whatever happened before. Inside an island every run points
to the first that starts when it has ended; those that the island's first run leads to begin, and
they are found by doubling the pointers, in as many turns as the longest chain has binary digits.

Runs are sorted within a key and a day; what earlier or later days hold comes in as one value a
day. So the history of one busy agent is neither one task nor one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

FOREVER = "9999-12-31 00:00:00"


def so_far(rows: DataFrame, out: str, value: Column, order: list[Column], fold: Callable[[Column], Column] = F.max, own: bool = True) -> DataFrame:
    """Rows (_key, _day) with the largest (fold F.max) value of the rows before in the key, or with F.min the least of the rows after; own: this row too."""
    ahead = fold is F.min
    days = rows.groupBy("_key", "_day").agg(fold(value).alias("_of_day"))
    others = Window.partitionBy("_key").orderBy(F.desc("_day") if ahead else F.asc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_key", "_day", fold("_of_day").over(others).alias("_carried"))
    here = Window.partitionBy("_key", "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    both = (F.least if ahead else F.greatest)(fold(value).over(here), F.col("_carried"))
    return rows.join(days, ["_key", "_day"]).withColumn(out, both).drop("_carried")


def accepted(runs: DataFrame, agent: str, start: str, end: str, ord: str, out: str = "accepted") -> DataFrame:
    """runs with out: whether a run begins, that is, no run of its agent that began before it (start, ord) is still going on.

    A run may begin at the moment when another ends. One without an end goes on for ever; one that
    ends before it starts ends at once; one without a start never begins. Null agents are
    one agent. Of runs equal in start, ord and end one is first, it doesn't matter which.
    """
    names = runs.columns
    timed = runs.filter(F.col(start).isNotNull())
    forever = F.lit(FOREVER).cast(runs.schema[end].dataType)
    until = F.greatest(F.coalesce(F.col(end), forever), F.col(start).cast(runs.schema[end].dataType))
    rows = timed.select(F.struct(*names).alias("_row"), F.struct(F.col(agent).alias("agent")).alias("_key"), F.to_date(start).alias("_day"), F.col(start).alias("_start"), F.col(ord).alias("_ord"), until.alias("_until"))
    here = Window.partitionBy("_key", "_day").orderBy("_start", "_ord", "_until")
    rows = rows.withColumn("_place", F.struct("_start", "_ord", "_until", F.row_number().over(here).alias("_n")))
    rows = so_far(rows, "_reach", F.col("_until"), [F.col("_place")], own=False)
    rows = rows.withColumn("_head", F.coalesce(F.col("_reach") <= F.col("_start"), F.lit(True)))
    rows = checkpointed(rows.select("_row", "_key", "_day", "_start", "_until", "_place", "_head"))
    jumps = checkpointed(_following(rows))
    at = jumps.join(rows.filter("_head").select(F.struct("_key", "_place").alias("id")), "id", "left_semi").select("id")
    begun = []
    while True:
        new = checkpointed(at.join(jumps, "id").select(F.col("to").alias("id")))
        if new.isEmpty():
            break
        begun.append(new)
        at = checkpointed(at.unionByName(new))
        jumps = checkpointed(jumps.join(jumps.select(F.col("id").alias("to"), F.col("to").alias("further")), "to").select("id", F.col("further").alias("to")))
    verdict = F.col("_head")
    out_rows = rows.withColumn("id", F.struct("_key", "_place"))
    if begun:
        found = begun[0]
        for more in begun[1:]:
            found = found.unionByName(more)
        out_rows = out_rows.join(found.withColumn("_begun", F.lit(True)), "id", "left")
        verdict = verdict | F.coalesce("_begun", F.lit(False))
    never = runs.filter(F.col(start).isNull()).withColumn(out, F.lit(False))
    return out_rows.select("_row.*", verdict.alias(out)).unionByName(never)


def _following(rows: DataFrame) -> DataFrame:
    """id, to: from each run to the first of its island that starts when it has ended."""
    starts = rows.select("_key", "_day", F.col("_start").alias("_t"), F.col("_place").alias("_o"), F.lit(0).alias("_kind"), F.struct("_place", "_head").alias("_begins"), F.lit(None).cast(rows.schema["_place"].dataType).alias("_of"))
    # an end comes before all starts of its moment, but that of a run without duration right after its own start
    moment = F.col("_until") == F.col("_start")
    ends = rows.filter(F.col("_until") < F.lit(FOREVER).cast(rows.schema["_until"].dataType)).select(
        "_key", F.to_date("_until").alias("_day"), F.col("_until").alias("_t"), F.when(moment, F.col("_place")).alias("_o"), F.when(moment, 1).otherwise(0).alias("_kind"), F.lit(None).cast(starts.schema["_begins"].dataType).alias("_begins"), F.col("_place").alias("_of")
    )
    order = [F.col("_t").desc(), F.col("_o").desc_nulls_last(), F.col("_kind").desc()]
    next_one = so_far(starts.unionByName(ends), "_next", F.col("_begins"), order, F.min)
    found = next_one.filter(F.col("_of").isNotNull() & ~F.col("_next._head"))
    return found.select(F.struct("_key", F.col("_of").alias("_place")).alias("id"), F.struct("_key", "_next._place").alias("to"))


def during(points: DataFrame, intervals: DataFrame, key: str, ts: str, out: str = "during") -> DataFrame:
    """points with out: whether any interval (key, since, until) of their key holds them, since included and until not; one without an end goes on for ever."""
    kind = points.schema[ts].dataType
    until = F.coalesce(F.col("until"), F.lit(FOREVER)).cast(kind)
    own = points.select(F.struct(*points.columns).alias("_row"), F.struct(F.col(key).alias("key")).alias("_key"), F.col(ts).alias("_ts"), F.lit(True).alias("_point"), F.lit(None).cast(kind).alias("_until"))
    held = intervals.filter("since is not null").select(F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), F.struct(F.col(key).alias("key")).alias("_key"), F.col("since").cast(kind).alias("_ts"), F.lit(False).alias("_point"), until.alias("_until"))
    both = own.unionByName(held).withColumn("_day", F.coalesce(F.to_date("_ts"), F.lit("0001-01-01").cast("date")))
    rows = so_far(both, "_reach", F.col("_until"), [F.col("_ts"), F.col("_point")])
    return rows.filter("_point").select("_row.*", F.coalesce(F.col("_reach") > F.col("_ts"), F.lit(False)).alias(out))
