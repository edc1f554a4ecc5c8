"""Sessions from lifecycle events (user_id, session_id, action, ts, ord), and conversation epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RECENT = 50


def lifecycle(events: DataFrame) -> DataFrame:
    """One row for each session that was created: the first create wins, ends before it do nothing, the last end after it counts."""
    key = ["user_id", "session_id"]
    first = F.min(F.when(F.col("action") == "create", F.struct("ts", "ord"))).over(Window.partitionBy(*key))
    rows = events.withColumn("c", first).filter("c is not null")
    ended = F.max(F.when((F.col("action") == "end") & (F.struct("ts", "ord") > F.col("c")), F.struct("ts", "ord")))
    return rows.groupBy(*key).agg(F.first("c").alias("c"), ended.alias("e")).select(*key, F.col("c.ts").alias("created_at"), F.col("c.ord").alias("created_ord"), F.col("e.ts").alias("ended_at"), F.col("e").isNull().alias("is_active"))


def recent(sessions: DataFrame, k: int = RECENT) -> DataFrame:
    """The k latest sessions of each user, nth from 1."""
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("created_ord"), "session_id")
    return sessions.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)


def latest_active(sessions: DataFrame) -> DataFrame:
    return recent(sessions.filter("is_active"), 1).drop("nth")


def epochs(events: DataFrame, is_clear) -> DataFrame:
    """Events with the number of clear events of the user so far; what a cleared window holds is one epoch."""
    order = Window.partitionBy("user_id").orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("epoch", F.count_if(is_clear).over(order))


def messages_of(sessions: DataFrame, packed: DataFrame) -> DataFrame:
    """Sessions with their messages, by user and session (never by the joined text of both, which is ambiguous)."""
    return sessions.join(packed, ["user_id", "session_id"])


def last_per_epoch(events: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("user_id", "epoch").orderBy(F.desc("ts"), F.desc("ord"))
    return events.withColumn("_back", F.row_number().over(order)).filter(F.col("_back") <= n).drop("_back")
