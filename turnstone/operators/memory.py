"""Long-term memories: latest write of each key, best ones of each user, prompt text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonx, text

# Limits that results must match.
PER_USER, SHOWN_FROM = 100, 0.5
HEADING, GROUP_END, ITEM = "\n\n【长期记忆】", "：", "\n  · "
KEY = ["user_id", "category", "key_text"]


def upsert(writes: DataFrame) -> DataFrame:
    """One row for each (user, category, key): the latest write wins even with less confidence, the first one dates its
    creation, and the access count starts anew. One shuffle with partial aggregation, whatever the number of writes."""
    w = writes.withColumn("category", jsonx.category(F.col("category")))
    latest = F.max(F.struct("ts", "ord", "value_text", "confidence")).alias("w")
    return w.groupBy(*KEY).agg(latest, F.min("ts").alias("created_at")).select(*KEY, "w.value_text", "w.confidence", "created_at", F.col("w.ts").alias("updated_at"), F.col("w.ord").alias("ord"), F.lit(0).cast("long").alias("access_count"))


def top_per_user(memories: DataFrame, k: int = PER_USER) -> DataFrame:
    """The k memories of each user with most confidence, of those the latest; rank from 1. Spark limits each task's groups before the shuffle."""
    order = Window.partitionBy("user_id").orderBy(F.desc("confidence"), F.desc("updated_at"), "category", "key_text")
    return memories.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def grouped(top: DataFrame) -> DataFrame:
    """user_id, category, first_rank, entries (in order of rank). A group is at most PER_USER rows."""
    entry = F.struct("rank", "value_text", "confidence")
    return top.groupBy("user_id", "category").agg(F.min("rank").alias("first_rank"), F.array_sort(F.collect_list(entry)).alias("entries"))


def shown(entries="entries"):
    """Entries sure enough to be shown; their group keeps its heading even if none is."""
    return F.filter(F.col(entries), lambda e: e["confidence"] >= SHOWN_FROM)


def prompt_text(top: DataFrame) -> DataFrame:
    """user_id, prompt_text. Groups stand in the order of their best entry."""
    lines = F.concat(F.lit("\n"), text.category_label(F.col("category")), F.lit(GROUP_END), F.array_join(F.transform(shown(), lambda e: F.concat(F.lit(ITEM), e["value_text"])), ""))
    parts = grouped(top).select("user_id", F.struct("first_rank", lines.alias("t")).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["t"]), "")
    return parts.groupBy("user_id").agg(F.concat(F.lit(HEADING), joined).alias("prompt_text"))


def prepared_prompt(base: DataFrame, prompts: DataFrame) -> DataFrame:
    """base (user_id, body) with each user's memory text on a new line after it, if there is any."""
    return base.join(prompts, "user_id", "left").select("user_id", F.concat("body", F.coalesce(F.concat(F.lit("\n"), F.col("prompt_text")), F.lit(""))).alias("prompt"))


def access_counts(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """user_id, key_text, access_count: reads since the key's latest write. Both sides are aggregated by one shuffle of their union."""
    both = writes.select("user_id", "key_text", "ts", "ord", F.lit(True).alias("write")).unionByName(reads.select("user_id", "key_text", "ts", "ord", F.lit(False).alias("write")))
    last = F.max(F.when(F.col("write"), F.struct("ts", "ord"))).over(Window.partitionBy("user_id", "key_text"))
    return both.withColumn("last", last).filter("last is not null").groupBy("user_id", "key_text").agg(F.count_if(~F.col("write") & (F.struct("ts", "ord") > F.col("last"))).alias("access_count"))


def surviving(writes: DataFrame, deletes: DataFrame) -> DataFrame:
    """Latest writes of (user, key) that no later tombstone deletes. A tombstone with a null key deletes all that the user had."""
    rows = writes.select("user_id", "key_text", "ts", "ord", "value_text", F.lit(False).alias("gone")).unionByName(deletes.filter("key_text is not null").select("user_id", "key_text", "ts", "ord", F.lit(None).cast("string").alias("value_text"), F.lit(True).alias("gone")))
    last = rows.groupBy("user_id", "key_text").agg(F.max(F.struct("ts", "ord", "gone", "value_text")).alias("w")).filter("not w.gone")
    everything = deletes.filter("key_text is null").groupBy("user_id").agg(F.max(F.struct("ts", "ord")).alias("d"))
    kept = last.join(everything, "user_id", "left").filter(F.col("d").isNull() | (F.struct("w.ts", "w.ord") > F.col("d")))
    return kept.select("user_id", "key_text", "w.value_text")


def extracted(turns: DataFrame, answers: DataFrame) -> DataFrame:
    """Memory writes (user_id, category, key_text, value_text, confidence, ts, ord) from turns (turn_id, user_id, user_message, ts) and what a model made of them (turn_id, model_output).

    Turns without a user's message are never sent to the model, so an answer to one counts for nothing. ord tells the candidates of one turn apart.
    """
    asked = turns.filter(F.coalesce("user_message", F.lit("")) != "").select("turn_id", "user_id", "ts")
    made = jsonx.candidates(asked.join(answers, "turn_id"))
    return made.select("user_id", "category", "key_text", "value_text", "confidence", "ts", F.struct("turn_id", "pos").alias("ord"))


def turn_completed(turns: DataFrame, answers: DataFrame, conversations: DataFrame, summaries: DataFrame, rule=None) -> tuple[DataFrame, DataFrame]:
    """What the end of turns leaves: the memories upserted from them, and the conversations (memory_id, pos, type, text) compacted where the rule asks for it."""
    from . import messages

    rule = rule or messages.Compaction()
    return upsert(extracted(turns, answers)), messages.compacted(conversations, messages.plan(conversations, rule), summaries, rule)
