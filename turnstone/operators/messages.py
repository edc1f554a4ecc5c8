"""Chat messages: bounded windows, token estimates, compaction.

Messages are rows (memory_id, seq, type, text) with types system, user, ai or
assistant, tool. A conversation is the unit of a window and a group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

COUNTED = ["system", "user", "ai", "assistant", "tool"]
SUMMARY = "【对话摘要】"


@dataclass(frozen=True)
class Compaction:
    """Fixed values of the rule: estimated tokens from which, messages over which, and dialog messages that stay."""

    tokens: int = 4000
    messages: int = 7
    keep: int = 10


def window_last(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation. Its first system message stays and takes one of the n places;
    results of tools whose call fell out go too, where calls have ids (column call_id)."""
    conv = Window.partitionBy("memory_id")
    first_system = F.min(F.when(F.col("type") == "system", F.col("seq"))).over(conv)
    rows = messages.withColumn("_sys", first_system).withColumn("_pinned", F.coalesce(F.col("seq") == F.col("_sys"), F.lit(False)))
    back = Window.partitionBy("memory_id", "_pinned").orderBy(F.desc("seq"))
    room = F.lit(n) - F.col("_sys").isNotNull().cast("int")
    rows = rows.withColumn("_back", F.row_number().over(back)).filter(F.col("_pinned") | (F.col("_back") <= room))
    if "call_id" in messages.columns:
        asked = F.collect_set(F.when(F.col("type") != "tool", F.col("call_id"))).over(conv)
        rows = rows.withColumn("_asked", asked).filter((F.col("type") != "tool") | F.array_contains("_asked", F.col("call_id"))).drop("_asked")
    return rows.drop("_sys", "_pinned", "_back")


def tokens(text_col: str = "text", type_col: str = "type") -> Column:
    """Aggregate: half the characters of a conversation, rounded down once; other types count nothing."""
    return F.floor(F.sum(F.when(F.col(type_col).isin(*COUNTED), F.length(F.coalesce(F.col(text_col), F.lit("")))).otherwise(0)) / 2).cast("long")


def input_chars(text_col: str = "text") -> Column:
    return F.sum(F.length(F.coalesce(F.col(text_col), F.lit("")))).cast("long")


def stats(messages: DataFrame) -> DataFrame:
    return messages.groupBy("memory_id").agg(F.count("*").alias("message_count"), tokens().alias("token_estimate"), input_chars().alias("input_chars"))


def _placed(messages: DataFrame, rule: Compaction) -> DataFrame:
    """Each message with its conversation's totals and its part: system, region (to be compacted) or kept."""
    conv = Window.partitionBy("memory_id")
    rows = messages.withColumn("_n", F.count("*").over(conv))
    chars = F.sum(F.when(F.col("type").isin(*COUNTED), F.length(F.coalesce("text", F.lit("")))).otherwise(0)).over(conv)
    rows = rows.withColumn("_tokens", F.floor(chars / 2).cast("long"))
    rows = rows.withColumn("_sys", F.min(F.when(F.col("type") == "system", F.col("seq"))).over(conv))
    head = F.coalesce(F.col("seq") == F.col("_sys"), F.lit(False))
    back = F.row_number().over(Window.partitionBy("memory_id", head).orderBy(F.desc("seq")))
    rows = rows.withColumn("_back", back)
    return rows.withColumn("_part", F.when(head, "system").when(F.col("_back") <= rule.keep, "kept").otherwise("region"))


def plan(messages: DataFrame, rule: Compaction = Compaction(), calls_col: str | None = None) -> DataFrame:
    """memory_id, message_count, token_estimate, n_region, n_kept, compact (whether it happens), summary_lines (the region as text).

    Not below the tokens, not up to the messages, not without a region, and not while the region's last ai
    message asks for tools.
    """
    rows = _placed(messages, rule)
    calls = F.col(calls_col) if calls_col else None
    region = F.col("_part") == "region"
    asks = F.size(F.coalesce(calls, F.array())) > 0 if calls is not None else F.lit(False)
    pending = F.max(F.when(region & F.col("type").isin("ai", "assistant"), F.struct("seq", asks.alias("asks"))))
    line = text.summary_line(F.col("type"), F.col("text"), F.col("tool_name") if "tool_name" in messages.columns else None, calls)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(region & line.isNotNull(), F.struct("seq", line.alias("t"))))), lambda x: F.concat(x["t"], F.lit("\n"))), "")
    out = rows.groupBy("memory_id").agg(F.first("_n").alias("message_count"), F.first("_tokens").alias("token_estimate"), F.count_if(region).alias("n_region"), F.count_if(F.col("_part") == "kept").alias("n_kept"), pending.alias("_p"), lines.alias("summary_lines"))
    compact = (F.col("token_estimate") >= rule.tokens) & (F.col("message_count") > rule.messages) & (F.col("n_region") > 0) & ~F.coalesce(F.col("_p.asks"), F.lit(False))
    return out.withColumn("compact", compact).select("memory_id", "message_count", "token_estimate", "n_region", "n_kept", "compact", "summary_lines")


def compacted(messages: DataFrame, plans: DataFrame, summaries: DataFrame, rule: Compaction = Compaction()) -> DataFrame:
    """memory_id, pos, type, text (and tool_name, if messages have it) after compaction. summaries: memory_id, summary; a null or blank one leaves the conversation as it is."""
    named = [c for c in ("tool_name",) if c in messages.columns]
    ready = plans.filter("compact").join(summaries.filter(F.trim("summary") != ""), "memory_id").select("memory_id", F.trim("summary").alias("_summary"))
    rows = _placed(messages, rule).join(ready, "memory_id", "left")
    stay = rows.filter(F.col("_summary").isNull() | (F.col("_part") != "region"))
    stay = stay.select("memory_id", F.when(F.col("_summary").isNull(), 1).when(F.col("_part") == "system", 0).otherwise(2).alias("_o"), "seq", "type", "text", *named)
    said = ready.select("memory_id", F.lit(1).alias("_o"), F.lit(0).cast("long").alias("seq"), F.lit("user").alias("type"), F.concat(F.lit(SUMMARY), F.col("_summary")).alias("text"), *(F.lit(None).cast("string").alias(c) for c in named))
    order = Window.partitionBy("memory_id").orderBy("_o", "seq")
    return stay.unionByName(said).select("memory_id", F.row_number().over(order).cast("long").alias("pos"), "type", "text", *named)


def joined(messages: DataFrame, limit: int = text.FORMAT_LIMIT) -> DataFrame:
    """memory_id, formatted: the messages' formatted texts by line, cut to the limit."""
    line = text.format_message(F.col("type"), F.col("text"), F.col("tool_name") if "tool_name" in messages.columns else None)
    items = F.array_sort(F.collect_list(F.struct("seq", line.alias("t"))))
    return messages.groupBy("memory_id").agg(text.cut_format(F.array_join(F.transform(items, lambda x: x["t"]), "\n"), limit).alias("formatted"))


def with_context(context: DataFrame, messages: DataFrame) -> DataFrame:
    """Transient messages (memory_id, chain_pos, type, text) before those of the conversation, duplicates kept. Adds pos from 1."""
    both = context.select("memory_id", F.lit(0).alias("_o"), F.col("chain_pos").cast("long").alias("seq"), "type", "text").unionByName(messages.select("memory_id", F.lit(1).alias("_o"), "seq", "type", "text"))
    order = Window.partitionBy("memory_id").orderBy("_o", "seq")
    return both.select("memory_id", F.row_number().over(order).cast("long").alias("pos"), "type", "text")


def changed_prompts(prompts: DataFrame, messages: DataFrame) -> DataFrame:
    """memory_id, body of the system prompts that differ from what the conversation has (or that it lacks)."""
    current = messages.filter(F.col("type") == "system").groupBy("memory_id").agg(F.min_by("text", "seq").alias("current"))
    return prompts.join(current, "memory_id", "left").filter(~F.col("body").eqNullSafe(F.col("current"))).select("memory_id", "body")


def with_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Tool calls with their results by call_id; a call without one keeps null."""
    return calls.join(results.select("call_id", F.col("text").alias("result")), "call_id", "left")
