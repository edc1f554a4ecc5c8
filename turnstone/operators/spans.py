"""Trace spans: children under their root, roll-ups, attributes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def attributes(**values: Column) -> Column:
    """A map of attributes as text, without those that are null."""
    entries = F.array(*[F.struct(F.lit(k.replace("__", ".")).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def children(spans: DataFrame) -> DataFrame:
    """Each child with its root's name and attributes: the tree has two levels, so one equi-join on the parent."""
    root = spans.filter("parent_id is null").select("trace_id", F.col("span_id").alias("parent_id"), F.col("name").alias("root_name"), F.col("attrs").alias("root_attrs"))
    return spans.join(root, ["trace_id", "parent_id"])


def rollup(roots: DataFrame, child: DataFrame, name: Column, failed: Column) -> DataFrame:
    """trace_id, n_children, n_errors and the names of the distinct children of each root, also of those without any."""
    made = child.groupBy("trace_id").agg(F.count("*").alias("n"), F.count_if(failed).alias("e"), F.array_join(F.array_sort(F.collect_set(name)), ", ").alias("names"))
    return roots.select("trace_id").join(made, "trace_id", "left").select("trace_id", F.coalesce("n", F.lit(0)).alias("n_children"), F.coalesce("e", F.lit(0)).alias("n_errors"), F.coalesce("names", F.lit("")).alias("names"))


def request_span(request: DataFrame, mode: str = "REDACTED") -> DataFrame:
    """Attributes of a request's root span (request_id, session_id, source_app, input_type, persona, user_id, text); a null text has length 0."""
    said = text.captured(F.col("text"), F.lit("text"), F.lit(mode))
    attrs = attributes(
        agent__persona=F.col("persona"), user__id=F.col("user_id"), request__id=F.col("request_id"), session__id=F.col("session_id"), source__app=F.col("source_app"),
        input__type=F.col("input_type"), user__input__length=F.coalesce(F.length("text"), F.lit(0)), user__input=said,
    )
    return request.select("request_id", F.lit("agent.request").alias("name"), attrs.alias("attrs"))


def answered(roots: DataFrame, responses: DataFrame) -> DataFrame:
    """Root spans (request_id, attrs) with what the response (request_id, success, text, error_type) that was dispatched first says, which its own span has too; roots without one stay."""
    said = responses.select("request_id", _response().alias("_said"))
    return roots.join(said, "request_id", "left").withColumn("attrs", F.when(F.col("_said").isNull(), F.col("attrs")).otherwise(merged(F.col("attrs"), F.col("_said")))).drop("_said")


def tool_span(calls: DataFrame, mode: str = "REDACTED") -> DataFrame:
    """Attributes of tool.execute of calls (vehicle, ord, iteration, name, arguments, output, vetoed, veto_reason); success only says that no guard stopped the call."""
    arguments, output = text.captured(F.col("arguments"), F.lit("argument"), F.lit(mode)), text.captured(F.col("output"), F.lit("result"), F.lit(mode))
    attrs = attributes(agent__iteration=F.col("iteration"), tool__name=F.col("name"), tool__arguments=arguments, tool__success=~F.col("vetoed"), tool__safety_veto=F.col("vetoed"), tool__safety_veto_reason=F.col("veto_reason"), tool__output=output)
    return calls.select("vehicle", "ord", F.lit("tool.execute").alias("name"), attrs.alias("attrs"))


def persona_span(runs: DataFrame) -> DataFrame:
    """The root span agent.<persona> of runs (run_id, persona, user_id, text)."""
    attrs = attributes(session__persona=F.col("persona"), user__id=F.col("user_id"), user__input=text.voice_input(F.col("text")))
    return runs.select("run_id", F.concat(F.lit("agent."), F.col("persona")).alias("name"), attrs.alias("attrs"))


def prompt_span(prompts: DataFrame, mode: str = "REDACTED") -> DataFrame:
    """prompt.assembly of iterations (run_id, iteration, persona, transient and chat (formatted texts), message_count, tool_names (array))."""
    kept = lambda c: text.captured(F.col(c) if isinstance(c, str) else c, F.lit("text"), F.lit(mode))
    listed = F.coalesce(F.array_join("tool_names", ", "), F.lit(""))
    count = F.coalesce(F.array_size("tool_names"), F.lit(0))
    attrs = attributes(agent__persona=F.col("persona"), agent__iteration=F.col("iteration"), prompt__transient_messages=kept("transient"), prompt__chat_messages=kept("chat"), prompt__message_count=F.col("message_count"), prompt__tool_spec_count=count, prompt__tool_specs=kept(listed))
    return prompts.select("run_id", "iteration", F.lit("prompt.assembly").alias("name"), attrs.alias("attrs"))


def model_span(calls: DataFrame, mode: str = "REDACTED", provider: str = "dashscope") -> DataFrame:
    """gen_ai.chat of model calls (run_id, iteration, model, message_count, answer, tool_names, input_tokens, output_tokens, total_tokens); what a model doesn't report is left out."""
    output = text.captured(F.col("answer"), F.lit("result"), F.lit(mode))
    asked = F.when(F.array_size("tool_names") > 0, F.array_join("tool_names", ", "))
    attrs = attributes(
        gen_ai__provider=F.lit(provider), gen_ai__model=F.col("model"), agent__iteration=F.col("iteration"), prompt__message_count=F.col("message_count"), gen_ai__output=output, gen_ai__tool_calls=asked,
        gen_ai__usage__input_tokens=F.col("input_tokens"), gen_ai__usage__output_tokens=F.col("output_tokens"), gen_ai__usage__total_tokens=F.col("total_tokens"),
    )
    return calls.select("run_id", "iteration", F.lit("gen_ai.chat").alias("name"), attrs.alias("attrs"))


def memory_span(steps: DataFrame, mode: str = "REDACTED") -> DataFrame:
    """memory.extract or memory.compress (by operation) of steps (run_id, operation, input_chars, prompt, output, candidate_count, compressed)."""
    extract = F.col("operation") != "compress"
    prompt, output = text.captured(F.col("prompt"), F.lit("text"), F.lit(mode)), text.captured(F.col("output"), F.lit("result"), F.lit(mode))
    attrs = attributes(
        memory__operation=F.col("operation"), memory__input_chars=F.greatest("input_chars", F.lit(0)), memory__prompt=prompt, memory__output=output, memory__output_chars=F.coalesce(F.length("output"), F.lit(0)),
        memory__candidate_count=F.when(extract, F.greatest("candidate_count", F.lit(0))), memory__compressed=F.when(~extract, F.col("compressed")),
    )
    return steps.select("run_id", F.when(extract, "memory.extract").otherwise("memory.compress").alias("name"), attrs.alias("attrs"))


def _response() -> Column:
    return attributes(response__success=F.col("success"), response__text__length=F.coalesce(F.length("text"), F.lit(0)), response__error_type=F.col("error_type"))


def response_span(responses: DataFrame) -> DataFrame:
    """response.dispatch of responses (request_id, success, text, error_type)."""
    return responses.select("request_id", F.lit("response.dispatch").alias("name"), _response().alias("attrs"))


def failed(spans: DataFrame) -> DataFrame:
    """Spans with status and attributes of the exception that ended them (columns error_class, error_message), if one did."""
    short = F.regexp_extract("error_class", r"([^.$]*)$", 1)
    attrs = F.map_concat("attrs", attributes(error__type=F.col("error_class"), error__message=F.col("error_message")))
    names = [c for c in spans.columns if c not in ("attrs", "error_class", "error_message")]
    status = F.when(F.col("error_class").isNull(), F.lit("OK")).otherwise(F.coalesce("error_message", short))
    return spans.select(*names, attrs.alias("attrs"), F.when(F.col("error_class").isNull(), F.lit("OK")).otherwise(F.lit("ERROR")).alias("status"), status.alias("status_text"))


def http_span(calls: DataFrame) -> DataFrame:
    """status and error.type of HTTP calls: 4xx and 5xx by code, exceptions by class."""
    kind = F.coalesce(F.col("error"), text.http_error(F.col("status")))
    return calls.select(*[c for c in calls.columns if c not in ("error",)], F.when(kind.isNull(), "OK").otherwise("ERROR").alias("span_status"), kind.alias("error_type"))


def exported(spans: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    spans.write.mode("append").option("maxRecordsPerFile", rows_per_file).parquet(path)


def merged(left: Column, right: Column) -> Column:
    """Two maps, the right one's values first."""
    keep = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)) if not isinstance(right, Mapping) else left
    return F.map_concat(keep, right)
