"""Redaction, truncation, formatting and templates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, limits and texts that results must match.
PHONE = r"((?:\+86)?1[3-9]\d)\d{4}(\d{4})"
IMAGE_SIGNS = ["/9j/", "iVBOR", "base64", "Base64"]
TEXT_LIMIT, ARGUMENT_LIMIT, RESULT_LIMIT, IMAGE_KEEP = 500, 200, 200, 100
CUT, CUT_IMAGE, CUT_PLAIN, CUT_VOICE = "… (truncated)", "… (base64 truncated)", "... (truncated)", "…"
PHONE_SPAN = 14
FORMAT_LIMIT, FORMAT_LEAST, LINE_LIMIT = 1000, 20, 80
CATEGORY_LABELS = {"preference": "用户偏好", "fact": "已知事实", "habit": "行为习惯", "rule": "用户规则"}
VISION_WARNING = "（该响应仅对本次前向视野互动有效，对后续前向视野互动意图属于无效的记忆，必须重新调用摄像头数据识别工具！）"
TEMPLATES = {"user/vehicle_status": "车辆状态：{{vehicle_status}}", "user/scene_description": "场景描述：{{scene_description}}", "user/summarize": "整合下面两段话，字数80字以内：\n{{first_part}}\n{{second_part}}"}


def mask_phones(text: Column) -> Column:
    """Four digits of every phone number hidden, inside longer runs of digits too."""
    return F.regexp_replace(text, PHONE, "$1****$2")


def cut(text: Column, limit: int, suffix: str) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(suffix))).otherwise(text)


def masked_cut(text: Column, limit: int, suffix: str) -> Column:
    """cut() of the masked text. Masking keeps the length, so only what the cut leaves is masked, and as much more as a number that begins there can take."""
    head = mask_phones(F.substring(text, 1, limit + PHONE_SPAN))
    return F.when(F.length(text) > limit, F.concat(F.substring(head, 1, limit), F.lit(suffix))).otherwise(head)


def redact_user_input(text: Column) -> Column:
    return masked_cut(text, TEXT_LIMIT, CUT)


def redact_result(text: Column) -> Column:
    return masked_cut(text, RESULT_LIMIT, CUT)


def voice_input(text: Column) -> Column:
    """What the root span of a persona keeps of an input: cut, not masked; null for none."""
    return F.when(text != "", cut(text, TEXT_LIMIT, CUT_VOICE))


def redact_arguments(text: Column) -> Column:
    """Long texts with signs of an image are cut short unmasked; all others as results."""
    image = F.lit(False)
    for sign in IMAGE_SIGNS:
        image = image | text.contains(sign)
    return F.when((F.length(text) > ARGUMENT_LIMIT) & image, F.concat(F.substring(text, 1, IMAGE_KEEP), F.lit(CUT_IMAGE))).otherwise(masked_cut(text, ARGUMENT_LIMIT, CUT))


def captured(text: Column, kind: Column, mode: Column) -> Column:
    """What a trace keeps of a text, argument or result: nothing (OFF), redacted, or cut only (FULL_DEBUG)."""
    redacted = F.when(kind == "text", redact_user_input(text)).when(kind == "argument", redact_arguments(text)).otherwise(redact_result(text))
    whole = F.when(kind == "text", cut(text, TEXT_LIMIT, CUT_PLAIN)).otherwise(cut(text, RESULT_LIMIT, CUT_PLAIN))
    return F.when(mode == "REDACTED", redacted).when(mode == "FULL_DEBUG", whole)


def format_message(kind: Column, text: Column, tool_name: Column | None = None, calls: Column | None = None) -> Column:
    """calls: names of the tools that an ai message asks for, before its text."""
    said = F.concat(F.lit("assistant:"), F.coalesce(text, F.lit("")))
    if calls is not None:
        said = F.when(F.size(calls) > 0, F.concat(F.lit("assistant_tool_calls:"), F.array_join(calls, ", "))).otherwise(said)
    out = F.when(kind == "system", F.concat(F.lit("system:"), text)).when(kind == "user", F.concat(F.lit("user:"), text)).when(kind.isin("ai", "assistant"), said)
    if tool_name is not None:
        out = out.when(kind == "tool", F.concat(F.lit("tool:"), tool_name, F.lit(":"), text))
    return out.otherwise(F.concat(kind, F.lit(":"), F.coalesce(text, F.lit(""))))


def cut_format(text: Column, limit: int = FORMAT_LIMIT) -> Column:
    return cut(text, max(FORMAT_LEAST, limit), CUT_PLAIN)


def summary_line(kind: Column, text: Column, tool_name: Column | None = None, calls: Column | None = None) -> Column:
    """A message as a line for the summariser; null for those that give none. Text goes before tool calls here."""
    asked = F.when(F.size(calls) > 0, F.concat(F.lit("AI：调用了工具 "), F.get(calls, 0))) if calls is not None else F.lit(None).cast("string")
    short = F.when(F.length(text) > LINE_LIMIT, F.concat(F.substring(text, 1, LINE_LIMIT), F.lit("…"))).otherwise(text)
    out = F.when(kind == "user", F.concat(F.lit("用户："), text)).when(kind.isin("ai", "assistant"), F.when(F.length(text) > 0, F.concat(F.lit("AI："), text)).otherwise(asked))
    return out.when(kind == "tool", F.concat(F.lit("工具["), tool_name, F.lit("]："), short)) if tool_name is not None else out


def render(body: Column, values: Mapping[str, Column]) -> Column:
    """Every {{name}} replaced, in the order given: a value that holds a later placeholder is itself filled."""
    for name, value in values.items():
        body = F.replace(body, F.lit("{{" + name + "}}"), value)
    return body


def missing_placeholders(body: Column, names: list[str]) -> Column:
    """Placeholders of a template that no value is given for; a caller treats any as an error."""
    return F.array_except(F.regexp_extract_all(body, F.lit(r"\{\{(\w+)\}\}"), F.lit(1)), F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"))


def category_label(category: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_LABELS.items() for x in kv]), category), category)


def local_time(ts: Column) -> Column:
    """UTC to GMT+8."""
    return F.from_utc_timestamp(ts.cast("timestamp"), "GMT+8")


def time_line(ts: Column) -> Column:
    return F.date_format(local_time(ts), "yyyy年MM月dd日 HH时mm分")


def session_name(ts: Column) -> Column:
    return F.concat(F.lit("S_"), F.date_format(local_time(ts), "yyyyMMdd_HHmmss"))


def memory_id(user: Column, session: Column) -> Column:
    """For display; join on both columns, as the joined text is ambiguous."""
    return F.concat_ws("_", user.cast("string"), session)


def status_text(message: Column, error_type: Column) -> Column:
    return F.coalesce(message, error_type, F.lit("Unknown error"))


def elapsed_ms(start_ns: Column, end_ns: Column) -> Column:
    return F.call_function("div", end_ns - start_ns, F.lit(1_000_000))


def http_error(status: Column) -> Column:
    """error.type of a response: its code from 400 on, else null."""
    return F.when(status >= 400, status.cast("string"))


def with_vision_warning(text: Column) -> Column:
    return F.concat(text, F.lit(VISION_WARNING))


def base64_plain(content: Column) -> Column:
    """Base64 in one line, whether or not the session chunks it."""
    return F.regexp_replace(F.base64(content), "[\r\n]", "")


def base64_lines(content: Column) -> Column:
    """Base64 in lines of 76 characters, each with its end, as the device's default form is."""
    return F.regexp_replace(base64_plain(content), "(.{1,76})", "$1\n")
