"""Requests and responses: routing, first response, timeouts, run outcomes, listeners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import occupancy

# Names, prefix and limits that results must match.
INPUT_TYPES = ["TEXT", "IMAGE", "VOICE", "CONTROL"]
COMMANDS, COMMAND_PREFIX = ["StartListen", "StopListen", "ClearChatMemory"], r"^@#%\^"
DEFAULT_USER, TIMEOUT_S, NO_TRACE, TIMEOUT_TEXT = "default_user", 15, "0" * 32, "系统: 请求超时"
MOST_ITERATIONS = {"chat": 10, "scene": 2, "vision": 1}
LOOP_TIMEOUT_S = {"chat": 30, "scene": 20, "vision": 20}


def route(input_type: Column) -> Column:
    """The input type if it has a handler, else null: such requests are dropped."""
    return F.when(input_type.isin(*INPUT_TYPES), input_type)


def command(text: Column) -> Column:
    """The control command of a text, with or without its prefix, or null."""
    bare = F.regexp_replace(text, COMMAND_PREFIX, "")
    return F.when(bare.isin(*COMMANDS), bare)


def user_key(session_id: Column) -> Column:
    return F.coalesce(session_id, F.lit(DEFAULT_USER))


def traced(trace_id: Column) -> Column:
    return F.coalesce((trace_id != "") & (trace_id != NO_TRACE), F.lit(False))


def first_response(responses: DataFrame, *rest: str) -> DataFrame:
    """Of the responses (request_id, arrival, ord) to a request the first; one is dispatched whatever comes later."""
    return responses.groupBy("request_id").agg(F.min(F.struct("arrival", "ord", *rest)).alias("r"), F.count("*").alias("n_responses")).select("request_id", "r.*", "n_responses")


def timed_out(enqueued: Column, answered: Column, seconds: int = TIMEOUT_S) -> Column:
    """From when the request was put in the queue, not from when work on it began."""
    return F.unix_micros(answered.cast("timestamp")) - F.unix_micros(enqueued.cast("timestamp")) > seconds * 1_000_000


def outcomes(iterations: DataFrame, most: int, timeout_s: int) -> DataFrame:
    """run_id, iterations_used, outcome, and duration_s where rows have end_s, of runs from rows (run_id, iteration, start_s since the run began, n_calls, all_vetoed).

    An iteration that starts after the timeout isn't run; a text reply (no calls) or a veto of all calls ends a run with success;
    a run that uses up its iterations without either fails.
    """
    rows = iterations.withColumn("late", F.col("start_s") > timeout_s)
    ends = (F.col("n_calls") == 0) | F.col("all_vetoed")
    first = lambda c: F.min(F.when(c, F.col("iteration")))
    ended = [F.collect_list(F.struct("iteration", "end_s")).alias("ended")] if "end_s" in iterations.columns else []
    out = rows.groupBy("run_id").agg(first(F.col("late")).alias("late_at"), first(ends & ~F.col("late") & (F.col("iteration") < most)).alias("end_at"), F.max("iteration").alias("last"), *ended)
    done = F.col("end_at").isNotNull() & (F.col("late_at").isNull() | (F.col("end_at") < F.col("late_at")))
    late = F.col("late_at").isNotNull() & (F.col("late_at") < most)
    used = F.when(done, F.col("end_at") + 1).when(late, F.col("late_at")).otherwise(F.least(F.col("last") + 1, F.lit(most))).cast("long")
    # until the end of the last iteration that ran; a run has some iterations at most
    spent = [F.array_max(F.transform(F.filter("ended", lambda x: x["iteration"] < used), lambda x: x["end_s"])).alias("duration_s")] if ended else []
    return out.select("run_id", used.alias("iterations_used"), *spent, F.when(done, "SUCCESS").when(late, "TIMEOUT").when(F.col("last") + 1 >= most, "MAX_ITERATIONS_REACHED").otherwise("RUNNING").alias("outcome"))


def terminated(no_calls: Column, vetoed: Column, exhausted: Column, mode: str = "any") -> Column:
    return (no_calls | vetoed | exhausted) if mode == "any" else (no_calls & vetoed & exhausted)


def collected(answers: DataFrame) -> DataFrame:
    """run_id, success, text, iterations_used, duration_ms of answers (run_id, iteration from 0, text, started_ms, now_ms): the answer as it is."""
    return answers.select("run_id", F.lit(True).alias("success"), "text", (F.col("iteration") + 1).alias("iterations_used"), (F.col("now_ms") - F.col("started_ms")).alias("duration_ms"))


def busy(runs: DataFrame) -> DataFrame:
    """Runs (agent, start, end, ord) with rejected: whether one that began before is still going on. A rejected run never began and keeps nobody waiting."""
    return occupancy.accepted(runs, "agent", "start", "end", "ord").withColumn("rejected", ~F.col("accepted")).drop("accepted")


#: Listeners up to which they are broadcast; beyond, responses meet them by day.
MOST_LISTENERS = 10_000


def fan_out(responses: DataFrame, listeners: DataFrame, most: int = MOST_LISTENERS) -> DataFrame:
    """A row for each response and listener (listener, since, until) registered when it comes."""
    registered = (F.col("arrival") >= F.col("since")) & (F.col("until").isNull() | (F.col("arrival") < F.col("until")))
    if listeners.limit(most + 1).count() <= most:
        return responses.join(F.broadcast(listeners), registered)
    days = responses.agg(F.to_date(F.min("arrival")).alias("low"), F.to_date(F.max("arrival")).alias("high")).first()
    start, end = F.greatest(F.to_date("since"), F.lit(days.low)), F.least(F.coalesce(F.to_date("until"), F.lit(days.high)), F.lit(days.high))
    by_day = listeners.withColumn("_day", F.explode(F.when(start <= end, F.sequence(start, end))))
    return responses.withColumn("_day", F.to_date("arrival")).join(by_day, "_day").filter(registered).drop("_day")


def answered(requests: DataFrame, responses: DataFrame, seconds: int = TIMEOUT_S) -> DataFrame:
    """request_id, ts, text, error_type: the first response (request_id, arrival, ord, text) to each request (request_id, enqueued), or a timeout where none comes in time."""
    first = first_response(responses, "text")
    due = F.col("enqueued") + F.make_dt_interval(secs=F.lit(seconds))
    late = F.col("arrival").isNull() | timed_out(F.col("enqueued"), F.col("arrival"), seconds)
    out = requests.join(first, "request_id", "left")
    return out.select("request_id", F.when(late, due).otherwise(F.col("arrival")).alias("ts"), F.when(late, F.lit(TIMEOUT_TEXT)).otherwise(F.col("text")).alias("text"), F.when(late, F.lit("TIMEOUT")).alias("error_type"))


def located(addresses: DataFrame, cities: DataFrame) -> DataFrame:
    """adcode of each address by exact name, '' where no city has it."""
    return addresses.join(cities, "address", "left").withColumn("adcode", F.coalesce("adcode", F.lit("")))
