"""Tables, and views that give fixture tables the roles of agent tables.

Each view has the same definition in SQL (``VIEWS``), for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

#: Canonical schemas for tables that callers bring along.
MESSAGES = "memory_id string, seq bigint, type string, text string, tool_name string, tool_calls array<struct<id:string,name:string,arguments:string>>"
MEMORY_EVENTS = "user_id string, category string, key_text string, value_text string, confidence double, ts timestamp, ord bigint"
TOOL_CALLS = "run_id string, seq bigint, iteration bigint, name string, arguments string, result string, vetoed boolean, veto_reason string, ts timestamp"
PROP_VALUES = "ts timestamp, prop int, area_id int, status int, value struct<i32:array<int>,f32:array<float>,i64:array<bigint>,bytes:binary,str:string>"
SPANS = "trace_id string, span_id string, parent_id string, name string, status string, attrs map<string,string>, start_ts timestamp, end_ts timestamp"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def templates(spark: SparkSession, path: str) -> DataFrame:
    """template (file name without its ending), body: whole UTF-8 text files, read once and small enough to broadcast."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("template"), F.col("value").alias("body"))


def documents_at(spark: SparkSession, path: str) -> DataFrame:
    """path, document (file name), body: one row for each UTF-8 text file under a folder."""
    read = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("document"), F.col("value").alias("body"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, content, and its base64 text, of image files."""
    return spark.read.format("binaryFile").load(path).select("path", "content", text.base64_plain(F.col("content")).alias("base64"))


def frames(spark: SparkSession, path: str, stream: bool = False, per_trigger: int = 100) -> DataFrame:
    """Camera frames from files <seqid>_<mode>.<type>: seqid, mode, ts (when the file was written), path, content.

    As a stream the file source keeps the offsets: a query that starts again with its checkpoint reads each frame once. Files named otherwise are left out, and so are empty ones, which Spark doesn't read.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", per_trigger) if stream else spark.read
    if stream:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    named = r"(?:^|/)([0-9]{1,9})_([0-9]{1,9})\.[A-Za-z]+$"
    rows = reader.format("binaryFile").load(path).filter(F.col("path").rlike(named))
    number = lambda k: F.regexp_extract("path", named, k).cast("int")
    return rows.select(number(1).alias("seqid"), number(2).alias("mode"), F.col("modificationTime").alias("ts"), "path", "content")


def packed_messages(packed: DataFrame) -> DataFrame:
    """Rows (memory_id, messages_json) to one row a message; text that can't be read gives no rows."""
    item = "array<struct<type:string,text:string,tool_name:string>>"
    return packed.select("memory_id", F.posexplode(F.from_json("messages_json", item)).alias("seq", "m")).select("memory_id", F.col("seq").cast("long").alias("seq"), "m.*")


def pack_messages(messages: DataFrame) -> DataFrame:
    """The reverse: one row for each memory_id with the whole list as JSON, in order."""
    item = F.struct("seq", "type", "text", "tool_name")
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda m: F.struct(m["type"].alias("type"), m["text"].alias("text"), m["tool_name"].alias("tool_name")))
    return messages.groupBy("memory_id").agg(F.to_json(listed).alias("messages_json"))


def _case(column: str, mapping: dict[str, str], otherwise: str | None = None) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when if out is None else out.when)(F.col(column) == k, F.lit(v))
    return out.otherwise(F.col(column) if otherwise is None else F.lit(otherwise))


def _case_sql(column: str, mapping: dict[str, str], otherwise: str | None = None) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {column if otherwise is None else repr(otherwise)} END"


CATEGORY_OF = {"signup": "fact", "purchase": "preference", "view": "habit", "error": "rule"}
TOOL_OF = {"signup": "set_ac_drive_temp", "purchase": "set_ac_fan_intensity", "view": "set_vehicle_spd", "click": "set_door_lock"}
SCENE_OF = {"signup": "雨雪天气", "purchase": "驾驶员疲劳", "view": "乘客休息", "click": "工程施工", "error": "其他"}
INPUT_OF = {"signup": "TEXT", "purchase": "IMAGE", "view": "VOICE", "click": "CONTROL"}
K = F.get_json_object


def v_msg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("memory_id"), F.col("turn").alias("seq"), F.col("role").alias("type"), "text")


def v_mem(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select("user_id", "event_type", _case("event_type", CATEGORY_OF).alias("category"), K("props", "$.k").alias("key_text"), F.col("event_id").cast("string").alias("value_text"), (F.col("value") / 500).alias("confidence"), "ts", F.col("event_id").alias("ord"))


def v_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    k, i = K("props", "$.k"), F.col("event_id") % 20
    odd = {0: "{}", 1: '{"arg0": null}', 2: '{"arg0": true}', 3: '{"arg0": false}', 4: '{"arg0": "TRUE"}', 5: '{"arg0": "false"}', 6: '{"arg0": "yes"}', 7: "broken", 8: '{"arg0": 0}', 9: '{"arg0": false}'}
    arguments = F.when(i == 10, F.concat(F.lit('{"arg0": "'), k, F.lit('"}'))).when(i == 11, F.concat(F.lit('{"arg0": '), k, F.lit(".75}")))
    # as the device's lenient parser takes them; the SQL has the same in strict JSON
    loose = {12: ("{arg0:", "}"), 13: ("{'arg0':'", "'}"), 14: ("{arg0=>", "; x=1} tail"), 17: ("{arg0: ", "")}
    for n, (before, after) in loose.items():
        arguments = arguments.when(i == n, F.concat(F.lit(before), k, F.lit(after)))
    odd |= {15: "/* on */ {arg0: TRUE} # end", 16: "{arg0: 0x10}"}
    for n, given in odd.items():
        arguments = arguments.when(i == n, F.lit(given))
    arguments = arguments.otherwise(F.concat(F.lit('{"arg0": '), k, F.lit("}")))
    return e.select(F.col("user_id").alias("vehicle"), F.col("event_id").alias("ord"), "ts", _case("event_type", TOOL_OF, "set_unknown").alias("name"), arguments.alias("arguments"))


CHAT_TYPE = {"signup": "system", "purchase": "user", "view": "ai", "click": "ai", "error": "tool"}


def v_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with tool calls and results."""
    e, kind = load(spark, sf_dir, "events"), F.col("event_type")
    said = F.when(kind == "error", F.repeat(K("props", "$.k"), F.lit(50))).when(kind != "click", F.concat(F.lit("m"), F.col("event_id").cast("string")))
    calls = F.when(kind == "click", F.array(F.lit("set_ac_status"), F.lit("set_door_lock"))).otherwise(F.array().cast("array<string>"))
    call = F.when(kind.isin("click", "error"), F.concat(F.lit("c"), F.floor(F.col("event_id") / 2).cast("string")))
    return e.select(F.col("user_id").alias("memory_id"), F.col("event_id").alias("seq"), _case("event_type", CHAT_TYPE).alias("type"), said.alias("text"), F.when(kind == "error", F.lit("set_door_lock")).alias("tool_name"), calls.alias("calls"), call.alias("call_id"))


def v_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("stream_id"), "ts", F.col("event_id").alias("ord"), _case("event_type", SCENE_OF).alias("name"), K("props", "$.k").cast("int").alias("k"))


def v_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "error"))
    return e.select("user_id", F.concat(F.lit("S_"), F.date_format("ts", "yyyyMMdd")).alias("session_id"), _case("event_type", {"signup": "create", "error": "end"}).alias("action"), "ts", F.col("event_id").alias("ord"))


#: The same in SQL.
VIEWS = {
    "v_msg": "SELECT conv_id AS memory_id, turn AS seq, role AS type, text FROM conversations",
    "v_mem": f"SELECT user_id, event_type, {_case_sql('event_type', CATEGORY_OF)} AS category, props->>'$.k' AS key_text, CAST(event_id AS VARCHAR) AS value_text, value / 500 AS confidence, ts, event_id AS ord FROM events",
    "v_tool": f"""SELECT user_id AS vehicle, event_id AS ord, ts, {_case_sql("event_type", TOOL_OF, "set_unknown")} AS name,
        CASE event_id % 20 WHEN 0 THEN '{{}}' WHEN 1 THEN '{{"arg0": null}}' WHEN 2 THEN '{{"arg0": true}}' WHEN 3 THEN '{{"arg0": false}}' WHEN 4 THEN '{{"arg0": "TRUE"}}' WHEN 5 THEN '{{"arg0": "false"}}' WHEN 6 THEN '{{"arg0": "yes"}}' WHEN 7 THEN 'broken'
        WHEN 8 THEN '{{"arg0": 0}}' WHEN 9 THEN '{{"arg0": false}}' WHEN 10 THEN '{{"arg0": "' || (props->>'$.k') || '"}}' WHEN 11 THEN '{{"arg0": ' || (props->>'$.k') || '.75}}' WHEN 13 THEN '{{"arg0": "' || (props->>'$.k') || '"}}' WHEN 15 THEN '{{"arg0": true}}' WHEN 16 THEN '{{"arg0": 16}}' WHEN 17 THEN '{{arg0: ' || (props->>'$.k')
        ELSE '{{"arg0": ' || (props->>'$.k') || '}}' END AS arguments FROM events""",
    "v_chat": f"""SELECT user_id AS memory_id, event_id AS seq, {_case_sql("event_type", CHAT_TYPE)} AS type, CASE WHEN event_type = 'error' THEN repeat(props->>'$.k', 50) WHEN event_type <> 'click' THEN 'm' || event_id END AS text,
        CASE WHEN event_type = 'error' THEN 'set_door_lock' END AS tool_name, CASE WHEN event_type = 'click' THEN ['set_ac_status', 'set_door_lock'] ELSE []::VARCHAR[] END AS calls, CASE WHEN event_type IN ('click', 'error') THEN 'c' || (event_id // 2) END AS call_id FROM events""",
    "v_frame": f"SELECT user_id AS stream_id, ts, event_id AS ord, {_case_sql('event_type', SCENE_OF)} AS name, CAST(props->>'$.k' AS INTEGER) AS k FROM events",
    "v_session": f"SELECT user_id, 'S_' || strftime(ts, '%Y%m%d') AS session_id, {_case_sql('event_type', {'signup': 'create', 'error': 'end'})} AS action, ts, event_id AS ord FROM events WHERE event_type IN ('signup', 'error')",
}


def with_views(sql: str, *names: str) -> str:
    """The query with the views that it names in front."""
    used = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in sql or n in names]
    body = sql.strip()
    if not used:
        return body
    return "WITH " + ", ".join(used) + (", " + body[5:] if body.startswith("WITH ") else " " + body)


def time_text(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def time_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"
