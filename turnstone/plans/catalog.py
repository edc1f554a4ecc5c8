"""Every operator as a named query over the fixture tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jsonx, text
from ..operators import memory, messages, personas, properties, requests, safety, scenes, sessions, spans, tools
from ..sources.tables import load, time_sql, time_text, v_chat, v_frame, v_mem, v_msg, v_session, v_tool, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
K = lambda: F.get_json_object("props", "$.k")
SQL_K = "props->>'$.k'"


def query(sql: str) -> Callable[[Query], Query]:
    def named(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, with_views(sql)
        return f

    return named


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(map(_q, values)) + ")"


def _map_sql(column: str, mapping: dict[str, str], otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in mapping.items()) + f" ELSE {otherwise} END"


# ---- memories

_CAT = f"CASE WHEN category IN {_in(jsonx.CATEGORIES)} THEN category ELSE 'fact' END"
_MEM = f"""n AS (SELECT user_id, {_CAT} AS category, key_text, value_text, confidence, ts, ord FROM v_mem),
    l AS (SELECT *, row_number() OVER (PARTITION BY user_id, category, key_text ORDER BY ts DESC, ord DESC) AS rn, min(ts) OVER (PARTITION BY user_id, category, key_text) AS created_at FROM n),
    mem AS (SELECT user_id, category, key_text, value_text, confidence, created_at, ts AS updated_at FROM l WHERE rn = 1)"""
_TOP = f"""{_MEM}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, updated_at DESC, category, key_text) AS rank FROM mem), top AS (SELECT * FROM r WHERE rank <= 10)"""


@query(f"WITH {_MEM} SELECT user_id, category, key_text, value_text, confidence, {time_sql('created_at')} AS created_at, {time_sql('updated_at')} AS updated_at, 0::BIGINT AS access_count FROM mem")
def memory_upsert(spark, d):
    return memory.upsert(v_mem(spark, d)).withColumns({c: time_text(c) for c in ("created_at", "updated_at")}).drop("ord")


def _top(spark, d):
    return memory.top_per_user(memory.upsert(v_mem(spark, d)), 10)


@query(f"WITH {_TOP} SELECT user_id, rank::INTEGER AS rank, category, key_text, value_text, confidence FROM top")
def memory_topk_per_user(spark, d):
    return _top(spark, d).select("user_id", "rank", "category", "key_text", "value_text", "confidence")


@query(f"WITH {_TOP} SELECT user_id, category, min(rank)::INTEGER AS first_rank, count(*) AS n_entries, coalesce(string_agg(value_text, '|' ORDER BY rank) FILTER (confidence >= 0.5), '') AS shown FROM top GROUP BY user_id, category")
def memory_grouped(spark, d):
    g = memory.grouped(_top(spark, d))
    return g.select("user_id", "category", "first_rank", F.size("entries").cast("long").alias("n_entries"), F.array_join(F.transform(memory.shown(), lambda e: e["value_text"]), "|").alias("shown"))


@query(rf"""WITH {_TOP}, g AS (SELECT user_id, min(rank) AS fr, chr(10) || {_map_sql("category", text.CATEGORY_LABELS, "category")} || '：' || coalesce(string_agg(chr(10) || '  · ' || value_text, '' ORDER BY rank) FILTER (confidence >= 0.5), '') AS t FROM top GROUP BY user_id, category)
    SELECT user_id, chr(10) || chr(10) || '【长期记忆】' || string_agg(t, '' ORDER BY fr) AS prompt_text FROM g GROUP BY user_id""")
def memory_prompt_text(spark, d):
    return memory.prompt_text(_top(spark, d))


@query(rf"""WITH {_TOP}, g AS (SELECT user_id, min(rank) AS fr, chr(10) || {_map_sql("category", text.CATEGORY_LABELS, "category")} || '：' || coalesce(string_agg(chr(10) || '  · ' || value_text, '' ORDER BY rank) FILTER (confidence >= 0.5), '') AS t FROM top GROUP BY user_id, category),
    p AS (SELECT user_id, chr(10) || chr(10) || '【长期记忆】' || string_agg(t, '' ORDER BY fr) AS pt FROM g GROUP BY user_id)
    SELECT b.user_id, 'base ' || b.user_id || coalesce(chr(10) || pt, '') AS prompt FROM (SELECT user_id FROM v_mem UNION SELECT c_custkey FROM customer) b LEFT JOIN p USING (user_id)""")
def memory_prepared_prompt(spark, d):
    users = v_mem(spark, d).select("user_id").union(load(spark, d, "customer").select("c_custkey")).distinct()
    base = users.select("user_id", F.concat(F.lit("base "), F.col("user_id").cast("string")).alias("body"))
    return memory.prepared_prompt(base, memory.prompt_text(_top(spark, d)))


@query("""WITH w AS (SELECT user_id, key_text, max(row(ts, ord)) AS last FROM v_mem WHERE event_type <> 'click' GROUP BY ALL)
    SELECT w.user_id, w.key_text, count(r.ord) AS access_count FROM w LEFT JOIN v_mem r ON r.user_id = w.user_id AND r.key_text = w.key_text AND r.event_type = 'click' AND row(r.ts, r.ord) > w.last GROUP BY ALL""")
def memory_access_count(spark, d):
    m = v_mem(spark, d)
    return memory.access_counts(m.filter("event_type <> 'click'"), m.filter("event_type = 'click'"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, key_text ORDER BY ts DESC, ord DESC) AS rn FROM v_mem) SELECT user_id, key_text, value_text FROM r WHERE rn = 1 AND event_type <> 'error'""")
def memory_delete_tombstone(spark, d):
    m = v_mem(spark, d)
    return memory.surviving(m.filter("event_type <> 'error'"), m.filter("event_type = 'error'"))


def _model_output() -> Column:
    """Answers of a model, good and bad, made of an event."""
    i, k, e = F.col("ord") % 10, F.col("key_text"), F.col("value_text")
    c = (F.col("ord") % 100).cast("string")
    conf = F.concat(F.lit("0."), F.lpad(c, 2, "0"))
    one = F.concat(F.lit('{"category":"preference","key":"k'), k, F.lit('","value":"'), e, F.lit('","confidence":'), conf, F.lit("}"))
    return (
        F.when(i == 0, F.concat(F.lit("```json\n["), one, F.lit("]\n```"))).when(i == 1, one).when(i == 2, F.lit("不是 JSON")).when(i == 3, F.concat(F.lit('[7, "x", {"category":"zzz","key":"a","value":{"b":1}}, '), one, F.lit("]")))
        .when(i == 4, F.concat(F.lit("["), one)).when(i == 5, F.concat(F.lit('[{"category":"odd","key":"n","value":'), e, F.lit("}]"))).when(i == 6, F.concat(F.lit('[{"key":"s","value":"v","confidence":"abc"}, {"key":"","value":"v"}]')))
        .when(i == 8, F.concat(F.lit("[{category:preference, 'key':'q'; value=['"), e, F.lit("'],confidence:0.9}, {key:b, value:[1,2]}, {key:c, value:[]}, {key:[[d]], value:{}},] // end")))
        .when(i == 9, F.lit('[{"key":"n","value":1.50,"confidence":"NaN"}, {"key":"m","value":1.50},]')).otherwise(F.lit("[]"))
    )


_ONE_SQL = """'{"category":"preference","key":"k' || key_text || '","value":"' || value_text || '","confidence":0.' || lpad((ord % 100)::VARCHAR, 2, '0') || '}'"""
_OUTPUT_SQL = f"""CASE ord % 10 WHEN 0 THEN '```json' || chr(10) || '[' || {_ONE_SQL} || ']' || chr(10) || '```' WHEN 1 THEN {_ONE_SQL} WHEN 2 THEN '不是 JSON' WHEN 3 THEN '[7, "x", {{"category":"zzz","key":"a","value":{{"b":1}}}}, ' || {_ONE_SQL} || ']'
    WHEN 4 THEN '[' || {_ONE_SQL} WHEN 5 THEN '[{{"category":"odd","key":"n","value":' || value_text || '}}]' WHEN 6 THEN '[{{"key":"s","value":"v","confidence":"abc"}}, {{"key":"","value":"v"}}]'
    WHEN 8 THEN '[{{"category":"preference","key":"q","value":"' || value_text || '","confidence":0.9}}]' WHEN 9 THEN '[0, {{"key":"m","value":"1.50"}}]' ELSE '[]' END"""


@query(rf"""WITH o AS (SELECT ord, trim(regexp_replace(regexp_replace({_OUTPUT_SQL}, '```json\s*', '', 'g'), '```\s*', '', 'g'), chr(10) || ' ') AS t FROM v_mem),
    a AS (SELECT ord, CAST(t AS JSON) AS j FROM o WHERE json_valid(t) AND CASE WHEN json_valid(t) THEN json_type(t) END = 'ARRAY'),
    e AS (SELECT ord, unnest(range(json_array_length(j)::BIGINT)) AS pos, j FROM a), x AS (SELECT ord, pos, json_extract(j, '$[' || pos || ']') AS v FROM e),
    c AS (SELECT ord, pos, coalesce(v->>'$.category', 'fact') AS category, coalesce(v->>'$.key', '') AS key_text, CASE WHEN json_type(v, '$.value') = 'OBJECT' THEN '' ELSE coalesce(v->>'$.value', '') END AS value_text, coalesce(try_cast(v->>'$.confidence' AS DOUBLE), 0.5) AS confidence FROM x WHERE json_type(v) = 'OBJECT')
    SELECT ord, pos, {_CAT} AS category, key_text, value_text, confidence FROM c WHERE key_text <> '' AND value_text <> '' AND confidence >= 0.3""")
def candidate_parse_filter(spark, d):
    return jsonx.candidates(v_mem(spark, d).select("ord", _model_output().alias("model_output")))


# ---- messages

_WINDOW = """s AS (SELECT *, min(CASE WHEN type = 'system' THEN seq END) OVER (PARTITION BY memory_id) AS sys FROM v_msg),
    p AS (SELECT *, coalesce(seq = sys, false) AS pinned FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY memory_id, pinned ORDER BY seq DESC) AS back FROM p),
    win AS (SELECT memory_id, seq, type, text FROM b WHERE pinned OR back <= 5 - CASE WHEN sys IS NULL THEN 0 ELSE 1 END)"""


@query(f"WITH {_WINDOW} SELECT * FROM win")
def msg_window_last_n(spark, d):
    return messages.window_last(v_msg(spark, d), 5)


@query("SELECT memory_id, count(*) AS message_count, (sum(length(coalesce(text, ''))) // 2)::BIGINT AS token_estimate, sum(length(coalesce(text, '')))::BIGINT AS input_chars FROM v_msg GROUP BY memory_id")
def msg_token_estimate(spark, d):
    return messages.stats(v_msg(spark, d))


_RULE = messages.Compaction(tokens=300, messages=4, keep=3)
_PLAN = rf"""s AS (SELECT *, count(*) OVER (PARTITION BY memory_id) AS n, sum(length(coalesce(text, ''))) OVER (PARTITION BY memory_id) // 2 AS tokens, min(CASE WHEN type = 'system' THEN seq END) OVER (PARTITION BY memory_id) AS sys FROM v_msg),
    h AS (SELECT *, coalesce(seq = sys, false) AS head FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY memory_id, head ORDER BY seq DESC) AS back FROM h),
    parts AS (SELECT *, CASE WHEN head THEN 'system' WHEN back <= {_RULE.keep} THEN 'kept' ELSE 'region' END AS part, CASE type WHEN 'user' THEN '用户：' || text WHEN 'assistant' THEN CASE WHEN length(text) > 0 THEN 'AI：' || text END END AS line FROM b),
    plan AS (SELECT memory_id, min(n) AS message_count, min(tokens)::BIGINT AS token_estimate, count(*) FILTER (part = 'region') AS n_region, count(*) FILTER (part = 'kept') AS n_kept, coalesce(string_agg(line || chr(10), '' ORDER BY seq) FILTER (part = 'region' AND line IS NOT NULL), '') AS summary_lines FROM parts GROUP BY memory_id),
    planned AS (SELECT memory_id, message_count, token_estimate, n_region, n_kept, token_estimate >= {_RULE.tokens} AND message_count > {_RULE.messages} AND n_region > 0 AS compact, summary_lines FROM plan)"""


@query(f"WITH {_PLAN} SELECT * FROM planned")
def msg_compaction_plan(spark, d):
    return messages.plan(v_msg(spark, d), _RULE)


@query(rf"""WITH {_PLAN}, s2 AS (SELECT memory_id, n_region || ':' || split_part(summary_lines, chr(10), 1) AS summary FROM planned WHERE compact),
    u AS (SELECT p.memory_id, CASE WHEN s2.summary IS NULL THEN 1 WHEN part = 'system' THEN 0 ELSE 2 END AS o, seq, type, text FROM parts p LEFT JOIN s2 USING (memory_id) WHERE s2.summary IS NULL OR part <> 'region'
          UNION ALL SELECT memory_id, 1, 0, 'user', '【对话摘要】' || summary FROM s2)
    SELECT memory_id, row_number() OVER (PARTITION BY memory_id ORDER BY o, seq) AS pos, type, text FROM u""")
def msg_compacted(spark, d):
    from ..models import stub_summary

    m = v_msg(spark, d)
    plans = messages.plan(m, _RULE)
    return messages.compacted(m, plans, plans.select("memory_id", stub_summary(F.col("n_region"), F.col("summary_lines")).alias("summary")), _RULE)


@query("WITH f AS (SELECT memory_id, string_agg(CASE type WHEN 'system' THEN 'system:' WHEN 'user' THEN 'user:' ELSE 'assistant:' END || coalesce(text, ''), chr(10) ORDER BY seq) AS t FROM v_msg GROUP BY memory_id) SELECT memory_id, CASE WHEN length(t) > 1000 THEN substr(t, 1, 1000) || '... (truncated)' ELSE t END AS formatted FROM f")
def msg_format_joined(spark, d):
    return messages.joined(v_msg(spark, d))


@query(f"""WITH {_WINDOW}, u AS (SELECT memory_id, 0 AS o, seq, type, text FROM (SELECT DISTINCT memory_id, 1 AS seq, 'user' AS type, '车辆状态：' || memory_id AS text FROM v_msg) UNION ALL SELECT memory_id, 1, seq, type, text FROM win)
    SELECT memory_id, row_number() OVER (PARTITION BY memory_id ORDER BY o, seq) AS pos, type, text FROM u""")
def msg_union_context(spark, d):
    m = v_msg(spark, d)
    status = text.render(F.lit(text.TEMPLATES["user/vehicle_status"]), {"vehicle_status": F.col("memory_id").cast("string")})
    context = m.select("memory_id").distinct().select("memory_id", F.lit(1).alias("chain_pos"), F.lit("user").alias("type"), status.alias("text"))
    return messages.with_context(context, messages.window_last(m, 5))


@query("""WITH c AS (SELECT memory_id, arg_min(text, seq) AS cur FROM v_msg WHERE type = 'system' GROUP BY memory_id), p AS (SELECT DISTINCT memory_id, CASE WHEN memory_id % 2 = 0 THEN 'new prompt' END AS body FROM v_msg)
    SELECT memory_id, coalesce(body, cur, 'new prompt') AS body FROM p LEFT JOIN c USING (memory_id) WHERE coalesce(body, cur, 'new prompt') IS DISTINCT FROM cur""")
def msg_prompt_refresh(spark, d):
    m = v_msg(spark, d)
    current = m.filter("type = 'system'").groupBy("memory_id").agg(F.min_by("text", "seq").alias("cur"))
    wanted = m.select("memory_id").distinct().join(current, "memory_id", "left").select("memory_id", F.coalesce(F.when(F.col("memory_id") % 2 == 0, F.lit("new prompt")), "cur", F.lit("new prompt")).alias("body"))
    return messages.changed_prompts(wanted, m)


@query("SELECT memory_id, seq, type, text FROM v_msg")
def msg_pack_round_trip(spark, d):
    from ..sources.tables import pack_messages, packed_messages

    packed = pack_messages(v_msg(spark, d).withColumn("tool_name", F.lit(None).cast("string")))
    return packed_messages(packed).select("memory_id", "seq", "type", "text")


_CALLED = "len(calls) > 0"


@query(rf"""SELECT memory_id, seq, CASE type WHEN 'system' THEN 'system:' || text WHEN 'user' THEN 'user:' || text WHEN 'ai' THEN CASE WHEN {_CALLED} THEN 'assistant_tool_calls:' || array_to_string(calls, ', ') ELSE 'assistant:' || coalesce(text, '') END WHEN 'tool' THEN 'tool:' || tool_name || ':' || text END AS formatted,
    CASE type WHEN 'user' THEN '用户：' || text WHEN 'ai' THEN CASE WHEN length(text) > 0 THEN 'AI：' || text WHEN {_CALLED} THEN 'AI：调用了工具 ' || calls[1] END WHEN 'tool' THEN '工具[' || tool_name || ']：' || CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END END AS line FROM v_chat""")
def msg_format_tools(spark, d):
    parts = F.col("type"), F.col("text"), F.col("tool_name"), F.col("calls")
    return v_chat(spark, d).select("memory_id", "seq", text.format_message(*parts).alias("formatted"), text.summary_line(*parts).alias("line"))


@query("SELECT c.memory_id, c.seq, c.call_id, r.text AS result FROM v_chat c LEFT JOIN v_chat r ON r.call_id = c.call_id AND r.type = 'tool' WHERE c.type = 'ai' AND c.call_id IS NOT NULL")
def msg_call_results(spark, d):
    m = v_chat(spark, d)
    return messages.with_results(m.filter("type = 'ai' and call_id is not null").drop("text"), m.filter("type = 'tool'")).select("memory_id", "seq", "call_id", "result")


# ---- sessions

_SESSION = """c AS (SELECT *, min(CASE WHEN action = 'create' THEN row(ts, ord) END) OVER (PARTITION BY user_id, session_id) AS c FROM v_session),
    life AS (SELECT user_id, session_id, min(CASE WHEN action = 'create' THEN ts END) AS created_at, min(CASE WHEN action = 'create' AND row(ts, ord) = c THEN ord END) AS created_ord, max(CASE WHEN action = 'end' AND row(ts, ord) > c THEN ts END) AS ended_at FROM c WHERE c IS NOT NULL GROUP BY user_id, session_id)"""


@query(f"WITH {_SESSION} SELECT user_id, session_id, {time_sql('created_at')} AS created_at, {time_sql('ended_at')} AS ended_at, ended_at IS NULL AS is_active FROM life")
def session_lifecycle(spark, d):
    return sessions.lifecycle(v_session(spark, d)).withColumns({c: time_text(c) for c in ("created_at", "ended_at")}).drop("created_ord")


@query(f"WITH {_SESSION}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, created_ord DESC) AS nth FROM life WHERE ended_at IS NULL) SELECT user_id, session_id, user_id || '_' || session_id AS memory_id FROM r WHERE nth = 1")
def session_latest_active(spark, d):
    s = sessions.latest_active(sessions.lifecycle(v_session(spark, d)))
    return s.select("user_id", "session_id", text.memory_id(F.col("user_id"), F.col("session_id")).alias("memory_id"))


@query(f"WITH {_SESSION}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, created_ord DESC) AS nth FROM life) SELECT user_id, session_id, nth::INTEGER AS nth FROM r WHERE nth <= 3")
def session_recent_k(spark, d):
    return sessions.recent(sessions.lifecycle(v_session(spark, d)), 3).select("user_id", "session_id", "nth")


@query(f"""WITH {_SESSION}, m AS (SELECT user_id, 'S_' || strftime(ts, '%Y%m%d') AS session_id, event_id AS seq, event_type AS type FROM events WHERE event_type IN ('view', 'click')) SELECT user_id, session_id, seq, type, ended_at IS NULL AS is_active FROM life JOIN m USING (user_id, session_id)""")
def session_messages(spark, d):
    said = load(spark, d, "events").filter("event_type in ('view', 'click')").select("user_id", F.concat(F.lit("S_"), F.date_format("ts", "yyyyMMdd")).alias("session_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"))
    return sessions.messages_of(sessions.lifecycle(v_session(spark, d)), said).select("user_id", "session_id", "seq", "type", "is_active")


@query("SELECT user_id, session_id, count(*) AS message_count, (sum(length(value_text)) // 2)::BIGINT AS token_estimate FROM (SELECT user_id, 'S_' || strftime(ts, '%Y%m%d') AS session_id, value_text FROM v_mem) GROUP BY user_id, session_id")
def session_stats(spark, d):
    m = v_mem(spark, d).select("user_id", F.concat(F.lit("S_"), F.date_format("ts", "yyyyMMdd")).alias("session_id"), F.lit("user").alias("type"), F.col("value_text").alias("text"))
    return m.groupBy("user_id", "session_id").agg(F.count("*").alias("message_count"), messages.tokens().alias("token_estimate"))


@query("""WITH e AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, ord ROWS UNBOUNDED PRECEDING) AS epoch FROM v_mem),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, epoch ORDER BY ts DESC, ord DESC) AS back FROM e WHERE event_type <> 'signup') SELECT user_id, epoch, ord FROM r WHERE back <= 3""")
def clear_epoch(spark, d):
    e = sessions.epochs(v_mem(spark, d), F.col("event_type") == "signup")
    return sessions.last_per_epoch(e.filter("event_type <> 'signup'"), 3).select("user_id", "epoch", "ord")


# ---- tools and safety

_n = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "[" + ", ".join(map(_q, x)) + "]" if isinstance(x, list) else _q(x)
_RULES = "rules(nth, name, field, kind, lo, hi, allowed, method, ok, off, bad, bad_end) AS (VALUES " + ", ".join(f"({k}, " + ", ".join(map(_n, (*r[:6], *r[7:]))) + ")" for k, r in enumerate(tools.RULES)) + ")"
_JAVA = "CASE jt WHEN 'UBIGINT' THEN 'java.lang.Integer' WHEN 'BIGINT' THEN 'java.lang.Integer' WHEN 'DOUBLE' THEN 'java.lang.Double' WHEN 'BOOLEAN' THEN 'java.lang.Boolean' WHEN 'VARCHAR' THEN 'java.lang.String' WHEN 'NULL' THEN 'org.json.JSONObject$1' END"


def _check_sql(calls: str) -> str:
    """Arguments as the lenient JSON library takes them: booleans or their texts, numbers or texts that read as one, fractions cut off."""
    return rf"""a AS (SELECT v.*, nth, field, kind, lo, hi, allowed, method, ok, off, bad, bad_end, json_valid(v.arguments) AS valid, CASE WHEN json_valid(v.arguments) THEN json_type(v.arguments, '$.arg0') END AS jt,
          CASE WHEN json_valid(v.arguments) THEN coalesce(v.arguments->>'$.arg0', CASE WHEN json_type(v.arguments, '$.arg0') = 'NULL' THEN 'null' END) END AS raw FROM {calls} v LEFT JOIN rules USING (name)),
    b AS (SELECT *, CASE WHEN jt IN ('BIGINT', 'UBIGINT') THEN try_cast(raw AS INTEGER) WHEN jt IN ('VARCHAR', 'DOUBLE') THEN trunc(try_cast(raw AS DOUBLE))::INTEGER END AS num, CASE WHEN jt IN ('BOOLEAN', 'VARCHAR') AND lower(raw) IN ('true', 'false') THEN lower(raw) = 'true' END AS flag FROM a),
    t AS (SELECT *, CASE kind WHEN 'range' THEN num::VARCHAR WHEN 'bool' THEN flag::VARCHAR ELSE raw END AS value,
          CASE WHEN raw IS NULL THEN '缺少参数: arg0 (方法: ' || coalesce(method, name) || ')' END AS missing, CASE WHEN NOT valid THEN 'Value ' || arguments || ' of type java.lang.String cannot be converted to JSONObject' END AS unreadable,
          CASE WHEN (kind = 'range' AND num IS NULL) OR (kind = 'bool' AND flag IS NULL) THEN 'Value ' || raw || ' at arg0 of type ' || {_JAVA} || ' cannot be converted to ' || CASE kind WHEN 'bool' THEN 'boolean' ELSE 'int' END END AS wrong FROM b),
    v AS (SELECT *, coalesce(CASE WHEN kind IS NULL THEN '无效的工具调用: ' || name END, '工具执行失败: ' || coalesce(unreadable, missing, wrong)) AS error, coalesce(CASE kind WHEN 'range' THEN num BETWEEN lo AND hi WHEN 'enum' THEN list_contains(allowed, value) ELSE kind IS NOT NULL END, false) AS fits FROM t),
    checked AS (SELECT *, error IS NULL AND fits AS accepted, CASE WHEN fits THEN CASE kind WHEN 'bool' THEN CASE WHEN value = 'true' THEN ok ELSE off END WHEN 'enum' THEN ok || value ELSE ok END ELSE bad || value || bad_end END AS reply FROM v)"""


_CHECK = f"{_RULES}, {_check_sql('v_tool')}"


def _checked(spark, d, calls: DataFrame | None = None):
    return tools.checked(tools.looked_up(v_tool(spark, d) if calls is None else calls, tools.registry(spark)))


@query(f"WITH {_CHECK} SELECT ord, name, kind, CASE WHEN kind IS NULL THEN '无效的工具调用: ' || name ELSE 'Success' END AS result FROM checked")
def tool_lookup(spark, d):
    return tools.looked_up(v_tool(spark, d), tools.registry(spark)).select("ord", "name", "kind", tools.result_text(F.lit(None).cast("string"), F.col("lookup_error")).alias("result"))


@query(f"WITH {_CHECK} SELECT ord, num AS int_arg, flag AS bool_arg, raw AS text_arg, coalesce(unreadable, missing) AS failure FROM checked")
def tool_arg_resolve(spark, d):
    c, given = jsonx.once(tools.looked_up(v_tool(spark, d), tools.registry(spark)), "given", jsonx.parsed(F.col("arguments"))), F.col("given")
    failure = F.coalesce(given["failure"], jsonx.missing_argument(given, F.coalesce("method", "name")))
    return c.select("ord", jsonx.int_argument(given).alias("int_arg"), jsonx.bool_argument(given).alias("bool_arg"), given["raw"].alias("text_arg"), failure.alias("failure"))


@query(f"WITH {_CHECK} SELECT ord, name, value, error, accepted FROM checked WHERE kind = 'range'")
def tool_validate_range(spark, d):
    return _checked(spark, d).filter("kind = 'range'").select("ord", "name", "value", "error", "accepted")


@query(f"WITH {_CHECK} SELECT ord, value, error, accepted FROM checked WHERE kind = 'bool'")
def tool_validate_bool(spark, d):
    return _checked(spark, d).filter("kind = 'bool'").select("ord", "value", "error", "accepted")


@query(f"""WITH c AS (SELECT ord, CASE ord % 3 WHEN 0 THEN 'set_chassis_mode' WHEN 1 THEN 'set_frag_intensity' ELSE 'set_dms_drive_emotion' END AS name, CASE ord % 5 WHEN 0 THEN '雪地模式' WHEN 1 THEN '关闭' WHEN 2 THEN '高兴' WHEN 3 THEN '低' ELSE '无' END AS value FROM v_tool)
    SELECT ord, name, value, CASE name WHEN 'set_chassis_mode' THEN value IN {_in(["普通模式", "越野模式", "雪地模式"])} WHEN 'set_frag_intensity' THEN value IN {_in(["关闭", "低", "中", "高"])} ELSE value IN {_in(["中性", "高兴", "惊讶", "悲伤", "愤怒", "厌恶", "恐惧"])} END AS accepted FROM c""")
def tool_validate_enum(spark, d):
    names = F.array(*map(F.lit, ["set_chassis_mode", "set_frag_intensity", "set_dms_drive_emotion"]))
    values = F.array(*map(F.lit, ["雪地模式", "关闭", "高兴", "低", "无"]))
    calls = v_tool(spark, d).select("ord", F.get(names, (F.col("ord") % 3).cast("int")).alias("name"), F.to_json(F.struct(F.get(values, (F.col("ord") % 5).cast("int")).alias("arg0"))).alias("arguments"))
    return _checked(spark, d, calls).select("ord", "name", "value", "accepted")


@query(f"WITH {_CHECK}, r AS (SELECT *, row_number() OVER (PARTITION BY vehicle, field ORDER BY ts DESC, ord DESC) AS rn FROM checked WHERE accepted) SELECT vehicle, field, value FROM r WHERE rn = 1")
def tool_state_last_accepted(spark, d):
    return tools.state(_checked(spark, d))


@query(f"""WITH {_CHECK}, r AS (SELECT *, row_number() OVER (PARTITION BY vehicle, field ORDER BY ts DESC, ord DESC) AS rn FROM checked WHERE accepted), s AS (SELECT vehicle, field, value FROM r WHERE rn = 1)
    SELECT v.vehicle, '{{"车速":' || coalesce(max(s.value) FILTER (field = '车速'), '70') || '}}' AS speed, '{{"左前门开启":false,"右前门开启":false,"左后门开启":false,"右后门开启":false,"车门闭锁":' || coalesce(max(s.value) FILTER (field = '车门闭锁'), 'false') || '}}' AS door,
    '{{"底盘行驶模式":"普通模式"}}' AS chassis FROM (SELECT DISTINCT vehicle FROM v_tool) v LEFT JOIN s USING (vehicle) GROUP BY v.vehicle""")
def tool_snapshot_json(spark, d):
    state = tools.state(_checked(spark, d), v_tool(spark, d).select("vehicle").distinct())
    return tools.snapshots(state, ["speed", "door", "chassis"])


@query("SELECT DISTINCT vehicle, (vehicle % 3 = 0) AS any_door_open FROM v_tool")
def tool_any_door_open(spark, d):
    doors = v_tool(spark, d).select("vehicle").distinct().select("vehicle", F.explode(F.array(*map(F.lit, tools.DOORS))).alias("field"))
    return tools.any_door_open(doors.withColumn("value", ((F.col("vehicle") % 3 == 0) & (F.col("field") == tools.DOORS[1])).cast("string")))


#: Each event registers a tool under its name; the last one counts.
@query(f"SELECT name, arg_max(kind, ord) AS kind, max(ord) AS nth, arg_max(hi, ord) AS hi FROM (SELECT name, CASE vehicle % 3 WHEN 0 THEN 'bool' WHEN 1 THEN 'range' ELSE 'enum' END AS kind, (vehicle * 7 % 100)::INTEGER AS hi, ord FROM v_tool) GROUP BY name")
def tool_last_registered(spark, d):
    v, kinds = v_tool(spark, d), F.array(F.lit("bool"), F.lit("range"), F.lit("enum"))
    told = v.select("name", F.get(kinds, (F.col("vehicle") % 3).cast("int")).alias("kind"), (F.col("vehicle") * 7 % 100).cast("int").alias("hi"), F.col("ord").alias("nth"))
    return tools.last_registered(told)


_GUARD = rf"""{_CHECK}, u AS (SELECT *, CASE WHEN name = 'set_vehicle_spd' AND accepted THEN num END AS spd FROM checked),
    g AS (SELECT *, coalesce(last_value(spd IGNORE NULLS) OVER (PARTITION BY vehicle ORDER BY ts, ord ROWS UNBOUNDED PRECEDING), 70) AS speed FROM u),
    vetoes AS (SELECT *, CASE WHEN name = 'set_door_lock' AND flag = false AND speed > 5 THEN '出于安全考虑，车速 ' || speed || ' km/h 时不允许解锁车门。请先停车。' END AS veto_reason FROM g)"""


@query(f"WITH {_GUARD} SELECT ord, vehicle, speed, veto_reason IS NOT NULL AS vetoed, veto_reason FROM vetoes WHERE name = 'set_door_lock'")
def guard_speed_asof(spark, d):
    return safety.guarded(v_tool(spark, d), tools.registry(spark)).filter("name = 'set_door_lock'").select("ord", "vehicle", "speed", "vetoed", "veto_reason")


@query(f"""WITH {_GUARD}, i AS (SELECT vehicle, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_calls, count(*) FILTER (veto_reason IS NOT NULL) AS n_vetoed FROM vetoes WHERE name = 'set_door_lock' GROUP BY ALL)
    SELECT *, n_calls = n_vetoed AND n_vetoed > 0 AS all_vetoed, CASE WHEN n_calls = n_vetoed AND n_vetoed > 0 THEN '安全原因已阻止所有工具调用。' END AS ends_with FROM i""")
def guard_all_vetoed(spark, d):
    calls = safety.guarded(v_tool(spark, d), tools.registry(spark)).filter("name = 'set_door_lock'").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return safety.iterations(calls, "vehicle", "day")


@query(f"WITH {_GUARD} SELECT ord, accepted AND veto_reason IS NULL AS accepted, veto_reason IS NULL AS success, CASE WHEN veto_reason IS NOT NULL THEN '[SAFETY VETO] ' || veto_reason ELSE coalesce(error, reply, 'Success') END AS output FROM vetoes")
def tool_success_semantics(spark, d):
    return safety.guarded(v_tool(spark, d), tools.registry(spark)).select("ord", "accepted", "success", "output")


#: Every tool is called in turn, with values that fit and values that don't.
_CALLS = """v_call AS (SELECT user_id AS vehicle, event_id AS ord, ts, r.name, CASE r.kind WHEN 'bool' THEN '{"arg0": ' || (k % 2 = 0)::VARCHAR || '}' WHEN 'range' THEN '{"arg0": ' || (k * 3) || '}'
    WHEN 'enum' THEN '{"arg0": "' || CASE WHEN k % 4 = 0 THEN '无' ELSE r.allowed[k % len(r.allowed) + 1] END || '"}' ELSE '{"arg0": "' || k || '"}' END AS arguments FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events) e JOIN rules r ON r.nth = event_id % 47)"""


def _calls(spark, d):
    rules = tools.registry(spark, tools.RULES).select("name", "kind", "allowed")
    nth = spark.createDataFrame([(k, r[0]) for k, r in enumerate(tools.RULES)], "nth int, name string")
    e = load(spark, d, "events").select(F.col("user_id").alias("vehicle"), F.col("event_id").alias("ord"), "ts", K().cast("int").alias("k"), (F.col("event_id") % len(tools.RULES)).cast("int").alias("nth"))
    k = F.col("k")
    chosen = F.when(k % 4 == 0, F.lit("无")).otherwise(F.get("allowed", k % F.array_size("allowed")))
    given = F.when(F.col("kind") == "bool", (k % 2 == 0).cast("string")).when(F.col("kind") == "range", (k * 3).cast("string")).otherwise(F.concat(F.lit('"'), F.when(F.col("kind") == "enum", chosen).otherwise(k.cast("string")), F.lit('"')))
    return e.join(nth, "nth").join(rules, "name").select("vehicle", "ord", "ts", "name", F.concat(F.lit('{"arg0": '), given, F.lit("}")).alias("arguments"))


def _snapshot_sql(part: str) -> str:
    kinds, default = {r[1]: r[2] for r in tools.RULES if r[1]}, {r[1]: r[6] for r in tools.RULES if r[1]} | tools.FIXED_FIELDS
    mark = lambda f: "'\"' || " if kinds.get(f) == "enum" else ""
    one = lambda f: f"""'"{f}":' || {mark(f)}coalesce(max(s.value) FILTER (field = {_q(f)}), {_q(default[f])}){" || '" + '"' + "'" if mark(f) else ""}"""
    return "'{' || " + " || ',' || ".join(map(one, tools.SNAPSHOTS[part])) + f" || '}}' AS {part}"


@query(f"""WITH {_RULES}, {_CALLS}, {_check_sql('v_call')}, r AS (SELECT *, row_number() OVER (PARTITION BY vehicle, field ORDER BY ts DESC, ord DESC) AS rn FROM checked WHERE accepted AND field IS NOT NULL), s AS (SELECT vehicle, field, value FROM r WHERE rn = 1)
    SELECT v.vehicle, {", ".join(map(_snapshot_sql, tools.SNAPSHOTS))} FROM (SELECT DISTINCT vehicle FROM v_call) v LEFT JOIN s USING (vehicle) GROUP BY v.vehicle""")
def tool_snapshots_all_parts(spark, d):
    calls = _calls(spark, d)
    return tools.snapshots(tools.state(_checked(spark, d, calls), calls.select("vehicle").distinct()))


@query(f"WITH {_RULES}, {_CALLS}, {_check_sql('v_call')} SELECT ord, name, accepted, coalesce(error, reply, 'Success') AS output FROM checked")
def tool_result_text(spark, d):
    return _checked(spark, d, _calls(spark, d)).select("ord", "name", "accepted", tools.result_text(tools.reply(), F.col("error")).alias("output"))


#: Errors are taken as doors that open and shut.
_DOORS = """doors AS (SELECT user_id AS vehicle, ts, event_id AS ord, ['左前门开启', '右前门开启', '左后门开启', '右后门开启'][user_id % 4 + 1] AS field, CAST(props->>'$.k' AS INTEGER) % 2 = 0 AS open FROM events WHERE event_type = 'error')"""


@query(f"""WITH {_CHECK}, {_DOORS}, u AS (SELECT ord, vehicle, ts, name, flag, error, accepted, reply, NULL::BOOLEAN AS open, 1 AS o FROM checked UNION ALL SELECT ord, vehicle, ts, NULL, NULL, NULL, NULL, NULL, open, 0 FROM doors),
    w AS (SELECT *, coalesce(last_value(open IGNORE NULLS) OVER (PARTITION BY vehicle ORDER BY ts, ord, o ROWS UNBOUNDED PRECEDING), false) AS door_open FROM u)
    SELECT ord, vehicle, door_open, accepted AND NOT (flag AND door_open) AS accepted, coalesce(error, CASE WHEN flag AND door_open THEN '车门未关闭，车门闭锁失败' ELSE reply END) AS output FROM w WHERE name = 'set_door_lock' AND flag""")
def tool_door_refusal(spark, d):
    doors = load(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").alias("vehicle"), "ts", F.col("event_id").alias("ord"), F.get(F.array(*map(F.lit, tools.DOORS)), (F.col("user_id") % 4).cast("int")).alias("field"), (K().cast("int") % 2 == 0).alias("open"))
    calls = safety.guarded(v_tool(spark, d), tools.registry(spark), doors)
    return calls.filter("name = 'set_door_lock' and value = 'true'").select("ord", "vehicle", "door_open", "accepted", "output")


#: Managers register the tools that were called in their vehicles.
@query("SELECT DISTINCT 'm' || vehicle % 3 AS manager, (vehicle % 3)::INTEGER AS nth, name FROM v_tool")
def tool_specs(spark, d):
    v = v_tool(spark, d)
    return tools.specs([(f"m{k}", v.filter(F.col("vehicle") % 3 == k).select("name").distinct()) for k in range(3)])


@query(f"WITH s AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{{\"车速\":' || ({SQL_K}) || '}}' WHEN 1 THEN '{{}}' ELSE 'broken' END AS status, CAST({SQL_K} AS INTEGER) AS k FROM events) SELECT event_id, CASE event_id % 3 WHEN 0 THEN k ELSE 0 END AS speed FROM s")
def speed_status(spark, d):
    i = F.col("event_id") % 3
    status = F.when(i == 0, F.concat(F.lit('{"车速":'), K(), F.lit("}"))).when(i == 1, F.lit("{}")).otherwise(F.lit("broken"))
    return load(spark, d, "events").select("event_id", jsonx.speed(status).alias("speed"))


# ---- scenes

_SC = f"CASE WHEN name IN {_in(scenes.SCENES)} THEN name ELSE '其他' END"


@query(f"SELECT ord, CASE WHEN k % 4 = 0 THEN '其他' ELSE {_SC} END AS name FROM v_frame")
def scene_normalise(spark, d):
    f = v_frame(spark, d)
    return f.select("ord", scenes.normalised(F.when(F.col("k") % 4 == 0, F.lit("nothing known")).otherwise(F.col("name"))).alias("name"))


@query("WITH f AS (SELECT *, lag(name) OVER (PARTITION BY stream_id ORDER BY ts, ord) AS prev FROM v_frame WHERE name NOT IN ('其他', '')) SELECT stream_id, ord, name FROM f WHERE name IS DISTINCT FROM prev")
def scene_change(spark, d):
    return scenes.changes(v_frame(spark, d)).select("stream_id", "ord", "name")


@query("""WITH r AS (SELECT *, coalesce(count(*) FILTER (k < 10) OVER (PARTITION BY stream_id ORDER BY ts, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM v_frame),
    f AS (SELECT *, lag(name) OVER (PARTITION BY stream_id, seg ORDER BY ts, ord) AS prev FROM r WHERE name NOT IN ('其他', '')) SELECT stream_id, ord, name FROM f WHERE name IS DISTINCT FROM prev""")
def scene_change_reset(spark, d):
    return scenes.changes(v_frame(spark, d), F.col("k") < 10).select("stream_id", "ord", "name")


_ALLOWED = "allowed(scene, name) AS (VALUES " + ", ".join(f"({_q(s)}, {_q(t)})" for s, ts in scenes.SCENE_TOOLS.items() for t in ts) + ")"


@query(f"WITH {_RULES}, {_ALLOWED} SELECT ord, scene, allowed.name FROM (SELECT ord, name AS scene FROM v_frame) f JOIN allowed USING (scene) SEMI JOIN rules ON allowed.name = rules.name")
def scene_tools_semi(spark, d):
    usable = scenes.tools_of(tools.registry(spark), scenes.whitelist(spark))
    return v_frame(spark, d).select("ord", F.col("name").alias("scene")).join(usable, "scene").select("ord", "scene", "name")


@query(f"WITH {_RULES}, {_ALLOWED} SELECT ord, scene, allowed.name FROM (SELECT ord, name AS scene FROM v_frame) f JOIN allowed USING (scene) ANTI JOIN rules ON allowed.name = rules.name")
def scene_tools_anti(spark, d):
    missing = scenes.missing_tools(scenes.whitelist(spark), tools.registry(spark))
    return v_frame(spark, d).select("ord", F.col("name").alias("scene")).join(missing, "scene").select("ord", "scene", "name")


@query(f"SELECT ord, name, {_map_sql('name', scenes.ACTIONS, repr(''))} AS action, CASE WHEN {_map_sql('name', scenes.ACTIONS, repr(''))} = '' THEN 'text' ELSE 'text+' || {_map_sql('name', scenes.ACTIONS, repr(''))} END AS merged FROM v_frame")
def scene_action(spark, d):
    a = scenes.action(F.col("name"))
    return v_frame(spark, d).select("ord", "name", a.alias("action"), scenes.merged(F.lit("text"), a, F.concat(F.lit("text+"), a)).alias("merged"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts DESC, ord DESC) AS rn FROM v_frame) SELECT stream_id, ord, name, k FROM r WHERE rn = 1")
def frame_latest(spark, d):
    return scenes.latest(v_frame(spark, d), "stream_id").drop("ts")


def _in_turn(free: str, key: str) -> str:
    """Sequential acceptance in SQL: rows n = 1, 2, ... of a key one after another, with until when it is occupied."""
    return f"""SELECT * FROM (WITH RECURSIVE f AS ({free}), t AS (SELECT {key}, n, ord, true AS begun, until AS free_at FROM f WHERE n = 1 UNION ALL
        SELECT f.{key}, f.n, f.ord, f.ts >= t.free_at, CASE WHEN f.ts >= t.free_at THEN f.until ELSE t.free_at END FROM t JOIN f ON f.{key} = t.{key} AND f.n = t.n + 1) SELECT * FROM t)"""


#: Purchases are requests that are answered after some hours, sign-ups are answers read aloud.
_FRAMES = f"""o AS (SELECT user_id AS stream_id, ts AS since, ts + INTERVAL 1 HOUR * CASE event_type WHEN 'purchase' THEN CAST({SQL_K} AS INTEGER) % 3 ELSE 1 END AS until FROM events WHERE event_type IN ('purchase', 'signup')),
    w AS (SELECT f.*, ts + INTERVAL 1 HOUR * (k % 13) AS until, EXISTS (SELECT 1 FROM o WHERE o.stream_id = f.stream_id AND o.since < f.ts AND f.ts < o.until) AS occupied FROM v_frame f)"""


@query(f"""WITH {_FRAMES}, t AS ({_in_turn("SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts, ord) AS n FROM w WHERE NOT occupied", "stream_id")}) SELECT ord, coalesce(begun, false) AS processed FROM w LEFT JOIN t USING (ord)""")
def frame_admission(spark, d):
    e = load(spark, d, "events").filter(F.col("event_type").isin("purchase", "signup"))
    hours = F.when(F.col("event_type") == "purchase", K().cast("int") % 3).otherwise(1)
    just_after = F.col("ts") + F.expr("INTERVAL 1 MICROSECOND")
    occupied = e.select(F.col("user_id").alias("stream_id"), just_after.alias("since"), (F.col("ts") + F.make_dt_interval(hours=hours)).alias("until"))
    return scenes.admitted(v_frame(spark, d), occupied, F.col("ts") + F.make_dt_interval(hours=F.col("k") % 13)).select("ord", "processed")


@query("SELECT ord, CASE WHEN k = 7 THEN 'task/front_view_qa' WHEN name IN ('', '其他', '无效场景') THEN 'system/assistant_default' ELSE 'system/assistant_scene' END AS prompt FROM v_frame")
def prompt_select(spark, d):
    earlier = F.when(F.col("k") == 7, F.lit("task/front_view_qa"))
    return v_frame(spark, d).select("ord", scenes.prompt_name(F.col("name"), earlier).alias("prompt"))


@query("SELECT ord, CASE WHEN k % 3 = 0 THEN '其他' ELSE name END AS name, CASE WHEN k % 3 = 0 THEN 'broken {' || k ELSE 'd' || k END AS description FROM v_frame")
def scene_json_round_trip(spark, d):
    said = F.when(F.col("k") % 3 == 0, F.concat(F.lit("broken {"), F.col("k").cast("string"))).otherwise(jsonx.scene_json(F.col("name"), F.concat(F.lit("d"), F.col("k").cast("string"))))
    return v_frame(spark, d).select("ord", jsonx.scene(said).alias("s")).select("ord", "s.name", "s.description")


# ---- requests

_INPUT = "CASE event_type WHEN 'signup' THEN 'TEXT' WHEN 'purchase' THEN 'IMAGE' WHEN 'view' THEN 'VOICE' WHEN 'click' THEN 'CONTROL' END"
_TEXT = f"CASE (CAST({SQL_K} AS INTEGER)) % 4 WHEN 0 THEN 'StartListen' WHEN 1 THEN '@#%^StopListen' WHEN 2 THEN '@#%^ClearChatMemory' ELSE 'hello' END"


@query(f"SELECT event_id, {_INPUT} AS route, CASE WHEN event_type = 'click' THEN CASE (CAST({SQL_K} AS INTEGER)) % 4 WHEN 0 THEN 'StartListen' WHEN 1 THEN 'StopListen' WHEN 2 THEN 'ClearChatMemory' END END AS command, coalesce(CASE WHEN event_id % 2 = 0 THEN 's' || user_id END, 'default_user') AS user_key FROM events WHERE event_type <> 'error'")
def request_route(spark, d):
    e = load(spark, d, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in {"signup": "TEXT", "purchase": "IMAGE", "view": "VOICE", "click": "CONTROL", "error": "BROKEN"}.items() for x in kv]), F.col("event_type"))
    said = F.get(F.array(*map(F.lit, ["StartListen", "@#%^StopListen", "@#%^ClearChatMemory", "hello"])), K().cast("int") % 4)
    r = e.withColumn("route", requests.route(kind)).filter("route is not null")
    session = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("s"), F.col("user_id").cast("string")))
    return r.select("event_id", "route", F.when(F.col("route") == "CONTROL", requests.command(said)).alias("command"), requests.user_key(session).alias("user_key"))


@query("WITH r AS (SELECT o_orderkey AS request_id, l_linenumber AS winner, count(*) OVER (PARTITION BY o_orderkey) AS n_responses, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS rn FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT request_id, winner, n_responses FROM r WHERE rn = 1")
def request_first_response(spark, d):
    o, li = load(spark, d, "orders").select("o_orderkey"), load(spark, d, "lineitem")
    r = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_orderkey").alias("request_id"), F.col("l_shipdate").alias("arrival"), F.col("l_linenumber").alias("ord"), "l_partkey", "l_suppkey")
    return requests.first_response(r, "l_partkey", "l_suppkey").select("request_id", F.col("ord").alias("winner"), "n_responses")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate) - epoch_us(o_orderdate) > 30 * 86400000000 AS timed_out FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def request_timeout_flag(spark, d):
    o, li = load(spark, d, "orders").select("o_orderkey", "o_orderdate"), load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", requests.timed_out(F.col("o_orderdate"), F.col("l_shipdate"), 30 * 86_400).alias("timed_out"))


def _runs(spark, d):
    """Events of a user and day as iterations of a run; clicks are text replies, errors have only vetoed calls."""
    e = load(spark, d, "events").withColumn("run_id", F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")))
    order = Window.partitionBy("run_id").orderBy("ts", "event_id")
    return e.select("run_id", (F.row_number().over(order) - 1).cast("long").alias("iteration"), (K().cast("int") / 2.5).alias("start_s"), (K().cast("int") / 2.5 + 2).alias("end_s"), F.when(F.col("event_type") == "click", 0).otherwise(1).alias("n_calls"), (F.col("event_type") == "error").alias("all_vetoed"))


@query(f"""WITH i AS (SELECT user_id || ':' || strftime(ts, '%Y%m%d') AS run_id, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y%m%d') ORDER BY ts, event_id) - 1 AS iteration, CAST({SQL_K} AS INTEGER) / 2.5 + 2 AS end_s, CAST({SQL_K} AS INTEGER) / 2.5 > 30 AS late, event_type IN ('click', 'error') AS ends FROM events),
    g AS (SELECT run_id, min(iteration) FILTER (late) AS late_at, min(iteration) FILTER (ends AND NOT late AND iteration < 3) AS end_at, max(iteration) AS last FROM i GROUP BY run_id),
    x AS (SELECT *, end_at IS NOT NULL AND (late_at IS NULL OR end_at < late_at) AS done, late_at IS NOT NULL AND late_at < 3 AS timeout FROM g),
    y AS (SELECT run_id, CASE WHEN done THEN end_at + 1 WHEN timeout THEN late_at ELSE least(last + 1, 3) END AS iterations_used, CASE WHEN done THEN 'SUCCESS' WHEN timeout THEN 'TIMEOUT' WHEN last + 1 >= 3 THEN 'MAX_ITERATIONS_REACHED' ELSE 'RUNNING' END AS outcome FROM x)
    SELECT run_id, iterations_used, max(end_s) FILTER (iteration < iterations_used) AS duration_s, outcome FROM y JOIN i USING (run_id) GROUP BY ALL""")
def run_outcome(spark, d):
    return requests.outcomes(_runs(spark, d), 3, 30)


@query(f"SELECT event_id, event_type = 'click' OR event_type = 'error' OR CAST({SQL_K} AS INTEGER) >= 90 AS any_stops, event_type = 'click' AND CAST({SQL_K} AS INTEGER) % 2 = 0 AND CAST({SQL_K} AS INTEGER) >= 90 AS all_stop FROM events")
def run_terminated(spark, d):
    k, kind = K().cast("int"), F.col("event_type")
    return load(spark, d, "events").select("event_id", requests.terminated(kind == "click", kind == "error", k >= 90).alias("any_stops"), requests.terminated(kind == "click", k % 2 == 0, k >= 90, "all").alias("all_stop"))


@query("""SELECT l_orderkey AS request_id, epoch_us(ts) AS ts_us, text, error_type FROM (WITH r AS (SELECT l_orderkey, l_shipdate, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, 'r' || l_partkey) AS rn FROM lineitem)
    SELECT o_orderkey AS l_orderkey, CASE WHEN late THEN o_orderdate + INTERVAL 2592000 SECOND ELSE l_shipdate END AS ts, CASE WHEN late THEN '系统: 请求超时' ELSE 'r' || l_partkey END AS text, CASE WHEN late THEN 'TIMEOUT' END AS error_type
    FROM (SELECT *, l_shipdate IS NULL OR epoch_us(l_shipdate) - epoch_us(o_orderdate) > 2592000000000 AS late FROM orders LEFT JOIN r ON o_orderkey = l_orderkey AND rn = 1))""")
def request_answer(spark, d):
    asked = load(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("enqueued"))
    got = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_shipdate").alias("arrival"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("r"), F.col("l_partkey").cast("string")).alias("text"))
    return requests.answered(asked, got, 30 * 86_400).withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")


@query(f"""SELECT ord AS event_id, NOT begun AS rejected FROM ({_in_turn("SELECT user_id, event_id AS ord, ts, ts + INTERVAL 6 HOUR AS until, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events", "user_id")})""")
def run_busy(spark, d):
    e = load(spark, d, "events").select("event_id", F.col("user_id").alias("agent"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("end"), F.col("event_id").alias("ord"))
    return requests.busy(e).select("event_id", "rejected")


@query("""SELECT event_id, n AS listener FROM events JOIN (VALUES ('all', TIMESTAMP '2000-01-01', NULL), ('early', TIMESTAMP '2000-01-01', TIMESTAMP '2024-01-10'), ('late', TIMESTAMP '2024-01-20', NULL)) AS l(n, since, until) ON ts >= since AND (until IS NULL OR ts < until)""")
def listener_fan_out(spark, d):
    rows = [("all", "2000-01-01", None), ("early", "2000-01-01", "2024-01-10"), ("late", "2024-01-20", None)]
    who = spark.createDataFrame(rows, "listener string, since string, until string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("since", "until")})
    r = load(spark, d, "events").select("event_id", F.col("ts").alias("arrival"))
    return requests.fan_out(r, who).select("event_id", "listener")


@query("SELECT c_custkey, coalesce(CASE WHEN n_regionkey <> 2 THEN 'R' || n_regionkey || '-' || n_nationkey END, '') AS adcode FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def geocode_lookup(spark, d):
    cities = load(spark, d, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("address"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit("-"), F.col("n_nationkey").cast("string")).alias("adcode"))
    return requests.located(load(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("address")), cities).select("c_custkey", "adcode")


@query(f"SELECT event_id AS run_id, true AS success, event_type AS text, CAST({SQL_K} AS INTEGER) % 10 + 1 AS iterations_used, CAST({SQL_K} AS INTEGER) * 7 AS duration_ms FROM events")
def run_collected(spark, d):
    k = K().cast("int")
    return requests.collected(load(spark, d, "events").select(F.col("event_id").alias("run_id"), (k % 10).alias("iteration"), F.col("event_type").alias("text"), k.alias("started_ms"), (k * 8).alias("now_ms")))


@query("SELECT doc_id, regexp_replace(to_base64(encode(text)), '(.{1,76})', '\\1' || chr(10), 'g') AS content FROM documents")
def image_base64(spark, d):
    return load(spark, d, "documents").select("doc_id", text.base64_lines(F.col("text").cast("binary")).alias("content"))


# ---- redaction and text

_PHONE = r"((?:\+86)?1[3-9]\d)\d{4}(\d{4})"
_MASK = rf"regexp_replace(text, '{_PHONE}', '\1****\2', 'g')"


def _cut_sql(x: str, n: int, suffix: str) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '{suffix}' ELSE {x} END"


_ARG = f"CASE WHEN length(text) > 200 AND (contains(text, '/9j/') OR contains(text, 'iVBOR') OR contains(text, 'base64') OR contains(text, 'Base64')) THEN substr(text, 1, 100) || '… (base64 truncated)' ELSE {_cut_sql(_MASK, 200, '… (truncated)')} END"


@query(f"SELECT doc_id, {_cut_sql(_MASK, 500, '… (truncated)')} AS redacted FROM documents")
def redact_user_input(spark, d):
    return load(spark, d, "documents").select("doc_id", text.redact_user_input(F.col("text")).alias("redacted"))


@query(f"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'base64,' || text ELSE text END AS text FROM documents) SELECT doc_id, {_ARG} AS redacted FROM t")
def redact_arguments(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("base64,"), F.col("text"))).otherwise(F.col("text"))
    return load(spark, d, "documents").select("doc_id", text.redact_arguments(t).alias("redacted"))


@query(f"SELECT doc_id, {_cut_sql(_MASK, 200, '… (truncated)')} AS redacted FROM documents")
def redact_result(spark, d):
    return load(spark, d, "documents").select("doc_id", text.redact_result(F.col("text")).alias("redacted"))


@query(f"""SELECT doc_id, mode, kind, CASE mode WHEN 'REDACTED' THEN CASE kind WHEN 'text' THEN {_cut_sql(_MASK, 500, "… (truncated)")} WHEN 'argument' THEN {_ARG} ELSE {_cut_sql(_MASK, 200, "… (truncated)")} END
    WHEN 'FULL_DEBUG' THEN CASE kind WHEN 'text' THEN {_cut_sql("text", 500, "... (truncated)")} ELSE {_cut_sql("text", 200, "... (truncated)")} END END AS captured
    FROM documents, (VALUES ('OFF'), ('REDACTED'), ('FULL_DEBUG')) AS m(mode), (VALUES ('text'), ('argument'), ('result')) AS k(kind)""")
def capture_mode(spark, d):
    each = [F.struct(F.lit(m).alias("mode"), F.lit(k).alias("kind"), text.captured(F.col("text"), F.lit(k), F.lit(m)).alias("captured")) for m in ("OFF", "REDACTED", "FULL_DEBUG") for k in ("text", "argument", "result")]
    return load(spark, d, "documents").select("doc_id", F.inline(F.array(*each)))


@query("SELECT doc_id, CASE WHEN text = '' THEN NULL WHEN length(text) > 500 THEN substr(text, 1, 500) || '…' ELSE text END AS user_input FROM documents")
def voice_input_cut(spark, d):
    return load(spark, d, "documents").select("doc_id", text.voice_input(F.col("text")).alias("user_input"))


@query("WITH n AS (SELECT memory_id, seq, text, lead(text) OVER (PARTITION BY memory_id ORDER BY seq) AS answer FROM v_msg) SELECT memory_id, seq, replace(replace('U={{user_message}} A={{ai_response}}', '{{user_message}}', CASE WHEN seq % 2 = 0 THEN text ELSE 'see {{ai_response}}' END), '{{ai_response}}', coalesce(answer, '')) AS prompt FROM n")
def template_render(spark, d):
    m = v_msg(spark, d).withColumn("answer", F.lead("text").over(Window.partitionBy("memory_id").orderBy("seq")))
    said = F.when(F.col("seq") % 2 == 0, F.col("text")).otherwise(F.lit("see {{ai_response}}"))
    return m.select("memory_id", "seq", text.render(F.lit("U={{user_message}} A={{ai_response}}"), {"user_message": said, "ai_response": F.coalesce("answer", F.lit(""))}).alias("prompt"))


@query("SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y年%m月%d日 %H时%M分') AS time_line, strftime(ts + INTERVAL 8 HOUR, 'S_%Y%m%d_%H%M%S') AS session_name FROM events")
def time_text_query(spark, d):
    return load(spark, d, "events").select("event_id", text.time_line(F.col("ts")).alias("time_line"), text.session_name(F.col("ts")).alias("session_name"))


QUERIES["time_text"], SQL["time_text"] = QUERIES.pop("time_text_query"), SQL.pop("time_text_query")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'said ' || event_id END, CASE WHEN event_id % 3 = 1 THEN event_type END, 'Unknown error') AS status_text, (CAST(value * 1000000 AS BIGINT) // 1000000)::BIGINT AS elapsed_ms, CASE WHEN event_type = 'view' THEN event_type || '（该响应仅对本次前向视野互动有效，对后续前向视野互动意图属于无效的记忆，必须重新调用摄像头数据识别工具！）' ELSE event_type END AS answer FROM events")
def response_text(spark, d):
    e, i = load(spark, d, "events"), F.col("event_id") % 3
    said = text.status_text(F.when(i == 0, F.concat(F.lit("said "), F.col("event_id").cast("string"))), F.when(i == 1, F.col("event_type")))
    ns = F.round(F.col("value") * 1_000_000).cast("long")
    return e.select("event_id", said.alias("status_text"), text.elapsed_ms(F.lit(0), ns).alias("elapsed_ms"), F.when(F.col("event_type") == "view", text.with_vision_warning(F.col("event_type"))).otherwise(F.col("event_type")).alias("answer"))


# ---- spans, maps, properties

@query("SELECT o_orderkey AS trace_id, count(l_orderkey) AS n_children, count(*) FILTER (l_returnflag = 'R') AS n_errors, coalesce(string_agg(DISTINCT l_linestatus || l_returnflag, ', ' ORDER BY l_linestatus || l_returnflag), '') AS names FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def span_rollup(spark, d):
    roots = load(spark, d, "orders").select(F.col("o_orderkey").alias("trace_id"))
    child = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("trace_id"), "l_linestatus", "l_returnflag")
    return spans.rollup(roots, child, F.concat("l_linestatus", "l_returnflag"), F.col("l_returnflag") == "R")


@query("SELECT l_orderkey AS trace_id, l_linenumber, l_partkey, l_suppkey, 'agent.request' AS root_name, o_orderpriority AS priority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def span_children(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("trace_id"), F.lit("root").alias("span_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("agent.request").alias("name"), F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("attrs"))
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("trace_id"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")]).alias("span_id"), F.lit("root").alias("parent_id"), F.lit("tool.execute").alias("name"), F.create_map(F.lit("line"), F.col("l_linenumber").cast("string")).alias("attrs"))
    part = lambda i: F.split("span_id", "-")[i]
    return spans.children(o.unionByName(li)).select("trace_id", part(0).cast("int").alias("l_linenumber"), part(1).cast("long").alias("l_partkey"), part(2).cast("long").alias("l_suppkey"), "root_name", F.col("root_attrs")["priority"].alias("priority"))


@query(f"SELECT event_id, CASE WHEN CAST({SQL_K} AS INTEGER) * 6 >= 400 OR event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS span_status, CASE WHEN event_type = 'error' THEN 'IOException' WHEN CAST({SQL_K} AS INTEGER) * 6 >= 400 THEN (CAST({SQL_K} AS INTEGER) * 6)::VARCHAR END AS error_type FROM events")
def span_http_error(spark, d):
    e = load(spark, d, "events").select("event_id", (K().cast("int") * 6).alias("status"), F.when(F.col("event_type") == "error", F.lit("IOException")).alias("error"))
    return spans.http_span(e).select("event_id", "span_status", "error_type")


@query(f"WITH {_GUARD} SELECT ord, 'agent.iteration=' || ord % 10 || ';tool.name=' || name || ';tool.success=' || (veto_reason IS NULL)::VARCHAR || coalesce(';tool.safety_veto_reason=' || veto_reason, '') AS attrs FROM vetoes")
def span_tool_attributes(spark, d):
    made = spans.tool_span(safety.guarded(v_tool(spark, d), tools.registry(spark)).withColumn("iteration", F.col("ord") % 10))
    return made.select("ord", _shown("agent.iteration", "tool.name", "tool.success", "tool.safety_veto_reason"))


#: A request without a text has length 0; null attributes are left out.
_REQUESTS = """q AS (SELECT event_id AS request_id, CASE event_id % 3 WHEN 0 THEN 'chat' WHEN 1 THEN 'scene' ELSE 'vision_qa' END AS persona, CASE WHEN event_id % 7 > 0 THEN user_id END AS user_id, CASE WHEN event_id % 5 > 0 THEN event_type || ' 13812345678' END AS text, event_type FROM events),
    a AS (SELECT *, 'agent.persona=' || persona || coalesce(';user.id=' || user_id, '') || ';request.id=' || request_id || ';user.input.length=' || coalesce(length(text), 0) || coalesce(';user.input=' || event_type || CASE WHEN text IS NOT NULL THEN ' 138****5678' END, '') AS attrs FROM q)"""


def _requests(spark, d):
    i = F.col("event_id")
    persona = F.get(F.array(F.lit("chat"), F.lit("scene"), F.lit("vision_qa")), (i % 3).cast("int"))
    r = load(spark, d, "events").select(i.alias("request_id"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("source_app"), F.lit(None).cast("string").alias("input_type"), persona.alias("persona"), F.when(i % 7 > 0, F.col("user_id")).alias("user_id"), F.when(i % 5 > 0, F.concat("event_type", F.lit(" 13812345678"))).alias("text"))
    return spans.request_span(r)


_REQUEST_KEYS = ("agent.persona", "user.id", "request.id", "session.id", "user.input.length", "user.input")


@query(f"WITH {_REQUESTS} SELECT request_id, attrs FROM a")
def span_request(spark, d):
    return _requests(spark, d).select("request_id", _shown(*_REQUEST_KEYS))


@query(f"WITH {_REQUESTS} SELECT request_id, attrs || CASE WHEN event_type = 'click' THEN '' ELSE ';response.success=' || (event_type <> 'error')::VARCHAR || ';response.text.length=' || CASE WHEN event_type = 'view' THEN 0 ELSE length(event_type) END || CASE WHEN event_type = 'error' THEN ';response.error_type=MODEL' ELSE '' END END AS attrs FROM a")
def span_root_response(spark, d):
    kind = F.col("event_type")
    said = load(spark, d, "events").filter(kind != "click").select(F.col("event_id").alias("request_id"), (kind != "error").alias("success"), F.when(kind != "view", kind).alias("text"), F.when(kind == "error", F.lit("MODEL")).alias("error_type"))
    return spans.answered(_requests(spark, d), said).select("request_id", _shown(*_REQUEST_KEYS, "response.success", "response.text.length", "response.error_type"))


@query(f"SELECT event_id, event_id % 2 <> 0 AS traced FROM events")
def trace_active(spark, d):
    i = F.col("event_id")
    trace = F.when(i % 4 == 0, F.lit("")).when(i % 4 == 2, F.lit("0" * 32)).otherwise(i.cast("string"))
    return load(spark, d, "events").select("event_id", requests.traced(trace).alias("traced"))


@query(f"SELECT event_id, 'a=' || CASE WHEN event_id % 2 = 0 THEN 'right' ELSE 'left' END || ',k=' || ({SQL_K}) AS merged FROM events")
def map_merge(spark, d):
    left = F.create_map(F.lit("a"), F.lit("left"), F.lit("k"), K())
    right = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("a"), F.lit("right"))).otherwise(F.create_map(F.lit("k"), K()))
    m = F.array_sort(F.map_entries(spans.merged(left, right)))
    return load(spark, d, "events").select("event_id", F.array_join(F.transform(m, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("merged"))


_SIGNALS = "s(signal_id, prop, area_id, name) AS (VALUES " + ", ".join(f"({i}, {p}, {a}, {_q(n)})" for i, p, a, n in properties.SIGNALS) + ")"


@query(f"""WITH {_SIGNALS} SELECT event_id, signal_id::BIGINT AS signal_id, name, CASE prop & 4026531840 WHEN 268435456 THEN 'SYSTEM' WHEN 536870912 THEN 'VENDOR' END AS "group",
    CASE prop & 251658240 WHEN 16777216 THEN 'GLOBAL' WHEN 50331648 THEN 'WINDOW' WHEN 67108864 THEN 'MIRROR' WHEN 83886080 THEN 'SEAT' WHEN 100663296 THEN 'DOOR' WHEN 117440512 THEN 'WHEEL' END AS area,
    CASE prop & 16711680 WHEN 1048576 THEN 'STRING' WHEN 2097152 THEN 'BOOLEAN' WHEN 4194304 THEN 'INT32' WHEN 4259840 THEN 'INT32_VEC' WHEN 5242880 THEN 'INT64' WHEN 5308416 THEN 'INT64_VEC' WHEN 6291456 THEN 'FLOAT' WHEN 6356992 THEN 'FLOAT_VEC' WHEN 7340032 THEN 'BYTES' WHEN 14680064 THEN 'MIXED' END AS type, (prop & 65535)::BIGINT AS number FROM events JOIN s ON signal_id = 10001 + event_id % 30""")
def prop_decode(spark, d):
    values = load(spark, d, "events").select("event_id", (F.lit(10001) + F.col("event_id") % 30).alias("signal_id")).join(properties.signals(spark), "signal_id")
    return properties.decoded(values).select("event_id", "signal_id", "name", "group", "area", "type", "number")


def _values(spark, d):
    return load(spark, d, "events").select((K().cast("int") % 5).alias("prop"), (F.col("user_id") % 4).cast("int").alias("area_id"), "ts", F.col("event_id").alias("ord"), "value")


_VALUES = f"p AS (SELECT (CAST({SQL_K} AS INTEGER) % 5) AS prop, (user_id % 4)::INTEGER AS area_id, ts, event_id AS ord, value FROM events)"


@query(f"WITH {_VALUES}, r AS (SELECT *, row_number() OVER (PARTITION BY prop, area_id ORDER BY ts DESC, ord DESC) AS rn FROM p) SELECT prop, area_id, value, ord FROM r WHERE rn = 1")
def prop_latest_by_area(spark, d):
    return properties.latest(_values(spark, d))


@query(f"WITH {_VALUES}, r AS (SELECT *, date_trunc('hour', ts) AS slot, row_number() OVER (PARTITION BY prop, area_id, date_trunc('hour', ts) ORDER BY ts DESC, ord DESC) AS rn FROM p) SELECT prop, area_id, {time_sql('slot')} AS slot, value, ord FROM r WHERE rn = 1")
def prop_downsample(spark, d):
    return properties.sampled(_values(spark, d), "1 hour").withColumn("slot", time_text("slot"))


@query(f"WITH {_SIGNALS} SELECT event_id, s.name, value FROM events JOIN s ON s.signal_id = 10001 + event_id % 30")
def prop_with_signal(spark, d):
    c = properties.signals(spark)
    values = load(spark, d, "events").select("event_id", "value", (F.lit(10001) + F.col("event_id") % 30).alias("signal_id")).join(c.select("signal_id", "prop", "area_id"), "signal_id")
    return properties.with_signals(values.drop("signal_id"), c.select("prop", "area_id", "name")).select("event_id", "name", "value")


#: Each event shows a card with its functions.
@query("SELECT event_id, card, pos, function FROM events JOIN (VALUES " + ", ".join(f"({k}, {_q(c)}, {i}, {_q(f)})" for k, (c, fs) in enumerate(properties.CARDS) for i, f in enumerate(fs)) + f") AS t(nth, card, pos, function) ON nth = event_id % {len(properties.CARDS)}")
def card_functions(spark, d):
    names = F.array(*(F.lit(c) for c, _ in properties.CARDS))
    shown = load(spark, d, "events").select("event_id", F.get(names, (F.col("event_id") % len(properties.CARDS)).cast("int")).alias("card"))
    return shown.join(properties.cards(spark), "card").select("event_id", "card", F.posexplode("functions").alias("pos", "function"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, u AS unit FROM lineitem JOIN (VALUES ('GALLON', 66), ('US_GALLON', 66), ('LITER', 65), ('IMPERIAL_GALLON', 67)) AS t(u, code) ON code = 65 + l_linenumber % 3")
def unit_fan_out(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.lit(65) + F.col("l_linenumber") % 3).alias("code"))
    return li.join(properties.units(spark), "code").drop("code")


# ---- spans of the other steps, personas, ends of turns


def _shown(*keys: str) -> Column:
    return F.concat_ws(";", *[F.concat(F.lit(k + "="), F.col("attrs")[k]) for k in keys]).alias("attrs")


@query("""SELECT event_id AS run_id, 'agent.' || CASE event_id % 3 WHEN 0 THEN 'chat' WHEN 1 THEN 'scene' ELSE 'vision_qa' END AS name, 'session.persona=' || CASE event_id % 3 WHEN 0 THEN 'chat' WHEN 1 THEN 'scene' ELSE 'vision_qa' END || ';user.id=' || user_id || CASE WHEN event_id % 5 = 0 THEN '' ELSE ';user.input=' || event_type END AS attrs FROM events""")
def span_persona(spark, d):
    e, i = load(spark, d, "events"), F.col("event_id")
    runs = e.select(i.alias("run_id"), F.get(F.array(*map(F.lit, personas.PERSONAS)), (i % 3).cast("int")).alias("persona"), "user_id", F.when(i % 5 == 0, F.lit("")).otherwise(F.col("event_type")).alias("text"))
    return spans.persona_span(runs).select("run_id", "name", _shown("session.persona", "user.id", "user.input"))


@query(rf"""WITH f AS (SELECT memory_id, string_agg(CASE type WHEN 'system' THEN 'system:' WHEN 'user' THEN 'user:' ELSE 'assistant:' END || coalesce(text, ''), chr(10) ORDER BY seq) AS text, count(*) AS n FROM v_msg GROUP BY memory_id), c AS (SELECT memory_id, n, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '... (truncated)' ELSE text END AS text FROM f)
    SELECT memory_id AS run_id, 'agent.persona=chat;agent.iteration=2;prompt.transient_messages=user:now;prompt.chat_messages=' || {_cut_sql(_MASK, 500, "… (truncated)")} || ';prompt.message_count=' || n || ';prompt.tool_spec_count=' || CASE WHEN memory_id % 2 = 0 THEN 2 ELSE 0 END || ';prompt.tool_specs=' || CASE WHEN memory_id % 2 = 0 THEN 'a, b' ELSE '' END AS attrs FROM c""")
def span_prompt_assembly(spark, d):
    m = v_msg(spark, d)
    prompts = messages.joined(m).join(messages.stats(m), "memory_id").select(F.col("memory_id").alias("run_id"), F.lit(2).alias("iteration"), F.lit("chat").alias("persona"), F.lit("user:now").alias("transient"), F.col("formatted").alias("chat"), "message_count", F.when(F.col("memory_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("tool_names"))
    return spans.prompt_span(prompts).select("run_id", _shown("agent.persona", "agent.iteration", "prompt.transient_messages", "prompt.chat_messages", "prompt.message_count", "prompt.tool_spec_count", "prompt.tool_specs"))


@query(f"""SELECT event_id AS run_id, 'gen_ai.provider=dashscope;gen_ai.model=qwen-turbo;agent.iteration=' || CAST({SQL_K} AS INTEGER) % 10 || ';prompt.message_count=' || CAST({SQL_K} AS INTEGER) || CASE WHEN event_type = 'click' THEN ';gen_ai.tool_calls=a, b' ELSE ';gen_ai.output=138****' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') END
    || CASE WHEN event_id % 2 = 0 THEN ';gen_ai.usage.input_tokens=' || CAST({SQL_K} AS INTEGER) * 9 || ';gen_ai.usage.output_tokens=7;gen_ai.usage.total_tokens=' || CAST({SQL_K} AS INTEGER) * 9 + 7 ELSE '' END AS attrs FROM events""")
def span_model_call(spark, d):
    e, k, i = load(spark, d, "events"), K().cast("int"), F.col("event_id")
    used = lambda n: F.when(i % 2 == 0, n)
    answer = F.when(F.col("event_type") != "click", F.concat(F.lit("1381234"), F.lpad((i % 10_000).cast("string"), 4, "0")))
    calls = e.select(i.alias("run_id"), (k % 10).alias("iteration"), F.lit("qwen-turbo").alias("model"), k.alias("message_count"), answer.alias("answer"), F.when(F.col("event_type") == "click", F.array(F.lit("a"), F.lit("b"))).alias("tool_names"), used(k * 9).alias("input_tokens"), used(F.lit(7)).alias("output_tokens"), used(k * 9 + 7).alias("total_tokens"))
    return spans.model_span(calls).select("run_id", _shown("gen_ai.provider", "gen_ai.model", "agent.iteration", "prompt.message_count", "gen_ai.tool_calls", "gen_ai.output", "gen_ai.usage.input_tokens", "gen_ai.usage.output_tokens", "gen_ai.usage.total_tokens"))


@query("""SELECT doc_id AS run_id, CASE WHEN doc_id % 2 = 0 THEN 'memory.compress' ELSE 'memory.extract' END AS name, 'memory.operation=' || CASE WHEN doc_id % 2 = 0 THEN 'compress' ELSE 'extract' END || ';memory.input_chars=' || greatest(length(coalesce(text, '')) - 100, 0) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ';memory.output=' || lang END
    || ';memory.output_chars=' || CASE WHEN doc_id % 3 = 0 THEN 0 ELSE length(lang) END || CASE WHEN doc_id % 2 = 0 THEN ';memory.compressed=' || (doc_id % 3 <> 0)::VARCHAR ELSE ';memory.candidate_count=' || doc_id % 4 END AS attrs FROM documents""")
def span_memory(spark, d):
    i, docs = F.col("doc_id"), load(spark, d, "documents")
    output = F.when(i % 3 != 0, F.col("lang"))
    steps = docs.select(i.alias("run_id"), F.when(i % 2 == 0, "compress").otherwise("extract").alias("operation"), (F.length(F.coalesce("text", F.lit(""))) - 100).alias("input_chars"), F.col("text").alias("prompt"), output.alias("output"), (i % 4).alias("candidate_count"), (i % 3 != 0).alias("compressed"))
    return spans.memory_span(steps).select("run_id", "name", _shown("memory.operation", "memory.input_chars", "memory.output", "memory.output_chars", "memory.compressed", "memory.candidate_count"))


@query("SELECT event_id AS request_id, 'response.success=' || (event_type <> 'error')::VARCHAR || ';response.text.length=' || CASE WHEN event_type = 'view' THEN 0 ELSE length(event_type) END || CASE WHEN event_type = 'error' THEN ';response.error_type=MODEL' ELSE '' END AS attrs FROM events")
def span_response(spark, d):
    kind = F.col("event_type")
    r = load(spark, d, "events").select(F.col("event_id").alias("request_id"), (kind != "error").alias("success"), F.when(kind != "view", kind).alias("text"), F.when(kind == "error", F.lit("MODEL")).alias("error_type"))
    return spans.response_span(r).select("request_id", _shown("response.success", "response.text.length", "response.error_type"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status, CASE WHEN event_type <> 'error' THEN 'OK' WHEN event_id % 2 = 0 THEN 'network down' ELSE 'IOException' END AS status_text, CASE WHEN event_type = 'error' THEN 'a=1;error.type=java.io.IOException' || CASE WHEN event_id % 2 = 0 THEN ';error.message=network down' ELSE '' END ELSE 'a=1' END AS attrs FROM events""")
def span_exception(spark, d):
    bad = F.col("event_type") == "error"
    made = load(spark, d, "events").select("event_id", spans.attributes(a=F.lit(1)).alias("attrs"), F.when(bad, F.lit("java.io.IOException")).alias("error_class"), F.when(bad & (F.col("event_id") % 2 == 0), F.lit("network down")).alias("error_message"))
    return spans.failed(made).select("event_id", "status", "status_text", _shown("a", "error.type", "error.message"))


_NOTE = """CASE WHEN event_type <> 'error' THEN '{"场景名称":"' || name || '","场景描述":"d' || k || '"}' ELSE '未知场景' END"""


@query(f"""WITH r AS (SELECT event_id, e.ts, user_id, event_type, CAST({SQL_K} AS INTEGER) AS k, event_id % 3 AS iteration, v.name FROM events e JOIN v_frame v ON v.ord = event_id),
    c AS (SELECT event_id, 'chat' AS persona, [CASE WHEN iteration = 0 AND k % 2 = 0 THEN '【用户记忆参考】m' || k END, '车辆状态：s' || user_id, '当前时间：' || strftime(ts + INTERVAL 8 HOUR, '%Y年%m月%d日 %H时%M分')] AS said FROM r
          UNION ALL SELECT event_id, 'scene', ['场景描述：' || {_NOTE}, '车辆状态：s' || user_id, 'act'] FROM r),
    u AS (SELECT event_id, persona, unnest([1, 2, 3]) AS chain_pos, unnest(said) AS text FROM c) SELECT event_id AS run_id, persona, chain_pos, text FROM u WHERE text IS NOT NULL""")
def persona_context(spark, d):
    f = v_frame(spark, d).select(F.col("ord").alias("event_id"), F.when(F.col("name") != scenes.OTHER, F.col("name")).alias("scene"))
    k, i = K().cast("int"), F.col("event_id")
    runs = load(spark, d, "events").join(f, "event_id").select(F.col("user_id").alias("memory_id"), i.alias("run_id"), (i % 3).alias("iteration"), F.when(k % 2 == 0, F.concat(F.lit("m"), k.cast("string"))).alias("memory_text"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("vehicle_status"), "ts", "scene", F.concat(F.lit("d"), k.cast("string")).alias("scene_text"))
    made = [personas.context(runs, personas.PERSONAS[p], {"user/active_control": "act"}).select("run_id", F.lit(p).alias("persona"), "chain_pos", "text") for p in ("chat", "scene")]
    return made[0].unionByName(made[1])


@query(f"""SELECT ord, 'a' || k AS chat, CASE WHEN {_map_sql('name', scenes.ACTIONS, repr(''))} = '' THEN 'a' || k ELSE 'a' || k || '+' || {_map_sql('name', scenes.ACTIONS, repr(''))} END AS scene, 'a' || k || '{text.VISION_WARNING}' AS vision FROM v_frame""")
def persona_answer(spark, d):
    said, p = F.concat(F.lit("a"), F.col("k").cast("string")), personas.PERSONAS
    merged = F.concat(said, F.lit("+"), scenes.action(F.col("name")))
    return v_frame(spark, d).select("ord", personas.after(said, p["chat"]).alias("chat"), personas.after(said, p["scene"], F.col("name"), merged).alias("scene"), personas.after(said, p["vision_qa"]).alias("vision"))


_TURN = rf"""o AS (SELECT ord, user_id, ts, trim(regexp_replace(regexp_replace({_OUTPUT_SQL}, '```json\s*', '', 'g'), '```\s*', '', 'g'), chr(10) || ' ') AS t FROM v_mem WHERE ord % 5 <> 0),
    a AS (SELECT ord, user_id, ts, CAST(t AS JSON) AS j FROM o WHERE json_valid(t) AND CASE WHEN json_valid(t) THEN json_type(t) END = 'ARRAY'),
    e AS (SELECT ord, user_id, ts, unnest(range(json_array_length(j)::BIGINT)) AS pos, j FROM a), x AS (SELECT ord, user_id, ts, pos, json_extract(j, '$[' || pos || ']') AS v FROM e),
    c AS (SELECT ord, user_id, ts, pos, coalesce(v->>'$.category', 'fact') AS category, coalesce(v->>'$.key', '') AS key_text, CASE WHEN json_type(v, '$.value') = 'OBJECT' THEN '' ELSE coalesce(v->>'$.value', '') END AS value_text, coalesce(try_cast(v->>'$.confidence' AS DOUBLE), 0.5) AS confidence FROM x WHERE json_type(v) = 'OBJECT'),
    w AS (SELECT ord, user_id, ts, pos, {_CAT} AS category, key_text, value_text, confidence FROM c WHERE key_text <> '' AND value_text <> '' AND confidence >= 0.3)"""


@query(rf"""WITH {_TURN}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, category, key_text ORDER BY ts DESC, ord DESC, pos DESC) AS rn, min(ts) OVER (PARTITION BY user_id, category, key_text) AS created FROM w)
    SELECT user_id, category, key_text, value_text, confidence, {time_sql('created')} AS created_at, {time_sql('ts')} AS updated_at FROM r WHERE rn = 1""")
def turn_end_memories(spark, d):
    m = v_mem(spark, d)
    turns = m.select(F.col("ord").alias("turn_id"), "user_id", "ts", F.when(F.col("ord") % 5 == 0, F.lit("")).otherwise(F.col("value_text")).alias("user_message"))
    made = memory.upsert(memory.extracted(turns, m.select(F.col("ord").alias("turn_id"), _model_output().alias("model_output"))))
    return made.select("user_id", "category", "key_text", "value_text", "confidence", time_text("created_at").alias("created_at"), time_text("updated_at").alias("updated_at"))


@query(f"SELECT user_id, count(*) FILTER (event_type = 'view') AS n_compactions, arg_max(CAST({SQL_K} AS INTEGER), row(ts, event_id)) AS last_tokens FROM events GROUP BY user_id")
def turn_end_runtime(spark, d):
    return personas.runtime(load(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("ord"), (F.col("event_type") == "view").alias("compacted"), K().cast("int").alias("token_estimate")))


#: Two callbacks to most requests, some to none.
@query(f"""WITH c AS (SELECT user_id AS client, CASE WHEN event_id % 17 > 0 THEN event_id // 300 END AS request_id, ts, event_id AS ord, CASE WHEN CAST({SQL_K} AS INTEGER) % 9 > 0 THEN CAST({SQL_K} AS INTEGER) END AS value FROM events)
    SELECT client, request_id, arg_max(struct_pack(v := value), row(ts, ord)).v AS value FROM c WHERE request_id IS NOT NULL GROUP BY client, request_id""")
def prop_callbacks(spark, d):
    given = F.when(K().cast("int") % 9 == 0, F.array().cast("array<int>")).otherwise(F.array(K().cast("int"), F.lit(-1)))
    request = F.when(F.col("event_id") % 17 > 0, F.floor(F.col("event_id") / 300).cast("long"))
    return properties.by_request(load(spark, d, "events").select(F.col("user_id").alias("client"), request.alias("request_id"), "ts", F.col("event_id").alias("ord"), given.alias("int_values")))


#: Sign-ups subscribe and errors unsubscribe; every event sets a value.
_SUBSCRIBED = f"""e AS (SELECT *, CAST({SQL_K} AS INTEGER) AS k FROM events), r AS (SELECT user_id % 40 AS client, k % 5 AS prop, ts, event_id AS ord, CASE k % 3 WHEN 0 THEN []::INTEGER[] WHEN 1 THEN [k % 4, (k + 1) % 4] END AS area_ids,
        CASE WHEN k % 4 > 0 THEN 1.0::DOUBLE / (3600 * (k % 4)) ELSE 0 END AS rate, event_type = 'error' AS off FROM e WHERE event_type IN ('signup', 'error')),
    s AS (SELECT *, lead(ts) OVER (PARTITION BY client, prop ORDER BY ts, ord) AS until FROM r), w AS (SELECT client, prop, area_ids, CASE WHEN rate > 0 THEN round(1000000.0::DOUBLE / rate)::BIGINT ELSE 0 END AS width_us, ts AS since, until FROM s WHERE NOT off),
    p AS (SELECT k % 5 AS prop, (user_id % 4)::INTEGER AS area_id, ts, event_id AS ord, value FROM e),
    m AS (SELECT client, p.prop, area_id, since, ts, value, p.ord, CASE WHEN width_us > 0 THEN (epoch_us(ts) - epoch_us(since)) // width_us ELSE p.ord END AS slot FROM p JOIN w ON p.prop = w.prop AND since <= ts AND (until IS NULL OR ts < until) AND (coalesce(len(area_ids), 0) = 0 OR list_contains(area_ids, area_id))),
    n AS (SELECT *, row_number() OVER (PARTITION BY client, prop, area_id, since, slot ORDER BY ts DESC, ord DESC) AS rn FROM m)"""


@query(f"WITH {_SUBSCRIBED} SELECT client, prop, area_id, {time_sql('ts')} AS ts, value, ord FROM n WHERE rn = 1")
def prop_subscriptions(spark, d):
    e = load(spark, d, "events").withColumn("k", K().cast("int"))
    k = F.col("k")
    areas = F.when(k % 3 == 0, F.array().cast("array<int>")).when(k % 3 == 1, F.array(k % 4, (k + 1) % 4))
    off = F.col("event_type") == "error"
    told = e.filter(F.col("event_type").isin("signup", "error")).select((F.col("user_id") % 40).alias("client"), (k % 5).alias("prop"), "ts", F.col("event_id").alias("ord"), areas.alias("area_ids"), F.when(k % 4 > 0, F.lit(1.0) / (3600 * (k % 4))).otherwise(0.0).alias("rate"), off.alias("off"))
    values = e.select((k % 5).alias("prop"), (F.col("user_id") % 4).cast("int").alias("area_id"), "ts", F.col("event_id").alias("ord"), "value")
    return properties.delivered(values, properties.subscriptions(told)).withColumn("ts", time_text("ts"))


# ---- extensions: beyond the operators of an assistant, labelled ext_

@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, count(*) AS count_order FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def ext_pricing_summary(spark, d):
    li = load(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.count("*").alias("count_order"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, """ + time_sql("min(ts)") + """ AS started, count(*) AS n_events FROM s GROUP BY user_id, n""")
def ext_session_window(spark, d):
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n_events")).select("user_id", time_text("w.start").alias("started"), "n_events")
