"""Streaming forms of the operators that keep state, with the results of their batch forms.

Rows may come in any order inside a micro-batch. Where a form takes ``late``, rows
may also come in a later batch than their neighbours: they are held back until the
watermark has passed them. Without it batches are taken in order, as one device sends them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import jsonx
from ..operators import memory, messages, requests, safety, scenes, tools
from ..session import checkpointed
from ..sources.tables import pack_messages, packed_messages


def files(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files; one camera frame, call or event a row."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def captures(spark: SparkSession, per_second: int = 1, delay_s: int = 5) -> DataFrame:
    """nth, ts of the captures that a fixed-rate timer asks for, the first one after the delay."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return ticks.filter(F.col("value") >= delay_s * per_second).select((F.col("value") - delay_s * per_second).alias("nth"), F.col("timestamp").alias("ts"))


def _micros(ts: pd.Series) -> list[int]:
    return [int(x) for x in pd.to_datetime(ts).astype("datetime64[us]").astype("int64")]


def scene_changes(frames: DataFrame, late: str | None = None) -> DataFrame:
    """frames: stream_id long, ts timestamp, ord long, name, and reset boolean where some frames reset the scene.

    Emits stream_id, ord, name at each change; scenes without a name or 其他 don't count. After a row with reset
    the same scene may be announced again. late: how much later than others a row may come.
    """
    resets = "reset" in frames.columns
    rows = frames.select("stream_id", "ts", "ord", F.coalesce("name", F.lit("")).alias("name"), (F.coalesce("reset", F.lit(False)) if resets else F.lit(False)).alias("reset"))
    rows = rows.filter(F.col("reset") | ~F.col("name").isin("", scenes.OTHER))
    if late:
        rows = rows.withWatermark("ts", late)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at, ords, names, marks = state.get if state.exists else (None, [], [], [], [])
        held = list(zip(at, ords, names, marks))
        for b in batches:
            held += zip(_micros(b["ts"]), map(int, b["ord"]), b["name"], map(bool, b["reset"]))
        held.sort()
        passed = state.getCurrentWatermarkMs() * 1000 if late else None
        ready = [r for r in held if passed is None or r[0] < passed]
        held = held[len(ready) :]
        out = []
        for _, ord_, name, reset in ready:
            if name not in ("", scenes.OTHER) and name != last:
                out.append((key[0], ord_, name))
                last = name
            last = None if reset else last
        state.update((last, [r[0] for r in held], [r[1] for r in held], [r[2] for r in held], [r[3] for r in held]))
        if held:
            state.setTimeoutTimestamp(max(held[0][0] // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["stream_id", "ord", "name"])

    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    return rows.groupBy("stream_id").applyInPandasWithState(run, "stream_id long, ord long, name string", "last string, at array<long>, ords array<long>, names array<string>, marks array<boolean>", "append", timeout)


def last_values(accepted: DataFrame) -> DataFrame:
    """accepted: vehicle long, field, value, ts, ord long, in any order. Emits vehicle, field, value, ord whenever a field's last value changes (update mode)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        for b in batches:
            r = b.sort_values(["ts", "ord"]).iloc[-1]
            mine = (int(r["ts"].value), int(r["ord"]), r["value"])
            best = mine if best is None or mine[:2] > tuple(best)[:2] else best
        state.update(tuple(best))
        yield pd.DataFrame({"vehicle": [key[0]], "field": [key[1]], "value": [best[2]], "ord": [best[1]]})

    return accepted.groupBy("vehicle", "field").applyInPandasWithState(run, "vehicle long, field string, value string, ord long", "ts long, ord long, value string", "update", GroupStateTimeout.NoTimeout)


class _Fields(StatefulProcessor):
    """The last value of each field of a vehicle, a map in the state store: a batch reads and writes only the fields it touches, and all of them once to show them."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = handle.getMapState("fields", "field string", "value string, ts long, ord long", self.ttl_ms)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples():
            self._put(r.field, r.value, -1, -1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed = False
        for b in rows:
            for ts, ord_, field, value in zip(_micros(b["ts"]), map(int, b["ord"]), b["field"], b["value"]):
                changed |= self._put(field, value, ts, ord_)
        if changed:
            shown = [(f[0], v[0]) for f, v in self.fields.iterator()]
            yield pd.DataFrame({"vehicle": [key[0]], "fields": [[f for f, _ in shown]], "values": [[v for _, v in shown]]})

    def _put(self, field: str, value: str, ts: int, ord_: int) -> bool:
        old = self.fields.getValue((field,)) if self.fields.containsKey((field,)) else None
        if old is not None and (ts, ord_) <= (old[1], old[2]):
            return False
        self.fields.updateValue((field,), (value, ts, ord_))
        return old is None or old[0] != value

    def close(self) -> None:
        pass


def vehicle_states(accepted: DataFrame, initial: DataFrame | None = None, parts: list[str] | None = None, ttl_ms: int | None = None) -> DataFrame:
    """accepted: vehicle long, field, value, ts, ord long, in any order and however late. Emits vehicle and one JSON text for each part whenever a field changes (update mode).

    initial: vehicle, field, value that vehicles have before any call; else fields never set have their defaults. ttl_ms: after so
    long without a call a field falls back to its default; needed where vehicles come and go. Needs the RocksDB state store.
    """
    rows = accepted.select("vehicle", "field", "value", "ts", "ord").groupBy("vehicle")
    start = initial.select("vehicle", "field", "value").groupBy("vehicle") if initial is not None else None
    out = rows.transformWithStateInPandas(_Fields(ttl_ms), "vehicle long, fields array<string>, values array<string>", "update", "ProcessingTime" if ttl_ms else "None", initialState=start)
    return out.select("vehicle", *tools.snapshot_texts(F.map_from_arrays("fields", "values"), parts))


class _InOrder(StatefulProcessor):
    """Rows (ts, ord, kind, body) of a key wait in a map until the watermark has passed them; then they are taken in order. kind 0 comes before 1 at the same (ts, ord)."""

    #: Of what the rows taken so far leave behind.
    state, columns = "", []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "ts long, ord long, kind int", "body string")
        self.left = handle.getValueState("left", self.state)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for b in rows:
            for ts, ord_, kind, body in zip(_micros(b["ts"]), map(int, b["ord"]), map(int, b["kind"]), b["body"]):
                self.held.updateValue((ts, ord_, kind), (body,))
                due.add(ts // 1000 + 1)
        for at in due:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready = sorted(k for k in self.held.keys() if k[0] < passed)
        if not ready:
            return
        left, out = self.left.get() if self.left.exists() else None, []
        for at in ready:
            left, row = self.taken(left, *at, self.held.getValue(at)[0])
            self.held.removeKey(at)
            if row is not None:
                out.append((key[0], at[0], at[1], *row))
        self.left.update(tuple(left))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def taken(self, left: tuple | None, ts: int, ord_: int, kind: int, body: str) -> tuple[tuple, tuple | None]:
        """The state after a row, and what is emitted for it."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class _SpeedAsOf(_InOrder):
    state, columns = "speed int", ["vehicle", "us", "ord", "speed", "body"]

    def taken(self, left, ts, ord_, kind, body):
        left = left or (safety.DEFAULT_SPEED,)
        if kind == 1:
            return left, (left[0], body)
        return (left if body is None else (int(body),)), None


class _Batches(_InOrder):
    state, columns = "first long, n int, batch long", ["exporter", "us", "ord", "batch", "body"]

    def __init__(self, size: int, seconds: float):
        self.size, self.span = size, int(seconds * 1e6)

    def taken(self, left, ts, ord_, kind, body):
        first, n, batch = left or (ts, 0, 0)
        if n == self.size or ts >= first + self.span:
            first, n, batch = ts, 0, batch + 1
        return (first, n + 1, batch), (batch, body)


def span_batches(spans: DataFrame, size: int = 64, seconds: float = 2.0, late: str = "10 seconds") -> DataFrame:
    """spans: exporter long, ts timestamp, ord long and others, in any order and up to late behind. Adds batch, from 0 for each exporter.

    A batch closes with its size or so long after its first span, whichever comes first, so each boundary depends on the one before. A span is out once the watermark has passed it.
    """
    own = [c for c in spans.columns if c not in ("exporter", "ts", "ord")]
    body = F.to_json(F.struct(*own)) if own else F.lit("{}")
    rows = spans.select("exporter", "ts", "ord", F.lit(0).alias("kind"), body.alias("body")).withWatermark("ts", late).groupBy("exporter")
    out = rows.transformWithStateInPandas(_Batches(size, seconds), "exporter long, us long, ord long, batch long, body string", "append", "EventTime")
    read = F.from_json("body", spans.select(*own).schema).alias("s")
    return out.select("exporter", F.timestamp_micros("us").alias("ts"), "ord", "batch", *([read] if own else [])).select("exporter", "ts", "ord", "batch", *(["s.*"] if own else []))


def guarded_calls(calls: DataFrame, speeds: DataFrame, late: str = "10 seconds") -> DataFrame:
    """calls: vehicle long, ts timestamp, ord long, name, arguments; speeds: vehicle, ts, ord, speed int; two streams, each in any order and up to late behind.

    Emits vehicle, ts, ord, name, arguments, speed (the last one at or before the call), veto_reason, vetoed, once the watermark has passed the call.
    A call and a speed of one (vehicle, ts, ord) are told apart; two calls are not.
    """
    body = F.to_json(F.struct("name", "arguments"))
    both = calls.select("vehicle", "ts", "ord", F.lit(1).alias("kind"), body.alias("body")).unionByName(speeds.select("vehicle", "ts", "ord", F.lit(0).alias("kind"), F.col("speed").cast("int").cast("string").alias("body")))
    rows = both.withWatermark("ts", late).groupBy("vehicle")
    out = rows.transformWithStateInPandas(_SpeedAsOf(), "vehicle long, us long, ord long, speed int, body string", "append", "EventTime")
    out = out.withColumn("call", F.from_json("body", "name string, arguments string")).select("vehicle", F.timestamp_micros("us").alias("ts"), "ord", "call.name", "call.arguments", "speed")
    given = jsonx.once(out, "given", jsonx.parsed(F.col("arguments")))
    return given.withColumn("veto_reason", safety.door_guard(F.col("name"), F.col("given"), F.col("speed"))).withColumn("vetoed", F.col("veto_reason").isNotNull()).drop("given")


def answers(rows: DataFrame, late: str = "15 seconds", seconds: int = requests.TIMEOUT_S, forget_s: int = 3600) -> DataFrame:
    """rows: request_id string, kind (request or response), ts timestamp, ord long, text. Emits request_id, ts, ord, text, error_type once for each request.

    That is its first response by (ts, ord), or a timeout where none has come so many seconds after the request; a
    response without a request never times out. An answer is given when the watermark has passed it, so that no earlier
    one can come. A request that was answered is remembered for forget_s seconds more: a response after that starts anew.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        asked, ts, ord_, text, done = state.get if state.exists else (None, None, None, None, False)
        now = state.getCurrentWatermarkMs()
        if state.hasTimedOut and done:
            state.remove()
            return
        for b in batches:
            for kind, t, o, said in zip(b["kind"], _micros(b["ts"]), map(int, b["ord"]), b["text"]):
                if kind == "request":
                    asked = t if asked is None else min(asked, t)
                elif ts is None or (t, o) < (ts, ord_):
                    ts, ord_, text = t, o, said
        if done:
            state.update((asked, ts, ord_, text, True))
            state.setTimeoutTimestamp(now + forget_s * 1000)
            return
        due = asked + seconds * 1_000_000 if asked is not None else None
        timed_out = due is not None and (ts is None or ts > due)
        at = due if timed_out else ts
        if at // 1000 < now:
            state.update((asked, ts, ord_, text, True))
            state.setTimeoutTimestamp(now + forget_s * 1000)
            yield pd.DataFrame({"request_id": [key[0]], "ts": pd.to_datetime([at], unit="us"), "ord": pd.array([None if timed_out else ord_], "Int64"), "text": [requests.TIMEOUT_TEXT if timed_out else text], "error_type": ["TIMEOUT" if timed_out else None]})
        else:
            state.update((asked, ts, ord_, text, False))
            state.setTimeoutTimestamp(at // 1000 + 1)

    out = "request_id string, ts timestamp, ord long, text string, error_type string"
    kept = rows.select("request_id", "kind", "ts", "ord", "text").withWatermark("ts", late)
    return kept.groupBy("request_id").applyInPandasWithState(run, out, "asked long, ts long, ord long, text string, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def first_responses(responses: DataFrame, delay: str = "15 seconds", forget_s: int = 3600) -> DataFrame:
    """responses: request_id, arrival timestamp, ord, text: of each request the first by (arrival, ord), once the watermark has passed it."""
    rows = responses.select("request_id", F.lit("response").alias("kind"), F.col("arrival").alias("ts"), "ord", "text")
    return answers(rows, delay, forget_s=forget_s).select("request_id", F.col("ts").alias("arrival"), "ord", "text")


def sampled(values: DataFrame, every: str, late: str = "1 minute") -> DataFrame:
    """values: prop, area_id, ts (timestamp), ord, value. The last value in each span of time, once the span can't get more (append mode)."""
    w = F.window("ts", every)
    return values.withWatermark("ts", late).groupBy("prop", "area_id", w.alias("w")).agg(F.max(F.struct("ts", "ord", "value")).alias("v")).select("prop", "area_id", F.col("w.start").alias("slot"), "v.value", "v.ord")


def exported(spans: DataFrame, path: str, checkpoint: str, every: str = "2 seconds", rows_per_file: int = 64, once: bool = False):
    """Start to write a stream of spans in batches, one at each tick; once: what there is, then stop."""
    out = spans.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", rows_per_file).outputMode("append")
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=every)).start()


class Ledger:
    """What counts of some tables: for each table and bucket the version to read, for each stream the last batch that is in them.

    Records are numbered by the ledger itself, so a stream with a new checkpoint goes on with the tables as they are. A record
    counts when it is whole; the newest one that is tells all. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def latest(self) -> int:
        """Number of the newest whole record, -1 if there is none."""
        at, fs = self._fs(self.path)
        numbers = sorted((int(f.getPath().getName()) for f in fs.listStatus(at)), reverse=True) if fs.exists(at) else []
        for n in numbers:
            done, _ = self._fs(f"{self.path}/{n:010d}/_SUCCESS")
            if fs.exists(done):
                return n
        return -1

    def record(self, number: int) -> tuple[dict[tuple[str, int], int], dict[str, int]]:
        """(table, bucket) -> version, stream -> batch: a row for each bucket and stream."""
        if number < 0:
            return {}, {}
        rows = self.spark.read.schema("kind string, name string, bucket int, number long").parquet(f"{self.path}/{number:010d}").collect()
        return {(r.name, r.bucket): r.number for r in rows if r.kind == "table"}, {r.name: r.number for r in rows if r.kind == "stream"}

    def commit(self, number: int, versions: dict[tuple[str, int], int], streams: dict[str, int]) -> None:
        rows = [("table", name, bucket, v) for (name, bucket), v in sorted(versions.items())] + [("stream", name, None, n) for name, n in sorted(streams.items())]
        self.spark.createDataFrame(rows, "kind string, name string, bucket int, number long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{number:010d}")

    def delete(self, path: str) -> None:
        at, fs = self._fs(path)
        fs.delete(at, True)


def stream_of(spark: SparkSession) -> str:
    """Inside foreachBatch the id that a query keeps with its checkpoint; else an empty text."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def merge_all(ledger: Ledger, tables: dict[BucketTable, DataFrame], number: int, stream: str | None = None) -> bool:
    """Write what a batch brings to several tables, then one record that makes all of it count.

    A batch that is in the record already changes nothing; one that failed before its record was whole starts anew from the
    record before, over its own files. False if the batch was there.
    """
    spark = ledger.spark
    stream = stream_of(spark) if stream is None else stream
    last = ledger.latest()
    before, streams = ledger.record(last)
    if streams.get(stream, -1) >= number:
        return False
    version, after = last + 1, dict(before)
    for table, writes in tables.items():
        own = {b: v for (name, b), v in before.items() if name == table.name}
        after |= {(table.name, b): version for b in table.stage(writes, own, version)}
    ledger.commit(version, after, streams | {stream: number})
    if last > 1:
        ledger.delete(f"{ledger.path}/{last - 2:010d}")
    earlier, _ = ledger.record(last - 1)
    paths = {t.name: t for t in tables}
    for (name, bucket), v in earlier.items():
        if name in paths and v not in (before.get((name, bucket)), after[name, bucket]):
            ledger.delete(paths[name].file(bucket, v))
    return True


class BucketTable:
    """A table as Parquet files in buckets of a key. A micro-batch rewrites only the buckets that it touches, and
    a ledger tells which version of each bucket counts. Versions that neither the last record nor the one before
    reads are deleted. The number of buckets is that of the table's first write and must stay."""

    #: Column whose hash tells the bucket; the table's name in its ledger.
    by, name = "key", "table"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, ledger: Ledger | None = None):
        self.spark, self.path, self.buckets, self.ledger = spark, path, buckets, ledger or Ledger(spark, f"{path}/versions")

    def prepared(self, writes: DataFrame) -> DataFrame:
        """The rows that a batch brings."""
        return writes

    def merged(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """What becomes of old rows and prepared() ones."""
        raise NotImplementedError

    def file(self, bucket: int, version: int) -> str:
        return f"{self.path}/data/version={version}/bucket={bucket}"

    def _load(self, versions: dict[int, int]) -> DataFrame | None:
        return self.spark.read.parquet(*(self.file(b, v) for b, v in sorted(versions.items()))) if versions else None

    def read(self) -> DataFrame | None:
        """The table as the newest record has it, None before the first."""
        versions, _ = self.ledger.record(self.ledger.latest())
        return self._load({b: v for (name, b), v in versions.items() if name == self.name})

    def stage(self, writes: DataFrame, versions: dict[int, int], version: int) -> list[int]:
        """Write new versions of the buckets that writes touch, which count only when a record names them."""
        own = F.pmod(F.xxhash64(self.by), F.lit(self.buckets)).cast("int")
        new = self.prepared(writes).withColumn("bucket", own)
        new.persist()
        try:
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]
            old = self._load({b: v for b, v in versions.items() if b in touched})
            rows = self.merged(new.limit(0) if old is None else old.withColumn("bucket", own), new)
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        finally:
            new.unpersist()
        return touched

    def merge(self, writes: DataFrame, number: int, stream: str | None = None) -> bool:
        """For foreachBatch: a batch counts once however often it runs."""
        return merge_all(self.ledger, {self: writes}, number, stream)


class MemoryTable(BucketTable):
    """Long-term memories: the latest write of each key wins and the first dates it."""

    by, name = "user_id", "memories"

    def prepared(self, writes: DataFrame) -> DataFrame:
        return memory.upsert(writes)

    def merged(self, old: DataFrame, new: DataFrame) -> DataFrame:
        latest = F.max(F.struct("updated_at", "ord", "value_text", "confidence", "access_count")).alias("w")
        rows = old.unionByName(new).groupBy("bucket", *memory.KEY).agg(latest, F.min("created_at").alias("created_at"))
        return rows.select("bucket", *memory.KEY, "w.value_text", "w.confidence", "created_at", "w.updated_at", "w.ord", "w.access_count")


class MessageTable(BucketTable):
    """Packed message lists (memory_id, messages_json): a list replaces the one before it as a whole. Of several in one batch the last counts (column ord)."""

    by, name = "memory_id", "messages"

    def prepared(self, writes: DataFrame) -> DataFrame:
        return writes.groupBy("memory_id").agg(F.max_by("messages_json", "ord").alias("messages_json"))

    def merged(self, old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new.select("memory_id"), "memory_id", "left_anti").unionByName(new)


class TurnEnd:
    """What the end of turns leaves, in two tables under one ledger: the memories that a model finds in the turns, and
    the message lists that became too long, compacted. Both count from the same record on, or neither.

    extract: from turns (turn_id, user_message, ai_response) to turn_id, model_output. summarise: from memory_id,
    summary_lines to memory_id, summary. Turns without a user's message aren't sent to extract, lists that the rule leaves
    alone not to summarise.
    """

    def __init__(self, spark: SparkSession, path: str, extract: Callable[[DataFrame], DataFrame], summarise: Callable[[DataFrame], DataFrame], rule: messages.Compaction | None = None, buckets: int = 64):
        self.ledger = Ledger(spark, f"{path}/versions")
        self.memories, self.lists = MemoryTable(spark, f"{path}/memories", buckets, self.ledger), MessageTable(spark, f"{path}/messages", buckets, self.ledger)
        self.extract, self.summarise, self.rule = extract, summarise, rule or messages.Compaction()

    def merge(self, turns: DataFrame, number: int, stream: str | None = None) -> bool:
        """For foreachBatch. turns: turn_id, user_id, memory_id, ts, ord, user_message, ai_response, messages_json (the whole list after the turn).

        Of several turns of one conversation in a batch the last one's list is looked at.
        """
        asked = turns.filter(F.coalesce("user_message", F.lit("")) != "")
        # models are asked once: what they say is written down before anything reads it
        writes = memory.extracted(turns, checkpointed(self.extract(asked.select("turn_id", "user_message", "ai_response"))))
        last = turns.filter("memory_id is not null").groupBy("memory_id").agg(F.max_by("messages_json", F.struct("ts", "ord")).alias("messages_json"))
        said = packed_messages(last)
        plan = messages.plan(said, self.rule)
        summaries = checkpointed(self.summarise(plan.filter("compact").select("memory_id", "summary_lines"))).filter(F.trim("summary") != "")
        shorter = messages.compacted(said.join(summaries.select("memory_id"), "memory_id", "left_semi"), plan, summaries, self.rule)
        lists = pack_messages(shorter.withColumnRenamed("pos", "seq")).withColumn("ord", F.lit(0))
        return merge_all(self.ledger, {self.memories: writes, self.lists: lists}, number, stream)
