"""Assistant event-stream operators.

Each function takes a DataFrame that may be batch or streaming and returns
the same kind. Stateless ones are projections, filters and explodes.
Stateful ones aggregate per key and session: a stream's state lives until
``ttl`` passes without an event (a session window), so pass ``watermark`` on
a stream and its state expires; nothing is collected over all time. The
approval state machine and a twin of the text assembly run on state variables
with timers (stateful.py); stores that streams feed are in stores.py. Window
functions (not allowed on streams) are never used here.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.chat import CRED_ERROR, acl
from ..sources.streamdata import DONE, TRACE_PATH
from . import stateful
from .stores import index_changes, last_entries

MAX_RESUME_ATTEMPTS = 3
TTL = "5 minutes"
WATERMARK = "10 minutes"


def sessions(df: DataFrame, key: str, ttl: str, watermark: str | None, *aggs: Column) -> DataFrame:
    """groupBy(key, session of ``ttl``) with aggregates. On a stream pass
    ``watermark``: times are cast to TIMESTAMP for it, and back; state is kept
    in RocksDB, and rows behind the watermark are dropped (counted by
    stateful.LateRows)."""
    if watermark:
        stateful.use_rocksdb(df.sparkSession)
        df = df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    g = df.groupBy(key, F.session_window("ts", ttl).alias("s")).agg(*aggs)
    return g.withColumns({"session_start": F.col("s.start").cast("timestamp_ntz"),
                          "session_end": F.col("s.end").cast("timestamp_ntz")}).drop("s")


def assemble_text(chunks: DataFrame, ttl: str = TTL, watermark: str | None = None) -> DataFrame:
    """Ordered text deltas -> text per stream and session; the ordering
    happens after the aggregation, the list is one session's."""
    g = sessions(chunks, "stream_id", ttl, watermark,
                 F.collect_list(F.when(F.col("type") == "text-delta", F.struct("seq", "delta"))).alias("d"))
    return g.select("stream_id", "session_start",
                    F.array_join(F.transform(F.array_sort("d"), lambda x: x["delta"]), "").alias("text"),
                    F.size("d").alias("n_deltas"))


def agent_items(updates: DataFrame) -> DataFrame:
    """Updates (event_id, messages of kind, text, data) -> one item per
    message; tool content that is not a string is JSON-encoded."""
    m = updates.select("event_id", F.posexplode("messages").alias("pos", "m"))
    return m.select("event_id", F.col("pos").cast("long").alias("pos"),
                    F.when(F.col("m.kind") == "tool", "function_call_output").otherwise("message").alias("item_type"),
                    F.coalesce("m.text", F.to_json("m.data")).alias("content"))


def done_items(raw: DataFrame) -> DataFrame:
    return raw.filter(F.get_json_object("raw", "$.type") == DONE)


def trace_id(raw: DataFrame, path: str = TRACE_PATH, ttl: str = TTL, watermark: str | None = None) -> DataFrame:
    """Per stream and session: the trace id (at ``path``) of the last done
    event carrying one wins; a bare trace_id counts only while none is set
    (so the first bare one)."""
    nested = F.when(F.get_json_object("raw", "$.type") == DONE, F.get_json_object("raw", path))
    bare = F.get_json_object("raw", "$.trace_id")
    g = sessions(raw, "stream_id", ttl, watermark,
                 F.max_by(nested, F.when(nested.isNotNull(), F.col("seq"))).alias("n"),
                 F.min_by(bare, F.when(bare.isNotNull(), F.col("seq"))).alias("b"))
    return g.select("stream_id", "session_start", F.coalesce("n", "b").alias("trace_id"))


def outcome(chunks: DataFrame, ttl: str = TTL, watermark: str | None = None) -> DataFrame:
    """Per stream and session. failed: an error before the first text-* chunk;
    partial: an error after it (forwarded); ok: no error."""
    g = sessions(chunks, "stream_id", ttl, watermark,
                 F.min(F.when(F.col("type").startswith("text-"), F.col("seq"))).alias("first_text"),
                 F.min(F.when(F.col("type") == "error", F.col("seq"))).alias("first_error"))
    o = (F.when(F.col("first_error").isNull(), "ok")
         .when(F.col("first_text").isNull() | (F.col("first_error") < F.col("first_text")), "failed").otherwise("partial"))
    return g.select("stream_id", "session_start", o.alias("outcome"))


def expand_parts(results: DataFrame) -> DataFrame:
    """A whole result's parts as stream chunks: text and reasoning -> start,
    delta, end (nothing when empty); file, source-url, source-document, tool
    call and tool result -> one chunk; other parts -> nothing; a final finish
    chunk with the finish reason."""
    null_s = F.lit(None).cast("string")
    chunk = lambda typ, d=null_s: F.struct(F.lit(typ).alias("type"), d.alias("delta"))

    def rows(p):
        t, said = p["type"], F.coalesce(F.length(p["text"]), F.lit(0)) > 0
        spoken = lambda kind: F.array(chunk(f"{kind}-start"), chunk(f"{kind}-delta", p["text"]), chunk(f"{kind}-end"))
        return (F.when((t == "text") & said, spoken("text")).when((t == "reasoning") & said, spoken("reasoning"))
                .when(t == "file", F.array(chunk("file", p["url"])))
                .when(t == "source-url", F.array(chunk("source-url", p["url"])))
                .when(t == "source-document", F.array(chunk("source-document", p["url"])))
                .when(t == "dynamic-tool", F.array(chunk("tool-input-available", p["tool_name"])))
                .when(t == "tool-result", F.array(chunk("tool-output-available", p["tool_name"])))
                .otherwise(F.array().cast("array<struct<type:string,delta:string>>")))

    flat = F.concat(F.flatten(F.transform("parts", rows)), F.array(chunk("finish", F.col("finish_reason"))))
    return results.select(F.col("id").alias("message_id"), F.posexplode(flat).alias("seq", "c")).select(
        "message_id", F.col("seq").cast("long").alias("seq"), F.col("c.type").alias("type"), F.col("c.delta").alias("delta"))


def resume(chunks: DataFrame, requests: DataFrame, active: DataFrame, chats: DataFrame) -> DataFrame:
    """Replay for resume requests (chat_id, user_id, cursor): the chat's
    active stream from the cursor on (from the start without one). Nothing
    for a chat without an active stream or one the user may not read; a chat
    that is not stored yet may be resumed by anyone. chunks may be a stream."""
    allowed = acl(chats, requests).filter(F.col("can_read") | (F.col("reason") == "not_found")) \
        .select("chat_id", "user_id").distinct()
    asked = requests.join(allowed, ["chat_id", "user_id"]).join(active.select("chat_id", "stream_id"), "chat_id")
    return chunks.join(asked, "stream_id").filter(F.col("seq") >= F.coalesce(F.col("cursor"), F.lit(0))) \
        .select("chat_id", "user_id", "stream_id", "seq", "type", "delta")


def resume_decision(endings: DataFrame, max_attempts: int = MAX_RESUME_ATTEMPTS) -> DataFrame:
    """Client decision when a stream ends (is_abort, is_disconnect, is_error,
    last_part, attempts, error_text of the last message): never after a user
    abort or a credential error; resume when the last part is not 'finish'
    and the end was a disconnect, an error or nothing at all, while attempts
    remain."""
    last = F.col("last_part")
    cred = F.coalesce(F.col("error_text").rlike(CRED_ERROR), F.lit(False))
    should = F.coalesce(last != "finish", F.lit(True)) & (F.col("is_disconnect") | F.col("is_error") | last.isNull())
    decision = (F.when(F.col("is_abort"), "no_abort").when(cred, "no_credential")
                .when(should & (F.col("attempts") < max_attempts), "resume").when(should, "give_up").otherwise("done"))
    return endings.select("stream_id", decision.alias("decision"))


def active_stream(registrations: DataFrame, ttl: str = TTL, watermark: str | None = None) -> DataFrame:
    """Latest registered stream per chat and session (registrations: chat_id,
    seq, ts, op register/clear, stream_id), none once a clear follows it."""
    reg = F.col("op") == "register"
    g = sessions(registrations, "chat_id", ttl, watermark,
                 F.max_by("stream_id", F.when(reg, F.col("seq"))).alias("stream_id"),
                 F.max(F.when(reg, F.col("seq"))).alias("reg_seq"),
                 F.max(F.when(~reg, F.col("seq"))).alias("clear_seq"))
    return g.filter(F.col("reg_seq").isNotNull() & (F.col("clear_seq").isNull() | (F.col("clear_seq") < F.col("reg_seq")))) \
        .select("chat_id", "session_start", "stream_id")


def ttl_sessions(chunks: DataFrame, ttl: str = TTL, watermark: str | None = None) -> DataFrame:
    """A stream's cache entry lives until ``ttl`` passes without a push:
    session windows per stream."""
    g = sessions(chunks, "stream_id", ttl, watermark, F.count(F.lit(1)).alias("n_chunks"))
    return g.select("stream_id", "session_start", "session_end", "n_chunks")


def upsert_store(log: DataFrame) -> DataFrame:
    """Compaction of an upsert/delete log: latest op per key wins. (A store
    that is kept between compactions: stores.compact_log and store_now.)"""
    return last_entries(log).filter(~F.col("is_delete")).drop("is_delete")


def upsert_stream(stream: DataFrame, log_path: str, checkpoint: str, trigger_once: bool = True):
    """Continuous upsert: each micro-batch is written to its own
    batch_id=N folder of the log (overwrite of that folder, so a replayed
    batch is idempotent); ``stores.store_now`` is the current state."""
    def write(df, batch_id):
        df.write.mode("overwrite").parquet(f"{log_path.rstrip('/')}/batch_id={batch_id}")
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def approval_state(ev: DataFrame) -> DataFrame:
    """Batch twin of the approval state machine: a request becomes pending;
    the first decision after the latest request settles it (approved ->
    continue, denied -> stop); decisions without a pending request are
    ignored."""
    last_req = ev.groupBy("request_id").agg(F.max(F.when(F.col("kind") == "requested", F.col("seq"))).alias("req_seq"))
    dec = ev.filter(F.col("kind") != "requested").join(last_req, "request_id") \
        .filter(F.col("seq") > F.col("req_seq")).groupBy("request_id").agg(F.min_by("kind", "seq").alias("decision"))
    st = last_req.filter(F.col("req_seq").isNotNull()).join(dec, "request_id", "left")
    state = F.coalesce(F.col("decision"), F.lit("pending"))
    return st.select("request_id", state.alias("state"),
                     F.when(state == "approved", "continue").when(state == "denied", "stop").otherwise("wait").alias("action"))


def approval_state_stream(ev: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Streaming twin: a state machine per request (stateful.Approvals)."""
    return stateful.approval_state_stream(ev, watermark)


def assemble_text_stream(chunks: DataFrame, ttl: str = TTL, watermark: str = WATERMARK) -> DataFrame:
    """Streaming twin of ``assemble_text`` on list state and timers."""
    return stateful.assemble_text_stream(chunks, int(pd.Timedelta(ttl).total_seconds() * 1000), watermark)


def index_sync_batch(old: DataFrame, new: DataFrame, embedder) -> DataFrame:
    """One step of the triggered index sync over whole snapshots."""
    return index_changes(old, new, embedder)


# Executors need not have this package installed: functions of this module
# are shipped by value with the tasks that use them.
from pyspark import cloudpickle as _cloudpickle  # noqa: E402

_cloudpickle.register_pickle_by_value(sys.modules[__name__])
