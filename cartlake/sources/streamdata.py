"""Assistant event streams derived from the driver's ``events`` and
``conversations`` tables: fixed rules (ours), identical in DuckDB
(queries/streams.py), that give the streaming operators the documented
columns they take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chatdata import message_parts
from .tables import Tables

DONE = "response.output_item.done"
TRACE_PATH = "$.output.trace.info.trace_id"


def raw_events(events: DataFrame) -> DataFrame:
    """stream_id, seq, ts, raw: response events of a user as JSON text; a
    purchase ends an item with a nested trace id, a view names a bare one."""
    e, k = F.col("event_type"), F.col("event_id").cast("string")
    raw = (F.when(e == "purchase", F.concat(F.lit('{"type":"' + DONE + '","output":{"trace":{"info":{"trace_id":"tr-'), k,
                                            F.lit('"}}}}')))
           .when(e == "view", F.concat(F.lit('{"type":"response.output_text.delta","trace_id":"bare-'), k, F.lit('"}')))
           .otherwise(F.lit('{"type":"response.output_text.delta"}')))
    return events.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), "ts", raw.alias("raw"))


def agent_updates(events: DataFrame) -> DataFrame:
    """event_id and the messages of an update: none for a signup, a tool
    result (structured for a click, text for an error) with the assistant
    text before it, or the text alone."""
    e, p = F.col("event_type"), F.col("props")
    number = F.get_json_object("props", "$.k")
    data = F.create_map(F.lit("k"), number, F.lit("type"), e)
    null_m = F.lit(None).cast("map<string,string>")
    one = lambda kind, text, d: F.struct(F.lit(kind).alias("kind"), text.alias("text"), d.alias("data"))
    said = one("assistant", F.concat(F.lit("said "), number), null_m)
    null_s = F.lit(None).cast("string")
    messages = (F.when(e == "click", F.array(said, one("tool", null_s, data)))
                .when(e == "error", F.array(said, one("tool", p, null_m)))
                .when(e == "signup", F.array().cast("array<struct<kind:string,text:string,data:map<string,string>>>"))
                .otherwise(F.array(said)))
    return events.select("event_id", messages.alias("messages"))


def approval_events(events: DataFrame) -> DataFrame:
    """request_id, seq, kind (requested / approved / denied), ts."""
    e = F.col("event_type")
    kind = F.when(e == "signup", "requested").when(e == "purchase", "approved").when(e == "error", "denied")
    return events.select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), kind.alias("kind"), "ts") \
        .filter(F.col("kind").isNotNull())


def endings(events: DataFrame) -> DataFrame:
    """stream_id (one per event), what the client knows when it ends: abort,
    disconnect and error flags, the last part's type, attempts so far, and
    the last message's error text."""
    k, e = F.col("event_id"), F.col("event_type")
    last = F.when(k % 4 == 0, "finish").when(k % 4 == 1, "text-delta").when(k % 4 == 2, "error")
    text = F.when(k % 9 == 0, F.concat(F.lit("Credential for user identity("), F.col("user_id").cast("string"),
                                       F.lit(") is not found for the connection 'x'"))).when(k % 9 < 3, "Upstream error")
    return events.select(k.alias("stream_id"), (k % 11 == 0).alias("is_abort"), (e == "view").alias("is_disconnect"),
                         (e == "error").alias("is_error"), last.alias("last_part"), (k % 5).cast("int").alias("attempts"),
                         text.alias("error_text"))


def registrations(events: DataFrame) -> DataFrame:
    """chat_id, seq, ts, op, stream_id: signups and views register a stream
    of their chat (a user), purchases clear it."""
    e = F.col("event_type")
    op = F.when(e.isin("signup", "view"), "register").when(e == "purchase", "clear")
    return events.select(F.col("user_id").alias("chat_id"), F.col("event_id").alias("seq"), "ts", op.alias("op"),
                         F.when(op == "register", F.concat(F.lit("st-"), F.col("event_id").cast("string"))).alias("stream_id")) \
        .filter(F.col("op").isNotNull())


def results(t: Tables) -> DataFrame:
    """Whole (not streamed) results: an assistant message's parts, where
    every fifth text is a reasoning, untitled sources are documents and
    answered tool calls are results; finish reason by message."""
    def kind(p, i):
        named = (F.when((p["type"] == "text") & (i % 5 == 0), "reasoning")
                 .when((p["type"] == "source-url") & p["title"].isNull(), "source-document")
                 .when((p["type"] == "dynamic-tool") & (p["state"] == "output-available"), "tool-result").otherwise(p["type"]))
        return p.withField("type", named)
    m = message_parts(t).filter(F.col("role") == "assistant")
    reason = F.when(F.col("id") % 7 == 0, "length").otherwise("stop")
    return m.select("id", F.transform("parts", kind).alias("parts"), reason.alias("finish_reason"))
