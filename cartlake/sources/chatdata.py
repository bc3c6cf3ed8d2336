"""Chat-store shaped views of the driver ``conversations`` table.

Fixed derivation rules (ours, deterministic, identical in the DuckDB views):
* a message's parts are its text lines; by role and line index i (0-based)
  a line becomes: assistant i%4=2 -> source-url, i%4=3 -> dynamic-tool,
  i%4=1 with length%7=0 -> data-error; user i%3=2 -> file; system i=0 ->
  a <name> part; everything else a text part. Assistant turns with
  turn%3=0 carry a data-traceId part with the trace id, turn%3=2 one with
  null data.
* the chat change log: insert (seq 1), title from the first message
  (seq 2), visibility flip or an invalid value (seq 3), usage context
  (seq 4), delete of public chats whose id is a multiple of 9 (seq 5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Tables, _day_offset, chat as chat_rows, message_id_of

PART_FIELDS = "type string, text string, url string, title string, state string, approved boolean, tool_name string, media_type string"


def _part(role: Column, line: Column, i: Column) -> Column:
    n = F.length(line)
    w1, w2 = F.split_part(line, F.lit(" "), F.lit(1)), F.split_part(line, F.lit(" "), F.lit(2))
    is_src = (role == "assistant") & (i % 4 == 2)
    is_tool = (role == "assistant") & (i % 4 == 3)
    is_err = (role == "assistant") & (i % 4 == 1) & (n % 7 == 0)
    is_file = (role == "user") & (i % 3 == 2)
    is_name = (role == "system") & (i == 0)
    typ = (F.when(is_src, "source-url").when(is_tool, "dynamic-tool").when(is_err, "data-error")
           .when(is_file, "file").otherwise("text"))
    err = F.when(n % 2 == 0, F.concat(
        F.lit("Credential for user identity("), w1, F.lit(") is not found for the connection '"), w2,
        F.lit("'. Please login first to the connection by visiting https://login.local/"),
        F.substring(F.md5(line), 1, 6))).otherwise(F.concat(F.lit("Upstream error: "), w1))
    text = (F.when(is_name, F.concat(F.lit("<name>"), w1, F.lit("</name>"))).when(is_err, err)
            .when(~(is_src | is_tool | is_file), line))
    url = (F.when(is_src, F.concat(F.lit("https://kb.local/"), F.substring(F.md5(line), 1, 8)))
           .when(is_file, F.concat(F.lit("https://files.local/"), F.substring(F.md5(line), 1, 8))))
    title = F.when(is_src & (n % 2 == 1), w1).when(is_file, w1)
    state = F.when(is_tool, F.when(n % 5 == 0, "output-denied").when(n % 5 == 1, "approval-responded")
                   .otherwise("output-available"))
    approved = F.when(is_tool & (n % 5 == 1), n % 2 == 0)
    tool = F.when(is_tool, F.concat(F.lit("tool_"), (n % 3).cast("string")))
    media = F.when(is_file, F.when(n % 3 == 0, "image/png").when(n % 3 == 1, "image/jpeg").otherwise("application/pdf"))
    return F.struct(typ.alias("type"), text.alias("text"), url.alias("url"), title.alias("title"),
                    state.alias("state"), approved.alias("approved"), tool.alias("tool_name"),
                    media.alias("media_type"))


def message_parts(t: Tables) -> DataFrame:
    cv = t.conversations
    role, turn = F.col("role"), F.col("turn")
    trace = F.when(turn % 3 == 2, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("tr-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string")))
    null_s = F.lit(None).cast("string")
    trace_part = F.struct(F.lit("data-traceId").alias("type"), trace.alias("text"), null_s.alias("url"),
                          null_s.alias("title"), null_s.alias("state"), F.lit(None).cast("boolean").alias("approved"),
                          null_s.alias("tool_name"), null_s.alias("media_type"))
    lines = F.transform(F.split("text", "\n"), lambda line, i: _part(role, line, i))
    parts = F.when((role == "assistant") & (turn % 3 != 1), F.concat(lines, F.array(trace_part))).otherwise(lines)
    return cv.select(message_id_of(F.col("conv_id"), turn).alias("id"), F.col("conv_id").alias("chat_id"), "role", "text",
                     parts.alias("parts"), _day_offset(F.col("conv_id"), turn).alias("created_at"),
                     trace.alias("trace_id"))


def truncate_words(c: Column, max_len: int) -> Column:
    """Cut to max_len characters, back to the last space; a space at index 0
    or none at all means a hard cut."""
    sl = F.substring(c, 1, max_len)
    last_space = F.length(sl) - F.locate(" ", F.reverse(sl)) + 1  # 1-based, = len+1 when absent
    has = F.locate(" ", F.reverse(sl)) > 0
    cut = F.when(has & (last_space > 1), F.substring(sl, 1, last_space - 1)).otherwise(sl)
    return F.when(F.length(c) <= max_len, c).otherwise(cut)


def chat_log(t: Tables) -> DataFrame:
    base = chat_rows(t)
    first = (t.conversations.filter(F.col("turn") == 0)
             .select(F.col("conv_id").alias("id"), truncate_words(F.col("text"), 128).alias("title")))
    null_s = F.lit(None).cast("string")
    cols = ["seq", "op", "id", "user_id", "title", "visibility", "last_context", "created_at"]
    ins = base.select(F.lit(1).alias("seq"), F.lit("insert").alias("op"), "id", "user_id", null_s.alias("title"),
                      "visibility", null_s.alias("last_context"), "created_at")
    ttl = first.select(F.lit(2).alias("seq"), F.lit("title").alias("op"), "id", F.lit(None).cast("long").alias("user_id"),
                       "title", null_s.alias("visibility"), null_s.alias("last_context"),
                       F.lit(None).cast("timestamp_ntz").alias("created_at"))
    vis = base.filter(F.col("id") % 5 == 0).select(
        F.lit(3).alias("seq"), F.lit("visibility").alias("op"), "id", F.lit(None).cast("long").alias("user_id"),
        null_s.alias("title"),
        F.when(F.col("id") % 15 == 0, "secret").when(F.col("visibility") == "public", "private")
        .otherwise("public").alias("visibility"), null_s.alias("last_context"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"))
    ctx = base.filter(F.col("id") % 2 == 0).select(
        F.lit(4).alias("seq"), F.lit("context").alias("op"), "id", F.lit(None).cast("long").alias("user_id"),
        null_s.alias("title"), null_s.alias("visibility"),
        F.concat(F.lit('{"inputTokens":'), ((F.col("id") * 7) % 1000).cast("string"), F.lit(',"outputTokens":'),
                 ((F.col("id") * 13) % 1000).cast("string"), F.lit("}")).alias("last_context"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"))
    dele = base.filter((F.col("visibility") == "public") & (F.col("id") % 9 == 0)).select(
        F.lit(5).alias("seq"), F.lit("delete").alias("op"), "id", F.lit(None).cast("long").alias("user_id"),
        null_s.alias("title"), null_s.alias("visibility"), null_s.alias("last_context"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"))
    return ins.unionByName(ttl).unionByName(vis).unionByName(ctx).unionByName(dele).select(*cols)


def message_log(t: Tables) -> DataFrame:
    """Every message written once (seq 1) with its parts and the links of its
    files as attachments; assistant messages of every fifth chat rewritten as
    a continuation (seq 2): new text, first part only, no attachments, null
    trace id, and a different role/created_at that the upsert must ignore."""
    m = message_parts(t)
    files = F.transform(F.filter("parts", lambda p: p["type"] == "file"), lambda p: p["url"])
    first = m.select(F.lit(1).alias("seq"), "id", "chat_id", "role", "text", "created_at", "trace_id", "parts",
                     files.alias("attachments"))
    again = m.filter((F.col("role") == "assistant") & (F.col("chat_id") % 5 == 0)).select(
        F.lit(2).alias("seq"), "id", "chat_id", F.lit("user").alias("role"),
        F.concat(F.col("text"), F.lit(" (edited)")).alias("text"),
        (F.col("created_at") + F.make_dt_interval(F.lit(1))).alias("created_at"),
        F.lit(None).cast("string").alias("trace_id"), F.slice("parts", 1, 1).alias("parts"),
        F.array().cast("array<string>").alias("attachments"))
    return first.unionByName(again)
