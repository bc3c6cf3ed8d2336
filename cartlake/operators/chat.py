"""Chat store: chats, messages, votes and the message/part rules.

Stores are append-only logs compacted with max_by/min_by (see upsert.py);
deletes are left_anti joins against the id set to delete. Per-message part
rules are higher-order functions over the parts array (no shuffle at all).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import ustrip
from ..plans.numbering import rank_within, time_blocks
from ..sources.chatdata import truncate_words
from .upsert import alive, last_by_op, last_write

VISIBILITIES = ("public", "private")
CITATION_SUFFIX = "::citation"      # marks a link as a citation; callers may pass their own
FUNCTION_CALL_TAG = "<has_function_call>"
# Fixed patterns of the credential-error message (case-insensitive).
CRED_ERROR = r"(?i)Credential for user identity\([^)]*\) is not found for the connection"
CRED_LOGIN_URL = r"(?i)please login first to the connection by visiting\s+(https?://[^\s]+)"
CRED_CONNECTION = r"(?i)for the connection\s+'([^']+)'"


# ---------------------------------------------------------------- chats log

def insert_chat(log: DataFrame, chats: DataFrame, now: Column) -> DataFrame:
    """Append insert operations numbered by the caller (``seq``: where in the
    log the insert stands, so that an insert after a delete revives the
    chat); createdAt defaults to ``now``."""
    nxt = chats.select("seq", F.lit("insert").alias("op"), "id", "user_id",
                       F.lit(None).cast("string").alias("title"), "visibility",
                       F.lit(None).cast("string").alias("last_context"),
                       F.coalesce(F.col("created_at"), now).alias("created_at"))
    return log.unionByName(nxt)


def compact_chats(log: DataFrame) -> DataFrame:
    """Current chats: insert fields keep their first value, updates are last
    writer wins per field, invalid visibility updates are ignored and a
    delete removes the chat."""
    valid_vis = (F.col("op") == "insert") | ((F.col("op") == "visibility") & F.col("visibility").isin(*VISIBILITIES))
    g = log.groupBy("id").agg(
        F.min_by("user_id", F.when(F.col("op") == "insert", F.col("seq"))).alias("user_id"),
        F.min_by("created_at", F.when(F.col("op") == "insert", F.col("seq"))).alias("created_at"),
        last_by_op("title", "seq", F.col("op") == "title"),
        last_by_op("visibility", "seq", valid_vis),
        last_by_op("last_context", "seq", F.col("op") == "context"),
        alive())
    return g.filter("alive").drop("alive")


def set_visibility(log: DataFrame) -> DataFrame:
    return compact_chats(log).select("id", "visibility")


def set_title(log: DataFrame) -> DataFrame:
    return compact_chats(log).select("id", "title")


def set_last_context(log: DataFrame) -> DataFrame:
    c = compact_chats(log)
    ctx = F.from_json("last_context", "inputTokens long, outputTokens long")
    return c.select("id", ctx["inputTokens"].alias("input_tokens"), ctx["outputTokens"].alias("output_tokens"))


def get_chat(chats: DataFrame, chat_id) -> DataFrame:
    return chats.filter(F.col("id") == chat_id)


def delete_chat(chats: DataFrame, messages: DataFrame, votes: DataFrame, ids: DataFrame) -> DataFrame:
    """Surviving rows after deleting chats ``ids`` (votes, then messages,
    then chats; the reference leaves votes behind, we remove them too)."""
    ids = ids.select(F.col("id").alias("chat_id")).distinct()
    v = votes.join(ids, "chat_id", "left_anti")
    m = messages.join(ids, "chat_id", "left_anti")
    c = chats.join(ids.withColumnRenamed("chat_id", "id"), "id", "left_anti")
    return (c.select(F.lit("chat").alias("kind"), F.col("id").alias("row_id"))
            .unionByName(m.select(F.lit("message").alias("kind"), F.col("id").alias("row_id")))
            .unionByName(v.select(F.lit("vote").alias("kind"), F.col("message_id").alias("row_id"))))


def delete_trailing(messages: DataFrame, votes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Delete messages with createdAt >= the chat's anchor timestamp and
    their votes; returns surviving messages and votes. Messages are read
    once: a message survives when its chat has no anchor or a later one, a
    vote when its message survives."""
    a = anchors.select("chat_id", F.col("ts").alias("anchor_ts"))
    v = votes.groupBy(F.col("message_id").alias("id")).agg(F.count(F.lit(1)).alias("n_votes"))
    kept = (messages.select("id", "chat_id", "created_at").join(a, "chat_id", "left")
            .filter(F.col("anchor_ts").isNull() | (F.col("created_at") < F.col("anchor_ts"))).join(v, "id", "left"))
    kinds = F.concat(F.array(F.lit("message")), F.array_repeat(F.lit("vote"), F.coalesce("n_votes", F.lit(0)).cast("int")))
    return kept.select(F.explode(kinds).alias("kind"), F.col("id").alias("row_id"))


# ---------------------------------------------------------------- history paging

def history_page(chats: DataFrame, limit: int, user_id=None) -> DataFrame:
    """Newest ``limit`` chats per user plus has_more (limit+1 probe). The
    rank filter becomes a partial WindowGroupLimit before the shuffle."""
    c = chats if user_id is None else chats.filter(F.col("user_id") == user_id)
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    r = c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit + 1)
    more = r.groupBy("user_id").agg((F.max("rank") > limit).alias("has_more"))
    return (r.filter(F.col("rank") <= limit).join(more, "user_id")
            .select("user_id", F.col("rank").cast("long").alias("rank"), "id", "created_at", "has_more"))


def _cursor_page(chats: DataFrame, cursors: DataFrame, limit: int, newer: bool) -> DataFrame:
    cur = cursors.join(chats.select(F.col("id").alias("cursor_id"), F.col("created_at").alias("cursor_ts")), "cursor_id")
    j = chats.join(cur.select("user_id", "cursor_ts"), "user_id")
    j = j.filter(F.col("created_at") > F.col("cursor_ts")) if newer else j.filter(F.col("created_at") < F.col("cursor_ts"))
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    r = j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit + 1)
    more = r.groupBy("user_id").agg((F.max("rank") > limit).alias("has_more"))
    return (r.filter(F.col("rank") <= limit).join(more, "user_id")
            .select("user_id", F.col("rank").cast("long").alias("rank"), "id", "created_at", "has_more"))


def history_after(chats: DataFrame, cursors: DataFrame, limit: int) -> DataFrame:
    """Chats strictly newer than each user's cursor chat, newest first (so the
    newest ``limit``, not the ones adjacent to the cursor)."""
    return _cursor_page(chats, cursors, limit, True)


def history_before(chats: DataFrame, cursors: DataFrame, limit: int) -> DataFrame:
    """Chats strictly older than the cursor (equal timestamps are skipped)."""
    return _cursor_page(chats, cursors, limit, False)


def history_pages(chats: DataFrame, size: int = 20) -> DataFrame:
    """Page number of every chat when a user's history is read newest first
    in pages of ``size``. The rank is a blocked prefix sum (a user with a
    huge history is not sorted in one task)."""
    r = rank_within(chats.select("user_id", "id", "created_at"), ["user_id"], [F.desc("created_at"), F.desc("id")],
                    time_blocks(F.col("created_at"), descending=True))
    return r.select("user_id", "id", "created_at", F.floor((F.col("rank") - 1) / size).cast("long").alias("page"))


def date_buckets(chats: DataFrame, now: Column) -> DataFrame:
    d, today = F.to_date("created_at"), F.to_date(now)
    b = (F.when(d == today, "today").when(d == F.date_sub(today, 1), "yesterday")
         .when(F.col("created_at") > now - F.expr("INTERVAL 7 DAYS"), "last_week")
         .when(F.col("created_at") > F.add_months(now, -1).cast("timestamp_ntz"), "last_month").otherwise("older"))
    return chats.select("id", "user_id", "created_at", b.alias("bucket"))


# ---------------------------------------------------------------- messages

def upsert_messages(log: DataFrame) -> DataFrame:
    """Insert; on id conflict only text/parts/attachments and traceId are
    replaced (a later null trace id clears it); role, chatId and createdAt
    keep the first write. One aggregate each, over the fields as a whole."""
    g = log.groupBy("id").agg(F.min_by(F.struct("chat_id", "role", "created_at"), "seq").alias("first"),
                              F.max_by(F.struct("text", "parts", "attachments", "trace_id"), "seq").alias("last"))
    return g.select("id", "first.*", "last.*")


def messages_by_chat(messages: DataFrame, chat_id) -> DataFrame:
    return messages.filter(F.col("chat_id") == chat_id).orderBy("created_at", "id")


def message_by_id(messages: DataFrame, message_id) -> DataFrame:
    return messages.filter(F.col("id") == message_id)


def traced_messages(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("trace_id").isNotNull()).select("chat_id", F.col("id").alias("message_id"), "trace_id")


def context_merge(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Model context per chat: the prior messages in order, then the new user
    message if the request carries one; a request without one is a
    continuation and sends the prior messages only."""
    cols = ["chat_id", "id", "role", "created_at", "parts"]
    asked = new.select("chat_id").distinct().withColumn("mode", F.lit("new_message"))
    rows = prior.select(*cols, F.lit(0).alias("turn")).unionByName(new.select(*cols, F.lit(1).alias("turn")))
    ranked = rank_within(rows, ["chat_id"], [F.col("turn"), F.col("created_at"), F.col("id")],
                         [F.col("turn"), *time_blocks(F.col("created_at"))], out="position")
    return ranked.join(asked, "chat_id", "left").select(
        "chat_id", F.col("id").alias("message_id"), "role", "position", "parts",
        F.coalesce("mode", F.lit("continuation")).alias("mode"))


def continuation_rows(prior: DataFrame, now: Column) -> DataFrame:
    """Rows written for a continuation: assistant messages of the prior
    context with their parts, createdAt kept (else now), attachments empty,
    traceId null."""
    return prior.filter(F.col("role") == "assistant").select(
        "id", "chat_id", "role", "parts", F.array().cast("array<string>").alias("attachments"),
        F.coalesce(F.col("created_at"), now).alias("created_at"), F.lit(None).cast("string").alias("trace_id"))


def ui_messages(messages: DataFrame) -> DataFrame:
    """Messages as the client reads them: id, role, parts, ISO time."""
    return messages.select("id", "role", "parts",
                           F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))


# ---------------------------------------------------------------- parts

def _texts(parts: Column) -> Column:
    return F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"])


def message_text(messages: DataFrame) -> DataFrame:
    return messages.select(F.col("id").alias("message_id"), F.array_join(_texts(F.col("parts")), "").alias("text"))


def copy_text(messages: DataFrame) -> DataFrame:
    t = F.array_join(_texts(F.col("parts")), "\n")
    return messages.select(F.col("id").alias("message_id"), ustrip(t).alias("text"))


def title_input(messages: DataFrame, max_len: int = 256) -> DataFrame:
    parts = F.transform(F.col("parts"), lambda p: F.when(p["type"] == "text", F.substring(p["text"], 1, max_len)))
    return messages.filter(F.col("role") == "user").select(
        F.col("id").alias("message_id"), F.array_join(parts, "\n").alias("title_input"))


def title_fallback(df: DataFrame, col: str = "text", max_len: int = 128) -> DataFrame:
    return df.withColumn("title", truncate_words(F.col(col), max_len))


def sanitize(df: DataFrame, col: str) -> DataFrame:
    """Remove the first function-call tag only."""
    pos = F.instr(F.col(col), FUNCTION_CALL_TAG)
    c = F.col(col)
    cut = F.concat(c.substr(F.lit(1), pos - 1), c.substr(pos + len(FUNCTION_CALL_TAG), F.length(c) + 1))
    return df.withColumn(col, F.when(pos > 0, cut).otherwise(F.col(col)))


def mcp_denied(messages: DataFrame) -> DataFrame:
    denied = F.exists("parts", lambda p: (p["type"] == "dynamic-tool")
                      & ((p["state"] == "output-denied") | (p["approved"] == F.lit(False))))
    return messages.select(F.col("id").alias("message_id"), F.coalesce(denied, F.lit(False)).alias("denied"))


def credential_errors(df: DataFrame, col: str) -> DataFrame:
    c = F.col(col)
    url = F.regexp_extract(c, CRED_LOGIN_URL, 1)
    conn = F.regexp_extract(c, CRED_CONNECTION, 1)
    return df.select("*", c.rlike(CRED_ERROR).alias("is_credential_error"),
                     F.when(c.rlike(CRED_LOGIN_URL), url).alias("login_url"),
                     F.when(c.rlike(CRED_CONNECTION), conn).alias("connection_name"))


def _is_cred(text: Column) -> Column:
    return F.coalesce(text.rlike(CRED_ERROR), F.lit(False))


def part_routing(messages: DataFrame) -> DataFrame:
    """A message's parts split for display: files, errors shown apart, the
    rest (credential errors stay inline), and whether only errors remain."""
    p = F.col("parts")
    errors = F.filter(p, lambda x: (x["type"] == "data-error") & ~_is_cred(x["text"]))
    others = F.filter(p, lambda x: x["type"] != "data-error")
    rest = F.filter(p, lambda x: (x["type"] != "data-error") | _is_cred(x["text"]))
    return messages.select(
        F.col("id").alias("message_id"), F.filter(p, lambda x: x["type"] == "file").alias("files"),
        errors.alias("errors"), rest.alias("rest"), ((F.size(errors) > 0) & (F.size(others) == 0)).alias("only_errors"))


def feedback_supported(messages: DataFrame) -> DataFrame:
    tp = F.filter("parts", lambda x: x["type"] == "data-traceId")
    return messages.select(F.col("id").alias("message_id"),
                           ((F.size(tp) == 0) | tp[0]["text"].isNotNull()).alias("feedback_supported"))


def _name_part(p: Column) -> Column:
    return (p["type"] == "text") & F.coalesce(p["text"].startswith("<name>") & p["text"].endswith("</name>"), F.lit(False))


def _joins_block(acc, p):
    """Segmentation rule: a source-url joins the block when the previous part
    is text or source-url; a plain text joins when its block starts with a
    plain text; anything else opens a new block."""
    kind = F.when(_name_part(p), "name").otherwise(p["type"])
    joins = (((p["type"] == "source-url") & acc["prev"].isin("text", "name", "source-url"))
             | ((kind == "text") & (acc["first"] == "text")))
    return kind, F.coalesce(joins, F.lit(False))


def part_segments(messages: DataFrame) -> DataFrame:
    """Segment number of every part (0-based), by one fold over the parts
    array (no shuffle)."""
    init = F.struct(F.lit(-1).alias("seg"), F.lit(None).cast("string").alias("prev"),
                    F.lit(None).cast("string").alias("first"), F.array().cast("array<int>").alias("out"))

    def step(acc, p):
        kind, joins = _joins_block(acc, p)
        seg = F.when(joins, acc["seg"]).otherwise(acc["seg"] + 1)
        return F.struct(seg.alias("seg"), kind.alias("prev"), F.when(joins, acc["first"]).otherwise(kind).alias("first"),
                        F.concat(acc["out"], F.array(seg)).alias("out"))

    segs = F.aggregate("parts", init, step)["out"]
    return (messages.select(F.col("id").alias("message_id"), F.arrays_zip(F.col("parts").alias("part"), segs.alias("segment")).alias("z"))
            .select("message_id", F.posexplode("z").alias("pos", "z"))
            .select("message_id", F.col("pos").cast("long").alias("pos"), F.col("z.segment").cast("long").alias("segment"),
                    F.col("z.part.type").alias("type")))


def citation_markdown(p: Column, suffix: str = CITATION_SUFFIX) -> Column:
    label = F.when(F.coalesce(p["title"], F.lit("")) != "", p["title"]).otherwise(p["url"])
    return F.concat(F.lit("["), label, F.lit("]("), p["url"], F.lit(suffix + ")"))


def _render(acc: Column, p: Column, suffix: str) -> Column:
    md = citation_markdown(p, suffix)
    src = (F.when(acc.endswith("|"), F.concat(acc.substr(F.lit(1), F.length(acc) - 1), F.lit(" "), md, F.lit("|")))
           .otherwise(F.concat(acc, F.lit(" "), md)))
    return F.when(p["type"] == "text", F.concat(acc, F.coalesce(p["text"], F.lit("")))) \
        .when(p["type"] == "source-url", src).otherwise(acc)


def join_citations(messages: DataFrame, suffix: str = CITATION_SUFFIX) -> DataFrame:
    """Markdown of every segment: text appended, each citation appended after
    a space, or put inside a trailing table cell ``|``. One fold per message
    segments and renders at once."""
    init = F.struct(F.lit(-1).alias("seg"), F.lit(None).cast("string").alias("prev"),
                    F.lit(None).cast("string").alias("first"), F.array().cast("array<string>").alias("outs"),
                    F.lit("").alias("cur"))

    def step(acc, p):
        kind, joins = _joins_block(acc, p)
        flush = ~joins & (acc["seg"] >= 0)
        outs = F.when(flush, F.concat(acc["outs"], F.array(acc["cur"]))).otherwise(acc["outs"])
        base = F.when(joins, acc["cur"]).otherwise(F.lit(""))
        return F.struct(F.when(joins, acc["seg"]).otherwise(acc["seg"] + 1).alias("seg"), kind.alias("prev"),
                        F.when(joins, acc["first"]).otherwise(kind).alias("first"), outs.alias("outs"),
                        _render(base, p, suffix).alias("cur"))

    done = F.aggregate("parts", init, step)
    segs = F.when(done["seg"] >= 0, F.concat(done["outs"], F.array(done["cur"]))).otherwise(F.array().cast("array<string>"))
    return (messages.select(F.col("id").alias("message_id"), F.posexplode(segs).alias("segment", "markdown"))
            .withColumn("segment", F.col("segment").cast("long")))


def decode_citation(c: Column, suffix: str = CITATION_SUFFIX) -> Column:
    return F.replace(c, F.lit(suffix), F.lit(""))


# ---------------------------------------------------------------- votes / feedback / acl

def vote_upsert(vote_log: DataFrame) -> DataFrame:
    return vote_log.groupBy("chat_id", "message_id").agg(last_write("is_up"))


def votes_by_chat(votes: DataFrame, chat_id) -> DataFrame:
    return votes.filter(F.col("chat_id") == chat_id)


def acl(chats: DataFrame, requests: DataFrame) -> DataFrame:
    """Access decision per (chat_id, user_id) request: not_found / public /
    owner / forbidden; writing always needs the owner."""
    c = chats.select(F.col("id").alias("chat_id"), F.col("user_id").alias("owner_id"), "visibility")
    j = requests.join(c, "chat_id", "left")
    reason = (F.when(F.col("owner_id").isNull() & F.col("visibility").isNull(), "not_found")
              .when(F.col("visibility") == "public", "public")
              .when(F.col("owner_id") == F.col("user_id"), "owner")
              .when(F.col("visibility") == "private", "forbidden").otherwise("allowed"))
    return j.select("chat_id", "user_id", reason.alias("reason"),
                    reason.isin("public", "owner", "allowed").alias("can_read"),
                    F.coalesce(F.col("owner_id") == F.col("user_id"), F.lit(False)).alias("can_write"))


def feedback_map(votes: DataFrame, chats: DataFrame, requests: DataFrame) -> DataFrame:
    """messageId -> thumbs_up/thumbs_down for each (chat, viewer) request;
    nothing where the ACL forbids reading. Votes of a chat that is not found
    (any more) are served."""
    ok = acl(chats, requests).filter(F.col("can_read") | (F.col("reason") == "not_found")).select("chat_id", "user_id")
    return ok.join(votes, "chat_id").select(
        "chat_id", "user_id", "message_id",
        F.when(F.col("is_up"), "thumbs_up").otherwise("thumbs_down").alias("feedback"))


def feedback_dedup(submissions: DataFrame, messages: DataFrame) -> DataFrame:
    """First submission per (message, user) creates the feedback, later ones
    update it; messages without a trace id are skipped."""
    traced = messages.filter(F.col("trace_id").isNotNull()).select(F.col("id").alias("message_id"), "trace_id")
    s = submissions.join(traced, "message_id")
    bounds = s.groupBy("message_id", "user_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return s.join(bounds, ["message_id", "user_id"]).select(
        "message_id", "user_id", "seq", "trace_id", "feedback_type",
        F.when(F.col("seq") == F.col("first_seq"), "create").otherwise("update").alias("action"),
        (F.col("seq") == F.col("last_seq")).alias("is_final"))


def chat_bundle(chats: DataFrame, messages: DataFrame, votes: DataFrame) -> DataFrame:
    """Chat with its messages and each message's vote (flat rows)."""
    v = votes.select("message_id", "is_up")
    m = messages.select(F.col("chat_id").alias("id"), F.col("id").alias("message_id"), "role", F.col("created_at").alias("message_at"))
    return (chats.join(m, "id", "left").join(v, "message_id", "left")
            .select("id", "user_id", "visibility", "message_id", "role", "message_at", "is_up"))


def usage_normalise(usage: DataFrame) -> DataFrame:
    return usage.select("*", F.struct(F.struct(F.col("input_tokens").alias("total")).alias("inputTokens"),
                                      F.struct(F.col("output_tokens").alias("total")).alias("outputTokens")).alias("usage"))


def validate_request(requests: DataFrame) -> DataFrame:
    """Request body rules; ``reasons`` lists every failed rule (empty = valid)."""
    uuid = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    bad_part = F.exists("parts", lambda p: F.when(p["type"] == "text", F.coalesce(F.length(p["text"]), F.lit(0)) < 1)
                        .when(p["type"] == "file", ~F.coalesce(p["media_type"].isin("image/jpeg", "image/png"), F.lit(False))
                              | ~F.coalesce(F.length(p["title"]) >= 1, F.lit(False))
                              | ~F.coalesce(p["url"].rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:.+"), F.lit(False)))
                        .otherwise(F.lit(True)))
    reasons = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("id").rlike(uuid), F.lit(False)), F.lit("id")),
        F.when(~F.coalesce(F.col("message_id").rlike(uuid), F.lit(False)), F.lit("message.id")),
        F.when(F.col("role") != "user", F.lit("message.role")),
        F.when(bad_part, F.lit("message.parts")),
        F.when(~F.col("model").isin("chat-model", "chat-model-reasoning"), F.lit("selectedChatModel")),
        F.when(~F.col("visibility").isin(*VISIBILITIES), F.lit("selectedVisibilityType"))))
    return requests.select("request_no", (F.size(reasons) == 0).alias("valid"), F.array_join(reasons, ",").alias("reasons"))
