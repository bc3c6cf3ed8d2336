"""Chat store (CHT) query bindings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import chat as C
from ..sources import chatdata as CD
from ..sources import tables as T
from ..sources.tables import Tables, ts_ntz
from . import chatsql
from .views import with_views as W

NOW = "2024-04-10 12:00:00"
PAGE = 5


def _t(s, d):
    return Tables(s, d)


def requests(c):
    """One request per chat, by its owner or the next user, and requests for
    chats that never exist (negative ids)."""
    user = F.expr("id div 10")
    viewer = user + F.when(F.col("id") % 3 == 0, 0).otherwise(1)
    return (c.select(F.col("id").alias("chat_id"), viewer.alias("user_id"))
            .unionByName(c.filter(F.col("id") % 4 == 1).select((-1 - F.col("id")).alias("chat_id"), user.alias("user_id"))))


def parts_text(parts="parts"):
    """All fields of all parts as one text, for comparison."""
    fields = ("type", "text", "url", "title", "state", "approved", "tool_name", "media_type")
    one = lambda p: F.concat_ws("|", *[F.coalesce(p[f].cast("string"), F.lit("")) for f in fields])
    return F.coalesce(F.array_join(F.transform(parts, one), "\x1e"), F.lit(""))


def votes(t):
    return C.vote_upsert(T.vote_log(t))


def cursors(chats):
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return chats.withColumn("r", F.row_number().over(w)).filter(F.col("r") == 6).select("user_id", F.col("id").alias("cursor_id"))


CURSORS_SQL = """cursors AS (SELECT user_id, id AS cursor_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY created_at DESC, id DESC) AS r FROM chat) WHERE r = 6)"""

COMPACT_SQL = """compacted AS (
  SELECT id,
    arg_min_null(user_id, seq) FILTER (WHERE op = 'insert') AS user_id,
    arg_min_null(created_at, seq) FILTER (WHERE op = 'insert') AS created_at,
    arg_max_null(title, seq) FILTER (WHERE op = 'title') AS title,
    arg_max_null(visibility, seq) FILTER (WHERE op = 'insert' OR (op = 'visibility' AND visibility IN ('public', 'private'))) AS visibility,
    arg_max_null(last_context, seq) FILTER (WHERE op = 'context') AS last_context,
    max(seq) FILTER (WHERE op = 'insert') AS ins, max(seq) FILTER (WHERE op = 'delete') AS del
  FROM chat_log GROUP BY id HAVING ins IS NOT NULL AND (del IS NULL OR ins > del))"""


def _page_sql(cmp: str) -> str:
    return f"""WITH {CURSORS_SQL},
j AS (SELECT c.* FROM chat c JOIN cursors u USING (user_id) JOIN chat k ON k.id = u.cursor_id WHERE c.created_at {cmp} k.created_at),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank FROM j),
m AS (SELECT user_id, max(rank) > {PAGE} AS has_more FROM r WHERE rank <= {PAGE + 1} GROUP BY user_id)
SELECT user_id, rank, id, created_at, has_more FROM r JOIN m USING (user_id) WHERE rank <= {PAGE}"""


Q = {}


def reg(name, sql=None, views=()):
    def deco(fn):
        Q[name] = (fn, W(sql, *views) if sql else None)
        return fn
    return deco


@reg("cht_insert_chat", f"""WITH revived AS (SELECT * FROM chat_log
UNION ALL SELECT 6, 'insert', id, user_id, NULL, visibility, NULL, coalesce(CASE WHEN id % 2 = 0 THEN created_at END, TIMESTAMP '{NOW}')
  FROM chat WHERE id % 3 = 0
UNION ALL SELECT 1, 'insert', -1 - id, user_id, NULL, visibility, NULL, TIMESTAMP '{NOW}' FROM chat WHERE id % 3 = 1),
{COMPACT_SQL.replace("FROM chat_log", "FROM revived")} SELECT id, user_id, created_at, title, visibility, last_context FROM compacted""",
     ("chat", "chat_log"))
def q_insert_chat(s, d):
    """Inserted again after a delete (seq 6 follows the delete's 5), and new
    chats without a time of their own."""
    t = _t(s, d)
    c, null_ts = T.chat(t), F.lit(None).cast("timestamp_ntz")
    again = c.filter(F.col("id") % 3 == 0).select(F.lit(6).alias("seq"), "id", "user_id", "visibility",
                                                  F.when(F.col("id") % 2 == 0, F.col("created_at")).alias("created_at"))
    new = c.filter(F.col("id") % 3 == 1).select(F.lit(1).alias("seq"), (-1 - F.col("id")).alias("id"), "user_id", "visibility",
                                                null_ts.alias("created_at"))
    return C.compact_chats(C.insert_chat(CD.chat_log(t), again.unionByName(new), ts_ntz(NOW)))


@reg("cht_set_visibility", f"WITH {COMPACT_SQL} SELECT id, visibility FROM compacted", ("chat", "chat_log"))
def q_set_visibility(s, d):
    return C.set_visibility(CD.chat_log(_t(s, d)))


@reg("cht_set_title", f"WITH {COMPACT_SQL} SELECT id, title FROM compacted", ("chat", "chat_log"))
def q_set_title(s, d):
    return C.set_title(CD.chat_log(_t(s, d)))


@reg("cht_set_last_context", f"""WITH {COMPACT_SQL} SELECT id, CAST(json_extract(last_context, '$.inputTokens') AS BIGINT) AS input_tokens,
  CAST(json_extract(last_context, '$.outputTokens') AS BIGINT) AS output_tokens FROM compacted""", ("chat", "chat_log"))
def q_set_last_context(s, d):
    return C.set_last_context(CD.chat_log(_t(s, d)))


@reg("cht_get_chat", "SELECT * FROM chat WHERE id = 7", ("chat",))
def q_get_chat(s, d):
    return C.get_chat(T.chat(_t(s, d)), 7)


@reg("cht_delete_chat", """WITH ids AS (SELECT DISTINCT id AS chat_id FROM chat_log WHERE op = 'delete')
SELECT 'chat' AS kind, id AS row_id FROM chat WHERE id NOT IN (SELECT chat_id FROM ids)
UNION ALL SELECT 'message', id FROM message WHERE chat_id NOT IN (SELECT chat_id FROM ids)
UNION ALL SELECT 'vote', message_id FROM votes WHERE chat_id NOT IN (SELECT chat_id FROM ids)""",
     ("chat", "chat_log", "message", "vote_log", "votes"))
def q_delete_chat(s, d):
    t = _t(s, d)
    ids = CD.chat_log(t).filter(F.col("op") == "delete").select("id")
    return C.delete_chat(T.chat(t), T.message(t), votes(t), ids)


@reg("cht_delete_trailing", """WITH a AS (SELECT chat_id, max(created_at) AS ts FROM message WHERE role = 'user' GROUP BY chat_id),
doomed AS (SELECT m.id FROM message m JOIN a USING (chat_id) WHERE m.created_at >= a.ts)
SELECT 'message' AS kind, id AS row_id FROM message WHERE id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'vote', message_id FROM votes WHERE message_id NOT IN (SELECT id FROM doomed)""",
     ("message", "vote_log", "votes"))
def q_delete_trailing(s, d):
    t = _t(s, d)
    m = T.message(t)
    anchors = m.filter(F.col("role") == "user").groupBy("chat_id").agg(F.max("created_at").alias("ts"))
    return C.delete_trailing(m, votes(t), anchors)


@reg("cht_history_page", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank FROM chat),
m AS (SELECT user_id, max(rank) > {PAGE} AS has_more FROM r WHERE rank <= {PAGE + 1} GROUP BY user_id)
SELECT user_id, rank, id, created_at, has_more FROM r JOIN m USING (user_id) WHERE rank <= {PAGE}""", ("chat",))
def q_history_page(s, d):
    return C.history_page(T.chat(_t(s, d)), PAGE)


@reg("cht_history_after", _page_sql(">"), ("chat",))
def q_history_after(s, d):
    c = T.chat(_t(s, d))
    return C.history_after(c, cursors(c), PAGE)


@reg("cht_history_before", _page_sql("<"), ("chat",))
def q_history_before(s, d):
    c = T.chat(_t(s, d))
    return C.history_before(c, cursors(c), PAGE)


@reg("cht_history_pages", """SELECT user_id, id, created_at,
  CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) - 1) / 20) AS BIGINT) AS page FROM chat""",
     ("chat",))
def q_history_pages(s, d):
    return C.history_pages(T.chat(_t(s, d)), 20)


@reg("cht_date_buckets", f"""SELECT id, user_id, created_at,
  CASE WHEN CAST(created_at AS DATE) = CAST(TIMESTAMP '{NOW}' AS DATE) THEN 'today'
       WHEN CAST(created_at AS DATE) = CAST(TIMESTAMP '{NOW}' AS DATE) - 1 THEN 'yesterday'
       WHEN created_at > TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN 'last_week'
       WHEN created_at > TIMESTAMP '{NOW}' - INTERVAL 1 MONTH THEN 'last_month' ELSE 'older' END AS bucket FROM chat""",
     ("chat",))
def q_date_buckets(s, d):
    return C.date_buckets(T.chat(_t(s, d)), ts_ntz(NOW))


@reg("cht_upsert_messages", f"""WITH u AS (SELECT id, arg_min_null(chat_id, seq) AS chat_id, arg_min_null(role, seq) AS role,
  arg_min_null(created_at, seq) AS created_at, arg_max_null(text, seq) AS text, arg_max_null(parts, seq) AS parts,
  arg_max_null(attachments, seq) AS attachments, arg_max_null(trace_id, seq) AS trace_id FROM message_log GROUP BY id)
SELECT id, chat_id, role, created_at, text, trace_id, {chatsql.parts_text()} AS parts, array_to_string(attachments, ' ') AS attachments
FROM u""", ("message_parts", "message_log"))
def q_upsert_messages(s, d):
    u = C.upsert_messages(CD.message_log(_t(s, d)))
    return u.withColumn("parts", parts_text()).withColumn("attachments", F.array_join("attachments", " "))


@reg("cht_messages_by_chat", "SELECT * FROM message WHERE chat_id = 3", ("message",))
def q_messages_by_chat(s, d):
    return C.messages_by_chat(T.message(_t(s, d)), 3)


@reg("cht_message_by_id", f"SELECT * FROM message WHERE id = {3 * 1048576 + 1}", ("message",))
def q_message_by_id(s, d):
    return C.message_by_id(T.message(_t(s, d)), 3 * (1 << 20) + 1)


@reg("cht_traced_messages", "SELECT chat_id, id AS message_id, trace_id FROM message WHERE trace_id IS NOT NULL", ("message",))
def q_traced(s, d):
    return C.traced_messages(T.message(_t(s, d)))


@reg("cht_context_merge", f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, id DESC) = 1
    AND role = 'user' AS is_new FROM message_parts)
SELECT chat_id, id AS message_id, role, row_number() OVER (PARTITION BY chat_id ORDER BY is_new, created_at, id) AS position,
  CASE WHEN bool_or(is_new) OVER (PARTITION BY chat_id) THEN 'new_message' ELSE 'continuation' END AS mode,
  {chatsql.parts_text()} AS parts FROM l""", ("message_parts",))
def q_context_merge(s, d):
    """A chat's last message, if a user wrote it, is the request's new one."""
    m = CD.message_parts(_t(s, d))
    last = m.groupBy("chat_id").agg(F.max(F.struct("created_at", "id", "role")).alias("l")) \
        .filter("l.role = 'user'").select("chat_id", F.col("l.id").alias("new_id"))
    m = m.join(last, "chat_id", "left").withColumn("is_new", F.coalesce(F.col("id") == F.col("new_id"), F.lit(False)))
    merged = C.context_merge(m.filter(~F.col("is_new")), m.filter("is_new"))
    return merged.withColumn("position", F.col("position").cast("long")).withColumn("parts", parts_text())


@reg("cht_continuation_rows", f"""SELECT id, chat_id, role, coalesce(created_at, TIMESTAMP '{NOW}') AS created_at,
  {chatsql.parts_text()} AS parts, 0 AS n_attachments, NULL::VARCHAR AS trace_id FROM message_parts WHERE role = 'assistant'""",
     ("message_parts",))
def q_continuation(s, d):
    r = C.continuation_rows(CD.message_parts(_t(s, d)), ts_ntz(NOW))
    return r.select("id", "chat_id", "role", "created_at", parts_text().alias("parts"),
                    F.size("attachments").alias("n_attachments"), "trace_id")


@reg("cht_ui_messages", f"""SELECT id, role, {chatsql.parts_text()} AS parts,
  strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM message_parts""", ("message_parts",))
def q_ui_messages(s, d):
    return C.ui_messages(CD.message_parts(_t(s, d))).withColumn("parts", parts_text())


TEXTS = "list_transform(list_filter(parts, lambda p: p.type = 'text'), lambda p: p.text)"


@reg("cht_message_text", f"SELECT id AS message_id, array_to_string({TEXTS}, '') AS text FROM message_parts", ("message_parts",))
def q_message_text(s, d):
    return C.message_text(CD.message_parts(_t(s, d)))


# every third message's texts end in spaces that a plain \\s leaves alone
WIDE = "chr(10) || chr(12288) || chr(160) || chr(8195)"
WIDE_STRIP = "'^[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'"


@reg("cht_copy_text", f"""WITH t AS (SELECT id, array_to_string({TEXTS}, chr(10)) AS x FROM message_parts),
w AS (SELECT id, CASE WHEN id % 3 = 0 THEN concat({WIDE}, x, {WIDE}) ELSE x END AS x FROM t),
l AS (SELECT id, regexp_replace(x, {WIDE_STRIP}, '') AS x FROM w)
SELECT id AS message_id, reverse(regexp_replace(reverse(x), {WIDE_STRIP}, '')) AS text FROM l""", ("message_parts",))
def q_copy_text(s, d):
    wide = "\n\u3000\u00a0\u2003"
    m = CD.message_parts(_t(s, d))
    edge = F.array(F.struct(F.lit("text").alias("type"), F.lit(wide).alias("text")))
    p = F.transform("parts", lambda x: F.struct(x["type"].alias("type"), x["text"].alias("text")))
    framed = m.select("id", F.when(F.col("id") % 3 == 0, F.concat(edge, p, edge)).otherwise(p).alias("parts"))
    return C.copy_text(framed)


@reg("cht_title_input", """SELECT id AS message_id,
  array_to_string(list_transform(parts, lambda p: CASE WHEN p.type = 'text' THEN substr(p.text, 1, 256) END), chr(10)) AS title_input
FROM message_parts WHERE role = 'user'""", ("message_parts",))
def q_title_input(s, d):
    return C.title_input(CD.message_parts(_t(s, d)), 256)


@reg("cht_title_fallback", f"SELECT *, {chatsql.TRUNCATE_SQL('text', 128)} AS title FROM message WHERE role = 'user'", ("message",))
def q_title_fallback(s, d):
    return C.title_fallback(T.message(_t(s, d)).filter(F.col("role") == "user"), "text", 128)


@reg("cht_sanitize", """SELECT id, CASE WHEN strpos(t, '<has_function_call>') > 0
  THEN concat(substr(t, 1, strpos(t, '<has_function_call>') - 1), substr(t, strpos(t, '<has_function_call>') + 19))
  ELSE t END AS t FROM (SELECT id, concat(role, '<has_function_call>', text, '<has_function_call>') AS t FROM message)""",
     ("message",))
def q_sanitize(s, d):
    m = T.message(_t(s, d)).select("id", F.concat("role", F.lit(C.FUNCTION_CALL_TAG), "text", F.lit(C.FUNCTION_CALL_TAG)).alias("t"))
    return C.sanitize(m, "t")


@reg("cht_mcp_denied", """SELECT id AS message_id, coalesce(list_bool_or(list_transform(parts, lambda p:
  p.type = 'dynamic-tool' AND (p.state = 'output-denied' OR p.approved = false))), false) AS denied FROM message_parts""",
     ("message_parts",))
def q_mcp_denied(s, d):
    return C.mcp_denied(CD.message_parts(_t(s, d)))


CRED = {
    "err": C.CRED_ERROR, "url": C.CRED_LOGIN_URL, "conn": C.CRED_CONNECTION,
}


@reg("cht_credential_errors", f"""SELECT message_id, text,
  regexp_matches(text, '{C.CRED_ERROR}') AS is_credential_error,
  CASE WHEN regexp_matches(text, '{C.CRED_LOGIN_URL}') THEN regexp_extract(text, '{C.CRED_LOGIN_URL}', 1) END AS login_url,
  CASE WHEN regexp_matches(text, '{C.CRED_CONNECTION.replace("'", "''")}') THEN regexp_extract(text, '{C.CRED_CONNECTION.replace("'", "''")}', 1) END AS connection_name
FROM (SELECT id AS message_id, unnest(list_transform(list_filter(parts, lambda p: p.type = 'data-error'), lambda p: p.text)) AS text
      FROM message_parts)""", ("message_parts",))
def q_credential_errors(s, d):
    m = CD.message_parts(_t(s, d))
    errs = m.select(F.col("id").alias("message_id"),
                    F.explode(F.transform(F.filter("parts", lambda p: p["type"] == "data-error"), lambda p: p["text"])).alias("text"))
    return C.credential_errors(errs, "text")


def _routed_sql(cond: str) -> str:
    return f"list_filter(parts, lambda p: {cond})"


_CRED_SQL = f"coalesce(regexp_matches(p.text, '{C.CRED_ERROR}'), false)"
_ERRORS_SQL = _routed_sql(f"p.type = 'data-error' AND NOT {_CRED_SQL}")


@reg("cht_part_routing", f"""WITH r AS (SELECT id AS message_id, {_routed_sql("p.type = 'file'")} AS files, {_ERRORS_SQL} AS errors,
  {_routed_sql(f"p.type <> 'data-error' OR {_CRED_SQL}")} AS rest,
  len({_ERRORS_SQL}) > 0 AND len({_routed_sql("p.type <> 'data-error'")}) = 0 AS only_errors FROM message_parts)
SELECT message_id, {chatsql.parts_text("files")} AS files, {chatsql.parts_text("errors")} AS errors,
  {chatsql.parts_text("rest")} AS rest, only_errors FROM r""", ("message_parts",))
def q_part_routing(s, d):
    r = C.part_routing(CD.message_parts(_t(s, d)))
    return r.select("message_id", *[parts_text(c).alias(c) for c in ("files", "errors", "rest")], "only_errors")


@reg("cht_feedback_supported", """SELECT id AS message_id,
  len(list_filter(parts, lambda p: p.type = 'data-traceId')) = 0
  OR (list_filter(parts, lambda p: p.type = 'data-traceId'))[1].text IS NOT NULL AS feedback_supported FROM message_parts""",
     ("message_parts",))
def q_feedback_supported(s, d):
    return C.feedback_supported(CD.message_parts(_t(s, d)))


SEGMENTS_SQL = """WITH p AS (SELECT id AS message_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS part FROM message_parts),
k AS (SELECT message_id, pos, part, part.type AS type, CASE WHEN part.type = 'text'
    AND coalesce(starts_with(part.text, '<name>') AND ends_with(part.text, '</name>'), false) THEN 'name' ELSE part.type END AS kind FROM p),
w AS (SELECT *, lag(kind) OVER (PARTITION BY message_id ORDER BY pos) AS prev,
  last_value(CASE WHEN kind <> 'source-url' THEN kind END IGNORE NULLS) OVER (PARTITION BY message_id ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ns FROM k),
f AS (SELECT *, CASE WHEN kind = 'source-url' THEN NOT coalesce(prev IN ('text', 'name', 'source-url'), false)
  WHEN kind = 'text' THEN NOT coalesce(last_ns = 'text', false) ELSE true END AS brk FROM w)
SELECT message_id, CAST(pos AS BIGINT) AS pos, CAST(sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY message_id ORDER BY pos
  ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS segment, type FROM f"""


@reg("cht_part_segments", SEGMENTS_SQL, ("message_parts",))
def q_part_segments(s, d):
    return C.part_segments(CD.message_parts(_t(s, d)))


# part_segments as SQL, then each segment folded to markdown
MARKDOWN_SQL = f"""seg AS (SELECT message_id, segment, list(part ORDER BY pos) AS parts FROM numbered GROUP BY ALL),
md AS (SELECT message_id, segment, list_transform(parts, lambda p: {{'type': p.type, 'x': CASE WHEN p.type = 'source-url' THEN
    concat('[', CASE WHEN coalesce(p.title, '') <> '' THEN p.title ELSE p.url END, '](', p.url, '{C.CITATION_SUFFIX}', ')')
    ELSE coalesce(p.text, '') END}}) AS l FROM seg)
SELECT message_id, segment, list_reduce(l, lambda a, p: {{'type': '', 'x': CASE WHEN p.type = 'text' THEN a.x || p.x
    WHEN p.type = 'source-url' AND ends_with(a.x, '|') THEN substr(a.x, 1, length(a.x) - 1) || ' ' || p.x || '|'
    WHEN p.type = 'source-url' THEN a.x || ' ' || p.x ELSE a.x END}}, {{'type': '', 'x': ''}}).x AS markdown FROM md"""


@reg("cht_join_citations", SEGMENTS_SQL.replace("SELECT message_id, CAST(pos AS BIGINT) AS pos, ", "numbered AS (SELECT message_id, pos, part, ")
     .replace("AS segment, type FROM f", "AS segment FROM f),\n") .replace("FROM w)\nnumbered", "FROM w),\nnumbered") + MARKDOWN_SQL,
     ("message_parts",))
def q_join_citations(s, d):
    return C.join_citations(CD.message_parts(_t(s, d)))


@reg("cht_vote_upsert", "SELECT * FROM votes", ("vote_log", "votes"))
def q_vote_upsert(s, d):
    return votes(_t(s, d))


@reg("cht_votes_by_chat", "SELECT * FROM votes WHERE chat_id = 3", ("vote_log", "votes"))
def q_votes_by_chat(s, d):
    return C.votes_by_chat(votes(_t(s, d)), 3)


ACL_SQL = """acl AS (SELECT r.chat_id, r.user_id,
  CASE WHEN c.id IS NULL THEN 'not_found' WHEN c.visibility = 'public' THEN 'public' WHEN c.user_id = r.user_id THEN 'owner'
       WHEN c.visibility = 'private' THEN 'forbidden' ELSE 'allowed' END AS reason,
  coalesce(c.user_id = r.user_id, false) AS can_write
  FROM requests r LEFT JOIN chat c ON c.id = r.chat_id)"""


@reg("cht_acl", f"""WITH {ACL_SQL} SELECT chat_id, user_id, reason, reason IN ('public', 'owner', 'allowed') AS can_read, can_write FROM acl""",
     ("chat", "requests"))
def q_acl(s, d):
    t = _t(s, d)
    c = T.chat(t)
    return C.acl(c, requests(c))


@reg("cht_feedback_map", f"""WITH {ACL_SQL.replace("LEFT JOIN chat c ON c.id = r.chat_id", "LEFT JOIN chat c ON c.id = r.chat_id AND c.id % 7 <> 0")}
SELECT a.chat_id, a.user_id, v.message_id, CASE WHEN v.is_up THEN 'thumbs_up' ELSE 'thumbs_down' END AS feedback
FROM acl a JOIN votes v USING (chat_id) WHERE a.reason <> 'forbidden'""",
     ("chat", "requests", "vote_log", "votes"))
def q_feedback_map(s, d):
    """Every seventh chat is gone, its votes are not."""
    t = _t(s, d)
    c = T.chat(t)
    return C.feedback_map(votes(t), c.filter(F.col("id") % 7 != 0), requests(c))


@reg("cht_feedback_dedup", """WITH s AS (SELECT v.message_id, v.chat_id // 10 AS user_id, v.seq,
  CASE WHEN v.is_up THEN 'thumbs_up' ELSE 'thumbs_down' END AS feedback_type, m.trace_id
  FROM vote_log v JOIN message m ON m.id = v.message_id WHERE m.trace_id IS NOT NULL)
SELECT message_id, user_id, seq, trace_id, feedback_type,
  CASE WHEN row_number() OVER (PARTITION BY message_id, user_id ORDER BY seq) = 1 THEN 'create' ELSE 'update' END AS action,
  seq = max(seq) OVER (PARTITION BY message_id, user_id) AS is_final FROM s""", ("message", "vote_log"))
def q_feedback_dedup(s, d):
    t = _t(s, d)
    subs = T.vote_log(t).select("message_id", F.expr("chat_id div 10").alias("user_id"), "seq",
                                F.when(F.col("is_up"), "thumbs_up").otherwise("thumbs_down").alias("feedback_type"))
    return C.feedback_dedup(subs, T.message(t))


@reg("cht_chat_bundle", """SELECT c.id, c.user_id, c.visibility, m.id AS message_id, m.role, m.created_at AS message_at, v.is_up
FROM chat c LEFT JOIN message m ON m.chat_id = c.id LEFT JOIN votes v ON v.message_id = m.id""",
     ("chat", "message", "vote_log", "votes"))
def q_chat_bundle(s, d):
    t = _t(s, d)
    return C.chat_bundle(T.chat(t), T.message(t), votes(t))


@reg("cht_usage_normalise", """SELECT chat_id, CAST(floor(sum(CASE WHEN role = 'user' THEN length(text) END) / 4) AS BIGINT) AS input_total,
  CAST(floor(sum(CASE WHEN role = 'assistant' THEN length(text) END) / 4) AS BIGINT) AS output_total
FROM message GROUP BY chat_id""", ("message",))
def q_usage(s, d):
    m = T.message(_t(s, d))
    u = m.groupBy("chat_id").agg(
        F.floor(F.sum(F.when(F.col("role") == "user", F.length("text"))) / 4).alias("input_tokens"),
        F.floor(F.sum(F.when(F.col("role") == "assistant", F.length("text"))) / 4).alias("output_tokens"))
    n = C.usage_normalise(u)
    return n.select("chat_id", F.col("usage.inputTokens.total").alias("input_total"),
                    F.col("usage.outputTokens.total").alias("output_total"))


@reg("cht_validate_request", """WITH r AS (
  SELECT m.id AS request_no,
    concat(substr(md5(CAST(m.chat_id AS VARCHAR)), 1, 8), '-', substr(md5(CAST(m.chat_id AS VARCHAR)), 9, 4), '-',
      substr(md5(CAST(m.chat_id AS VARCHAR)), 13, 4), '-', substr(md5(CAST(m.chat_id AS VARCHAR)), 17, 4), '-',
      substr(md5(CAST(m.chat_id AS VARCHAR)), 21, 12)) AS id,
    CASE WHEN m.id % 4 = 3 THEN concat('msg-', CAST(m.id AS VARCHAR)) ELSE concat(substr(md5(CAST(m.id AS VARCHAR)), 1, 8), '-',
      substr(md5(CAST(m.id AS VARCHAR)), 9, 4), '-', substr(md5(CAST(m.id AS VARCHAR)), 13, 4), '-',
      substr(md5(CAST(m.id AS VARCHAR)), 17, 4), '-', substr(md5(CAST(m.id AS VARCHAR)), 21, 12)) END AS message_id,
    m.role, m.parts, CASE WHEN m.id % 5 = 4 THEN 'gpt' ELSE 'chat-model' END AS model, c.visibility
  FROM message_parts m JOIN chat c ON c.id = m.chat_id),
v AS (SELECT request_no, list_filter([
    CASE WHEN NOT coalesce(regexp_matches(id, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$'), false) THEN 'id' END,
    CASE WHEN NOT coalesce(regexp_matches(message_id, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$'), false) THEN 'message.id' END,
    CASE WHEN role <> 'user' THEN 'message.role' END,
    CASE WHEN list_bool_or(list_transform(parts, lambda p: CASE WHEN p.type = 'text' THEN coalesce(length(p.text), 0) < 1
        WHEN p.type = 'file' THEN NOT coalesce(p.media_type IN ('image/jpeg', 'image/png'), false)
          OR NOT coalesce(length(p.title) >= 1, false) OR NOT coalesce(regexp_matches(p.url, '^[a-zA-Z][a-zA-Z0-9+.-]*:.+'), false)
        ELSE true END)) THEN 'message.parts' END,
    CASE WHEN model NOT IN ('chat-model', 'chat-model-reasoning') THEN 'selectedChatModel' END,
    CASE WHEN visibility NOT IN ('public', 'private') THEN 'selectedVisibilityType' END], lambda x: x IS NOT NULL) AS reasons FROM r)
SELECT request_no, len(reasons) = 0 AS valid, array_to_string(reasons, ',') AS reasons FROM v""", ("chat", "message_parts"))
def q_validate(s, d):
    t = _t(s, d)
    m = CD.message_parts(t)
    def uuid_of(c):
        h = F.md5(c.cast("string"))
        return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4),
                           F.substring(h, 21, 12))
    r = m.join(T.chat(t).select(F.col("id").alias("chat_id"), "visibility"), "chat_id").select(
        F.col("id").alias("request_no"), uuid_of(F.col("chat_id")).alias("id"),
        F.when(F.col("id") % 4 == 3, F.concat(F.lit("msg-"), F.col("id").cast("string"))).otherwise(uuid_of(F.col("id"))).alias("message_id"),
        "role", "parts", F.when(F.col("id") % 5 == 4, "gpt").otherwise("chat-model").alias("model"), "visibility")
    return C.validate_request(r)


QUERIES = Q
