"""Memory and checkpoint (MEM) query bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory as M
from ..sources import chatdata as CD
from ..sources import tables as T
from ..sources.tables import Tables
from . import chatsql  # noqa: F401  (registers the chat-shaped DuckDB views)
from .views import with_views as W

Q = {}


def reg(name, sql=None, views=()):
    def deco(fn):
        Q[name] = (fn, W(sql, *views) if sql else None)
        return fn
    return deco


def _t(s, d):
    return Tables(s, d)


def _requests(t):
    e, typ, u = t.events, F.col("event_type"), F.col("user_id").cast("string")
    null_s = F.lit(None).cast("string")
    ci = (F.when(typ == "view", F.create_map(F.lit("user_id"), F.concat(F.lit("u"), u), F.lit("thread_id"), F.lit("")))
          .when(typ == "click", F.create_map(F.lit("user_id"), null_s, F.lit("thread_id"), F.concat(F.lit("t"), u)))
          .when(typ == "signup", F.create_map(F.lit("session_id"), F.concat(F.lit("s"), F.col("event_id").cast("string"))))
          .when(typ == "purchase", F.create_map(F.lit("thread_id"), F.concat(F.lit("t"), u), F.lit("session_id"), F.lit("s")))
          .otherwise(F.create_map().cast("map<string,string>")))
    conv = (F.when(typ.isin("click", "error"), F.concat(F.lit("conv-"), u)).when(typ == "signup", F.lit("")))
    return e.select(F.col("event_id").alias("request_id"), ci.alias("custom_inputs"),
                    F.concat(F.lit("ctx"), u).alias("context_user_id"), conv.alias("conversation_id"))


@reg("mem_resolve_ids", """WITH r AS (SELECT event_id AS request_id, event_type AS t, CAST(user_id AS VARCHAR) AS u FROM events)
SELECT request_id,
  CASE WHEN t = 'view' THEN concat('u', u) WHEN t = 'click' THEN NULL ELSE concat('ctx', u) END AS user_id,
  coalesce(CASE WHEN t IN ('click', 'purchase') THEN concat('t', u) END,
           nullif(CASE WHEN t IN ('click', 'error') THEN concat('conv-', u) WHEN t = 'signup' THEN '' END, ''),
           concat('thread-', substr(sha256(CAST(request_id AS VARCHAR)), 1, 16))) AS thread_id,
  coalesce(nullif(CASE WHEN t IN ('click', 'error') THEN concat('conv-', u) WHEN t = 'signup' THEN '' END, ''),
           CASE WHEN t = 'signup' THEN concat('s', CAST(request_id AS VARCHAR)) WHEN t = 'purchase' THEN 's' END) AS session_id
FROM r""")
def q_resolve(s, d):
    return M.resolve_ids(_requests(_t(s, d)))


@reg("mem_namespace", """WITH u AS (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN concat('user.', CAST(user_id // 2 AS VARCHAR))
  ELSE concat('user-', CAST(user_id // 2 AS VARCHAR)) END AS raw_user FROM events),
n AS (SELECT raw_user, 'user_memories' AS ns_kind, replace(raw_user, '.', '-') AS ns_user FROM u)
SELECT *, count(*) OVER (PARTITION BY ns_kind, ns_user) AS n_raw_ids, count(*) OVER (PARTITION BY ns_kind, ns_user) > 1 AS collides FROM n""")
def q_namespace(s, d):
    e = _t(s, d).events
    half = F.floor(F.col("user_id") / 2).cast("string")
    raw = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("user."), half)).otherwise(F.concat(F.lit("user-"), half))
    return M.namespace(e.select(raw.alias("user_id")), "user_memories")


def _put_log(t):
    v = F.col("value")
    return T.memory_log(t).withColumn("value", F.when(F.col("seq") % 13 == 0, v.substr(F.lit(3), F.length(v)))
                                      .when(F.col("seq") % 17 == 0, F.concat(F.lit("["), v, F.lit("]"))).otherwise(v))


PUT_LOG = """plog AS (SELECT seq, ns_kind, ns_user, mem_key, CASE WHEN seq % 13 = 0 THEN substr(value, 3)
  WHEN seq % 17 = 0 THEN concat('[', value, ']') ELSE value END AS value, is_delete FROM memory_log),
ok AS (SELECT * FROM plog WHERE is_delete OR (coalesce(json_valid(value), false) AND json_type(value) = 'OBJECT'))"""


@reg("mem_put", f"""WITH {PUT_LOG}
SELECT ns_kind, ns_user, mem_key, arg_max(value, seq) AS value, max(seq) AS seq FROM ok GROUP BY ALL
HAVING NOT arg_max(is_delete, seq)""", ("memory_log",))
def q_put(s, d):
    return M.put(_put_log(_t(s, d)))


@reg("mem_delete", f"""WITH {PUT_LOG}
SELECT ns_kind, ns_user, mem_key, max(seq) AS deleted_seq FROM ok GROUP BY ALL
HAVING arg_max(is_delete, seq) AND min(seq) FILTER (WHERE NOT is_delete) IS NOT NULL""", ("memory_log",))
def q_delete(s, d):
    return M.delete(_put_log(_t(s, d)))


ISO = """CASE WHEN strftime(ts, '%f') = '000000' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END"""


def _summary_events(t, thread):
    """Every event saves its props as a summary: some are no JSON, some no
    object, some already hold a thread_id, some threads need escaping."""
    e, k, v = t.events, F.col("event_id"), F.col("props")
    value = (F.when(k % 13 == 0, v.substr(F.lit(3), F.length(v))).when(k % 17 == 0, F.concat(F.lit("["), v, F.lit("]")))
             .when(k % 19 == 0, F.lit('{"thread_id": "stale", "note": "say \\"hi\\"", "n": [1, null]}'))
             .when(k % 23 == 0, F.lit("{}")).otherwise(v))
    thread = F.when(k % 29 == 0, F.concat(thread, F.lit('-"q"'))).otherwise(thread)
    return e.select(F.col("user_id").alias("ns_user"), thread.alias("thread_id"), "ts", "event_id", value.alias("value"))


SAVES_SQL = """saves AS (SELECT event_id, user_id AS ns_user, ts,
    concat('thread-', CAST(user_id AS VARCHAR), {extra}, CASE WHEN event_id % 29 = 0 THEN '-"q"' ELSE '' END) AS thread_id,
    CASE WHEN event_id % 13 = 0 THEN substr(props, 3) WHEN event_id % 17 = 0 THEN concat('[', props, ']')
      WHEN event_id % 19 = 0 THEN '{{"thread_id": "stale", "note": "say \\"hi\\"", "n": [1, null]}}'
      WHEN event_id % 23 = 0 THEN '{{}}' ELSE props END AS value FROM events),
accepted AS (SELECT *, {iso} AS stamp FROM saves WHERE coalesce(json_valid(value), false) AND json_type(value) = 'OBJECT')"""
MERGED_SQL = "CAST(json_merge_patch(value, json_object('thread_id', thread_id, 'timestamp', stamp)) AS VARCHAR)"


@reg("mem_put_task", f"""WITH {SAVES_SQL.format(extra="''", iso=ISO)}
SELECT 'task_summaries' AS ns_kind, ns_user, concat(thread_id, '_', stamp) AS mem_key, {MERGED_SQL} AS value FROM accepted""")
def q_put_task(s, d):
    return M.put_task(_summary_events(_t(s, d), F.concat(F.lit("thread-"), F.col("user_id").cast("string"))))


@reg("mem_put_conversation", f"""WITH {SAVES_SQL.format(extra="'-', strftime(ts, '%Y-%m-%d')", iso=ISO)}
SELECT 'conversation_summaries' AS ns_kind, ns_user, thread_id AS mem_key, arg_max({MERGED_SQL}, ts) AS value
FROM accepted GROUP BY ns_user, thread_id""")
def q_put_conversation(s, d):
    thread = F.concat(F.lit("thread-"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))
    return M.put_conversation(_summary_events(_t(s, d), thread))


def _store(t):
    e = t.embeddings
    return e.select(F.lit("user_memories").alias("ns_kind"), F.col("label").cast("string").alias("ns_user"),
                    F.col("vec_id").alias("mem_key"),
                    F.concat(F.lit('{"label": '), F.col("label").cast("string"), F.lit("}")).alias("value"), "embedding")


def _mem_queries(t):
    """The stated query set, each in the namespace of its label."""
    return t.embeddings.filter(F.col("vec_id") % 50 == 0).select(
        F.col("vec_id").alias("query_id"), F.lit("user_memories").alias("ns_kind"),
        F.col("label").cast("string").alias("ns_user"), "embedding")


def _render_queries(t):
    """The queries of mem_search and, for each, one in a namespace without
    items."""
    q = _mem_queries(t)
    return q.unionByName(q.withColumn("query_id", -1 - F.col("query_id")).withColumn("ns_user", F.lit("nobody")))


def cos_sql(a: str, b: str) -> str:
    dot = f"list_reduce(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)), lambda x, y: x + y, 0.0)"
    return f"({dot} / ({norm_sql(a)} * {norm_sql(b)}))"


def norm_sql(a: str) -> str:
    return f"sqrt(list_reduce(list_transform({a}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda x, y: x + y, 0.0))"


SEARCH_SQL = f"""store AS (SELECT 'user_memories' AS ns_kind, CAST(label AS VARCHAR) AS ns_user, vec_id AS mem_key,
  concat('{{"label": ', CAST(label AS VARCHAR), '}}') AS value, embedding FROM embeddings),
qs AS (SELECT vec_id AS query_id, 'user_memories' AS ns_kind, CAST(label AS VARCHAR) AS ns_user, embedding AS q_emb
  FROM embeddings WHERE vec_id % 50 = 0),
scored AS (SELECT q.query_id, s.ns_kind, s.ns_user, s.mem_key, s.value,
  floor({cos_sql('q.q_emb', 's.embedding')} * 1000000 + 0.5) / 1000000 AS score
  FROM qs q JOIN store s USING (ns_kind, ns_user)),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_key) AS rank FROM scored)
  WHERE rank <= 5)"""


@reg("mem_search", f"WITH {SEARCH_SQL} SELECT * FROM hits")
def q_search(s, d):
    t = _t(s, d)
    return M.search(_store(t), _mem_queries(t), 5)


@reg("mem_render", f"""WITH {SEARCH_SQL}
SELECT query_id, concat('Found ', CAST(count(*) AS VARCHAR), ' relevant memories:', chr(10),
  string_agg(concat('- [', CAST(mem_key AS VARCHAR), ']: ', value), chr(10) ORDER BY rank)) AS text FROM hits GROUP BY query_id
UNION ALL SELECT -1 - query_id, '{M.RENDERED["user_memories"][1]}' FROM qs""")
def q_render(s, d):
    t = _t(s, d)
    qs = _render_queries(t)
    return M.render(M.search(_store(t), qs, 5), qs, "user_memories")


def _ckpts(t):
    return t.conversations.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("step"),
                                  (F.col("turn") + 1).alias("n_messages"), F.col("role").alias("last_role"))


@reg("mem_latest_checkpoint", """SELECT conv_id AS thread_id, max(turn) AS step, arg_max(turn + 1, turn) AS n_messages,
  arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id""")
def q_latest_ckpt(s, d):
    return M.latest_checkpoint(_ckpts(_t(s, d)))


@reg("mem_merge_messages", """WITH g AS (SELECT chat_id, id, min(seq) AS s0, arg_min(created_at, seq) AS c0,
  arg_max_null(text, seq) AS text FROM message_log GROUP BY chat_id, id)
SELECT chat_id, id, row_number() OVER (PARTITION BY chat_id ORDER BY s0, c0, id) AS position, text FROM g""", ("message_parts", "message_log"))
def q_merge_messages(s, d):
    return M.merge_messages(CD.message_log(_t(s, d)))


@reg("mem_broken_threads", """WITH p AS (SELECT chat_id AS thread_id, concat(CAST(id AS VARCHAR), ':', CAST(generate_subscripts(parts, 1) - 1 AS VARCHAR)) AS tool_call_id,
  unnest(parts) AS part FROM message_parts),
calls AS (SELECT thread_id, tool_call_id FROM p WHERE part.type = 'dynamic-tool'),
results AS (SELECT thread_id, tool_call_id FROM p WHERE part.type = 'dynamic-tool' AND part.state = 'output-available'),
broken AS (SELECT DISTINCT thread_id FROM calls c WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.thread_id = c.thread_id AND r.tool_call_id = c.tool_call_id))
SELECT conv_id AS thread_id, turn AS step, turn + 1 AS n_messages, role AS last_role FROM conversations
WHERE conv_id NOT IN (SELECT thread_id FROM broken)""", ("message_parts",))
def q_broken(s, d):
    t = _t(s, d)
    p = CD.message_parts(t).select(F.col("chat_id").alias("thread_id"), "id", F.posexplode("parts").alias("pos", "part"))
    calls = p.filter(F.col("part.type") == "dynamic-tool").select(
        "thread_id", F.concat(F.col("id").cast("string"), F.lit(":"), F.col("pos").cast("string")).alias("tool_call_id"),
        F.col("part.state").alias("state"))
    results = calls.filter(F.col("state") == "output-available").select("thread_id", "tool_call_id")
    return M.broken_threads(calls.select("thread_id", "tool_call_id"), results, _ckpts(t))


QUERIES = Q
