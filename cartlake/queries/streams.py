"""Streaming (STR) operators: batch twins registered here; tests run the
streaming versions over a file source and compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rag as G
from ..sources import streamdata as SD
from ..sources import tables as T
from ..sources.tables import Tables
from ..streaming import streams as S
from . import chatsql  # noqa: F401
from .chat import requests as chat_requests
from .rag import DOCS_SQL, NEW_DOCS_SQL, _para_chunks_sql, docs, new_docs, para_chunks, vector_sql, vector_text
from .views import with_views as W

Q = {}


def reg(name, sql=None, views=()):
    def deco(fn):
        Q[name] = (fn, W(sql, *views) if sql else None)
        return fn
    return deco


def _t(s, d):
    return Tables(s, d)


# sessions of a key: a new one starts when the gap reaches five minutes
def sessions_sql(src: str, key: str) -> str:
    return f"""lagged AS (SELECT *, lag(ts) OVER (PARTITION BY {key} ORDER BY ts) AS before FROM {src}),
broken AS (SELECT *, CASE WHEN before IS NULL OR ts > before + INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS brk FROM lagged),
ses AS (SELECT *, sum(brk) OVER (PARTITION BY {key} ORDER BY ts RANGE UNBOUNDED PRECEDING) AS sid FROM broken),
timed AS (SELECT *, min(ts) OVER (PARTITION BY {key}, sid) AS session_start FROM ses)"""


CHUNK_SESSIONS = sessions_sql("stream_chunk", "stream_id")


@reg("str_assemble_text", f"""WITH {CHUNK_SESSIONS}
SELECT stream_id, session_start, coalesce(string_agg(delta, '' ORDER BY seq) FILTER (WHERE type = 'text-delta'), '') AS text,
  CAST(count(*) FILTER (WHERE type = 'text-delta') AS INTEGER) AS n_deltas FROM timed GROUP BY stream_id, session_start""",
     ("stream_chunk",))
def q_assemble(s, d):
    return S.assemble_text(T.stream_chunk(_t(s, d)))


@reg("str_agent_items", """WITH m AS (SELECT event_id, event_type AS e, props, json_extract_string(props, '$.k') AS k FROM events),
l AS (SELECT event_id, CASE WHEN e = 'click' THEN [['message', 'said ' || k], ['function_call_output', '{"k":"' || k || '","type":"click"}']]
  WHEN e = 'error' THEN [['message', 'said ' || k], ['function_call_output', props]]
  WHEN e = 'signup' THEN [] ELSE [['message', 'said ' || k]] END AS l FROM m),
x AS (SELECT event_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS i FROM l)
SELECT event_id, pos, i[1] AS item_type, i[2] AS content FROM x""")
def q_agent_items(s, d):
    return S.agent_items(SD.agent_updates(_t(s, d).events))


RAW_SQL = """raw AS (SELECT user_id AS stream_id, event_id AS seq, ts, CASE
  WHEN event_type = 'purchase' THEN concat('{"type":"response.output_item.done","output":{"trace":{"info":{"trace_id":"tr-', CAST(event_id AS VARCHAR), '"}}}}')
  WHEN event_type = 'view' THEN concat('{"type":"response.output_text.delta","trace_id":"bare-', CAST(event_id AS VARCHAR), '"}')
  ELSE '{"type":"response.output_text.delta"}' END AS raw FROM events)"""


@reg("str_done_items", f"WITH {RAW_SQL} SELECT * FROM raw WHERE json_extract_string(raw, '$.type') = 'response.output_item.done'")
def q_done(s, d):
    return S.done_items(SD.raw_events(_t(s, d).events))


@reg("str_trace_id", f"""WITH {RAW_SQL}, {sessions_sql("raw", "stream_id")},
x AS (SELECT stream_id, session_start, seq, CASE WHEN json_extract_string(raw, '$.type') = 'response.output_item.done'
  THEN json_extract_string(raw, '{SD.TRACE_PATH}') END AS n, json_extract_string(raw, '$.trace_id') AS b FROM timed)
SELECT stream_id, session_start,
  coalesce(arg_max(n, seq) FILTER (WHERE n IS NOT NULL), arg_min(b, seq) FILTER (WHERE b IS NOT NULL)) AS trace_id
FROM x GROUP BY stream_id, session_start""")
def q_trace(s, d):
    return S.trace_id(SD.raw_events(_t(s, d).events))


@reg("str_outcome", f"""WITH {CHUNK_SESSIONS}
SELECT stream_id, session_start, CASE WHEN fe IS NULL THEN 'ok' WHEN ft IS NULL OR fe < ft THEN 'failed' ELSE 'partial' END AS outcome
FROM (SELECT stream_id, session_start, min(seq) FILTER (WHERE starts_with(type, 'text-')) AS ft, min(seq) FILTER (WHERE type = 'error') AS fe
  FROM timed GROUP BY stream_id, session_start)""", ("stream_chunk",))
def q_outcome(s, d):
    return S.outcome(T.stream_chunk(_t(s, d)))


def _spoken(kind: str) -> str:
    return (f"[{{'type': '{kind}-start', 'delta': NULL::VARCHAR}}, {{'type': '{kind}-delta', 'delta': p.text}}, "
            f"{{'type': '{kind}-end', 'delta': NULL::VARCHAR}}]")


@reg("str_expand_parts", f"""WITH k AS (SELECT id, list_transform(parts, lambda p, i: {{'text': p.text, 'url': p.url, 'tool_name': p.tool_name,
    'type': CASE WHEN p.type = 'text' AND (i - 1) % 5 = 0 THEN 'reasoning' WHEN p.type = 'source-url' AND p.title IS NULL THEN 'source-document'
      WHEN p.type = 'dynamic-tool' AND p.state = 'output-available' THEN 'tool-result' ELSE p.type END}}) AS parts,
  CASE WHEN id % 7 = 0 THEN 'length' ELSE 'stop' END AS reason FROM message_parts WHERE role = 'assistant'),
r AS (SELECT id AS message_id, list_concat(flatten(list_transform(parts, lambda p:
  CASE WHEN p.type IN ('text', 'reasoning') AND coalesce(length(p.text), 0) = 0 THEN []
       WHEN p.type = 'text' THEN {_spoken('text')} WHEN p.type = 'reasoning' THEN {_spoken('reasoning')}
       WHEN p.type IN ('file', 'source-url', 'source-document') THEN [{{'type': p.type, 'delta': p.url}}]
       WHEN p.type = 'dynamic-tool' THEN [{{'type': 'tool-input-available', 'delta': p.tool_name}}]
       WHEN p.type = 'tool-result' THEN [{{'type': 'tool-output-available', 'delta': p.tool_name}}]
       ELSE [] END)), [{{'type': 'finish', 'delta': reason}}]) AS l FROM k)
SELECT message_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS seq, unnest(l).type AS type, unnest(l).delta AS delta FROM r""",
     ("message_parts",))
def q_expand(s, d):
    return S.expand_parts(SD.results(_t(s, d)))


# the stream of a chat is the one of the user with its number; every third has none that is active
RESUME_SQL = """asked AS (SELECT r.chat_id, r.user_id, CASE WHEN r.chat_id % 2 = 0 THEN abs(r.chat_id) % 4 END AS cursor FROM requests r),
act AS (SELECT DISTINCT chat_id, abs(chat_id) % 50 AS stream_id FROM requests WHERE chat_id % 3 <> 0)"""


@reg("str_resume", f"""WITH {RESUME_SQL},
allowed AS (SELECT DISTINCT a.chat_id, a.user_id FROM asked a LEFT JOIN chat c ON c.id = a.chat_id
  WHERE c.id IS NULL OR c.visibility = 'public' OR c.user_id = a.user_id)
SELECT a.chat_id, a.user_id, s.stream_id, s.seq, s.type, s.delta FROM asked a JOIN allowed USING (chat_id, user_id)
JOIN act USING (chat_id) JOIN stream_chunk s ON s.stream_id = act.stream_id WHERE s.seq >= coalesce(a.cursor, 0)""",
     ("chat", "requests", "stream_chunk"))
def q_resume(s, d):
    t = _t(s, d)
    chats = T.chat(t)
    asked = chat_requests(chats).withColumn("cursor", F.when(F.col("chat_id") % 2 == 0, F.abs("chat_id") % 4))
    active = asked.filter(F.col("chat_id") % 3 != 0).select("chat_id", (F.abs("chat_id") % 50).alias("stream_id")).distinct()
    return S.resume(T.stream_chunk(t), asked, active, chats)


@reg("str_resume_decision", f"""WITH g AS (SELECT event_id AS stream_id, event_id % 11 = 0 AS is_abort, event_type = 'view' AS dis, event_type = 'error' AS err,
  CASE event_id % 4 WHEN 0 THEN 'finish' WHEN 1 THEN 'text-delta' WHEN 2 THEN 'error' END AS last_part, event_id % 5 AS attempts,
  event_id % 9 = 0 AS cred FROM events),
h AS (SELECT *, coalesce(last_part <> 'finish', true) AND (dis OR err OR last_part IS NULL) AS should FROM g)
SELECT stream_id, CASE WHEN is_abort THEN 'no_abort' WHEN cred THEN 'no_credential'
  WHEN should AND attempts < {S.MAX_RESUME_ATTEMPTS} THEN 'resume' WHEN should THEN 'give_up' ELSE 'done' END AS decision FROM h""")
def q_resume_decision(s, d):
    return S.resume_decision(SD.endings(_t(s, d).events))


@reg("str_active_stream", f"""WITH reg AS (SELECT user_id AS chat_id, event_id AS seq, ts, event_type IN ('signup', 'view') AS is_reg FROM events
  WHERE event_type IN ('signup', 'view', 'purchase')), {sessions_sql("reg", "chat_id")}
SELECT chat_id, session_start, concat('st-', CAST(reg_seq AS VARCHAR)) AS stream_id FROM (SELECT chat_id, session_start,
  max(seq) FILTER (WHERE is_reg) AS reg_seq, max(seq) FILTER (WHERE NOT is_reg) AS clear_seq FROM timed GROUP BY chat_id, session_start)
WHERE reg_seq IS NOT NULL AND (clear_seq IS NULL OR clear_seq < reg_seq)""")
def q_active(s, d):
    return S.active_stream(SD.registrations(_t(s, d).events))


@reg("str_ttl_sessions", """WITH x AS (SELECT stream_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY stream_id ORDER BY ts) IS NULL
    OR ts > lag(ts) OVER (PARTITION BY stream_id ORDER BY ts) + INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS brk FROM stream_chunk),
y AS (SELECT *, sum(brk) OVER (PARTITION BY stream_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM x)
SELECT stream_id, min(ts) AS session_start, max(ts) + INTERVAL 5 MINUTE AS session_end, count(*) AS n_chunks FROM y GROUP BY stream_id, sid""",
     ("stream_chunk",))
def q_ttl(s, d):
    return S.ttl_sessions(T.stream_chunk(_t(s, d)))


@reg("str_upsert_store", """SELECT ns_kind, ns_user, mem_key, arg_max(value, seq) AS value, max(seq) AS seq FROM memory_log
GROUP BY ALL HAVING NOT arg_max(is_delete, seq)""", ("memory_log",))
def q_upsert(s, d):
    return S.upsert_store(T.memory_log(_t(s, d)))


@reg("str_approval_state", """WITH ev AS (SELECT user_id AS request_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'requested'
    WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'denied' END AS kind FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
lr AS (SELECT request_id, max(seq) FILTER (WHERE kind = 'requested') AS req_seq FROM ev GROUP BY request_id),
dec AS (SELECT e.request_id, arg_min(e.kind, e.seq) AS decision FROM ev e JOIN lr USING (request_id)
  WHERE e.kind <> 'requested' AND e.seq > lr.req_seq GROUP BY e.request_id)
SELECT request_id, coalesce(decision, 'pending') AS state,
  CASE coalesce(decision, 'pending') WHEN 'approved' THEN 'continue' WHEN 'denied' THEN 'stop' ELSE 'wait' END AS action
FROM lr LEFT JOIN dec USING (request_id) WHERE req_seq IS NOT NULL""")
def q_approval(s, d):
    return S.approval_state(SD.approval_events(_t(s, d).events))


@reg("str_index_sync", f"""WITH {DOCS_SQL}, {NEW_DOCS_SQL}, {_para_chunks_sql('old', 'docs')}, {_para_chunks_sql('new', 'new_docs')},
ch AS (SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id, coalesce(n.doc_name, o.doc_name) AS doc_name,
  CASE WHEN o.chunk_id IS NULL THEN 'insert' WHEN n.chunk_id IS NULL THEN 'delete' WHEN md5(o.content) <> md5(n.content) THEN 'update' END AS action,
  n.content AS content FROM old o FULL OUTER JOIN new n USING (chunk_id))
SELECT chunk_id, doc_name, action, CASE WHEN action <> 'delete' THEN {vector_sql('content')} END AS embedding FROM ch WHERE action IS NOT NULL""")
def q_index_sync(s, d):
    """One step of the triggered sync: the change set with the vector of every
    inserted or updated chunk."""
    t = _t(s, d)
    ch = S.index_sync_batch(para_chunks(docs(t)), para_chunks(new_docs(t)), G.embed)
    return ch.select("chunk_id", "doc_name", "action", F.when(F.col("action") != "delete", vector_text("embedding")).alias("embedding"))


QUERIES = Q
