"""Trace (TRC) and evaluation (EVL) query bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chat as C
from ..operators import evaluate as E
from ..operators import traces as TR
from ..sources import chatdata as CD
from ..sources import tables as T
from ..sources.tables import Tables
from . import chatsql  # noqa: F401
from .chat import COMPACT_SQL
from .views import with_views as W

Q = {}


def reg(name, sql=None, views=()):
    def deco(fn):
        Q[name] = (fn, W(sql, *views) if sql else None)
        return fn
    return deco


def _t(s, d):
    return Tables(s, d)


STATUS_SQL = """ts AS (SELECT trace_id, CASE WHEN bool_or(status = 'ERROR') THEN 'ERROR' ELSE 'OK' END AS status,
  count(*) AS n_spans, min(start_time) AS start_time FROM spans GROUP BY trace_id)"""


@reg("trc_ok", f"WITH {STATUS_SQL} SELECT * FROM ts WHERE status = 'OK'", ("spans",))
def q_ok(s, d):
    return TR.ok(T.spans(_t(s, d)))


@reg("trc_by_type", """SELECT trace_id, count(*) AS n_spans, array_to_string(list_sort(list(DISTINCT name)), ',') AS names
FROM spans WHERE span_type = 'TOOL' GROUP BY trace_id""", ("spans",))
def q_by_type(s, d):
    return TR.by_type(T.spans(_t(s, d)), "TOOL")


@reg("trc_sessions", f"""WITH {STATUS_SQL},
m AS (SELECT trace_id, start_time, concat('s-', split_part(trace_id, '-', 1)) AS session_id,
  CASE WHEN dayofmonth(start_time) % 2 = 0 THEN concat('th-', trace_id) END AS thread_id FROM ts)
SELECT coalesce(thread_id, session_id) AS session, count(*) AS n_traces, min(start_time) AS first_start FROM m GROUP BY 1""",
     ("spans",))
def q_sessions(s, d):
    st = TR.trace_status(T.spans(_t(s, d)))
    meta = st.select("trace_id", "start_time",
                     F.concat(F.lit("s-"), F.split_part("trace_id", F.lit("-"), F.lit(1))).alias("session_id"),
                     F.when(F.dayofmonth("start_time") % 2 == 0, F.concat(F.lit("th-"), F.col("trace_id"))).alias("thread_id"))
    return TR.sessions(meta)


@reg("trc_latency_errors", """SELECT date_trunc('day', start_time) AS window_start, count(*) AS n_spans,
  floor(quantile_cont(duration_ms, 0.5) * 1000000 + 0.5) / 1000000 AS p50_ms,
  floor(quantile_cont(duration_ms, 0.95) * 1000000 + 0.5) / 1000000 AS p95_ms,
  floor(avg(CASE WHEN status = 'ERROR' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 1000000 + 0.5) / 1000000 AS error_rate
FROM spans GROUP BY 1""", ("spans",))
def q_latency(s, d):
    return TR.latency_errors(T.spans(_t(s, d)), "1 day", exact=True)


@reg("trc_token_usage", f"""WITH {COMPACT_SQL},
u AS (SELECT user_id, id AS chat_id, CAST(json_extract(last_context, '$.inputTokens') AS BIGINT) AS i,
  CAST(json_extract(last_context, '$.outputTokens') AS BIGINT) AS o FROM compacted)
SELECT user_id, chat_id, CAST(sum(coalesce(i, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(o, 0)) AS BIGINT) AS output_tokens,
  CAST(GROUPING(user_id, chat_id) AS INTEGER) AS level FROM u GROUP BY ROLLUP (user_id, chat_id)""", ("chat", "chat_log"))
def q_token_usage(s, d):
    """The usage stored with each live chat."""
    c = C.compact_chats(CD.chat_log(_t(s, d)))
    ctx = F.from_json("last_context", "inputTokens long, outputTokens long")
    return TR.token_usage(c.select("user_id", F.col("id").alias("chat_id"), ctx["inputTokens"].alias("input_tokens"),
                                   ctx["outputTokens"].alias("output_tokens")))


@reg("trc_tool_usage", """SELECT trace_id, count(*) AS n_calls, count(DISTINCT name) AS n_tools,
  array_to_string(list_sort(list(DISTINCT name)), ',') AS tools FROM spans WHERE span_type = 'TOOL' GROUP BY trace_id""",
     ("spans",))
def q_tool_usage(s, d):
    return TR.tool_usage(T.spans(_t(s, d)))


# ---------------------------------------------------------------- evaluation

def final_answers(t):
    return E.final_answer(CD.message_parts(t))


FINAL_SQL = """fa AS (SELECT chat_id, coalesce(
    arg_max(text, (created_at, id)) FILTER (WHERE length(text) > 0 AND NOT list_bool_or(list_transform(parts, lambda p: p.type = 'dynamic-tool'))),
    arg_max(text, (created_at, id))) AS answer FROM message_parts GROUP BY chat_id)"""


@reg("evl_final_answer", f"WITH {FINAL_SQL} SELECT * FROM fa", ("message_parts",))
def q_final(s, d):
    return final_answers(_t(s, d))


@reg("evl_response_guard", f"""WITH {FINAL_SQL} SELECT chat_id, answer, CAST(coalesce(length(answer), 0) AS INTEGER) AS answer_len,
  coalesce(length(answer), 0) < 10 AS flagged FROM fa""", ("message_parts",))
def q_guard(s, d):
    return E.response_guard(final_answers(_t(s, d)), "answer", 10)


def _hits_sql(text: str, phrases: list[str]) -> str:
    arr = "[" + ", ".join("'" + p.lower().replace("'", "''") + "'" for p in phrases) + "]"
    return f"list_reduce(list_transform({arr}, lambda p: CASE WHEN strpos({text}, p) > 0 THEN 1 ELSE 0 END), lambda a, b: a + b, 0)"


SPEC_SQL = f"CASE WHEN answer IS NULL THEN 0.0::DOUBLE ELSE least({_hits_sql('lower(answer)', E.POLICY_KEYWORDS)} / 3.0::DOUBLE, 1.0::DOUBLE) END"
_e, _a, _w, _b = (f"{x}::DOUBLE" for x in E.TONE_WEIGHTS)
TONE_SQL = f"""CASE WHEN answer IS NULL THEN 0.0::DOUBLE ELSE floor((CASE WHEN {_hits_sql('lower(answer)', E.TONE_BLAME)} > 0
  THEN greatest(s3 - {_b}, 0.0::DOUBLE) ELSE s3 END) * 100 + 0.5) / 100 END"""
TONE_STAGES = f"""t0 AS (SELECT *, CASE WHEN {_hits_sql('lower(answer)', E.TONE_EMPATHY)} > 0 THEN 0.0::DOUBLE + {_e} ELSE 0.0::DOUBLE END AS s1 FROM fa),
t1 AS (SELECT *, CASE WHEN {_hits_sql('lower(answer)', E.TONE_ACTION)} > 0 THEN s1 + {_a} ELSE s1 END AS s2 FROM t0),
t2 AS (SELECT *, CASE WHEN {_hits_sql('lower(answer)', E.TONE_WARM)} > 0 THEN s2 + {_w} ELSE s2 END AS s3 FROM t1)"""


@reg("evl_policy_specificity", f"WITH {FINAL_SQL} SELECT chat_id, {SPEC_SQL} AS score FROM fa", ("message_parts",))
def q_specificity(s, d):
    return final_answers(_t(s, d)).select("chat_id", E.policy_specificity(F.col("answer")).alias("score"))


@reg("evl_tone", f"WITH {FINAL_SQL}, {TONE_STAGES} SELECT chat_id, {TONE_SQL} AS score FROM t2", ("message_parts",))
def q_tone(s, d):
    return final_answers(_t(s, d)).select("chat_id", E.tone(F.col("answer")).alias("score"))


@reg("evl_scorer_matrix", f"""WITH {FINAL_SQL}, {TONE_STAGES},
sc AS (SELECT chat_id, {SPEC_SQL} AS policy_specificity, {TONE_SQL} AS tone,
  CASE WHEN coalesce(length(answer), 0) < 10 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS response_ok FROM t2),
l AS (UNPIVOT sc ON policy_specificity, tone, response_ok INTO NAME scorer VALUE value)
SELECT scorer, count(value) AS n, floor(avg(value) * 1000000 + 0.5) / 1000000 AS mean FROM l GROUP BY scorer""",
     ("message_parts",))
def q_matrix(s, d):
    rows = final_answers(_t(s, d)).withColumnRenamed("chat_id", "row_id")
    return E.scorer_matrix(rows, {
        "policy_specificity": E.policy_specificity(F.col("answer")),
        "tone": E.tone(F.col("answer")),
        "response_ok": F.when(F.coalesce(F.length("answer"), F.lit(0)) < 10, 0.0).otherwise(1.0),
    })


def _routing_rows(t):
    sp = T.spans(t).select(F.col("trace_id")).distinct()
    ms = T.message(t).select(F.coalesce("trace_id", F.concat(F.lit("m-"), F.col("id").cast("string"))).alias("trace_id"))
    rows = sp.unionByName(ms).distinct()
    return rows.select(F.col("trace_id").alias("row_id"), "trace_id")


@reg("evl_tool_routing", """WITH rows AS (SELECT DISTINCT trace_id FROM (SELECT trace_id FROM spans UNION ALL
    SELECT coalesce(trace_id, concat('m-', CAST(id AS VARCHAR))) FROM message)),
per AS (SELECT trace_id, bool_or(contains(lower(name), 'sql')) AS sql_tool,
  bool_or(contains(lower(name), 'vector') OR contains(lower(name), 'policy') OR contains(lower(name), 'search')) AS vector,
  bool_or(contains(lower(name), 'memory')) AS memory, array_to_string(list_sort(list(DISTINCT name)), ', ') AS tools
  FROM spans WHERE span_type = 'TOOL' GROUP BY trace_id),
traced AS (SELECT DISTINCT trace_id FROM spans)
SELECT r.trace_id AS row_id, r.trace_id,
  CASE WHEN t.trace_id IS NULL THEN 'unknown' WHEN p.tools IS NULL THEN 'no_tools' WHEN p.sql_tool OR p.vector OR p.memory THEN 'yes' ELSE 'no' END AS value,
  p.tools AS rationale
FROM rows r LEFT JOIN traced t USING (trace_id) LEFT JOIN per p USING (trace_id)""", ("spans", "message"))
def q_routing(s, d):
    t = _t(s, d)
    return E.tool_routing(_routing_rows(t), T.spans(t))


TOK = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


@reg("evl_fact_coverage", f"""WITH {FINAL_SQL},
q AS (SELECT conv_id AS chat_id, flatten(list(string_split(text, '. ') ORDER BY turn)) AS facts FROM conversations WHERE role = 'user' GROUP BY conv_id),
r AS (SELECT fa.chat_id AS row_id, {TOK.format(x='fa.answer')} AS ans_tok, q.facts FROM fa JOIN q USING (chat_id)),
f AS (SELECT row_id, len(facts) AS n_facts, list_transform(facts, lambda f:
    CASE WHEN len(list_distinct({TOK.format(x='f')})) = 0 THEN false
    ELSE len(list_intersect(list_distinct({TOK.format(x="f")}), ans_tok)) / len(list_distinct({TOK.format(x='f')})) >= 0.6 END) AS found FROM r)
SELECT row_id, CAST(n_facts AS INTEGER) AS n_facts, CAST(len(list_filter(found, lambda x: x)) AS INTEGER) AS n_found,
  CASE WHEN n_facts > 0 THEN floor(len(list_filter(found, lambda x: x)) / n_facts * 1000000 + 0.5) / 1000000 END AS coverage FROM f""",
     ("message_parts",))
def q_fact_coverage(s, d):
    t = _t(s, d)
    q = (t.conversations.filter(F.col("role") == "user").groupBy(F.col("conv_id").alias("chat_id"))
         .agg(F.array_sort(F.collect_list(F.struct("turn", F.split("text", r"\. ").alias("f")))).alias("l"))
         .select("chat_id", F.flatten(F.transform("l", lambda x: x["f"])).alias("facts")))
    rows = final_answers(t).join(q, "chat_id").withColumnRenamed("chat_id", "row_id")
    return E.fact_coverage(rows, "answer", "facts", 0.6)


@reg("evl_tool_efficiency", """SELECT trace_id, count(*) AS n_calls, count(DISTINCT (name, args)) AS n_distinct,
  count(*) - count(DISTINCT (name, args)) AS repeated
FROM (SELECT s.*, e.props AS args FROM spans s JOIN events e ON e.event_id = s.span_id) WHERE span_type = 'TOOL' GROUP BY trace_id""",
     ("spans",))
def q_efficiency(s, d):
    t = _t(s, d)
    sp = T.spans(t).join(t.events.select(F.col("event_id").alias("span_id"), F.col("props").alias("args")), "span_id")
    return E.tool_efficiency(sp)


@reg("evl_dataset_union", """SELECT 'simple' AS tag, item_id, text AS query FROM benchmark WHERE length(text) < 200
UNION ALL SELECT 'complex', item_id, text FROM benchmark WHERE length(text) >= 200 AND contains(text, chr(10))
UNION ALL SELECT 'out_of_scope', item_id, text FROM benchmark WHERE length(text) >= 200 AND NOT contains(text, chr(10))""")
def q_union(s, d):
    b = _t(s, d).benchmark.select("item_id", F.col("text").alias("query"))
    L = F.length("query")
    return E.dataset_union(simple=b.filter(L < 200), complex=b.filter((L >= 200) & F.col("query").contains("\n")),
                           out_of_scope=b.filter((L >= 200) & ~F.col("query").contains("\n")))


QUERIES = Q


def _sufficiency_rows(s, d):
    from ..operators import rag as G
    from .rag import batch_queries, index
    t = _t(s, d)
    hits = G.topk_batch(index(t), batch_queries(t), 5, "chunk_id")
    h = hits.join(t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), "chunk_id") \
        .withColumnRenamed("label", "doc_name")
    ctx = G.context(batch_queries(t), h, "doc_name", "content")
    own = t.documents.filter(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), F.split("text", r"\. ").alias("facts"))
    return ctx.join(own, "query_id").withColumnRenamed("query_id", "row_id")


@reg("evl_retrieval_sufficiency", None)
def q_sufficiency(s, d):
    return E.fact_coverage(_sufficiency_rows(s, d), "context", "facts", 0.6)


def _sufficiency_sql():
    from ..operators import rag as G
    from .rag import BATCH_SQL
    tok = TOK
    return W(f"""WITH {BATCH_SQL},
h AS (SELECT h.query_id, h.rank, concat('【', CAST(h.label AS VARCHAR), '】', chr(10), d.text) AS b
  FROM hits h JOIN documents d ON d.doc_id = h.chunk_id),
ctx AS (SELECT q.query_id, coalesce(string_agg(b, concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank), '{G.EMPTY_CONTEXT}') AS context
  FROM qs q LEFT JOIN h USING (query_id) GROUP BY q.query_id),
own AS (SELECT doc_id AS query_id, string_split(text, '. ') AS facts FROM documents WHERE doc_id % 50 = 0),
r AS (SELECT c.query_id AS row_id, {tok.format(x='c.context')} AS ans_tok, o.facts FROM ctx c JOIN own o USING (query_id)),
f AS (SELECT row_id, len(facts) AS n_facts, list_transform(facts, lambda f:
    CASE WHEN len(list_distinct({tok.format(x='f')})) = 0 THEN false
    ELSE len(list_intersect(list_distinct({tok.format(x='f')}), ans_tok)) / len(list_distinct({tok.format(x='f')})) >= 0.6 END) AS found FROM r)
SELECT row_id, CAST(n_facts AS INTEGER) AS n_facts, CAST(len(list_filter(found, lambda x: x)) AS INTEGER) AS n_found,
  CASE WHEN n_facts > 0 THEN floor(len(list_filter(found, lambda x: x)) / n_facts * 1000000 + 0.5) / 1000000 END AS coverage FROM f""")


Q["evl_retrieval_sufficiency"] = (q_sufficiency, _sufficiency_sql())
