"""Documents and retrieval (RAG) query bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rag as G
from ..sources.tables import Tables
from .memory import cos_sql
from .views import with_views as W

Q = {}
SEP = "\n"  # driver documents separate paragraphs by single newlines


def reg(name, sql=None, views=()):
    def deco(fn):
        Q[name] = (fn, W(sql, *views) if sql else None)
        return fn
    return deco


def _t(s, d):
    return Tables(s, d)


def docs(t):
    return t.documents.select(F.col("doc_id").alias("doc_name"), "text")


def new_docs(t):
    """The next snapshot of the corpus: every 11th document removed, every
    7th loses its last line, every 13th gains an appendix line, every 5th of
    the others a changed first line."""
    d = t.documents.filter(F.col("doc_id") % 11 != 0)
    txt = (F.when(F.col("doc_id") % 7 == 0, F.regexp_replace("text", r"\n[^\n]*\z", ""))
           .when(F.col("doc_id") % 13 == 0, F.concat(F.col("text"), F.lit("\nappendix "), F.col("doc_id").cast("string")))
           .when(F.col("doc_id") % 5 == 0, F.concat(F.lit("revised "), F.col("text")))
           .otherwise(F.col("text")))
    return d.select(F.col("doc_id").alias("doc_name"), txt.alias("text"))


def para_chunks(df):
    p = G.paragraphs(df, SEP)
    return p.select(G.chunk_id(F.col("doc_name"), F.col("pos")).alias("chunk_id"), "doc_name", F.col("paragraph").alias("content"))


PARA_SQL = """para AS (SELECT doc_name, CAST(row_number() OVER (PARTITION BY doc_name ORDER BY i) - 1 AS BIGINT) AS pos, p AS paragraph
  FROM (SELECT doc_name, i, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS p FROM (
    SELECT doc_name, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {src}))
  WHERE p <> '')"""
DOCS_SQL = "docs AS (SELECT doc_id AS doc_name, text FROM documents)"
NEW_DOCS_SQL = """new_docs AS (SELECT doc_id AS doc_name, CASE WHEN doc_id % 7 = 0 THEN regexp_replace(text, '\\n[^\\n]*\\z', '')
  WHEN doc_id % 13 = 0 THEN concat(text, chr(10), 'appendix ', CAST(doc_id AS VARCHAR))
  WHEN doc_id % 5 = 0 THEN concat('revised ', text) ELSE text END AS text
  FROM documents WHERE doc_id % 11 <> 0)"""


def _para_chunks_sql(name, src):
    return (PARA_SQL.replace("para AS", f"{name}_p AS").format(src=src)
            + f",\n{name} AS (SELECT substr(md5(concat(CAST(doc_name AS VARCHAR), '::', CAST(pos AS VARCHAR))), 1, 16) AS chunk_id, "
              f"doc_name, paragraph AS content FROM {name}_p)")


@reg("rag_paragraphs", f"WITH {DOCS_SQL}, {PARA_SQL.format(src='docs')} SELECT * FROM para")
def q_paragraphs(s, d):
    return G.paragraphs(docs(_t(s, d)), SEP)


# Python's white space as a character class, and stripping both ends by it
SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda v: v <> '')"


def chunks_sql(src: str, size: int, overlap: int, sep: str) -> str:
    """The chunk rules as a left fold over a document's items: paragraphs that
    fit a chunk (p), and the first (f) and further (w) words of longer ones."""
    item = "{{'k': {k}, 'x': {x}, 'cur': '', 'done': []::VARCHAR[]}}"
    state = "{{'k': '', 'x': '', 'cur': {cur}, 'done': {done}}}"
    flushed = f"CASE WHEN a.cur <> '' THEN list_append(a.done, {strip_sql('a.cur')}) ELSE a.done END"
    gap = "chr(10) || chr(10)"
    return f"""paras AS (SELECT doc_name, list_filter(list_transform(string_split(text, {sep}), lambda v: {strip_sql('v')}), lambda v: v <> '') AS ps
  FROM {src}),
items AS (SELECT doc_name, flatten(list_transform(ps, lambda p: CASE WHEN length(p) <= {size} THEN [{item.format(k="'p'", x='p')}]
  ELSE list_transform({words_sql('p')}, lambda w, i: {item.format(k="CASE WHEN i = 1 THEN 'f' ELSE 'w' END", x='w')}) END)) AS l FROM paras),
folded AS (SELECT doc_name, list_reduce(l, lambda a, e: CASE
  WHEN e.k = 'p' AND length(a.cur) + length(e.x) + 2 <= {size}
    THEN {state.format(cur=f"CASE WHEN a.cur <> '' THEN a.cur || {gap} || e.x ELSE e.x END", done="a.done")}
  WHEN e.k = 'p' THEN {state.format(cur=f"CASE WHEN len({flushed}) > 0 THEN right(({flushed})[-1], {overlap}) || {gap} || e.x ELSE e.x END", done=flushed)}
  WHEN e.k = 'f' AND length(e.x) + 1 <= {size} THEN {state.format(cur="e.x", done=flushed)}
  WHEN e.k = 'f' THEN {state.format(cur="' ' || e.x", done=f"list_append({flushed}, '')")}
  WHEN length(a.cur) + length(e.x) + 1 <= {size} THEN {state.format(cur="CASE WHEN a.cur <> '' THEN a.cur || ' ' || e.x ELSE e.x END", done="a.done")}
  ELSE {state.format(cur=f"right(a.cur, {overlap}) || ' ' || e.x", done=f"list_append(a.done, {strip_sql('a.cur')})")} END,
  {state.format(cur="''", done="[]::VARCHAR[]")}) AS f FROM items WHERE len(l) > 0),
listed AS (SELECT doc_name, CASE WHEN {strip_sql('f.cur')} <> '' THEN list_append(f.done, {strip_sql('f.cur')}) ELSE f.done END AS c FROM folded),
chunks AS (SELECT substr(md5(concat(CAST(doc_name AS VARCHAR), '::', CAST(i AS VARCHAR))), 1, 16) AS chunk_id, doc_name, i AS chunk_index, content
  FROM (SELECT doc_name, CAST(unnest(range(len(c))) AS BIGINT) AS i, unnest(c) AS content FROM listed))"""


CHUNKS_SQL = f"WITH {DOCS_SQL}, {chunks_sql('docs', G.CHUNK_SIZE, G.CHUNK_OVERLAP, 'chr(10)')}"
PIECES_SQL = f"""WITH {DOCS_SQL}, {PARA_SQL.format(src='docs')},
big AS (SELECT doc_name, pos, {words_sql('paragraph')} AS ws FROM para WHERE length(paragraph) > {G.CHUNK_SIZE}),
packed AS (SELECT doc_name, pos, list_reduce(list_transform(ws, lambda w: {{'x': w, 'cur': '', 'done': []::VARCHAR[]}}), lambda a, e:
  CASE WHEN length(a.cur) + length(e.x) + 1 <= {G.CHUNK_SIZE}
    THEN {{'x': '', 'cur': CASE WHEN a.cur <> '' THEN a.cur || ' ' || e.x ELSE e.x END, 'done': a.done}}
    ELSE {{'x': '', 'cur': right(a.cur, {G.CHUNK_OVERLAP}) || ' ' || e.x, 'done': list_append(a.done, {strip_sql('a.cur')})}} END,
  {{'x': '', 'cur': '', 'done': []::VARCHAR[]}}) AS f FROM big)
SELECT doc_name, pos, CAST(unnest(range(len(f.done) + 1)) AS BIGINT) AS piece_index, unnest(list_append(f.done, {strip_sql('f.cur')})) AS piece
FROM packed"""


def vector_text(c):
    """A sparse vector's places and values (6 decimals) as text, for comparison."""
    shown = F.zip_with(F.col(c)["spots"], F.col(c)["weights"], lambda i, v: F.concat(
        i.cast("string"), F.lit(":"), F.floor(v.cast("double") * 1000000 + 0.5).cast("string")))
    return F.array_join(shown, " ")


def vector_sql(text: str, dim: int = 1024) -> str:
    toks = f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda v: v <> '')"
    spots = f"list_transform({toks}, lambda t: CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % {dim})"
    return f"""(SELECT coalesce(string_agg(concat(CAST(spot AS VARCHAR), ':',
      CAST(CAST(floor(CAST(CAST(n / norm AS FLOAT) AS DOUBLE) * 1000000 + 0.5) AS BIGINT) AS VARCHAR)), ' ' ORDER BY spot), '')
    FROM (SELECT spot, n, sqrt(sum(n * n) OVER ()) AS norm FROM (SELECT spot, CAST(count(*) AS DOUBLE) AS n
      FROM (SELECT unnest({spots}) AS spot) GROUP BY spot)))"""


@reg("rag_chunk_documents", f"{CHUNKS_SQL} SELECT * FROM chunks")
def q_chunks(s, d):
    return G.chunk_documents(docs(_t(s, d)), G.CHUNK_SIZE, G.CHUNK_OVERLAP, SEP)


@reg("rag_split_oversize", PIECES_SQL)
def q_split_oversize(s, d):
    return G.split_oversize(G.paragraphs(docs(_t(s, d)), SEP), G.CHUNK_SIZE, G.CHUNK_OVERLAP)


@reg("rag_chunk_ids", f"{CHUNKS_SQL} SELECT chunk_id, doc_name, chunk_index FROM chunks")
def q_chunk_ids(s, d):
    return q_chunks(s, d).select("chunk_id", "doc_name", "chunk_index")


@reg("rag_chunk_stats", f"{CHUNKS_SQL} SELECT doc_name, count(*) AS n_chunks, CAST(max(length(content)) AS INTEGER) AS max_len FROM chunks GROUP BY doc_name")
def q_chunk_stats(s, d):
    return G.chunk_stats(q_chunks(s, d))


@reg("rag_embed", f"{CHUNKS_SQL} SELECT chunk_id, {vector_sql('content')} AS embedding FROM chunks")
def q_embed(s, d):
    return G.embed(q_chunks(s, d)).select("chunk_id", vector_text("embedding").alias("embedding"))


def index(t):
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), "label", "embedding")


def batch_queries(t):
    """The stated query set: every vector whose id is divisible by 50."""
    return t.embeddings.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@reg("rag_topk", f"""WITH q AS (SELECT arg_min(embedding, vec_id) AS q_emb FROM embeddings WHERE label = 0)
SELECT vec_id AS chunk_id, label, floor({cos_sql('embedding', 'q.q_emb')} * 1000000 + 0.5) / 1000000 AS score
FROM embeddings, q ORDER BY score DESC, chunk_id LIMIT 5""")
def q_topk(s, d):
    t = _t(s, d)
    q = t.embeddings.filter(F.col("label") == 0).groupBy().agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return G.topk(index(t), q, 5, "chunk_id")


BATCH_SQL = f"""qs AS (SELECT vec_id AS query_id, embedding AS q_emb FROM embeddings WHERE vec_id % 50 = 0),
sc AS (SELECT q.query_id, e.vec_id AS chunk_id, e.label, floor({cos_sql('e.embedding', 'q.q_emb')} * 1000000 + 0.5) / 1000000 AS score
  FROM embeddings e, qs q),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc) WHERE rank <= 5)"""


@reg("rag_topk_batch", f"WITH {BATCH_SQL} SELECT * FROM hits")
def q_topk_batch(s, d):
    t = _t(s, d)
    return G.topk_batch(index(t), batch_queries(t), 5, "chunk_id")


@reg("rag_topk_lsh")
def q_topk_lsh(s, d):
    t = _t(s, d)
    return G.topk_lsh(index(t), batch_queries(t), 5, "chunk_id")


@reg("rag_context", f"""WITH {BATCH_SQL},
h AS (SELECT h.query_id, h.rank, concat('【', CAST(h.label AS VARCHAR), '】', chr(10), d.text) AS b
  FROM hits h JOIN documents d ON d.doc_id = h.chunk_id)
SELECT q.query_id, coalesce(string_agg(b, concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank), '{G.EMPTY_CONTEXT}') AS context
FROM qs q LEFT JOIN h USING (query_id) GROUP BY q.query_id""")
def q_context(s, d):
    t = _t(s, d)
    hits = G.topk_batch(index(t), batch_queries(t), 5, "chunk_id")
    h = hits.join(t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), "chunk_id") \
        .withColumnRenamed("label", "doc_name")
    return G.context(batch_queries(t), h, "doc_name", "content")


@reg("rag_sync_plan", f"""WITH {DOCS_SQL}, {NEW_DOCS_SQL}, {_para_chunks_sql('old', 'docs')}, {_para_chunks_sql('new', 'new_docs')},
ch AS (SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id,
  CASE WHEN o.chunk_id IS NULL THEN 'insert' WHEN n.chunk_id IS NULL THEN 'delete' WHEN md5(o.content) <> md5(n.content) THEN 'update' END AS action
  FROM old o FULL OUTER JOIN new n USING (chunk_id)),
r AS (SELECT chunk_id, doc_name, content, false AS reembedded FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM ch WHERE action IS NOT NULL)
UNION ALL SELECT chunk_id, doc_name, content, true FROM new WHERE chunk_id IN (SELECT chunk_id FROM ch WHERE action IN ('insert', 'update')))
SELECT chunk_id, doc_name, content, reembedded, {vector_sql('content')} AS embedding FROM r""")
def q_sync(s, d):
    t = _t(s, d)
    # the index stands by chunk, as a stored one is bucketed: the join needs no other exchange of it
    idx = G.embed(para_chunks(docs(t)).repartition("chunk_id"))
    return G.sync_plan(idx, para_chunks(new_docs(t))).select("chunk_id", "doc_name", "content", "reembedded",
                                                          vector_text("embedding").alias("embedding"))


@reg("src_chunk_changes", f"""WITH {DOCS_SQL}, {NEW_DOCS_SQL}, {_para_chunks_sql('old', 'docs')}, {_para_chunks_sql('new', 'new_docs')}
SELECT * FROM (SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id,
  CASE WHEN o.chunk_id IS NULL THEN 'insert' WHEN n.chunk_id IS NULL THEN 'delete' WHEN md5(o.content) <> md5(n.content) THEN 'update' END AS action
  FROM old o FULL OUTER JOIN new n USING (chunk_id)) WHERE action IS NOT NULL""")
def q_changes(s, d):
    t = _t(s, d)
    return G.changes(para_chunks(docs(t)), para_chunks(new_docs(t)))


QUERIES = Q
