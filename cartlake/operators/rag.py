"""Documents -> paragraphs -> overlapping chunks -> vectors -> top-k.

Each document is chunked inside one row (by default a search over running
costs in Arrow batches, functions/chunking.py; the same rules are kept as a
native fold), so chunking is a narrow map with no shuffle; documents are
spread over tasks by the scan. Embedding is native and sparse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import PY_WHITESPACE_CLASS, cosine, money, ustrip
from ..functions.vectors import token_vector, top_matches
from ..plans.session import short_batches
from . import ivf

CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
TOP_K = 5
# Fixed strings of the retrieval tool output.
CONTEXT_SEPARATOR = "\n\n---\n\n"
EMPTY_CONTEXT = "関連するポリシー情報が見つかりませんでした。"
UNKNOWN_DOC = "不明"

_WS = PY_WHITESPACE_CLASS + "+"


def _strip(c: Column) -> Column:
    """Python str.strip(): the str.isspace characters at both ends."""
    return ustrip(c)


def _quote(sep: str) -> str:
    return r"\Q" + sep + r"\E"


def paragraphs_of(text: Column, sep: str = "\n\n") -> Column:
    """Split on ``sep``, strip every piece (set trim), drop empty pieces."""
    return F.array_remove(F.transform(F.split(text, _quote(sep)), _strip), "")


def paragraphs(docs: DataFrame, sep: str = "\n\n") -> DataFrame:
    """One row per non-empty stripped paragraph with its position."""
    return (docs.select("doc_name", F.posexplode(paragraphs_of(F.col("text"), sep)).alias("pos", "paragraph"))
            .select("doc_name", F.col("pos").cast("long").alias("pos"), "paragraph"))


def _tail(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def _pack_words(chunks: Column, para: Column, size: int, overlap: int) -> Column:
    """Word packing of one oversize paragraph; starts from an empty current
    chunk and carries the overlap of the *current* chunk on overflow."""
    words = F.filter(F.split(para, _WS), lambda w: w != "")
    init = F.struct(chunks.alias("chunks"), F.lit("").alias("cur"))

    def step(acc, w):
        cur = acc["cur"]
        fits = F.length(cur) + F.length(w) + 1 <= size
        grown = F.when(cur != "", F.concat(cur, F.lit(" "), w)).otherwise(w)
        return F.when(fits, F.struct(acc["chunks"].alias("chunks"), grown.alias("cur"))).otherwise(
            F.struct(F.concat(acc["chunks"], F.array(_strip(cur))).alias("chunks"),
                     F.concat(_tail(cur, overlap), F.lit(" "), w).alias("cur")))

    return F.aggregate(words, init, step)


def chunk_array(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, sep: str = "\n\n") -> Column:
    """array<string> of chunks of one document (greedy paragraph packing,
    overlap carried from the previous chunk, oversize paragraphs split by
    words)."""
    init = F.struct(F.array().cast("array<string>").alias("chunks"), F.lit("").alias("cur"))

    def step(acc, para):
        cur, chunks = acc["cur"], acc["chunks"]
        fits = F.length(cur) + F.length(para) + 2 <= size
        appended = F.struct(chunks.alias("chunks"),
                            F.when(cur != "", F.concat(cur, F.lit("\n\n"), para)).otherwise(para).alias("cur"))
        flushed = F.when(cur != "", F.concat(chunks, F.array(_strip(cur)))).otherwise(chunks)
        prev = F.element_at(flushed, -1)
        restart = F.struct(flushed.alias("chunks"),
                           F.when(F.size(flushed) > 0, F.concat(_tail(prev, overlap), F.lit("\n\n"), para))
                           .otherwise(para).alias("cur"))
        oversize = _pack_words(flushed, para, size, overlap)
        return F.when(fits, appended).when(F.length(para) > size, oversize).otherwise(restart)

    done = F.aggregate(paragraphs_of(text, sep), init, step)
    last = _strip(done["cur"])
    return F.when(last != "", F.concat(done["chunks"], F.array(last))).otherwise(done["chunks"])


def chunk_id(doc_name: Column, idx: Column) -> Column:
    return F.substring(F.md5(F.concat(doc_name.cast("string"), F.lit("::"), idx.cast("string"))), 1, 16)


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, sep: str = "\n\n",
                    engine: str = "arrow") -> DataFrame:
    """docs(doc_name, text) -> chunks(chunk_id, doc_name, chunk_index, content).

    engine="arrow" packs each document in a small Python helper over Arrow
    batches (mapInArrow, about 90x faster than the interpreted fold on the
    driver documents); engine="fold" is the same rules as a native
    aggregate() fold (no Python worker)."""
    if engine == "fold":
        c = docs.select("doc_name", F.posexplode(chunk_array(F.col("text"), size, overlap, sep)).alias("chunk_index", "content"))
    else:
        from ..functions.chunking import chunk_batches
        name_type = docs.schema["doc_name"].dataType.simpleString()
        # the scan's split size (spark.sql.files.maxPartitionBytes) sets the number of tasks
        short_batches(docs.sparkSession)
        c = docs.select("doc_name", "text").mapInArrow(
            chunk_batches(size, overlap, sep), f"doc_name {name_type}, chunk_index long, content string")
    return c.select(chunk_id(F.col("doc_name"), F.col("chunk_index")).alias("chunk_id"), "doc_name",
                    F.col("chunk_index").cast("long").alias("chunk_index"), "content")


def split_oversize(paras: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """The word path alone: pieces of every paragraph longer than ``size``
    (the chunk left open at the end is the last piece), packed by the same
    helper the chunker uses, over Arrow batches."""
    from ..functions.chunking import split_batches
    big = paras.filter(F.length("paragraph") > size).select("doc_name", "pos", "paragraph")
    name_type = big.schema["doc_name"].dataType.simpleString()
    short_batches(big.sparkSession)
    return big.mapInArrow(split_batches(size, overlap), f"doc_name {name_type}, pos long, piece_index long, piece string")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_name").agg(F.count(F.lit(1)).alias("n_chunks"),
                                          F.max(F.length("content")).alias("max_len"))


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def embed(df: DataFrame, dim: int = 1024, col: str = "content", out: str = "embedding") -> DataFrame:
    """Offline embedding: L2-normalised counts of the lower-cased word tokens
    in ``dim`` md5 buckets, as a sparse vector (spots, weights); native, no
    shuffle. ``functions.vectors.dense`` fills it for a product; callers with a
    real model supply their own ARRAY<FLOAT> column instead."""
    return df.withColumn(out, token_vector(_tokens(F.coalesce(F.col(col), F.lit(""))), dim))


def topk(index: DataFrame, query: DataFrame, k: int = TOP_K, id_col: str = "chunk_id") -> DataFrame:
    """k nearest index rows to ONE query vector. The query side is a single
    row (limit 1), so broadcasting it is bounded; the top-k is a
    TakeOrderedAndProject (per-partition heaps)."""
    q = F.broadcast(query.select(F.col("embedding").alias("q_emb")).limit(1))
    scored = index.join(q, how="inner").select(
        "*", money(cosine(F.col("embedding"), F.col("q_emb")), 6).alias("score")).drop("q_emb", "embedding")
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def topk_batch(index: DataFrame, queries: DataFrame, k: int = TOP_K, id_col: str = "chunk_id") -> DataFrame:
    """Exact top-k for any number of queries: blocks of the index against
    blocks of the queries, one matrix product each (functions/vectors.py); only
    k rows per query and index block leave a task."""
    carry = [c for c in index.columns if c not in ("embedding", id_col)]
    return top_matches(index, queries, k, id_col, carry=carry)


def topk_lsh(index: DataFrame, queries: DataFrame, k: int = TOP_K, id_col: str = "chunk_id", target: float = 0.95) -> DataFrame:
    """Approximate top-k for large query sets, by an inverted-file index that
    is fitted, built and searched here (operators/ivf.py keeps the steps apart
    for an index that is searched often)."""
    model = ivf.fit(index, id_col, k, target=target)
    return ivf.search(index, ivf.assigned(index, model, id_col), queries, model, k, id_col)


def recall(approx: DataFrame, exact: DataFrame, id_col: str) -> DataFrame:
    hit = exact.join(approx.select("query_id", id_col, F.lit(1).alias("hit")), ["query_id", id_col], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def context(queries: DataFrame, hits: DataFrame, doc_col: str = "doc_name", text_col: str = "content") -> DataFrame:
    """Retrieval tool text per query: 【doc】\\ncontent blocks in rank order
    joined by a rule, or the fixed message when nothing was found. The
    collected list is bounded by k."""
    block = F.concat(F.lit("【"), F.coalesce(F.col(doc_col).cast("string"), F.lit(UNKNOWN_DOC)), F.lit("】\n"),
                     F.col(text_col))
    g = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("l"))
    txt = F.array_join(F.transform("l", lambda x: x["b"]), CONTEXT_SEPARATOR)
    return queries.select("query_id").join(g, "query_id", "left").select(
        "query_id", F.coalesce(txt, F.lit(EMPTY_CONTEXT)).alias("context"))


def changes(old: DataFrame, new: DataFrame, key: str = "chunk_id", col: str = "content") -> DataFrame:
    """Snapshot diff on ``key``: insert / update / delete (unchanged rows are
    not reported). One full outer join on the key comparing md5 digests."""
    o = old.select(F.col(key), F.md5(F.col(col)).alias("old_md5"))
    n = new.select(F.col(key), F.md5(F.col(col)).alias("new_md5"))
    j = o.join(n, key, "full_outer")
    action = (F.when(F.col("old_md5").isNull(), "insert").when(F.col("new_md5").isNull(), "delete")
              .when(F.col("old_md5") != F.col("new_md5"), "update"))
    return j.select(key, action.alias("action")).filter(F.col("action").isNotNull())


def sync_plan(index: DataFrame, new: DataFrame, key: str = "chunk_id", col: str = "content", embedder=embed) -> DataFrame:
    """Apply a new snapshot to a vector index: unchanged rows keep their
    stored vector, only inserted or changed rows go through the embedder,
    deleted rows drop out. ``reembedded`` marks the rows embedded now. With the
    native embedding this is one join; another embedder sees the fresh rows as
    a DataFrame of their own."""
    others = [c for c in new.columns if c != key]
    o = index.select(key, F.md5(F.col(col)).alias("_old"), F.col("embedding"))
    j = new.withColumn("_new", F.md5(F.col(col))).join(o, key, "left")
    fresh = F.col("_old").isNull() | (F.col("_old") != F.col("_new"))
    if embedder is embed:
        own = embed(j, col=col, out="_own")
        return own.select(key, *others, F.when(fresh, F.col("_own")).otherwise(F.col("embedding")).alias("embedding"),
                          fresh.alias("reembedded"))
    kept = j.filter(~fresh).select(key, *others, "embedding", F.lit(False).alias("reembedded"))
    changed = embedder(j.filter(fresh).select(key, *others), col=col, out="embedding")
    return kept.unionByName(changed.select(key, *others, "embedding", F.lit(True).alias("reembedded")))
