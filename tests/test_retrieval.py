"""Retrieval: exact top-k against brute force, recall of the index, sync plan."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlake.operators import ivf
from cartlake.operators import rag as G
from cartlake.queries import rag as QR
from cartlake.sources.tables import Tables
from conftest import SF_CHECK, SF_SMALL


def test_topk_batch_equals_brute_force(spark):
    t = Tables(spark, SF_SMALL)
    idx, qs = QR.index(t), QR.batch_queries(t)
    got = {(r.query_id, r.rank): r.chunk_id for r in G.topk_batch(idx, qs, 5, "chunk_id").collect()}
    vecs = [(r.chunk_id, list(r.embedding)) for r in idx.collect()]

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b)))
    for q in qs.collect():
        best = sorted(vecs, key=lambda v: (-round(cos(q.embedding, v[1]), 6), v[0]))[:5]
        assert [got[(q.query_id, k + 1)] for k in range(5)] == [v[0] for v in best]


@pytest.mark.parametrize("sf", [SF_CHECK, "/root/testdata/sf0.1"])
def test_index_recall_and_exact_scores(spark, sf):
    """All rows of the query set: at least 0.9 of the exact neighbours, under a
    tenth of all pairs scored exactly, and these scores exact."""
    t = Tables(spark, sf)
    idx, qs = QR.index(t), QR.batch_queries(t)
    exact = G.topk_batch(idx, qs, 5, "chunk_id")
    model = ivf.fit(idx, "chunk_id", 5)
    lists = ivf.assigned(idx, model, "chunk_id")
    assert lists.count() == idx.count() and lists.select("list").distinct().count() <= len(model.centroids)
    approx = ivf.search(idx, lists, qs, model, 5, "chunk_id")
    rec = [r.recall for r in G.recall(approx, exact, "chunk_id").collect()]
    assert len(rec) == qs.count() and sum(rec) / len(rec) >= 0.9
    assert ivf.candidates(lists, qs, model, "chunk_id").count() < 0.1 * qs.count() * idx.count()
    scored = approx.join(exact.select("query_id", "chunk_id", F.col("score").alias("s2")), ["query_id", "chunk_id"])
    assert scored.filter(F.col("score") != F.col("s2")).count() == 0


def test_clustered_vectors_need_few_lists(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(20, 16))
    rows = [(i, (centers[i % 20] + 0.1 * rng.normal(size=16)).tolist()) for i in range(1500)] + [(9999, None)]
    idx = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    qs = idx.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    model = ivf.fit(idx, "chunk_id", 5, parts=4)
    assert model.probes <= len(model.centroids) / 3
    approx = ivf.search(idx, ivf.assigned(idx, model, "chunk_id"), qs, model, 5, "chunk_id")
    rec = [r.recall for r in G.recall(approx, G.topk_batch(idx, qs, 5, "chunk_id"), "chunk_id").collect()]
    assert sum(rec) / len(rec) >= 0.9


def test_tiny_and_empty_index(spark):
    idx = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id long, embedding array<float>")
    qs = idx.select(F.col("chunk_id").alias("query_id"), "embedding")
    got = sorted((r.query_id, r["rank"], r.chunk_id) for r in G.topk_lsh(idx, qs, 2, "chunk_id").collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1)]
    assert G.topk_lsh(idx.limit(0), qs, 2, "chunk_id").count() == 0


def test_topk_in_several_blocks(spark, monkeypatch):
    """Many small cells give what one cell gives, in a plan of the same size."""
    from cartlake.functions import vectors

    t = Tables(spark, SF_SMALL)
    idx, qs = QR.index(t), QR.batch_queries(t)
    one = G.topk_batch(idx, qs, 3, "chunk_id")
    want, size = sorted(map(tuple, one.collect())), len(one._jdf.queryExecution().analyzed().toString().splitlines())
    monkeypatch.setattr(vectors, "INDEX_BLOCK", 7)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 1)
    monkeypatch.setattr(vectors, "SCORES", 16)
    many = G.topk_batch(idx.repartition(5), qs, 3, "chunk_id")
    assert sorted(map(tuple, many.collect())) == want
    assert len(many._jdf.queryExecution().analyzed().toString().splitlines()) <= size + 2
    assert "NestedLoop" not in many._jdf.queryExecution().executedPlan().toString()


def test_topk_ties_nulls_and_empty(spark):
    shape = "chunk_id long, embedding array<float>, note string"
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], f"n{i}") for i in range(20)] + [(99, None, "none"), (98, [0.0, 0.0], "zero")]
    idx = spark.createDataFrame(rows, shape)
    qs = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [0.0, 3.0])], "query_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.chunk_id, r.score, r.note) for r in G.topk_batch(idx, qs, 2, "chunk_id").collect())
    assert got == [(1, 1, 1, 1.0, "n1"), (1, 2, 3, 1.0, "n3"), (3, 1, 0, 1.0, "n0"), (3, 2, 2, 1.0, "n2")]
    assert G.topk_batch(idx.limit(0), qs, 2, "chunk_id").count() == 0
    assert G.topk_batch(idx, qs.limit(0), 2, "chunk_id").count() == 0


def test_embedding_equals_a_plain_count(spark):
    import hashlib
    import re

    from cartlake.functions.vectors import dense

    texts = ["the cat, the Cat! THE dog", "", None, "   ", "été Ünder été x1 x1 x1", "a " * 300 + "b"]
    df = G.embed(spark.createDataFrame(list(enumerate(texts)), "i long, content string"), 32)
    for r in df.select("i", "embedding", dense(F.col("embedding"), 32).alias("d")).collect():
        n = [0] * 32
        for w in re.findall(r"[^\W_]+", (texts[r.i] or "").lower()):
            n[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 32] += 1
        norm = math.sqrt(sum(x * x for x in n)) or 1
        assert r.embedding.spots == [k for k in range(32) if n[k]]
        assert all(abs(a - b / norm) < 1e-6 for a, b in zip(r.d, n)) and len(r.d) == 32


def test_sync_plan_embeds_changed_rows_only(spark):
    old = spark.createDataFrame([("a", "same"), ("b", "old"), ("c", "gone")], "chunk_id string, content string")
    new = spark.createDataFrame([("a", "same"), ("b", "new"), ("d", "added")], "chunk_id string, content string")
    seen = []

    def embedder(df, col, out):
        seen.extend(r[col] for r in df.collect())
        return df.withColumn(out, F.array(F.lit(2.0).cast("float")))
    index = old.withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    got = {r.chunk_id: (r.embedding, r.reembedded) for r in G.sync_plan(index, new, embedder=embedder).collect()}
    assert got == {"a": ([1.0], False), "b": ([2.0], True), "d": ([2.0], True)} and sorted(seen) == ["added", "new"]
