"""Quality discriminant: held-out accuracy, statistics against numpy, odd rows."""

import numpy as np
from edge import no_docs, odd_docs, odd_rows
from pyspark.sql import functions as F

from cartlake.llm import quality as ql
from cartlake.llm.common import in_fold, table
from conftest import SF_CHECK


def test_held_out_accuracy(spark):
    labels = table(spark, SF_CHECK, "labels")
    feats = ql.features(table(spark, SF_CHECK, "documents"))
    model = ql.fit(feats, labels, learn=F.col("id").isNotNull() & ~in_fold(3, 1, "id"))
    got = ql.score(feats, model).join(labels, "doc_id").filter(in_fold(3, 1)).collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.97


def test_model_equals_numpy(spark):
    rows = odd_rows()
    feats = ql.features(odd_docs(spark, rows))
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(60)] + [(30, 1, "x"), (31, None, "x"), (None, 1, "x")],
                                   "doc_id long, quality int, label string")
    model = ql.fit(feats, labels, shrink=0.2, diagonal=0.1)
    x = {r.id: np.array([r[s] for s in ql.STATS]) for r in feats.collect() if r.id is not None}
    ids = [i for i in x if i != 30]                 # contradictory labels count for nothing
    want = {}
    data = {k: np.array([x[i] for i, *_ in rows if i in ids and i % 2 == k]) for k in (0, 1)}
    pooled = sum(len(d) * np.cov(d.T, bias=True) for d in data.values()) / sum(map(len, data.values()))
    for k, d in data.items():
        cov = 0.8 * np.cov(d.T, bias=True) + 0.2 * pooled
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(cov))
        inverse = np.linalg.inv(cov)
        for i, v in x.items():
            gap = v - d.mean(0)
            want[i, k] = np.log(len(d)) - 0.5 * (gap @ inverse @ gap + np.linalg.slogdet(cov)[1])
    for r in ql.score(feats, model).filter("doc_id IS NOT NULL").collect():
        gap = np.clip(want[r.doc_id, 0] - want[r.doc_id, 1], -700, 700)
        assert abs(r.score - 1 / (1 + np.exp(gap))) < 1e-5


def test_without_labels(spark):
    df = odd_docs(spark)
    feats = ql.features(df)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r.score for r in ql.score(feats, ql.fit(feats, labels.limit(0))).collect()} == {0.5}
    assert {r.score for r in ql.score(feats, ql.fit(feats, labels)).collect()} == {1.0}
    empty = ql.features(no_docs(spark))
    assert ql.score(empty, ql.fit(empty, labels)).count() == 0
