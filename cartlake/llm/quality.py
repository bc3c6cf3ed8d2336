"""Quality classifier: regularised quadratic discriminant (operator 1).

Each text becomes ``len(STATS)`` transformed statistics (log shares of byte
classes, word and line repetition, lengths). Per class, mean and covariance
are sums over all labelled training rows (one Spark aggregation, no sample);
covariances are shrunk towards the pooled one and its diagonal. A score is
the logistic of the two classes' log-density difference, each a Mahalanobis
distance through a cached Cholesky factor plus its log-determinant.

Defined cases: null and empty texts have all-zero counts and are scored like
any text; without a labelled row of both classes every score is the share of
label 1 (0.5 without labels); labels repeated for an id count if they agree,
else not; null ids and null labels are not learned from; repeated rows are
scored alike; extra columns are ignored; an empty table gives an empty
result."""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, ship, texts, tidy

STATS = ["length", "upper", "digit", "space", "line", "stop", "loud", "pipe", "symbol", "other", "word_length",
         "distinct", "repeat", "entropy", "dup_lines", "long_words"]


def byte_classes() -> np.ndarray:
    """(256, 9): upper, lower, digit, blank, newline, sentence marks, !?, |, other symbols; bytes over 127 in none."""
    groups = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\v\f", "\n",
              ".,;:'\"-()", "!?", "|"]
    out = np.zeros((256, 9))
    for k, g in enumerate(groups):
        out[[ord(c) for c in g], k] = 1
    out[:128, 8] = out[:128].sum(1) == 0
    return out


def statistics(docs: list[bytes], classes: np.ndarray) -> np.ndarray:
    """(rows, len(STATS)) transformed statistics."""
    hist = np.zeros((len(docs), 256))
    words_of = np.zeros((len(docs), 6))
    for k, t in enumerate(docs):
        hist[k] = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        words, lines = t.split(), [x for x in t.split(b"\n") if x]
        n = len(words)
        words_of[k] = (n, len(set(words)), sum(map(operator.eq, words, words[1:])), len(lines), len(set(lines)),
                       sum(1 for x in words if len(x) > 24))
    size = hist.sum(1)
    share = (hist @ classes) / np.maximum(size, 1)[:, None]
    upper, lower, digit, blank, line, stop, loud, pipe, symbol = share.T
    high = hist[:, 128:].sum(1) / np.maximum(size, 1)
    n, distinct, repeat, lines, own_lines, long_words = words_of.T
    p = hist / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.maximum(p, 1e-12))).sum(1)
    log = lambda x, eps: np.log(x + eps)
    some = np.maximum(n, 1)
    return np.column_stack([
        np.log1p(size), log(upper / np.maximum(upper + lower + high, 1e-9), 0.01), log(digit, 0.002),
        log(blank, 0.02), log(line, 0.001), log(stop, 0.005), log(loud, 0.002), log(pipe, 0.002),
        log(symbol, 0.002), log(high, 0.02), np.log1p((size - hist[:, 32]) / some),
        np.log((distinct + 1) / (n + 1)) / np.log(n + 3), log(repeat / some, 0.01), entropy,
        log(1 - own_lines / np.maximum(lines, 1), 0.02), log(long_words / some, 0.01)])


def stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    classes = byte_classes()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            x = statistics(texts(part.column(1)), classes)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in x.T)], ["id", *STATS])


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, statistics...) per row, written once."""
    inner = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shape = f"id {dict(inner.dtypes)['id']}, " + ", ".join(f"{s} double" for s in STATS)
    return saved(inner.mapInArrow(tidy(stat_batches), shape), "quality-statistics")


def agreed_labels(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of ids whose non-null labels agree."""
    lab = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    return (lab.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("hi"))
            .filter("label = hi").drop("hi"))


class Model:
    """Per class: mean, inverse Cholesky factor, log-determinant, log prior."""

    def __init__(self, prior: float, parts=None):
        self.prior, self.parts = prior, parts

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.prior)
        logs = []
        for mean, inverse, logdet, log_prior in self.parts:
            z = (x - mean) @ inverse.T
            logs.append(log_prior - 0.5 * ((z * z).sum(1) + logdet))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(feats: DataFrame, labels: DataFrame, label_col: str = "quality", learn: Column | None = None,
        shrink: float = 0.1, diagonal: float = 0.05) -> Model:
    """``learn``: which feature rows may be learned from (over column id)."""
    rows = feats.filter(F.col("id").isNotNull() if learn is None else learn)
    rows = rows.join(agreed_labels(labels, label_col), "id")
    m = len(STATS)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    sums = rows.groupBy("label").agg(F.count("*").alias("n"), F.array(*[F.sum(s) for s in STATS]).alias("s"),
                                     F.array(*[F.sum(F.col(STATS[i]) * F.col(STATS[j])) for i, j in pairs]).alias("q"))
    got = {r.label: r for r in sums.collect()}      # two rows
    total = sum(r.n for r in got.values())
    if len(got) < 2:
        return Model(0.5 if not got else float(next(iter(got))))
    means, covs = [], []
    for k in (0, 1):
        mean = np.array(got[k].s) / got[k].n
        second = np.zeros((m, m))
        for (i, j), v in zip(pairs, got[k].q):
            second[i, j] = second[j, i] = v / got[k].n
        means.append(mean)
        covs.append(second - np.outer(mean, mean))
    pooled = sum(got[k].n * covs[k] for k in (0, 1)) / total
    parts = []
    for k in (0, 1):
        cov = (1 - shrink) * covs[k] + shrink * pooled
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(m)
        factor = np.linalg.cholesky(cov)
        parts.append((means[k], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(got[k].n / total)))
    return Model(got[1].n / total, parts)


def score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["id", "score"])
    return run


def score(feats: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    out = feats.mapInArrow(tidy(score_batches(model)), f"id {dict(feats.dtypes)['id']}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


ship(__name__)
