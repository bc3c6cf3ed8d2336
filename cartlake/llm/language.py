"""Language identification by error-correcting output codes (operator 8).

Every language has a codeword of bits (all useful columns for up to six
languages, a fixed pseudo-random code with the largest found distance for
more). One linear classifier over hashed letter n-gram shares (1 to 3
letters, ``FEATURES`` buckets) predicts each bit; decoding adds, for each
codeword, the bits' squared hinge losses, weighted by how well each bit's
classifier separates the training rows, and takes the nearest codeword. A row
whose two nearest codewords are almost equally far is flagged ambiguous.

The classifiers are ridge regressions on +-1 targets, fitted on the driver
from at most ``per_language`` rows per language (chosen by a hash of the id;
only their feature counts are collected); everything else runs over all rows.

Defined cases: null text or text without a letter is ``und`` with score 0;
null languages are not learned; with no labelled row every row is ``und``;
with one language that one is predicted; null ids are predicted but not learned; repeated
rows are judged alike; extra columns are ignored; an empty table gives an
empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, short_batches, slices, tidy

FEATURES = 2048
CHUNK = 1 << 18           # letters scored at once
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """Code point -> lower-case letter, or 0 for everything else."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def grams(pieces: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature bucket, piece) of the n-grams around every inner character of
    the pieces; a piece's first and last characters are context."""
    flat = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = letters[flat].astype(np.uint64)
    size = np.array([len(p) for p in pieces], np.int64)
    inner = np.ones(len(c), bool)
    inner[np.cumsum(size) - 1] = False
    inner[np.cumsum(size) - size] = False
    row = np.repeat(np.arange(len(pieces)), size)[1:-1]
    one, two, three = c[:-2], c[1:-1], c[2:]
    mix = lambda *xs: ((sum(x * np.uint64(k) for x, k in zip(xs, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)))
                        * np.uint64(0x27D4EB2F165667C5)) >> np.uint64(40)) % np.uint64(FEATURES)
    uni = np.flatnonzero(inner[1:-1] & (two > 0))
    tri = uni[(one[uni] > 0) | (three[uni] > 0)]            # 0 marks a word's edge
    bucket = np.concatenate([mix(two[uni]), mix(one[tri], two[tri], three[tri])])
    return bucket.astype(np.int64), np.concatenate([row[uni], row[tri]])


def portions(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Row numbers and pieces in portions of about CHUNK characters; every
    character is the inner one of exactly one piece."""
    rows, part, size = [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(len(t), 1), CHUNK):
            rows.append(k)
            part.append((t[at - 1] if at else " ") + t[at:at + CHUNK] + (t[at + CHUNK:at + CHUNK + 1] or " "))
            size += len(part[-1])
            if size >= CHUNK:
                yield rows, part
                rows, part, size = [], [], 0
    if rows:
        yield rows, part


def sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, buckets, shares) sparse feature rows."""
    letters = letter_table()
    for batch in batches:
        langs, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        total = np.zeros((len(docs), FEATURES), np.float32)
        for rows, part in portions([t or "" for t in docs]):
            bucket, row = grams(part, letters)
            np.add.at(total, (np.array(rows)[row], bucket), 1)
        used = [np.flatnonzero(t) for t in total]
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array(langs, pa.string()),
            "buckets": pa.array([u.astype("<u2").tobytes() for u in used], pa.binary()),
            "shares": pa.array([(t[u] / max(t.sum(), 1)).astype("<f4").tobytes() for t, u in zip(total, used)],
                               pa.binary())})


def codewords(k: int) -> np.ndarray:
    """(k, bits) matrix of +-1."""
    if k <= 2:
        return np.array([[1.0], [-1.0]])[:k]
    if k <= 6:
        # every split of the languages into two non-empty sides, once
        return np.array([(1, *p) for p in product((1, -1), repeat=k - 1) if -1 in p], float).T
    bits = 6 * (k - 1).bit_length()
    best, best_gap = None, -1
    for trial in range(32):
        seed = b"".join(hashlib.sha256(f"{trial}/{k}/{i}".encode()).digest() for i in range(k * bits // 32 + 1))
        code = np.where(np.frombuffer(seed, np.uint8)[:k * bits].reshape(k, bits) & 1, 1.0, -1.0)
        gap = min(int((code[a] != code[b]).sum()) for a in range(k) for b in range(a))
        if gap > best_gap:
            best, best_gap = code, gap
    return best[:, np.abs(best.sum(0)) < k]


class Model:
    """Languages, codewords, bit classifiers and bit weights."""

    def __init__(self, langs, code, weights, bias, trust):
        self.langs, self.code, self.weights, self.bias, self.trust = langs, code, weights, bias, trust

    def losses(self, margin: np.ndarray) -> np.ndarray:
        """(rows, languages) loss-weighted distances; margin: (rows, bits)."""
        agree = margin[:, None, :] * self.code[None]
        return (np.maximum(0, 1 - agree) ** 2 * self.trust).sum(2) / self.trust.sum()


def fit(df: DataFrame, learn: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
        per_language: int = 1000, ridge: float = 2e-4) -> Model:
    """Fit on at most about ``per_language`` rows of every language."""
    known = df.filter(learn & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()) \
        .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)).alias("draw"))
    # one row per language
    n = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return Model([], np.zeros((0, 1)), np.zeros((FEATURES, 1)), np.zeros(1), np.ones(1))
    share = F.create_map(*[F.lit(x) for lang in sorted(n)
                           for x in (lang, int((1 << 30) * min(1.0, per_language / n[lang])))])
    rows = known.filter(F.col("draw") < share[F.col("lang")]).select("lang", "text") \
        .mapInArrow(tidy(sample_features), "lang string, buckets binary, shares binary").collect()
    rows.sort(key=lambda r: (r.lang, r.buckets, r.shares))
    langs = sorted(n)
    x = np.zeros((len(rows), FEATURES), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.buckets, "<u2")] = np.frombuffer(r.shares, "<f4")
    np.sqrt(x, out=x)
    code = codewords(len(langs))
    who = np.array([langs.index(r.lang) for r in rows], int)
    y = code[who]
    even = 1 / np.bincount(who, minlength=len(langs))[who] / len(langs)      # every language weighs the same
    mean, base = even @ x, even @ y
    x -= mean.astype(np.float32)
    gram, side = np.zeros((FEATURES, FEATURES), np.float32), np.zeros((FEATURES, code.shape[1]), np.float32)
    for at in range(0, len(x), 512):
        part, weight = x[at:at + 512], even[at:at + 512, None].astype(np.float32)
        gram += (part * weight).T @ part
        side += (part * weight).T @ (y[at:at + 512] - base).astype(np.float32)
    gram[np.diag_indices(FEATURES)] += ridge
    w = np.linalg.solve(gram, side)
    bias = base - mean @ w
    wrong = even @ (np.sign(x @ w + base) != y)
    trust = np.log((1 - np.clip(wrong, 1e-3, 0.49)) / np.clip(wrong, 1e-3, 0.49))
    return Model(langs, code, w.astype(np.float32), bias, trust)


def predict_batches(model: Model, names: list[str], keep_text: bool, sharpness: float, close: float):
    """Batches ending in a text column -> the columns, with or without the
    text, then lang_pred, score, ambiguous."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for part in (x for batch in batches for x in slices(batch)):
            docs = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
            # shares under a square root need each row's whole histogram
            total = np.zeros(len(docs) * FEATURES)
            for rows, texts in portions(docs):
                bucket, row = grams(texts, letters)
                first, last = rows[0], rows[-1] + 1
                total[first * FEATURES:last * FEATURES] += np.bincount(
                    (np.array(rows)[row] - first) * FEATURES + bucket, minlength=(last - first) * FEATURES)
            total = total.reshape(len(docs), FEATURES)
            n = total.sum(1)
            if model.langs:
                x = np.sqrt(total / np.maximum(n, 1)[:, None]).astype(np.float32)
                loss = model.losses(x @ model.weights + model.bias)
                near = np.sort(loss, 1)
                best, sure = loss.argmin(1), 1 / np.exp(-sharpness * (loss - near[:, :1])).sum(1)
                lang = [model.langs[b] if k else UNKNOWN for b, k in zip(best, n)]
                score = np.where(n > 0, sure, 0.0)
                doubt = (n == 0) | (near[:, 1] - near[:, 0] < close if len(model.langs) > 1 else False)
            else:
                lang, score, doubt = [UNKNOWN] * len(docs), np.zeros(len(docs)), np.ones(len(docs), bool)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:None if keep_text else -1], pa.array(lang, pa.string()), pa.array(score),
                 pa.array(doubt)], [*names, "lang_pred", "score", "ambiguous"])
    return run


def identify(df: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None,
             sharpness: float = 6.0, close: float = 0.05) -> DataFrame:
    """Columns ``carry`` plus lang_pred, score (0 to 1) and ambiguous."""
    short_batches(df.sparkSession)
    carry = carry or ["doc_id"]
    rest, keep_text = [c for c in carry if c != text_col], text_col in carry
    inner = df.select(F.struct(F.lit(0).alias("_"), *rest).alias("carried"), F.col(text_col).alias("text"))
    names = ["carried", "text"] if keep_text else ["carried"]
    shape = ", ".join(f"{c} {dict(inner.dtypes)[c]}" for c in names) + ", lang_pred string, score double, ambiguous boolean"
    out = inner.mapInArrow(tidy(predict_batches(model, names, keep_text, sharpness, close)), shape)
    return out.select(*[(F.col("text") if c == text_col else F.col("carried")[c]).alias(c) for c in carry],
                      "lang_pred", "score", "ambiguous")


ship(__name__)
