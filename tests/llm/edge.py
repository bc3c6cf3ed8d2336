"""Shared odd documents: nulls, empty and very long texts, ties, repeated
rows, extra columns whose names clash with the operators' own."""

import random

CLASH = ["id", "row", "row_no", "size", "hash", "digest", "token", "node", "score", "word", "copy", "stats", "rank",
         "text_sha256", "component", "items", "hits", "carried", "starts", "predicted", "held_out", "label"]


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    base = words(1, 120)
    near = base.split()
    near[60] = "changed"
    long = words(2, 30000, 5000)
    rows = [
        (0, base, "en", "a"), (1, base, "en", "a"), (2, " ".join(near), "de", "b"), (3, None, "fr", None),
        (4, "", None, "a"), (5, " \t\n ", "en", ""), (6, "one", "en", "b"), (7, "one", "en", "b"),
        (7, "one", "en", "b"), (8, "ONE two three four", "de", "c"), (9, long, "en", "a"), (10, long + " end", "en", "a"),
        (11, "x" * 50000, "en", "a"), (12, "ab" * 20000, "en", "a"), (None, base, "en", "a"), (None, None, None, None),
        (13, "ñandú　ÉÀ \x1c \x85 ﬁ  日本語", "es", "ü"), (14, base + "\n" + base, "en", "b"), (15, base + " ", "en", "b"),
        (16, "a b c d e", "en", "a"), (17, "A B c d e", "en", "a"), (18, "12345 67890 !!! ???", None, "c"),
        (20, "Word-word's \"quoted\" — dash", "en", "d")]
    for i in range(30, 60):
        rows.append((i, words(i, 20 + i * 7), ["en", "de", "fr"][i % 3], f"s{i % 4}"))
    return rows


def odd_docs(spark, rows=None, clash=True):
    df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows or odd_rows()],
                               "doc_id long, text string, lang string, source string, n_chars long")
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASH])
    return df


def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
