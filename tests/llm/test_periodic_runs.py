"""Periodic runs against brute force: Lyndon arrays, runs of every period,
the query's columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from edge import no_docs, odd_docs, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartlake.llm import periodic_runs as pr
from cartlake.llm.queries import op11_periodic_runs


def brute_lyndon(w):
    def lyndon(x):
        return all(x < x[k:] for k in range(1, len(x)))
    return [max(j - i for j in range(i + 1, len(w) + 1) if lyndon(w[i:j])) for i in range(len(w))]


def brute_runs(w, least=6, exponent=4):
    n, found = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i + q - s
            own = w[s:s + size]
            smaller = any(own[d:] == own[:-d] for d in range(1, q))
            if size >= max(least, exponent * q) and not smaller:
                found.append((s, size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return (text or "").encode().split()


def row_of(doc_id, text):
    words = [w.decode() for w in split(text)]
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    s, size, q = best or (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()      # noqa: E731
    return (doc_id, len(runs), s, size, q, best and 1000 * size // q,
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(collapsed(words, runs)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=14))
def test_phase_one_gives_the_lyndon_array(w):
    rank = [sorted(set(w)).index(x) for x in w]
    top = max(rank)
    assert pr.lyndon_lengths(rank, top) == brute_lyndon(rank)
    back = [top - x for x in rank]
    assert pr.lyndon_lengths(back, top) == brute_lyndon(back)


@pytest.mark.parametrize("least,exponent", [(6, 4), (3, 3), (20, 5)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(exponent)
    for _ in range(1200):
        w = []
        while len(w) < rng.randrange(1, 80):
            block = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(1, 7))]
            w += block * rng.randrange(1, 7)
            if len(w) > 1 and rng.random() < 0.5:
                w.pop()
        assert pr.runs_of(np.array(w), least, exponent) == brute_runs(w, least, exponent)


def test_stretches_lose_no_run(spark):
    """Whole batches, with neighbours that share words, against brute force."""
    rng = random.Random(5)
    texts = []
    for _ in range(150):
        w = []
        while len(w) < rng.randrange(0, 120):
            if rng.random() < 0.5:
                w += [f"u{rng.randrange(40)}" for _ in range(rng.randrange(1, 9))]
            else:
                block = [f"u{rng.randrange(6)}" for _ in range(rng.randrange(1, 8))]
                w += block * rng.randrange(2, 7)
        texts.append((rng.choice([" ", "\n", " \t", "\x0b\x0c"])).join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pr.periodic_runs(df).collect():
        w = texts[r.doc_id].split()
        assert r.n_words == len(w)
        assert [tuple(x) for x in r.runs] == brute_runs(w)
        assert r.kept == collapsed(w, brute_runs(w))


def test_query_on_odd_rows(spark, tmp_path):
    rows = [r for r in odd_rows() if len(r[1] or "") < 20000 or r[0] == 11]
    rows += [(100 + i, " ".join(f"v{k % (3 + i % 5)}" for k in range(11 * i % 90)), "en", "a") for i in range(120)]
    rows += [(7, "a b " * 9, "en", "a"), (7, "a b " * 9, "en", "a"), (8, "same " * 5, "en", "a"),
             (9, "same " * 6 + "x", "en", "a"), (9, "c d c d " * 3 + "e f e f " * 3, "en", "a")]
    odd_docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, (tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect())))
    assert got == sorted(str(row_of(r[0], r[1])) for r in rows)


def test_very_long_and_empty(spark):
    period = [f"p{k}" for k in range(997)]
    df = spark.createDataFrame([(1, " ".join(period * 60)), (2, "z " * 100000), (3, "x" * 10 ** 6)],
                               "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in pr.periodic_runs(df).collect()}
    assert got == {1: [(0, 59820, 997)], 2: [(0, 100000, 1)], 3: []}
    assert pr.periodic_runs(no_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        pr.periodic_runs(df, exponent=2)


def test_strongest_takes_the_first_of_equals(spark):
    df = spark.sql("SELECT array(named_struct('start', 0L, 'length', 8L, 'period', 2L),"
                   " named_struct('start', 9L, 'length', 12L, 'period', 3L),"
                   " named_struct('start', 30L, 'length', 13L, 'period', 3L)) AS runs")
    assert df.select(pr.strongest(F.col("runs")).alias("b")).first().b.start == 30
    assert df.select(pr.strongest(F.slice("runs", 1, 2)).alias("b")).first().b.start == 0
    assert df.select(pr.strongest(F.slice("runs", 1, 0)).alias("b")).first().b is None
