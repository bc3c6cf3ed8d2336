"""N-gram join against all pairs, components against union-find."""

import random

import numpy as np
import pytest
from edge import no_docs, odd_docs, odd_rows, words

from cartlake.llm import ngram_join as nj
from cartlake.llm.components import components


def shingles(t, k=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[i:i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)} if w else set()


def union(nodes, edges):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def variants(first, n, size, edits, seed):
    """n texts, each with its own edits of one base text."""
    base, rng, out = words(seed, size, 10_000).split(), random.Random(seed), []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(size)] = f"e{rng.randrange(10 ** 6)}"
        out.append((first + i, " ".join(w), "en", "a"))
    return out


@pytest.mark.parametrize("hot,stars", [(1 << 16, 8), (4, 1), (50, 3)])
def test_links(spark, hot, stars):
    rows = odd_rows() + variants(100, 25, 80, 6, 11) + variants(200, 25, 40, 3, 12)
    line = words(99, 14)
    rows += [(300 + i, line + " " + words(500 + i, 4 + i % 9), "en", "a") for i in range(40)]
    # a chain: neighbours link, the ends do not
    long = words(13, 300, 10_000).split()
    rows += [(400 + i, " ".join(long[12 * i:12 * i + 120]), "en", "a") for i in range(8)]
    known = [(i, t) for i, t, *_ in rows if i is not None]
    sets = {(i, t): shingles(t) for i, t in known}
    edges = [(a[0], b[0]) for a in sets for b in sets if a < b and a[1] and b[1] and sets[a]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])] if None not in sets else []
    top = union({i for i, _ in known}, edges)
    got = nj.ngram_join(odd_docs(spark, rows).repartition(4), hot=hot, stars=stars).collect()
    assert len(got) == len(rows)
    text = {}
    for i, t, *_ in rows:
        text.setdefault(i, []).append(t)
    for r in got:
        assert r.n_shingles in {len(shingles(t)) for t in text[r.doc_id]}
        if r.doc_id is not None:
            assert r.component_id == top[r.doc_id], r
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["0", "None"]


def test_empty(spark):
    assert nj.ngram_join(no_docs(spark)).count() == 0
    blank = odd_docs(spark, [(1, "", None, None), (2, None, None, None), (3, " ", None, None)])
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.ngram_join(blank).collect()) == [
        (1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_prefixes_share_enough():
    """Any two sets at the threshold share the asked number in their prefixes."""
    rng = np.random.default_rng(4)
    often_of = {}
    for _ in range(400):
        size = int(rng.integers(1, 60))
        x = np.unique(rng.integers(0, 200, size).astype(np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[:max(1, int(len(x) * rng.uniform(0.7, 1)))],
                                      rng.integers(0, 200, int(rng.integers(0, 4))).astype(np.uint64)]))
        if 100 * len(np.intersect1d(x, y)) < 75 * len(np.union1d(x, y)):
            continue
        often = lambda s: np.array([often_of.setdefault(int(v), int(rng.choice([0, 0, 0, 5, 900]))) for v in s])
        (px, mx), (py, my) = (nj.choose_prefix(s, often(s), 75) for s in (x, y))
        assert len(np.intersect1d(px, py)) >= min(mx, my)


@pytest.mark.parametrize("list_size", [1 << 16, 1])
def test_counts_of_a_pair_meet(spark, list_size):
    """The asking node of the pair 1, 4 is 4 for one token and 1 for the other."""
    held = [(7, 1), (7, 2), (7, 3), (7, 4), (8, 1), (8, 4), (8, 5), (8, 6)]
    rows = [(t, n, 10, 1, 1 if n < 4 else 4) for t, n in held]          # a pair needs 2
    entries = spark.createDataFrame(rows, "token long, node long, size long, ask int, component long").repartition(3)
    got = nj.cross_pairs(entries, 75, list_size).collect()
    assert [(r.a, r.b) for r in got] == [(1, 4)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 5 + k) for k in range(1, 80)]
    edges += [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union({n for e in edges for n in e}, edges)
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_a_saved_step_leaves_no_shuffle_files(spark):
    import time
    from cartlake.llm.common import CLEANUP, saved
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = files.getAllFiles()
        names = (found.apply(i).getName() for i in range(found.size()))
        return {n for n in names if n.startswith("shuffle_")}
    before, setting = shuffled(), spark.conf.get(CLEANUP)
    rows = spark.range(10_000).selectExpr("id % 100 AS k").groupBy("k").count().repartition(4, "count")
    out = saved(rows, "shuffle-files")
    for _ in range(50):            # files go in the background
        left = shuffled() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(CLEANUP) == setting
    assert sorted(map(tuple, out.collect())) == [(k, 100) for k in range(100)]
