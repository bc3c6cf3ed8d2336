"""Language model: base scores against counting, the automaton's walk against a
direct evaluation of the smoothed probabilities, and normalisation."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from edge import no_docs, odd_docs, odd_rows
from pyspark.sql import functions as F

from cartlake.llm import lm_score as lm
from cartlake.llm.common import in_fold


def tokens(t):
    return [*(t or "").encode().lower().split(), None]


class Direct:
    """The smoothed probabilities by their definition, from plain counts."""

    def __init__(self, docs, k=lm.SMOOTHING):
        self.k, self.n = k, [Counter(), Counter(), Counter()]
        for t in docs:
            s = ["start", *tokens(t)]
            self.n[0].update(s)
            self.n[1].update(zip(s, s[1:]))
            self.n[2].update(zip(s, s[1:], s[2:]))
        self.total = sum(self.n[0].values()) - len(docs)
        self.types = len(self.n[0]) - (1 if docs else 0)

    def p(self, context, w):
        if not context:
            return (self.n[0][w] + 1) / (self.total + self.types + 1)
        n = self.n[0][context[0]] if len(context) == 1 else self.n[1][context]
        lower = self.p(context[1:], w)
        k = self.k[0] * n ** self.k[1]
        return (self.n[len(context)][(*context, w)] + k * lower) / (n + k) if n else lower

    def score(self, t):
        s = ["start", *tokens(t)]
        return sum(math.log10(self.p(tuple(s[max(0, i - 2):i]), s[i])) for i in range(1, len(s)))


def test_scores(spark):
    rows = odd_rows()
    df = odd_docs(spark, rows).repartition(5)
    got = lm.lm_score(df, F.col("doc_id").isNotNull() & ~in_fold(7, 2)).collect()
    learned = [t for i, t, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c, model = Counter(), Direct(learned)
    for t in learned:
        c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    want = []
    for i, t, *_ in rows:
        want.append((str(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n,
                     round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 5), round(model.score(t), 4)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 4)) for r in got) == \
        sorted(want)
    assert all(r.score <= 0 for r in got)


def test_context_helps_held_out_text(spark):
    kinds = ["the cat sat on the mat", "el gato come pan", "a dog ran to a park"]
    df = spark.createDataFrame([(i, " ".join([kinds[i % 3]] * 5), "en") for i in range(90)],
                               "doc_id long, text string, lang string")
    held = [r for r in lm.lm_score(df, ~in_fold(7, 2)).withColumn("held", in_fold(7, 2)).collect() if r.held]
    assert held and all(r.score > 0.5 * r.base_score for r in held)


@pytest.mark.parametrize("chunk,shard", [(7, 11), (100, 50), (lm.CHUNK, lm.SHARD)])
def test_all_grams_are_learned(spark, monkeypatch, chunk, shard):
    """Scores are those of the direct evaluation, whatever the chunks, shards and partitions."""
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm, "SHARD", shard)
    rng = np.random.default_rng(5)
    docs = [" ".join(f"w{k}" for k in rng.geometric(0.08, int(n))) for n in rng.integers(1, 80, 60)]
    docs += ["odd pair here"] * 2 + ["", None, " \t\n ", "once only", " W1\x0bw2 "]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    model = Direct([t for i, t in enumerate(docs) if i % 4 != 1])
    got = lm.lm_score(df, F.col("doc_id") % 4 != 1).collect()
    assert len(got) == len(docs)
    for r in got:
        assert math.isclose(r.score, model.score(docs[r.doc_id]), rel_tol=1e-9, abs_tol=1e-12), docs[r.doc_id]


def test_every_state_is_a_distribution():
    """From every state the arcs and, behind the failure arc, the rest add up to one."""
    rng = np.random.default_rng(0)
    model = Direct([" ".join(f"w{k}" for k in rng.geometric(0.3, 30).clip(1, 6)) for _ in range(40)])
    words = [w for w in model.n[0] if w != "start"] + ["unknown"]
    contexts = [(), *((w,) for w in model.n[0] if w), *(g for g in model.n[1] if None not in g)]
    assert len(contexts) > 30
    for c in contexts:
        assert abs(sum(model.p(c, w) for w in words) - 1) < 1e-9, c


def test_states_and_failure_arcs():
    """One chunk by hand: b follows a twice, c follows a b once; the walk over
    known and unknown words takes the arcs and failure arcs it should."""
    texts, k = [b"a b c", b"a b", b"x b c a"], (2.0, 0.5)
    words = sorted({w for t in texts for w in t.split()})
    g = lm.Grams(np.array([3, 2, 4]), words, np.array([words.index(w) for t in texts for w in t.split()]))
    model = Direct([t.decode() for t in texts[:2]], k)
    name = [*words, None, "start"]
    n1 = np.array([model.n[0][w] for w in name])
    n2 = np.array([model.n[1][name[c // g.base], name[c % g.base]] for c in g.two])
    n3 = np.array([model.n[2][name[g.two[c // g.base] // g.base], name[g.two[c // g.base] % g.base], name[c % g.base]] for c in g.three])
    a = lm.Automaton(g, n1, n2, n3, model.total + model.types + 1, k)
    assert np.allclose(a.walk(), [model.score(t.decode()) for t in texts])
    x = words.index(b"x")
    assert a.to1[x] == 0 and a.to1[g.end] == 0              # unknown words and END are no contexts
    ab = int(np.flatnonzero(g.two == words.index(b"a") * g.base + words.index(b"b"))[0])
    assert a.fail[a.to2[ab]] == a.to1[words.index(b"b")] and math.isclose(10 ** a.back[a.to2[ab]], 2 * 2 ** 0.5 / (2 + 2 * 2 ** 0.5))


def test_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        x = rng.integers(0, 2 ** 63, n).astype(np.uint64)
        assert (lm.unpack(lm.pack(x, 8), 8) == x).all() and (lm.unpack(lm.pack(x % 97, 4), 4) == x % 97).all()
    assert lm.unpack_words(lm.pack_words([b"a", b"\xc3\xa9"])) == [b"a", b"\xc3\xa9"]


def test_nothing_to_learn(spark):
    got = lm.lm_score(odd_docs(spark), F.lit(False)).collect()
    assert len(got) == len(odd_rows())
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score == 0 for r in got)
    assert lm.lm_score(no_docs(spark), F.lit(True)).count() == 0
