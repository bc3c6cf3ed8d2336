"""Toxicity: lattice decoding against all readings, restored texts, held-out
accuracy, odd rows."""

from itertools import product

import numpy as np
import pytest
from edge import no_docs, odd_docs, odd_rows, words
from pyspark.sql import functions as F

from cartlake.llm import toxicity as tx
from cartlake.llm.common import in_fold, table
from conftest import SF_CHECK

CORPUS = ["you are an idiot and a loser", "the pathetic clown said stupid things", "this is a kind and gentle text",
          "people are good to each other here", "an idiot is not a good person"] * 20


@pytest.fixture(scope="module")
def letters(spark):
    return tx.fit_letters(spark.createDataFrame([(t,) for t in CORPUS], "text string"))


@pytest.mark.parametrize("seen,meant", [
    ("1d10t", "idiot"), ("id!ot", "idiot"), ("i.d.i.o.t", "idiot"), ("p@thet1c", "pathetic"), ("l0$er", "loser"),
    ("stuuuupid", "stupid"), ("i d i o t", "idiot"), ("an i d i o t here", "an idiot here"), ("kind", "kind"),
    ("IDIOT###", "idiot"), ("people!!", "people"), ("good", "good"), ("2024", ""), ("c-l-o-w-n", "clown")])
def test_restored(letters, seen, meant):
    assert tx.Restorer(letters).text(seen) == meant


def test_viterbi_finds_the_cheapest_reading(letters):
    def readings(seen, i=0):
        if i == len(seen):
            yield "", 0.0
            return
        for x, cost in tx.arcs(seen, i):
            for rest, more in readings(seen, i + 1):
                yield x + rest, cost + more

    def total(text, cost):
        a = b = 0
        for c in " ".join(text.split()):
            k = letters.code(c) if c != " " else 0
            cost -= float(letters.log[a, b, k])
            a, b = (0, 0) if c == " " else (b, k)
        return cost - (float(letters.log[a, b, 0]) if b else 0.0)

    for seen in ("1d10t", "l0$er", "g0od", "a1b", "stuuu1d", "c.l0"):
        best = min(total(t, c) for t, c in readings(seen) if not t.startswith(" ") and not t.endswith(" "))
        got = tx.decode(seen, letters)
        assert min(total(t, c) for t, c in readings(seen) if t.strip() == got) <= best + 1e-5


def test_no_reading_of_a_symbol_run_is_dropped():
    """A run with more than 16 states at a time, against all of its readings."""
    rng, counts = np.random.default_rng(0), np.zeros(tx.ALPHABET ** 3)
    counts[rng.integers(0, tx.ALPHABET ** 3, 3000)] = rng.integers(1, 10 ** 5, 3000)
    model, seen = tx.Letters("abcegilosty", counts), "0+7|10930!"
    log, best = model.log, (np.inf, "")
    for reading in product(*[tx.arcs(seen, i) for i in range(len(seen))]):
        cost, a, b, text = sum(c for _, c in reading), 0, 0, ""
        for x, _ in reading:
            if not x or (x == " " and b == 0):
                continue
            k = model.code(x) if x != " " else 0
            cost -= float(log[a, b, k])
            (a, b), text = ((0, 0) if x == " " else (b, k)), text + x
        best = min(best, (cost - (float(log[a, b, 0]) if b else 0.0), text))
    assert tx.decode(seen, model) == best[1].strip()


def test_restore_column(spark, letters):
    got = [r.restored for r in tx.restore(spark.createDataFrame([("an 1d10t",), (None,), ("",)], "text string"),
                                          letters).collect()]
    assert got == ["an idiot", None, ""]


def test_held_out(spark):
    """Clear and disguised insults among plain texts, learned from the other folds."""
    bad = ["idiot", "loser", "clown", "moron"]
    rows, labels = [], []
    for i in range(600):
        text = words(i, 40, 300).replace("w", "q")
        text = "".join(c if not c.isdigit() else "abcdefghij"[int(c)] for c in text)
        if i % 4 == 0:
            w = bad[i // 4 % 4]
            text += " " + (w if i % 3 else "".join({"o": "0", "i": "1"}.get(c, c) for c in w)) + " " + text[:20]
        rows.append((i, text, None, None))
        labels.append((i, int(i % 4 == 0)))
    df, lab = odd_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = tx.score(df, tx.fit(df, lab, ~in_fold(5, 0))).filter(in_fold(5, 0)).collect()
    assert len(got) > 80 and all(r.predicted == int(r.doc_id % 4 == 0) for r in got)


def test_driver_rows(spark):
    docs, labels = table(spark, SF_CHECK, "documents"), table(spark, SF_CHECK, "labels")
    model = tx.fit(docs, labels, ~in_fold(5, 0))
    got = tx.score(docs, model).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.95


def test_odd_rows(spark):
    df = odd_docs(spark)
    labels = spark.createDataFrame([(0, 1), (1, 0), (3, 1), (4, 0), (30, 1), (30, 0), (None, 1)], "doc_id long, toxic int")
    got = tx.score(df, tx.fit(df, labels, F.lit(True), support=1)).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    none = tx.score(df, tx.fit(df, labels.limit(0), F.lit(True))).collect()
    assert {r.score for r in none} == {0.0}
    assert tx.score(no_docs(spark), tx.fit(no_docs(spark), labels, F.lit(True))).count() == 0


def test_scores_equal_the_plain_method(spark):
    """Plain words only: document counts, log odds, the summary of a text and
    the model's probability, all recounted."""
    rng = np.random.default_rng(2)
    name = lambda k: "".join("bcdfghlmnrst"[int(d)] + "aeiou"[k % 5] for d in str(k + 100))     # noqa: E731
    rows, toxic = [], {}
    for i in range(500):
        toxic[i] = int(rng.random() < 0.4)
        rows.append((i, " ".join(name(int(k)) for k in (rng.geometric(0.05, 12) % 60) + (25 if toxic[i] else 0)), None, None))
    df = odd_docs(spark, rows)
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    model = tx.fit(df, labels, ~in_fold(5, 0))
    known = df.filter(~in_fold(5, 0)).select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("draw")).collect()
    counted, rest = [r for r in known if r.draw % 3], [r for r in known if r.draw % 3 == 0]
    features = lambda t: {f for w in t.split() for f in (w + "$", w[:6], w[:5], w[:4])}         # noqa: E731
    n = [sum(toxic[r.doc_id] == k for r in counted) for k in (0, 1)]
    seen = {}
    for r in counted:
        for f in features(r.text):
            seen.setdefault(f, [0, 0])[toxic[r.doc_id]] += 1
    odds = {f: np.log((b + 0.5) / (n[1] + 1)) - np.log((a + 0.5) / (n[0] + 1)) for f, (a, b) in seen.items() if a + b >= 4}
    telling = {f for f, e in odds.items() if e > 0.7}
    odds = {f: e for f, e in odds.items() if f in telling or any(f[:k] in telling for k in (4, 5, 6) if len(f) > k)}
    assert model.odds.keys() == odds.keys() and all(np.isclose(model.odds[f], e) for f, e in odds.items()) and len(odds) > 20

    def summary(text):
        words = set(text.split())
        found = [next((odds[f] for f in (w + "$", w[:6], w[:5], w[:4]) if f in odds), 0.0) for w in words]
        found = sorted((e for e in found if e > 0), reverse=True)
        top = (found + [0.0] * 3)[:3]
        return [*top, np.log(1 + sum(e > 2 for e in found)), top[0] ** 2 / 10, np.log(1 + len(words))]

    x, y = np.array([summary(r.text) for r in rest]), np.array([toxic[r.doc_id] for r in rest], float)
    w = tx.logistic(x, y)
    share = sum(toxic[r.doc_id] for r in known) / sum(1 - toxic[r.doc_id] for r in known)
    w[-1] += np.log(share) - np.log(y.sum() / (len(y) - y.sum()))
    text = {i: t for i, t, *_ in rows}
    for r in tx.score(df, model).collect():
        p = 1 / (1 + np.exp(-(np.array(summary(text[r.doc_id])) @ w[:-1] + w[-1])))
        assert abs(r.score - p) < 1e-6 and r.predicted == int(p >= 0.5)


def test_logistic_separates():
    x = np.array([[0.0], [1.0], [4.0], [5.0]])
    w = tx.logistic(x, np.array([0, 0, 1, 1.0]))
    assert (x @ w[:-1] + w[-1] > 0).tolist() == [False, False, True, True]
