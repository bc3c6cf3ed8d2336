"""Language ID: the plain method, held-out accuracy, codeword distance, odd rows."""

import numpy as np
import pytest
from edge import no_docs, odd_docs, odd_rows
from pyspark.sql import functions as F

from cartlake.llm import language as lg
from cartlake.llm.common import in_fold, table
from conftest import SF_CHECK


def test_held_out_accuracy(spark):
    docs = table(spark, SF_CHECK, "documents")
    got = lg.identify(docs, lg.fit(docs, ~in_fold(3, 1)), carry=["doc_id", "lang"]).filter(in_fold(3, 1)).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    df = odd_docs(spark)
    got = lg.identify(df, lg.fit(df, ~in_fold(3, 1)), carry=["doc_id", "text"]).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        no_letter = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == lg.UNKNOWN) == no_letter
        assert r.lang_pred in {"en", "de", "fr", "es", lg.UNKNOWN}
        if no_letter:
            assert r.score == 0 and r.ambiguous
    same = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert same[0] == same[1]


@pytest.mark.parametrize("langs", [[], ["xx"]])
def test_few_languages(spark, langs):
    df = odd_docs(spark, [(i, "some text", lang, None) for i, lang in enumerate(langs or [None])])
    got = lg.identify(df, lg.fit(df, F.lit(True))).collect()
    assert [r.lang_pred for r in got] == (langs or [lg.UNKNOWN])
    assert lg.identify(no_docs(spark), lg.fit(no_docs(spark), F.lit(True))).count() == 0


@pytest.mark.parametrize("k", [3, 4, 6, 7, 12, 40])
def test_codewords_correct_a_wrong_bit(k):
    code = lg.codewords(k)
    gap = min(int((code[a] != code[b]).sum()) for a in range(k) for b in range(a))
    assert gap >= (2 if k == 3 else 3)
    for bit in range(code.shape[1]):
        assert len(set(code[:, bit])) == 2


def test_portions_lose_no_gram(monkeypatch):
    letters = lg.letter_table()
    docs = ["Der schnelle Fuchs", "", "à côté — naïve", "x" * 300, "short"]

    def counts():
        total = np.zeros((len(docs), lg.FEATURES))
        for rows, part in lg.portions(docs):
            bucket, row = lg.grams(part, letters)
            np.add.at(total, (np.array(rows)[row], bucket), 1)
        return total
    whole = counts()
    monkeypatch.setattr(lg, "CHUNK", 50)
    parts = counts()
    assert (whole == parts).all() and whole.sum() > 500


class Plain:
    """The method by its definition, with plain counts and dense algebra."""

    def __init__(self, rows, ridge=2e-4):
        self.langs = sorted({lang for _, lang in rows})
        code = lg.codewords(len(self.langs))
        x = np.array([self.features(t) for t, _ in rows])
        who = np.array([self.langs.index(lang) for _, lang in rows])
        share = np.array([1 / sum(who == w) / len(self.langs) for w in who])
        mean, y = share @ x, code[who]
        base = share @ y
        a = (x - mean).T @ ((x - mean) * share[:, None]) + ridge * np.eye(lg.FEATURES)
        self.w = np.linalg.solve(a, (x - mean).T @ ((y - base) * share[:, None]))
        self.bias, self.code = base - mean @ self.w, code
        wrong = [sum(s for s, m, t in zip(share, (x @ self.w + self.bias)[:, b], y[:, b]) if m * t <= 0) for b in range(y.shape[1])]
        self.trust = np.array([np.log((1 - p) / p) for p in np.clip(wrong, 1e-3, 0.49)])

    @staticmethod
    def features(text):
        c = [0, *(ord(k.lower()[0]) if k.isalpha() else 0 for k in text or ""), 0]
        n = np.zeros(lg.FEATURES)

        def add(*letters):
            total = sum(k * f for k, f in zip(letters, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)))
            n[(total * 0x27D4EB2F165667C5 % 2 ** 64 >> 40) % lg.FEATURES] += 1
        for i in range(1, len(c) - 1):
            if c[i]:
                add(c[i])
                if c[i - 1] or c[i + 1]:
                    add(*c[i - 1:i + 2])
        return np.sqrt(n / max(n.sum(), 1))

    def losses(self, text):
        margin = self.features(text) @ self.w + self.bias
        return [sum(t * max(0, 1 - m * c) ** 2 for m, c, t in zip(margin, word, self.trust)) / sum(self.trust) for word in self.code]


def test_fit_and_decoding_equal_the_plain_method(spark):
    """Bits, weights, nearest codeword, score and the ambiguity flag of every row."""
    docs = table(spark, SF_CHECK, "documents").limit(400)
    learned = [(r.text, r.lang) for r in docs.filter(~in_fold(3, 1) & F.col("lang").isNotNull()).collect()]
    plain = Plain(learned)
    mixed = spark.createDataFrame([(10 ** 6 + i, a[0][:150] + " " + b[0][:150]) for i, (a, b) in enumerate(zip(learned, learned[7:60]))],
                                  "doc_id long, text string")
    asked = docs.select("doc_id", "text").unionByName(mixed)
    model = lg.fit(docs, ~in_fold(3, 1))
    assert model.langs == plain.langs and len(model.langs) > 2
    doubts = 0
    for r in lg.identify(asked, model, carry=["doc_id", "text"]).collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert r.lang_pred == lg.UNKNOWN
            continue
        loss = plain.losses(r.text)
        near = sorted(loss)
        assert abs(r.score - 1 / sum(np.exp(-6 * (x - near[0])) for x in loss)) < 0.02
        if near[1] - near[0] > 0.01:
            assert r.lang_pred == plain.langs[int(np.argmin(loss))]
        if abs(near[1] - near[0] - 0.05) > 0.01:
            assert r.ambiguous == (near[1] - near[0] < 0.05)
            doubts += r.ambiguous
    assert doubts > 0
