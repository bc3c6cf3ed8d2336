"""Decontamination against a plain window search, in one and in many blocks."""

import re

import pytest
from edge import no_docs, odd_docs, odd_rows, words

from cartlake.llm import decontaminate as dc

ITEMS = [(1, words(50, 40)), (2, words(1, 120)), (10, "One"), (3, None), (4, "?!"), (5, words(2, 30000, 5000)[:2000]),
         (None, "ñandú ÉÀ"), (7, "short item of SIX words here"), (8, "a b c d e f"), (2, words(33, 60))]


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items):
    w = split(text)
    hit, found = [False] * len(w), []
    for i, t in items:
        x = split(t)
        n = min(13, len(x))
        grams = {tuple(x[k:k + n]) for k in range(len(x) - n + 1)} if n else set()
        at = [k for k in range(len(w) - n + 1) if tuple(w[k:k + n]) in grams] if n else []
        for k in at:
            hit[k:k + n] = [True] * n
        if at:
            found.append("" if i is None else str(i))
    return len(w), sum(hit), sorted(found), hit


@pytest.mark.parametrize("block_words", [500_000, 60])
def test_hits(spark, block_words):
    rows = odd_rows() + [(90, "intro. " + words(50, 40).upper() + "; end, of: SIX words", "en", "a"),
                         (91, "A-b c d e f short item of six words here, onetwo", "en", "a")]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = dc.decontaminate(odd_docs(spark, rows), bench, carry=["text"], block_words=block_words).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, found, mask = brute(r.text, ITEMS)
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (n, hit, found, hit > 0 and 20 * hit >= n), r.doc_id
        raw = (r.text or "").encode()
        covered = set()
        for s in r.spans:
            before = len(split(raw[:s.start].decode()))
            covered.update(range(before, before + len(split(raw[s.start:s.stop].decode()))))
        assert covered == {k for k, m in enumerate(mask) if m}


def test_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dc.decontaminate(no_docs(spark), bench).count() == 0
    none = dc.decontaminate(odd_docs(spark), bench.limit(0)).collect()
    assert len(none) == len(odd_rows()) and not any(r.n_hit or r.contaminated for r in none)
