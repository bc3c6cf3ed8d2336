"""Repeated-passage removal against a brute-force set of all strings."""

import hashlib
import random

import numpy as np
import pytest
from edge import no_docs, odd_docs, odd_rows, words

from cartlake.llm import suffix_dedup as sd


def brute(rows, length):
    """Expected (spans, sha256) in corpus order; rows with one id in given order."""
    seen, out = set(), []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b, spans = (t or "").encode(), []
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if w in seen:
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + length
                else:
                    spans.append([s, s + length])
            seen.add(w)
        keep, at = b"", 0
        for a, e in spans:
            keep, at = keep + b[at:a], e
        out.append((i, len(b), [tuple(s) for s in spans], hashlib.sha256(keep + b[at:]).hexdigest()))
    return out


def rows_with_passages():
    rows = [r for r in odd_rows() if r[0] not in (10, None)]
    passage, rng = words(77, 60), random.Random(5)
    for i in range(70, 100):
        cut = rng.randrange(0, 40)
        rows.append((i, words(i + 1000, 30) + " " + passage[cut:cut + 250] + " " + words(i + 2000, 10), "en", "a"))
    rows.append((200, "ñ" * 300 + passage, "en", "a"))
    return [r for k, r in enumerate(rows) if not (r[0] == 7 and k % 2)]


@pytest.mark.parametrize("crowd", [1 << 16, 8])
def test_spans(spark, crowd, monkeypatch):
    rows = rows_with_passages()
    got = sd.suffix_dedup(odd_docs(spark, rows).repartition(6), crowd=crowd).collect()
    got = sorted(((r.doc_id, r.n_bytes, [(s.start, s.stop) for s in r.spans], r.kept_sha256) for r in got), key=str)
    assert got == sorted(brute(rows, 100), key=str)


def test_repeated_and_null_ids(spark):
    text = words(3, 100)
    rows = [(5, text, "en", "a"), (5, text, "en", "a"), (None, text, "en", "a"), (1, text + "!", "en", "a")]
    got = sd.suffix_dedup(odd_docs(spark, rows)).collect()
    n = len(text)
    # null first; one more byte after a known passage is a new string but covered
    assert sorted((str(r.doc_id), sum(s.stop - s.start for s in r.spans)) for r in got) == [
        ("1", n), ("5", n), ("5", n), ("None", 0)]


def test_empty(spark):
    assert sd.suffix_dedup(no_docs(spark)).count() == 0


def test_long_text_in_parts(monkeypatch):
    text = (words(1, 3000) + "ab" * 400).encode()
    one = sd.runs([text], 100)
    monkeypatch.setattr(sd, "PIECE", 700)
    many = sd.runs([text], 100)
    owned = lambda r: {int(s) + k: int(g) for s, n, g in zip(*r[1:]) for k in range(n)}
    assert owned(one) == owned(many) and len(owned(one)) == len(text) - 99


def test_longest_previous_factor():
    rng = random.Random(9)
    for _ in range(60):
        text = bytes(rng.choice(b"ab") if rng.random() < 0.9 else rng.choice(b"abc") for _ in range(rng.randrange(1, 90)))
        length = rng.choice([1, 7, 8, 9, 16, 20])
        n = len(text) - length + 1
        if n < 1:
            continue
        order, common = sd.suffix_order(np.frombuffer(text, np.uint8), np.arange(n), length)
        cut = [text[i:i + length] for i in order]
        assert cut == sorted(cut)
        factor = np.empty(n, int)
        factor[order] = sd.previous_factor(order, common)
        for i in range(n):
            lcp = lambda j: next((k for k in range(length) if text[i + k] != text[j + k]), length)  # noqa: B023,E731
            assert factor[i] == max((lcp(j) for j in range(i)), default=0)
