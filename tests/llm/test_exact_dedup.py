"""Exact dedup against a brute-force grouping, with few and many counters."""

import hashlib
import re

import pytest
from edge import no_docs, odd_docs, odd_rows

from cartlake.llm import exact_dedup as xd


def brute(rows):
    groups = {}
    for k, (i, t, *_) in enumerate(rows):
        t = t or ""
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest()
        groups.setdefault(key, []).append((-len(t), i is None, i or 0, k))
    out = []
    for key, members in groups.items():
        best = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), key))
    return out, len(groups)


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_groups(spark, counters):
    rows = odd_rows() + [(100 + i, "hot  text" + " " * (i % 3), "en", "a") for i in range(60)]
    got = xd.exact_dedup(odd_docs(spark, rows).repartition(5), counters=counters).collect()
    want, groups = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got), key=str) == sorted(want, key=str)
    kept = [r for r in got if r.kept]
    assert len(kept) == groups and all(r.doc_id == r.keep_id for r in kept)


def test_empty(spark):
    assert xd.exact_dedup(no_docs(spark)).count() == 0


def test_summary_keeps_heavy_hitters():
    import pyarrow as pa

    data = ["a"] * 500 + [f"x{i}" for i in range(400)] + ["b"] * 300
    batches = [pa.RecordBatch.from_pydict({"d": data[i:i + 50]}) for i in range(0, len(data), 50)]
    out = next(xd.misra_gries(3)(iter(batches))).to_pydict()
    held = dict(zip(out["digest"], out["at_least"]))
    assert {"a", "b"} <= set(held) and held["a"] <= 500 and len(held) <= 3
