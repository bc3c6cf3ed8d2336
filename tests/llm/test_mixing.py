"""Source mixing against the iterative definition of the targets."""

import re

from pyspark.sql import functions as F

from cartlake.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def targets(sizes, weights=(5, 2, 1)):
    """Share 150% by weight; what exceeds twice a source's size is shared anew."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 2 * sizes[s] + 1e-9}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over


def rows():
    out = []
    for i in range(400):
        source = None if i % 17 == 0 else "hot" if i % 3 else f"s{i % 7}"
        out.append((i, " ".join(["w"] * (i * 7 % 23)), source))
    return [*out, (400, None, "empty"), (401, "", "empty"), (5, "again again", "s5"), (None, "no id", "s1"),
            (402, "x " * 3000, "long"), (403, " a　b c", "wide")]


def test_targets_and_taken(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).withColumn("size", F.lit("clash")).withColumn("rank", F.lit(0))
    got = mixing.mix(df).collect()
    assert len(got) == len(data)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + size(t)
    want, taken, largest = targets(sizes), {}, {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert r.times in (0, 1, 2)
        taken[r.source] = taken.get(r.source, 0) + r.times * r["size"]
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
    for s, t in want.items():
        # equal hashes move together: id 5 is there twice
        assert abs(taken[s] - t) <= largest[s] + 5, (s, t, taken[s])
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)


def test_mixed_rows_repeat(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("row", F.lit("clash")).withColumn("hash", F.lit(1))
    times = {}
    for r in mixing.mix(df).collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + r.times
    got = {}
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in times.items() if v}


def test_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, "", "a"), (2, None, None)], SCHEMA)).collect()
    assert [r.target for r in got] == [0.0, 0.0]
