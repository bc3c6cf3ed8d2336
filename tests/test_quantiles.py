"""Exact percentiles against numpy, with ties, small groups, skew and a coarse sketch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlake.functions.quantiles import exact_percentiles

SHARES = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_equal_numpy(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    groups = {"one": [3.5], "two": [1.0, 2.0], "ties": [7.0] * 500 + [8.0] * 3, "some": rng.normal(size=37),
              "many": rng.lognormal(0, 4, 20000), "hot": np.concatenate([np.full(9000, 1.25), rng.random(5000)]),
              "wide": [-1e300, -5.0, 0.0, 1e-300, 1e300]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("some", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r for r in exact_percentiles(df, ["g"], "v", SHARES, accuracy).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].n == len(vs)
        for name, p in SHARES.items():
            assert got[g][name] == pytest.approx(np.percentile(vs, 100 * p), rel=1e-12, abs=1e-300), (g, name)


def test_brackets_are_small_and_empty_input(spark):
    df = spark.range(200_000).select(F.lit(1).alias("g"), F.rand(3).alias("v"))
    out = exact_percentiles(df, ["g"], "v", {"p50": 0.5})
    assert out.count() == 1
    assert exact_percentiles(df.limit(0), ["g"], "v", {"p50": 0.5}).count() == 0
