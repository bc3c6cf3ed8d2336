"""Exact interpolated percentiles per group without a group's values in one
task: a sketch brackets the wanted ranks, rows below a bracket are only
counted, and the few values inside it are ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACCURACY = 10_000          # of the sketch: its rank error is at most rows / ACCURACY


def exact_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float],
                      accuracy: int = ACCURACY) -> DataFrame:
    """A row a group: ``by``, ``n`` (rows with a value) and, under each name of
    ``shares``, the value at rank (n - 1) * share, linear between its neighbours
    (nulls are left out). A bracket reaches two sketch errors to either side,
    so it holds both neighbours (a group of up to ``accuracy`` rows is one
    bracket); a task orders the distinct values of one bracket, some 4 /
    ``accuracy`` of a group."""
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    near = 2 / accuracy
    sketch = lambda p: F.percentile_approx("_v", F.lit(min(max(p, 0.0), 1.0)), F.lit(accuracy))     # noqa: E731
    few = F.count(F.lit(1)) <= accuracy
    ends = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[
        e for k, p in enumerate(shares.values()) for e in (
            F.when(few, F.min("_v")).otherwise(sketch(p - near)).alias(f"_lo{k}"),
            F.when(few, F.max("_v")).otherwise(sketch(p + near)).alias(f"_hi{k}"))])
    inside = lambda k, c="_v": F.col(c).between(F.col(f"_lo{k}"), F.col(f"_hi{k}"))                  # noqa: E731
    any_inside = F.lit(False)
    for k in range(len(shares)):
        any_inside = any_inside | inside(k)
    # one row a bracketed value, and one (null) for all others
    met = rows.join(ends, by)
    held = met.groupBy(*by, F.when(any_inside, F.col("_v")).alias("_g")).agg(
        F.count(F.lit(1)).alias("_rows"), F.first("n").alias("n"),
        *[F.count_if(F.col("_v") < F.col(f"_lo{k}")).alias(f"_below{k}") for k in range(len(shares))],
        *[F.first(f"_{e}{k}").alias(f"_{e}{k}") for k in range(len(shares)) for e in ("lo", "hi")])
    targets = F.array(*[F.struct(
        F.lit(k).alias("_k"), ((F.col("n") - 1) * F.lit(float(p))).alias("_rank"), F.when(inside(k, "_g"), F.col("_g")).alias("_in"),
        F.when(inside(k, "_g"), F.col("_rows")).otherwise(F.col(f"_below{k}")).alias("_add")) for k, p in enumerate(shares.values())])
    told = held.select(*by, "n", F.explode(targets).alias("_t")).groupBy(*by, "n", "_t._k", "_t._rank", "_t._in").agg(F.sum("_t._add").alias("_add"))
    w = Window.partitionBy(*by, "_k").orderBy(F.asc_nulls_first("_in")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = told.withColumn("_upto", F.sum("_add").over(w)).filter("_in IS NOT NULL")
    at = lambda r: F.max(F.when((F.col("_upto") - F.col("_add") <= r) & (r < F.col("_upto")), F.col("_in")))       # noqa: E731
    low = F.floor("_rank")
    both = told.groupBy(*by, "n", "_k", "_rank").agg(at(low).alias("_a"), at(F.ceil("_rank")).alias("_b"))
    found = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_rank") - low)
    return both.groupBy(*by, "n").agg(*[F.max(F.when(F.col("_k") == k, found)).alias(name) for k, name in enumerate(shares)])
