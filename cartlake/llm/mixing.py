"""Mixing sources to target weights by hash-threshold histograms (operator 2).

DataFrame functions only. Every row has a 60-bit hash of its id. Words are
summed per (source, leading hash bits); a prefix sum over a source's buckets
finds the bucket its budget ends in, and only that boundary bucket is
refined with the next bits, level by level, down to one hash value. The
resulting nested thresholds turn the choice into a filter
``hash <= threshold``; no rows are sorted and no source is gathered.

A source whose target is at least its size is taken once whole and the
threshold chooses the rows taken a second time; targets never exceed twice
the size. The boundary value itself is taken when that brings the source
nearer to its target, so a source misses its target by at most half of its
boundary row (rows with one id move together).

Defined cases: null text = size 0; null source is a source of its own, last;
null id hashes as the empty string; a source without words has target 0;
with no words at all every target is 0; rows repeated or tied in hash are
taken together; an empty table gives an empty result; extra columns are
ignored by ``mix`` and kept by ``mixed_rows``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved

WORD = r"[^\x20\x09-\x0D]+"
HASH_DIGITS = 15          # hex digits of md5: 60 bits
LEVEL_BITS = 10
LEVELS = 6


def id_hash(c: Column) -> Column:
    hexed = F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), 1, HASH_DIGITS)
    return F.conv(hexed, 16, 10).cast("long")


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: rank (code-point order, null last), size, target.

    Water filling: the target is min(cap * size, level * weight) with the
    level that spends ``share`` of all words; sources fill up in order of
    cap * size / weight, so prefix sums over that order give the level.
    The input of both windows is one row per source, not per document."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = reduce(lambda e, i: F.when((F.col("rank") - 1) % len(weights) == i, F.lit(float(weights[i]))).otherwise(e),
               range(len(weights)), F.lit(0.0))
    by = by.withColumn("rank", F.row_number().over(order)).withColumn("weight", w)
    by = by.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    # the level reached if exactly the sources before this one are full
    by = (by.withColumn("full", F.coalesce(F.sum("most").over(fill), F.lit(0.0)))
          .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
          .withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(every) - F.col("full")) / F.col("open"))
          # the first source that this level does not fill ends the filling; later ones have lower levels
          .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level")))
                      .over(every)))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(
        F.least("most", F.col("level") * F.col("weight")))
    return by.select("source", "rank", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, need: DataFrame) -> DataFrame:
    """(rank, threshold): per source the hash up to which rows are taken so
    that their words come nearest to ``need``. sized: rank, hash, size."""
    edge = need.select("rank", F.col("need").alias("left"), F.lit(0).cast("long").alias("prefix"))
    total = LEVEL_BITS * LEVELS
    for level in range(1, LEVELS + 1):
        shift = total - LEVEL_BITS * level
        sums = (sized.withColumn("prefix", F.shiftright("hash", shift + LEVEL_BITS)).join(edge, ["rank", "prefix"])
                .groupBy("rank", F.shiftright("hash", shift).alias("bucket"))
                .agg(F.sum("size").alias("words"), F.first("left").alias("left")))
        upto = Window.partitionBy("rank").orderBy("bucket")
        sums = sums.withColumn("before", F.sum("words").over(upto) - F.col("words"))
        # the last bucket that starts below the budget holds its end
        edge = (sums.filter(F.col("before") < F.col("left")).groupBy("rank")
                .agg(F.max(F.struct("bucket", (F.col("left") - F.col("before")).alias("left"), "words")).alias("e"))
                .select("rank", F.col("e.left").alias("left"), F.col("e.bucket").alias("prefix"),
                        F.col("e.words").alias("words")))
    nearer = 2 * F.col("left") >= F.col("words")
    return edge.select("rank", F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("threshold"))


def plan(sized: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: rank, source_size, target, whole (taken once
    whole), threshold (rows up to this hash are taken once more; may be
    null). sized: source, size, hash."""
    targets = saved(source_targets(sized, weights, share, cap), "mix-targets")
    whole = (F.col("target") >= F.col("source_size")).cast("int")
    need = targets.select("rank", (F.col("target") - whole * F.col("source_size")).alias("need")).filter("need > 0")
    cut = thresholds(with_source(sized, targets).select("rank", "hash", "size"), need)
    return saved(targets.withColumn("whole", whole).join(cut, "rank", "left"), "mix-plan")


def with_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Null-safe equi-join on source; Spark broadcasts the per-source table
    when its size allows."""
    t = per_source.withColumnRenamed("source", "_source")
    return rows.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def times() -> Column:
    """How often the mix takes a row, from the plan's columns and its hash."""
    return F.col("whole") + F.when(F.col("hash") <= F.col("threshold"), 1).otherwise(0)


def sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return saved(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                           word_count(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("hash")),
                 "mix-sizes")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **rules) -> DataFrame:
    """Every row's id, source, size, source_size, target and ``times`` (0, 1
    or 2: how often the mix takes it)."""
    sized = sizes(df, id_col, text_col, source_col)
    return with_source(sized, plan(sized, **rules)).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        times().alias("times"))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               **rules) -> DataFrame:
    """The mix itself: every row of ``df`` as often as it is taken. The plan
    meets the rows by source and hash, so texts are neither copied nor shuffled."""
    found = plan(sizes(df, id_col, text_col, source_col), **rules)
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(source_col).alias("source"),
                     id_hash(F.col(id_col)).alias("hash"))
    taken = with_source(rows, found).select("row", F.explode(F.array_repeat(F.lit(0), times().cast("int"))))
    return taken.select(*[F.col("row")[c].alias(c) for c in df.columns])
