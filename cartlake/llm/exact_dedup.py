"""Exact dedup with a heavy-hitter split (operator 9).

Texts are equal when their SHA-256 after deleting ASCII white space
(space, \\t \\n \\v \\f \\r) is equal. Of equal rows the one with the most code
points stays, then the smallest id (nulls last), then the first written row.

Method: one scan writes (id, length, digest) rows. A Misra-Gries summary per
partition (``counters`` entries each) finds the digests that may be frequent;
the merged top ``counters`` candidates are counted exactly (a partial
aggregate: one row per digest and task leaves the map side) and their
verified winners - at most ``counters`` rows, a fixed bound - are broadcast,
so hot rows are decided map-side and never shuffled. All other digests take
the ordinary shuffle (groupBy + join). A missed hot digest only costs time,
never correctness.

Defined cases: null text = empty text; all empty or blank texts form one
group; a null id can stay only if no other id ties; repeated rows of one id
count as rows of the group and exactly one is kept; extra columns are
ignored; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, ship, tidy

SPACE = r"[\x20\x09-\x0D]+"


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, digest, row_no) per row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.length(text).cast("long").alias("n_chars"),
                     F.sha2(F.regexp_replace(text, SPACE, ""), 256).alias("digest"),
                     F.monotonically_increasing_id().alias("row_no"))


def misra_gries(counters: int):
    """Arrow batches of digests -> the partition's Misra-Gries summary."""
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for v in batch.column(0).value_counts().to_pylist():
                held[v["values"]] = held.get(v["values"], 0) + v["counts"]
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {k: n - cut for k, n in held.items() if n > cut}
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(held), pa.string()),
                                          "at_least": pa.array(list(held.values()), pa.int64())})
    return summarise


def keep_best(df: DataFrame) -> DataFrame:
    """One row per digest: the row that stays and the group's size."""
    best = F.max(F.struct("n_chars", F.col("id").isNotNull().alias("known"), (-F.col("id")).alias("neg"),
                          (-F.col("row_no")).alias("neg_row"))).alias("best")
    return (df.groupBy("digest").agg(best, F.count("*").alias("group_size"))
            .select("digest", (-F.col("best.neg")).alias("keep_id"), (-F.col("best.neg_row")).alias("keep_row"),
                    "group_size"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """Every row with its digest, the id of the row that stays, the size of
    its group and whether it stays itself."""
    rows = saved(digests(df, id_col, text_col), "exact-digests")
    frequent = (rows.select("digest").mapInArrow(tidy(misra_gries(counters)), "digest string, at_least long")
                .groupBy("digest").agg(F.sum("at_least").alias("at_least")).filter("at_least > 1")
                .orderBy(F.desc("at_least"), "digest").limit(counters).select("digest"))
    # at most ``counters`` rows: bounded, so a broadcast is safe
    frequent = saved(frequent, "exact-frequent")
    hot = rows.join(F.broadcast(frequent), "digest", "left_semi")
    winners = saved(keep_best(hot), "exact-winners")
    cold = rows.join(F.broadcast(frequent), "digest", "left_anti")
    decided = (rows.join(F.broadcast(winners), "digest")
               .unionByName(cold.join(keep_best(cold), "digest")))
    return decided.select(F.col("id").alias(id_col), "n_chars", "digest", "keep_id", "group_size",
                          (F.col("row_no") == F.col("keep_row")).alias("kept"))


ship(__name__)
