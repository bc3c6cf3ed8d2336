"""Vectors: token counts as sparse vectors, and exact top-k by cosine
similarity as a block schedule of matrix products.

Top-k: index rows and queries are both dealt into blocks of bounded size by
counts taken first (per ``within`` group, so a hot group gets more blocks), a
cell of the schedule is one index block with one query block, and every cell
gives the k best rows of its queries. Nothing goes through the driver but the
two counts of an ungrouped search, and the plan is the same for any number of
queries."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INDEX_BLOCK, QUERY_BLOCK = 8192, 4096        # rows of a cell at about this size
SCORES = 1 << 22                             # scores a cell holds at once

SPARSE = "struct<spots: array<int>, weights: array<float>>"


def token_vector(tokens: Column, dim: int) -> Column:
    """Unit vector of the tokens' counts by md5 bucket, as the buckets that
    occur (ascending) and their weights: native, no Python worker."""
    bucket = F.sort_array(F.transform(
        tokens, lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dim).cast("int")))
    # a bucket's count is the distance between the starts of its rows in sorted order
    def counted(b):
        places = F.sequence(F.lit(1), F.size(b))
        starts = F.filter(places, lambda i: (i == 1) | (F.get(b, i - 1) != F.get(b, i - 2)))
        return _let(F.when(F.size(b) > 0, starts).otherwise(F.array().cast("array<int>")), lambda at: F.struct(
            F.transform(at, lambda i: F.get(b, i - 1)).alias("spots"),
            F.transform(at, lambda i, k: (F.coalesce(F.get(at, k + 1), F.size(b) + 1) - i).cast("double")).alias("n")))

    def weighed(c):
        norm = F.sqrt(F.aggregate(c["n"], F.lit(0.0), lambda a, x: a + x * x))
        return _let(norm, lambda m: F.struct(c["spots"].alias("spots"),
                                             F.transform(c["n"], lambda x: (x / m).cast("float")).alias("weights")))

    return _let(_let(bucket, counted), weighed)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row."""
    return F.get(F.transform(F.array(value), body), 0)


def dense(vector: Column, dim: int) -> Column:
    """The sparse vector as ARRAY<FLOAT> of ``dim`` values, for a product."""
    def filled(v):
        weight = F.map_from_arrays(v["spots"], v["weights"])
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(weight[i], F.lit(0.0).cast("float")))
    return F.when(vector.isNotNull(), _let(vector, filled))


def matrix(rows: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix of doubles, one row each."""
    flat = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1 if len(flat) else 0)


def unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(n > 0, n, 1)


def best_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of the k best rows of every query (a column of scores);
    of equal scores the first."""
    if len(scores) <= k:
        return np.tile(np.arange(len(scores)), scores.shape[1]), np.repeat(np.arange(scores.shape[1]), len(scores))
    edge = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
    row, query = np.nonzero(scores >= edge)
    order = np.lexsort((row, -scores[row, query], query))
    row, query = row[order], query[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return row[place < k], query[place < k]


def cell(k: int, names: list[str]):
    """One index block against one query block."""
    def table(query_id, score, rows):
        return pa.Table.from_arrays([query_id, pa.array(score, pa.float64()), *rows.columns], ["query_id", "score", *names])

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        if not index.num_rows or not queries.num_rows:
            return table(queries.column("query_id").slice(0, 0), [], index.select(names).slice(0, 0))
        index = index.sort_by(names[0])
        rows, asked = unit(matrix(index.column("embedding"))), unit(matrix(queries.column("embedding")))
        step, parts = max(1, SCORES // len(rows)), []
        for at in range(0, len(asked), step):
            score = np.floor(rows @ asked[at:at + step].T * 1e6 + 0.5) / 1e6
            row, query = best_rows(score, k)
            parts.append(table(queries.column("query_id").take(pa.array(query + at)), score[row, query],
                               index.select(names).take(pa.array(row))))
        return pa.concat_tables(parts)
    return run


def block_counts(rows: DataFrame, asked: DataFrame, within: list[str]) -> DataFrame:
    """Per group that both sides have: how many blocks its rows and its
    queries need. One aggregation over keys only."""
    sides = rows.select(*within, F.lit(1).alias("r"), F.lit(0).alias("a")).unionByName(
        asked.select(*within, F.lit(0).alias("r"), F.lit(1).alias("a")))
    n = lambda c, size: F.ceil(F.coalesce(F.sum(c), F.lit(0)) / size).cast("int")      # noqa: E731
    return sides.groupBy(*within).agg(n("r", INDEX_BLOCK).alias("_rows"), n("a", QUERY_BLOCK).alias("_asked"))


def cells(rows: DataFrame, asked: DataFrame, within: list[str], id_col: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides dealt into blocks, and the keys of a cell: one block of
    either side of one group. Rows go to all query blocks of their group,
    queries to all its index blocks."""
    counts = block_counts(rows, asked, within)
    if within:
        rows, asked = rows.join(counts, within), asked.join(counts, within)
    else:
        n = counts.first()
        rows, asked = (x.withColumns({"_rows": F.lit(n["_rows"]), "_asked": F.lit(n["_asked"])}) for x in (rows, asked))
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))                                   # noqa: E731
    deal = lambda key, c: F.pmod(F.xxhash64(key), F.greatest(F.col(c), F.lit(1))).cast("int")          # noqa: E731
    rows = rows.filter("_rows > 0 AND _asked > 0").withColumn("_i", deal(id_col, "_rows")).withColumn("_j", spread("_asked"))
    asked = asked.filter("_rows > 0 AND _asked > 0").withColumn("_j", deal("query_id", "_asked")).withColumn("_i", spread("_rows"))
    return rows.drop("_rows", "_asked"), asked.drop("_rows", "_asked"), [*within, "_i", "_j"]


def top_matches(index: DataFrame, queries: DataFrame, k: int, id_col: str, within: list[str] = (),
                carry: list[str] = ()) -> DataFrame:
    """The k nearest index rows of every query (score to 6 decimals, ties by
    id), among rows equal in the ``within`` columns; null vectors take no part."""
    within, names = list(within), [id_col, *within, *carry]
    rows, asked, keys = cells(index.select("embedding", *names).filter("embedding IS NOT NULL"),
                              queries.select("query_id", "embedding", *within).filter("embedding IS NOT NULL"), within, id_col)
    types = dict(asked.dtypes) | dict(rows.dtypes) | {"score": "double"}
    shape = ", ".join(f"`{c}` {types[c]}" for c in ["query_id", "score", *names])
    best = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(cell(k, names), shape)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return (best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("long")))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
