"""Approximate top-k by an inverted-file index: every row belongs to the list
of its nearest coarse centroid and keeps its residual as product-quantised
codes (one byte a sub-vector); a query looks into the lists nearest to it,
ranks their rows by codes, and the best are ranked again by exact cosine.

Centroids and codebooks are fitted on a bounded sample (``SAMPLE`` rows, those
with the smallest id hash); every row is indexed. How many lists to probe and
how many rows to rank again is measured on the sample, as the least that finds
``target`` of the exact neighbours there; clustered vectors need few lists,
vectors without structure many. Rows and queries of a list meet in bounded
cells (functions/vectors.py), so a crowded list is many cells."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import cosine, money
from ..functions.vectors import cells, matrix, unit

SAMPLE = 20_000
CODES = 256
ASKED = 200            # rows of the sample whose neighbours are measured


@dataclass
class Model:
    centroids: np.ndarray      # lists x dim, of unit vectors
    codebooks: np.ndarray      # sub-vectors x codes x sub-dim, of residuals
    probes: int
    rerank: int

    def lists(self, m: np.ndarray) -> np.ndarray:
        """The nearest list of each unit vector."""
        return near(m, self.centroids)

    def codes(self, m: np.ndarray, own: np.ndarray) -> np.ndarray:
        parts = split(m - self.centroids[own], len(self.codebooks))
        return np.stack([near(p, book) for p, book in zip(parts, self.codebooks)], 1).astype(np.uint8)

    def approximate(self, queries: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """Estimated cosines of queries with the rows of one list, by codes."""
        score = np.repeat((queries @ self.centroids[own])[:, None], len(codes), 1)
        for part, book, code in zip(split(queries, len(self.codebooks)), self.codebooks, codes.T):
            score += (part @ book.T)[:, code]
        return score

    def nearest_lists(self, queries: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(queries @ self.centroids.T), 1, kind="stable")[:, :n]


def split(m: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.array_split(m, parts, 1)


def near(m: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers * centers).sum(1) - 2 * (m @ centers.T), 1)


def k_means(m: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from the first k rows (the sample is in hash order); an
    empty center stays where it is."""
    centers = m[:k].copy()
    for _ in range(rounds):
        own = near(m, centers)
        n = np.bincount(own, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, own, m)
        centers = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers)
    return centers


def fit(index: DataFrame, id_col: str = "chunk_id", k: int = 5, parts: int = 16, target: float = 0.95,
        lists: int | None = None, sample: int = SAMPLE) -> Model:
    """``lists`` is about the square root of the number of rows if not given,
    as far as the sample can place centroids."""
    rows = index.filter("embedding IS NOT NULL")
    n = rows.count()
    some = rows.select("embedding", F.xxhash64(id_col).alias("h"), id_col).orderBy("h", id_col).limit(sample).toArrow()
    m = unit(matrix(some.column("embedding")))
    lists = max(1, min(lists or round(n ** 0.5), len(m) // 16))
    centroids = k_means(m, lists) if len(m) else np.zeros((1, 1))
    residual = m - centroids[near(m, centroids)] if len(m) else m
    width = max([p.shape[1] for p in split(residual, parts)], default=1) if len(m) else 1
    books = np.zeros((parts, min(CODES, max(len(m), 1)), width))
    for at, p in enumerate(split(residual, parts) if len(m) else []):
        books[at, :, :p.shape[1]] = k_means(p, books.shape[1])
    model = Model(centroids, [b[:, :p.shape[1]] for b, p in zip(books, split(residual, parts))] if len(m) else [], lists, k)
    return calibrate(model, m, k, target, n)


def calibrate(model: Model, m: np.ndarray, k: int, target: float, n: int) -> Model:
    """The least probes that reach ``target`` of the exact neighbours of some
    rows of the sample, and the least rows to rank again (their number grows
    with the rows that are not in the sample)."""
    if len(m) <= k:
        return model
    asked = m[:: max(1, len(m) // ASKED)][:ASKED]
    exact = np.argsort(-(asked @ m.T), 1, kind="stable")[:, :k]
    own = model.lists(m)
    place = np.argsort(model.nearest_lists(asked, len(model.centroids)), 1)       # of each list in the order of a query
    depth = np.sort(np.take_along_axis(place, own[exact], 1).ravel())
    # half of what may be missed goes to the lists, half to the ranking
    share = lambda x: int(x[min(len(x) - 1, int(np.ceil((1 + target) / 2 * len(x))) - 1)])       # noqa: E731
    probes = share(depth) + 1
    score = np.full((len(asked), len(m)), -np.inf)
    codes = model.codes(m, own)
    for one in range(len(model.centroids)):
        rows, who = np.flatnonzero(own == one), np.flatnonzero(place[:, one] < probes)
        if len(rows) and len(who):
            score[np.ix_(who, rows)] = model.approximate(asked[who], one, codes[rows])
    rank = np.sort((score[:, None, :] > np.take_along_axis(score, exact, 1)[:, :, None]).sum(2).ravel())
    model.probes, model.rerank = probes, int(np.ceil((share(rank) + 1) * max(1.0, n / len(m))))
    return model


def assigned(index: DataFrame, model: Model, id_col: str = "chunk_id") -> DataFrame:
    """(id, list, code) of every row: the index proper. One scan."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = unit(matrix(batch.column(1)))
                own = model.lists(m)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in model.codes(m, own)], pa.binary())],
                    [id_col, "list", "code"])
    rows = index.filter("embedding IS NOT NULL").select(id_col, "embedding")
    return rows.mapInArrow(run, f"`{id_col}` {dict(index.dtypes)[id_col]}, list int, code binary")


def probed(queries: DataFrame, model: Model) -> DataFrame:
    """A row a query and list it looks into."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = model.nearest_lists(unit(matrix(batch.column(1))), model.probes)
                at = pa.array(np.repeat(np.arange(batch.num_rows), found.shape[1]))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in (0, 1)), pa.array(found.ravel().astype(np.int32))],
                                                 ["query_id", "embedding", "list"])
    rows = queries.filter("embedding IS NOT NULL").select("query_id", "embedding")
    types = dict(queries.dtypes)
    return rows.mapInArrow(run, f"query_id {types['query_id']}, embedding {types['embedding']}, list int")


def ranked_by_codes(model: Model, id_col: str):
    """A cell: rows of one list against queries that look into it."""
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        if not index.num_rows or not queries.num_rows:
            empty = [queries.column("query_id").slice(0, 0), index.column(id_col).slice(0, 0), pa.array([], pa.float64())]
            return pa.Table.from_arrays(empty, ["query_id", id_col, "estimate"])
        own = index.column("list")[0].as_py()
        codes = np.frombuffer(b"".join(index.column("code").to_pylist()), np.uint8).reshape(index.num_rows, -1)
        asked, parts = unit(matrix(queries.column("embedding"))), []
        for at in range(0, len(asked), max(1, (1 << 22) // len(codes))):
            score = model.approximate(asked[at:at + max(1, (1 << 22) // len(codes))], own, codes)
            take = np.argpartition(-score, model.rerank - 1, 1)[:, :model.rerank] if model.rerank < len(codes) else \
                np.tile(np.arange(len(codes)), (len(score), 1))
            who = np.repeat(np.arange(len(score)), take.shape[1])
            parts.append(pa.Table.from_arrays([queries.column("query_id").take(pa.array(who + at)), index.column(id_col).take(pa.array(take.ravel())),
                                               pa.array(score[who, take.ravel()])], ["query_id", id_col, "estimate"]))
        return pa.concat_tables(parts)
    return run


def candidates(lists: DataFrame, queries: DataFrame, model: Model, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id) of the ``rerank`` rows that a query's lists rank first."""
    rows, asked, keys = cells(lists, probed(queries, model), ["list"], id_col)
    types = dict(rows.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        ranked_by_codes(model, id_col), f"query_id {types['query_id']}, `{id_col}` {types[id_col]}, estimate double")
    w = Window.partitionBy("query_id").orderBy(F.desc("estimate"), id_col)
    return found.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= model.rerank).select("query_id", id_col)


def search(index: DataFrame, lists: DataFrame, queries: DataFrame, model: Model, k: int = 5, id_col: str = "chunk_id") -> DataFrame:
    """The k best of the candidates by exact cosine (to 6 decimals, ties by id),
    with the index's other columns and the rank."""
    asked = queries.select("query_id", F.col("embedding").alias("q_emb"))
    scored = (candidates(lists, queries, model, id_col).join(index, id_col).join(asked, "query_id")
              .select("query_id", *[c for c in index.columns if c != "embedding"],
                      money(cosine(F.col("embedding"), F.col("q_emb")), 6).alias("score")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
