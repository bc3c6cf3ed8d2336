"""Exact running counts / ranks without one task per (hot) group.

``offsets`` gives every row the sum of one or several columns over the rows
that come strictly before it in (``partition``, ``order``) order - an
exclusive prefix sum, i.e. a rank when the column is 1. A plain window
partitioned by the group would sort a hot group (say a third of all rows) in
one task; here rows are cut into nested blocks of consecutive order
positions. Block totals are small aggregates, one level built from the one
below; each level's prefix sum runs inside its parent block only, so no
window holds more than one block's children, whatever the size of the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STEP = 12          # bits of a numeric key per level: 4096 children per block
LEVELS = 4         # levels of a numeric key: one top block spans 2^48 keys


def number_blocks(c: Column, levels: int = LEVELS) -> list[Column]:
    """Nested blocks of a non-negative integer key, coarsest first."""
    return [F.shiftright(c.cast("long"), STEP * k) for k in range(levels, 0, -1)]


def offsets(df: DataFrame, sums: dict[str, str], order: list[Column], blocks: list[Column],
            partition: list[str] | None = None) -> DataFrame:
    """``df`` with, for every ``sums`` entry (column -> new column), the sum
    over the rows before. ``order`` is ascending and unique within a
    partition; ``blocks`` are expressions, coarsest first, that sort like a
    prefix of ``order``."""
    partition = partition or []
    names = [f"_b{i}" for i in range(len(blocks))]
    d = df.select("*", *[c.alias(n) for c, n in zip(blocks, names)])
    inner = Window.partitionBy(*partition, *names).orderBy(*order)
    d = d.select("*", *[(F.sum(c).over(inner) - F.col(c)).alias(f"_in_{c}") for c in sums])
    totals = [df.select(*partition, *sums, *[c.alias(n) for c, n in zip(blocks, names)])
              .groupBy(*partition, *names).agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])]
    for depth in range(len(names) - 1, 0, -1):
        totals.insert(0, totals[0].groupBy(*partition, *names[:depth])
                      .agg(*[F.sum(f"_sum_{c}").alias(f"_sum_{c}") for c in sums]))
    before = None
    for depth, t in enumerate(totals):
        # without a partition the top blocks (2^48 keys each, so a row or two) hang under one common parent
        parent = [*partition, *names[:depth]] or [F.shiftright(names[0], 62)]
        w = Window.partitionBy(*parent).orderBy(names[depth])
        t = t.select(*partition, *names[:depth + 1],
                     *[(F.sum(f"_sum_{c}").over(w) - F.col(f"_sum_{c}")).alias(f"_off_{c}") for c in sums])
        if before is None:
            before = t
            continue
        up = before.select(*partition, *names[:depth], *[F.col(f"_off_{c}").alias(f"_up_{c}") for c in sums])
        before = t.join(up, [*partition, *names[:depth]]).select(
            *partition, *names[:depth + 1], *[(F.col(f"_off_{c}") + F.col(f"_up_{c}")).alias(f"_off_{c}") for c in sums])
    d = d.join(before, [*partition, *names])
    for c, out in sums.items():
        d = d.withColumn(out, F.col(f"_off_{c}") + F.col(f"_in_{c}"))
    return d.drop(*names, *[f"_in_{c}" for c in sums], *[f"_off_{c}" for c in sums])


def rank_within(df: DataFrame, partition: list[str], order: list[Column], blocks: list[Column],
                out: str = "rank") -> DataFrame:
    """1-based row_number inside ``partition`` by ``order`` (unique): a hot
    partition is ranked by many tasks."""
    r = offsets(df.withColumn("_one", F.lit(1)), {"_one": out}, order, blocks, partition)
    return r.withColumn(out, (F.col(out) + 1).cast("long")).drop("_one")


def time_blocks(ts: Column, descending: bool = False) -> list[Column]:
    """Block keys (day, hour, second of the hour) of a TIMESTAMP_NTZ; they
    sort like the timestamp (or its reverse), with no time-zone conversion. A
    window holds the active days of a key, the hours of a day, the seconds of
    an hour or the rows of a second."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01"))
    keys = [day, F.hour(ts), F.minute(ts) * 60 + F.second(ts)]
    return [-k for k in keys] if descending else keys
