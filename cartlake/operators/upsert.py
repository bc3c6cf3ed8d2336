"""Append-only change logs compacted into current state.

Parquet tables accept no MERGE/UPDATE/DELETE, so every mutable store
(chats, messages, votes, memories) is an append-only log of operations with
a monotonically increasing ``seq``. Compaction is one ``groupBy(key)`` with
``max_by`` / ``min_by`` aggregates: these are partial aggregates, so a hot
key is combined map-side and only one small state per key and partition is
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_by_op(field: str, seq: str, ops: Column) -> Column:
    """Value of ``field`` written by the latest log row for which ``ops`` is
    true (a null value written later wins over an older non-null)."""
    return F.max_by(F.col(field), F.when(ops, F.col(seq))).alias(field)


def last_write(field: str, seq: str = "seq") -> Column:
    return F.max_by(F.col(field), F.col(seq)).alias(field)


def latest(log: DataFrame, keys: list[str], fields: list[str], seq: str = "seq") -> DataFrame:
    """Last-writer-wins row per key (whole row, by highest seq)."""
    return log.groupBy(*keys).agg(*[last_write(f, seq) for f in fields], F.max(seq).alias(seq))


def alive(op: str = "op", seq: str = "seq", insert=("insert",), delete=("delete",)) -> Column:
    """True when the latest insert is newer than the latest delete."""
    last_ins = F.max(F.when(F.col(op).isin(*insert), F.col(seq)))
    last_del = F.max(F.when(F.col(op).isin(*delete), F.col(seq)))
    return (last_ins.isNotNull() & (last_del.isNull() | (last_ins > last_del))).alias("alive")
