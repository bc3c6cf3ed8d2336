"""Trace and span monitoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import money
from ..functions.quantiles import exact_percentiles


def trace_status(spans: DataFrame) -> DataFrame:
    """One row per trace: ERROR when any span failed, else OK."""
    return spans.groupBy("trace_id").agg(
        F.when(F.bool_or(F.col("status") == "ERROR"), "ERROR").otherwise("OK").alias("status"),
        F.count(F.lit(1)).alias("n_spans"), F.min("start_time").alias("start_time"))


def ok(spans: DataFrame) -> DataFrame:
    return trace_status(spans).filter(F.col("status") == "OK")


def by_type(spans: DataFrame, span_type: str) -> DataFrame:
    """Spans of one type per trace; the name set is bounded by the number of
    distinct span names."""
    return (spans.filter(F.col("span_type") == span_type).groupBy("trace_id")
            .agg(F.count(F.lit(1)).alias("n_spans"),
                 F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names")))


def sessions(trace_meta: DataFrame) -> DataFrame:
    """The session id and then the thread id are written to the same
    metadata key, so the thread id wins whenever there is one."""
    key = F.coalesce(F.col("thread_id"), F.col("session_id"))
    return (trace_meta.withColumn("session", key).groupBy("session")
            .agg(F.count(F.lit(1)).alias("n_traces"), F.min("start_time").alias("first_start")))


def latency_errors(spans: DataFrame, every: str = "1 day", exact: bool = False) -> DataFrame:
    """Latency percentiles and error rate per time window, by the bounded
    percentile_approx sketch (rank error 1/10000). ``exact`` asks for the
    exact interpolated percentiles, found by a second scan between brackets
    of the sketch (functions/quantiles.py)."""
    rows = spans.select(F.window("start_time", every)["start"].alias("window_start"), "duration_ms", "status")
    rate = money(F.avg(F.when(F.col("status") == "ERROR", 1.0).otherwise(0.0)), 6).alias("error_rate")
    count = F.count(F.lit(1)).alias("n_spans")
    if exact:
        found = exact_percentiles(rows, ["window_start"], "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
        out = rows.groupBy("window_start").agg(count, rate).join(found.drop("n"), "window_start", "left")
        return out.select("window_start", "n_spans", money(F.col("p50_ms"), 6).alias("p50_ms"),
                          money(F.col("p95_ms"), 6).alias("p95_ms"), "error_rate")
    pct = lambda p: money(F.percentile_approx("duration_ms", F.lit(p), 10000), 6)      # noqa: E731
    return rows.groupBy("window_start").agg(count, pct(0.5).alias("p50_ms"), pct(0.95).alias("p95_ms"), rate)


def token_usage(usage: DataFrame) -> DataFrame:
    """Stored usage (user_id, chat_id, input_tokens, output_tokens; chats
    without one count as 0) by user and chat with ROLLUP subtotals."""
    return usage.rollup("user_id", "chat_id").agg(
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.grouping_id().cast("int").alias("level"))


def tool_usage(spans: DataFrame) -> DataFrame:
    t = spans.filter(F.col("span_type") == "TOOL")
    return t.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_calls"),
                                     F.count_distinct("name").alias("n_tools"),
                                     F.array_join(F.array_sort(F.collect_set("name")), ",").alias("tools"))
