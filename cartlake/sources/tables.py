"""Driver tables and the adapters that give them the retail / chat shape.

Every adapter is a narrow projection (plus at most a join against the
25-row nation / 5-row region dimensions), so it adds no shuffle of its own
and Catalyst prunes the parquet scan to the columns the caller uses.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

EPOCH = "2024-01-01 00:00:00"


def ts_ntz(text: str) -> Column:
    """A timestamp_ntz literal (the driver tables are timestamp_ntz)."""
    return F.to_timestamp_ntz(F.lit(text))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Tables:
    """Lazy accessor: ``Tables(spark, dir).lineitem`` is a parquet scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return read(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def _case(col: Column, mapping: dict, default) -> Column:
    items = list(mapping.items())
    expr = F.when(col == items[0][0], F.lit(items[0][1]))
    for k, v in items[1:]:
        expr = expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def geography(t: Tables) -> DataFrame:
    """Nation and region names by nation key. Nation (25 rows) and region (5
    rows) are fixed-size TPC-H dimensions: broadcasting them is bounded by
    construction."""
    n, r = t.nation, t.region
    return F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name"))


def customers(t: Tables, place: bool = True) -> DataFrame:
    """``place=False`` leaves out city and state, and the joins they need."""
    c, k = t.customer, F.col("c_custkey")
    tier = (F.when(F.col("c_acctbal") < 3500, "Bronze").when(F.col("c_acctbal") < 6500, "Silver")
            .when(F.col("c_acctbal") < 8500, "Gold").otherwise("Platinum"))
    prefs = F.concat(
        F.lit('{"dietary":["d'), (k % 3).cast("string"), F.lit('"],"favorite_categories":["'),
        _case(k % 3, {0: "ECONOMY", 1: "PROMO"}, "SMALL"), F.lit('"],"organic_preference":'),
        F.when(k % 2 == 0, "true").otherwise("false"), F.lit("}"))
    cols = [k.alias("customer_id"), F.col("c_name").alias("name"), tier.alias("membership_tier"),
            prefs.alias("preferences")]
    if not place:
        return c.select(*cols)
    geo = geography(t)
    return (c.join(geo, c.c_nationkey == geo.n_nationkey)
            .select(*cols[:2], F.col("n_name").alias("city"), F.col("r_name").alias("state"), *cols[2:]))


def products(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"), ((F.col("p_size") * 7) % 50).alias("stock_quantity"))


PAYMENT_BY_PRIORITY = {"1-URGENT": "credit_card", "2-HIGH": "debit_card", "3-MEDIUM": "cash",
                       "5-LOW": "gift_card"}
STATUS_BY_CODE = {"F": "completed", "P": "refunded"}


def transactions(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("customer_id"),
        (F.col("o_orderkey") % t.supplier.agg(F.count(F.lit(1))).scalar()).alias("store_id"), F.col("o_orderdate").alias("transaction_date"),
        F.col("o_totalprice").alias("total_amount"),
        _case(F.col("o_orderpriority"), PAYMENT_BY_PRIORITY, "mobile_pay").alias("payment_method"),
        _case(F.col("o_orderstatus"), STATUS_BY_CODE, "pending").alias("status"))


def transaction_items(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("transaction_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("supplier_id"), F.col("l_linenumber").alias("line_number"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("discount"))


def stores(t: Tables, place: bool = True) -> DataFrame:
    """``place=False`` leaves out city and state, and the joins they need."""
    s = t.supplier
    ident = [F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("name")]
    hours = F.when(F.col("s_suppkey") % 2 == 0, "07:00-22:00").otherwise("08:00-21:00").alias("hours")
    if not place:
        return s.select(*ident, hours)
    geo = geography(t)
    return (s.join(geo, s.s_nationkey == geo.n_nationkey)
            .select(*ident, F.col("n_name").alias("city"), F.col("r_name").alias("state"), hours))


def payment_history(t: Tables) -> DataFrame:
    return transactions(t).select("customer_id", "payment_method").distinct()


def message_id_of(conv: Column, turn: Column) -> Column:
    """One number per (conversation, turn): 20 bits for the turn."""
    return conv * (1 << 20) + turn


def _day_offset(days: Column, minutes: Column | None = None) -> Column:
    """A time in the ten years from EPOCH on: any key maps to a valid day."""
    ts = ts_ntz(EPOCH) + F.make_dt_interval(F.pmod(days, F.lit(3650)).cast("int"))
    if minutes is not None:
        ts = ts + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))
    return ts


def chat(t: Tables) -> DataFrame:
    return (t.conversations.select("conv_id").distinct()
            .select(F.col("conv_id").alias("id"), _day_offset(F.col("conv_id")).alias("created_at"),
                    F.expr("conv_id div 10").alias("user_id"),
                    F.when(F.col("conv_id") % 4 == 0, "public").otherwise("private").alias("visibility")))


def message(t: Tables) -> DataFrame:
    cv = t.conversations
    return cv.select(
        message_id_of(F.col("conv_id"), F.col("turn")).alias("id"), F.col("conv_id").alias("chat_id"), "role", "text",
        _day_offset(F.col("conv_id"), F.col("turn")).alias("created_at"),
        F.when(F.col("turn") % 3 == 2, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("tr-"), F.col("conv_id").cast("string"), F.lit("-"),
                            F.col("turn").cast("string"))).alias("trace_id"))


def vote_log(t: Tables) -> DataFrame:
    a = t.conversations.filter(F.col("role") == "assistant")
    mid = message_id_of(F.col("conv_id"), F.col("turn")).alias("message_id")
    first = a.select(mid, F.col("conv_id").alias("chat_id"), F.lit(1).alias("seq"),
                     ((F.col("conv_id") + F.col("turn")) % 2 == 0).alias("is_up"))
    second = a.filter(F.col("conv_id") % 3 == 0).select(
        mid, F.col("conv_id").alias("chat_id"), F.lit(2).alias("seq"),
        ((F.col("conv_id") + F.col("turn")) % 2 != 0).alias("is_up"))
    return first.unionByName(second)


def memory_log(t: Tables) -> DataFrame:
    e = t.events
    kind = _case(F.col("event_type"), {"view": "user_memories", "click": "task_summaries"}, "conversation_summaries")
    return e.select(F.col("event_id").alias("seq"), kind.alias("ns_kind"), F.col("user_id").alias("ns_user"),
                    F.substring(F.md5("props"), 1, 2).alias("mem_key"), F.col("props").alias("value"),
                    (F.col("event_type") == "error").alias("is_delete"))


def spans(t: Tables) -> DataFrame:
    e = t.events
    name = _case(F.col("event_type"), {"view": "sql_query", "purchase": "get_user_memory",
                                       "signup": "get_current_time"}, "policy_search")
    stype = _case(F.col("event_type"), {"signup": "LLM", "click": "RETRIEVER"}, "TOOL")
    return e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("ts").cast("date").cast("string")).alias("trace_id"),
        F.col("event_id").alias("span_id"), name.alias("name"), stype.alias("span_type"),
        F.col("ts").alias("start_time"), F.col("value").alias("duration_ms"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("OK").alias("status"))


def stream_chunk(t: Tables) -> DataFrame:
    from ..plans.numbering import rank_within, time_blocks
    # The sequence number is per stream (user), a blocked rank so one busy
    # stream is numbered by many tasks.
    e = rank_within(t.events.select("user_id", "event_id", "ts", "event_type", "props"), ["user_id"],
                    [F.col("ts"), F.col("event_id")], time_blocks(F.col("ts")), out="seq1")
    typ = _case(F.col("event_type"), {"signup": "text-start", "purchase": "finish", "error": "error"}, "text-delta")
    return e.select(F.col("user_id").alias("stream_id"), (F.col("seq1") - 1).alias("seq"), "ts",
                    typ.alias("type"), F.col("props").alias("delta"))


# payloads that a JSON reader takes as false, and near misses
ODD_PAYLOADS = ["null", "0", "-0", "0.0", "0.00", "0e0", "-0.0", '""', "false", "true", '"0"', '"false"', "[]", "{}", "1e-9", " 0 "]


def sse_line(t: Tables) -> DataFrame:
    e, k = t.events, F.col("event_id")
    line = (F.when(k % 10 == 0, "data: [DONE]").when(k % 7 == 0, "data: {").when(k % 11 == 0, ": ping")
            .when(k % 13 == 0, F.element_at(F.array(*[F.lit(f"data: {x}") for x in ODD_PAYLOADS]),
                                            (k % len(ODD_PAYLOADS) + 1).cast("int")))
            .otherwise(F.concat(F.lit("data: "), F.col("props"))))
    return e.select("event_id", line.alias("line"))


def union_all(dfs):
    return reduce(lambda a, b: a.unionByName(b), dfs)
