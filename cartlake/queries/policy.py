"""Policy rule (POL) bindings over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import policy as P
from ..sources import tables as T
from ..sources.tables import Tables, ts_ntz
from .views import with_views as W

Q = {}
NOW = "2026-06-30 00:00:00"
# Example recall notices (our rule rows: product name, purchase window).
RECALLS = [(1, "red plate", "1998-01-01", "1998-04-01"), (2, "small widget", "1996-06-01", "1996-07-01"),
           (3, "hot ring", "2000-01-01", "2000-12-31")]
CLASS_BY_TYPE = {"ECONOMY": "general", "STANDARD": "general", "PROMO": "fresh", "SMALL": "fresh",
                 "MEDIUM": "frozen", "LARGE": "frozen"}


def reg(name, sql=None, views=()):
    def deco(fn):
        Q[name] = (fn, W(sql, *views) if sql else None)
        return fn
    return deco


def _t(s, d):
    return Tables(s, d)


def values_sql(rows, cols) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) v({', '.join(cols)}))"


def rule_sql(name: str) -> str:
    rows, schema = P.RULE_SCHEMAS[name]
    cols = [c.strip().split(" ")[0] for c in schema.split(",")]
    return values_sql(rows, cols)


def returns(t):
    li, o, p = t.lineitem, t.orders, t.part
    cls = F.when(F.col("p_type").isin("ECONOMY", "STANDARD"), "general").when(F.col("p_type").isin("PROMO", "SMALL"), "fresh") \
        .otherwise("frozen")
    return (li.filter(F.col("l_returnflag") == "R")
            .join(o.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"), li.l_orderkey == o.o_orderkey)
            .join(p.select("p_partkey", "p_type"), li.l_partkey == p.p_partkey)
            .select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("return_id"),
                    F.col("o_custkey").alias("customer_id"), cls.alias("product_class"),
                    F.col("o_orderdate").alias("purchased_at"), F.col("l_shipdate").alias("returned_at"),
                    (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
                    (F.col("l_linenumber") % 2 == 0).alias("has_receipt"),
                    T._case(F.col("o_orderpriority"), T.PAYMENT_BY_PRIORITY, "mobile_pay").alias("payment_method")))


RETURNS_SQL = """ret AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS return_id, o_custkey AS customer_id,
  CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'general' WHEN p_type IN ('PROMO', 'SMALL') THEN 'fresh' ELSE 'frozen' END AS product_class,
  o_orderdate AS purchased_at, l_shipdate AS returned_at, l_extendedprice * (1 - l_discount) AS amount, l_linenumber % 2 = 0 AS has_receipt,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'credit_card' WHEN '2-HIGH' THEN 'debit_card' WHEN '3-MEDIUM' THEN 'cash'
    WHEN '5-LOW' THEN 'gift_card' ELSE 'mobile_pay' END AS payment_method
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R')"""

POINTS_SQL = f"""pts AS (SELECT t.transaction_id, t.customer_id, t.transaction_date, c.membership_tier,
  floor(t.total_amount / 100) * r.rate AS points
  FROM transactions t JOIN customers c USING (customer_id) JOIN {rule_sql('TIER_RULES')} r ON r.tier = c.membership_tier)"""


def points(t):
    return P.points_earned(T.transactions(t), T.customers(t, place=False), P.rules(t.spark, "TIER_RULES"))


@reg("pol_points_earned", f"WITH {POINTS_SQL} SELECT * FROM pts", ("customers", "transactions"))
def q_points(s, d):
    return points(_t(s, d))


@reg("pol_quarterly_tier", f"""WITH q AS (SELECT customer_id, CAST(date_trunc('quarter', transaction_date) AS DATE) AS quarter, total_amount FROM transactions),
sp AS (SELECT customer_id, quarter, sum(total_amount) AS spend FROM q GROUP BY ALL),
span AS (SELECT customer_id, min(quarter) AS q0, max(quarter) AS q1 FROM sp GROUP BY customer_id),
spine AS (SELECT customer_id, CAST(unnest(generate_series(q0, q1, INTERVAL 3 MONTH)) AS DATE) AS quarter FROM span),
s AS (SELECT spine.customer_id, spine.quarter, coalesce(sp.spend, 0.0) AS spend FROM spine LEFT JOIN sp USING (customer_id, quarter)),
r AS (SELECT s.customer_id, s.quarter, s.spend, max(rl.level) AS reached FROM s JOIN {rule_sql('TIER_RULES')} rl ON s.spend >= rl.min_quarter_spend
  GROUP BY ALL),
e AS (SELECT *, max(reached) OVER (PARTITION BY customer_id ORDER BY quarter ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS effective FROM r)
SELECT e.customer_id, e.quarter, floor(e.spend * 100 + 0.5) / 100 AS spend, e.reached, e.effective, rl.tier
FROM e JOIN {rule_sql('TIER_RULES')} rl ON rl.level = e.effective""", ("transactions",))
def q_quarterly(s, d):
    t = _t(s, d)
    return P.quarterly_tier(T.transactions(t), P.rules(s, "TIER_RULES"))


@reg("pol_points_expiry", f"""WITH {POINTS_SQL},
p AS (SELECT *, CASE WHEN lag(transaction_date) OVER w IS NOT NULL AND transaction_date > lag(transaction_date) OVER w + INTERVAL 12 MONTH
    AND membership_tier <> 'Platinum' THEN 1 ELSE 0 END AS brk FROM pts WINDOW w AS (PARTITION BY customer_id ORDER BY transaction_date, transaction_id)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY customer_id ORDER BY transaction_date, transaction_id ROWS UNBOUNDED PRECEDING) AS island FROM p)
SELECT customer_id, CAST(island AS BIGINT) AS island, min(transaction_date) AS first_purchase, max(transaction_date) AS last_purchase,
  sum(points) AS points, CASE WHEN first(membership_tier) = 'Platinum' THEN NULL
    ELSE CAST(CAST(max(transaction_date) AS DATE) + INTERVAL 12 MONTH AS DATE) END AS expires_on
FROM i GROUP BY customer_id, island""", ("customers", "transactions"))
def q_expiry(s, d):
    t = _t(s, d)
    return P.points_expiry(points(t).drop("membership_tier"), T.customers(t, place=False))


@reg("pol_reward_lookup", f"""WITH {POINTS_SQL}, b AS (SELECT customer_id, sum(points) AS points FROM pts GROUP BY customer_id)
SELECT b.customer_id, b.points, max(r.points_needed) AS points_needed, arg_max(r.yen_off, r.points_needed) AS yen_off
FROM b LEFT JOIN {rule_sql('REWARDS')} r ON b.points >= r.points_needed GROUP BY b.customer_id, b.points""", ("customers", "transactions"))
def q_reward(s, d):
    bal = points(_t(s, d)).groupBy("customer_id").agg(F.sum("points").alias("points"))
    return P.reward_lookup(bal, P.rules(s, "REWARDS"))


@reg("pol_delivery_fee", f"""SELECT t.transaction_id, c.membership_tier, t.total_amount, t.payment_method = 'credit_card' AS express,
  t.total_amount >= {P.MIN_ORDER} AS deliverable,
  CASE WHEN f.free_from IS NULL OR t.total_amount >= f.free_from THEN 0.0::DOUBLE ELSE f.fee END
    + CASE WHEN t.payment_method = 'credit_card' THEN {P.EXPRESS_SURCHARGE}::DOUBLE ELSE 0.0::DOUBLE END AS delivery_fee
FROM transactions t JOIN customers c USING (customer_id) JOIN {rule_sql('DELIVERY_FEES')} f ON f.tier = c.membership_tier""",
     ("customers", "transactions"))
def q_delivery(s, d):
    t = _t(s, d)
    return P.delivery_fee(T.transactions(t), T.customers(t, place=False), P.rules(s, "DELIVERY_FEES"), F.col("payment_method") == "credit_card")


@reg("pol_return_eligibility", f"""WITH {RETURNS_SQL},
j AS (SELECT r.*, w.window_hours, w.no_receipt_limit, (epoch(returned_at) - epoch(purchased_at)) / 3600.0 AS hours_elapsed
  FROM ret r JOIN {rule_sql('RETURN_WINDOWS')} w USING (product_class)),
k AS (SELECT *, hours_elapsed >= 0 AND hours_elapsed <= window_hours AS in_window,
  has_receipt OR (no_receipt_limit IS NOT NULL AND amount <= no_receipt_limit) AS receipt_ok FROM j)
SELECT return_id, product_class, hours_elapsed, in_window AND receipt_ok AS eligible,
  CASE WHEN NOT in_window THEN 'outside_window' WHEN NOT receipt_ok THEN 'receipt_required' ELSE 'ok' END AS reason FROM k""")
def q_return(s, d):
    return P.return_eligibility(returns(_t(s, d)), P.rules(s, "RETURN_WINDOWS"))


@reg("pol_no_receipt_limit", f"""WITH {RETURNS_SQL}, r AS (SELECT *, CAST(returned_at AS DATE) AS day FROM ret WHERE NOT has_receipt)
SELECT return_id, customer_id, day, amount,
  count(*) OVER (PARTITION BY customer_id ORDER BY day RANGE BETWEEN INTERVAL {P.NO_RECEIPT_DAYS} DAY PRECEDING AND CURRENT ROW) AS in_window,
  amount <= {P.NO_RECEIPT_CAP} AND count(*) OVER (PARTITION BY customer_id ORDER BY day
    RANGE BETWEEN INTERVAL {P.NO_RECEIPT_DAYS} DAY PRECEDING AND CURRENT ROW) <= {P.NO_RECEIPT_MAX} AS allowed FROM r""")
def q_no_receipt(s, d):
    return P.no_receipt_limit(returns(_t(s, d)))


def _purchases(t):
    # the sale price is taken before the join with the transactions, so that only what is used goes through its shuffle
    i = T.transaction_items(t).withColumn("sale_price", F.col("unit_price") - F.col("discount") / F.col("quantity"))
    i = i.join(T.transactions(t).select("transaction_id", "transaction_date"), "transaction_id")
    return i.select(F.concat_ws("-", "transaction_id", "line_number", "product_id", "supplier_id").alias("purchase_id"),
                    "product_id", "quantity", F.col("unit_price").alias("price"),
                    F.col("transaction_date").alias("purchased_at"), "sale_price")


@reg("pol_price_protection", """WITH i AS (SELECT concat_ws('-', transaction_id, line_number, product_id, supplier_id) AS purchase_id, product_id,
    quantity, unit_price AS price, transaction_date AS purchased_at, unit_price - discount / quantity AS sale_price
  FROM transaction_items JOIN transactions USING (transaction_id)),
low AS (SELECT product_id, CAST(purchased_at AS DATE) AS day, min(sale_price) AS low FROM i GROUP BY ALL),
b AS (SELECT p.purchase_id, p.product_id, p.quantity, p.price, min(l.low) AS lowest FROM i p JOIN low l
  ON l.product_id = p.product_id AND l.day BETWEEN CAST(p.purchased_at AS DATE) AND CAST(p.purchased_at AS DATE) + 7
  GROUP BY p.purchase_id, p.product_id, p.quantity, p.price)
SELECT purchase_id, product_id, price, lowest, floor((price - lowest) * quantity * 100 + 0.5) / 100 AS refund FROM b WHERE price - lowest > 0""",
     ("transactions", "transaction_items"))
def q_price_protection(s, d):
    p = _purchases(_t(s, d))
    return P.price_protection(p, p.select("product_id", F.col("purchased_at").alias("sold_at"), F.col("sale_price").alias("price")))


@reg("pol_recall_matches", f"""SELECT DISTINCT r.recall_id, t.customer_id FROM transaction_items i JOIN transactions t USING (transaction_id)
JOIN products p USING (product_id) JOIN {values_sql(RECALLS, ['recall_id', 'recalled_name', 'f', 'u'])} r
  ON p.name = r.recalled_name AND t.transaction_date >= CAST(r.f AS TIMESTAMP) AND t.transaction_date < CAST(r.u AS TIMESTAMP)""",
     ("transactions", "transaction_items", "products"))
def q_recall(s, d):
    t = _t(s, d)
    pur = (T.transaction_items(t).join(T.transactions(t), "transaction_id").join(T.products(t), "product_id")
           .select("customer_id", F.col("name").alias("product_name"), F.col("transaction_date").alias("purchased_at")))
    rec = s.createDataFrame(RECALLS, "recall_id int, recalled_name string, f string, u string").select(
        "recall_id", "recalled_name", F.to_timestamp_ntz("f").alias("bought_from"), F.to_timestamp_ntz("u").alias("bought_until"))
    return P.recall_matches(pur, rec)


@reg("pol_refund_routing", f"""WITH {RETURNS_SQL}
SELECT return_id AS refund_id, amount, min(l.level) AS level FROM ret JOIN {rule_sql('REFUND_LEVELS')} l
  ON l.max_amount IS NULL OR amount <= l.max_amount GROUP BY return_id, amount""")
def q_refund_routing(s, d):
    r = returns(_t(s, d)).select(F.col("return_id").alias("refund_id"), "amount")
    return P.refund_routing(r, P.rules(s, "REFUND_LEVELS"))


def _tickets(t):
    e = t.events.filter(F.col("event_type") == "error")
    k = F.get_json_object("props", "$.k").cast("int")
    pr = F.when(k < 10, "urgent").when(k < 40, "high").when(k < 70, "medium").otherwise("low")
    m = lambda x: F.make_dt_interval(F.lit(0), F.lit(0), x.cast("int"))
    return e.select(pr.alias("priority"), F.col("ts").alias("opened_at"),
                    (F.col("ts") + m(F.floor(F.col("value") * 6))).alias("responded_at"),
                    (F.col("ts") + m(F.floor(F.col("value") * 60))).alias("resolved_at"))


@reg("pol_sla_breach", f"""WITH tk AS (SELECT CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 10 THEN 'urgent'
    WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 40 THEN 'high' WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 70 THEN 'medium'
    ELSE 'low' END AS priority, ts AS opened_at, ts + to_minutes(CAST(floor(value * 6) AS INTEGER)) AS responded_at,
  ts + to_minutes(CAST(floor(value * 60) AS INTEGER)) AS resolved_at FROM events WHERE event_type = 'error'),
j AS (SELECT tk.priority, responded_at > opened_at + to_hours(sla.response_hours) AS rb, resolved_at > opened_at + to_hours(sla.resolution_hours) AS sb
  FROM tk JOIN {rule_sql('SLA')} sla USING (priority))
SELECT priority, count(*) AS n_tickets, floor(avg(CAST(rb AS DOUBLE)) * 1000000 + 0.5) / 1000000 AS response_breach_rate,
  floor(avg(CAST(sb AS DOUBLE)) * 1000000 + 0.5) / 1000000 AS resolution_breach_rate FROM j GROUP BY priority""")
def q_sla(s, d):
    return P.sla_breach(_tickets(_t(s, d)), P.rules(s, "SLA"))


@reg("pol_store_hours", f"""WITH c AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
k AS (SELECT day, strftime(day, '%m-%d') AS month_day, CASE WHEN dayofweek(day) = 0 THEN 'sunday' ELSE 'weekday' END AS day_kind FROM c)
SELECT k.day, CASE WHEN h.month_day IS NOT NULL THEN h.opens ELSE r.opens END AS opens,
  CASE WHEN h.month_day IS NOT NULL THEN h.closes ELSE r.closes END AS closes, h.month_day IS NOT NULL AND h.opens IS NULL AS closed
FROM k JOIN {rule_sql('REGULAR_HOURS')} r USING (day_kind) LEFT JOIN {rule_sql('HOLIDAY_HOURS')} h USING (month_day)""")
def q_store_hours(s, d):
    cal = _t(s, d).orders.select(F.to_date("o_orderdate").alias("day")).distinct()
    return P.store_hours(cal, P.rules(s, "REGULAR_HOURS"), P.rules(s, "HOLIDAY_HOURS"))


@reg("pol_retention_expired", f"""WITH rows AS (SELECT 'transactions' AS data_type, o_orderdate AS created_at FROM orders
  UNION ALL SELECT 'app_analytics', ts FROM events UNION ALL SELECT 'delivery', l_shipdate FROM lineitem
  UNION ALL SELECT 'customer_service', ts FROM events WHERE event_type = 'error')
SELECT data_type, count(*) AS n_rows, count(CASE WHEN r.months IS NOT NULL
  AND created_at < CAST(CAST(TIMESTAMP '{NOW}' AS DATE) - to_months(r.months) AS TIMESTAMP) THEN 1 END) AS n_expired
FROM rows JOIN {rule_sql('RETENTION')} r USING (data_type) GROUP BY data_type""")
def q_retention(s, d):
    t = _t(s, d)
    rows = (t.orders.select(F.lit("transactions").alias("data_type"), F.col("o_orderdate").alias("created_at"))
            .unionByName(t.events.select(F.lit("app_analytics").alias("data_type"), F.col("ts").alias("created_at")))
            .unionByName(t.lineitem.select(F.lit("delivery").alias("data_type"), F.col("l_shipdate").alias("created_at")))
            .unionByName(t.events.filter(F.col("event_type") == "error").select(F.lit("customer_service").alias("data_type"),
                                                                              F.col("ts").alias("created_at"))))
    return P.retention_expired(rows, P.rules(s, "RETENTION"), ts_ntz(NOW))


@reg("pol_refund_schedule", f"""WITH {RETURNS_SQL}
SELECT return_id AS refund_id, r.payment_method, s.refund_method, s.min_days, s.max_days
FROM ret r LEFT JOIN {rule_sql('REFUND_SCHEDULE')} s USING (payment_method)""")
def q_refund_schedule(s, d):
    r = returns(_t(s, d)).select(F.col("return_id").alias("refund_id"), "payment_method")
    return P.refund_schedule(r, P.rules(s, "REFUND_SCHEDULE"))


QUERIES = Q
