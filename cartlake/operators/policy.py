"""Policy rules from the store's policy documents, applied to retail data.

Each operator takes its rule values from a small rule DataFrame (built from
the fixed values below by ``rules(spark, NAME)``); rule tables have a fixed
handful of rows, so broadcasting them is bounded by construction. They are
always marked for it: a shuffle by a rule's key (a tier, a data type) would
bring a large part of all rows into one task. Range
lookups against rules are broadcast range joins; the one large-by-large
interval join (price protection) is turned into an equi-join on spans of
days after pre-aggregating the sale side per (product, day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import money

# ---------------------------------------------------------------------------
# Fixed values from the policy documents.
TIER_RULES = [  # tier, level, quarterly spend to reach it (yen), points per 100 yen
    ("Bronze", 0, 0.0, 1.0), ("Silver", 1, 50000.0, 1.5), ("Gold", 2, 150000.0, 2.0), ("Platinum", 3, 300000.0, 3.0)]
REWARDS = [  # points needed, yen off
    (100, 100), (500, 500), (1000, 1200), (2500, 3500), (5000, 7500), (10000, 17500)]
DELIVERY_FEES = [  # tier, free from order amount (null = always free), regular fee
    ("Bronze", 10000.0, 800.0), ("Silver", 7500.0, 600.0), ("Gold", 5000.0, 400.0), ("Platinum", None, 0.0)]
EXPRESS_SURCHARGE, MIN_ORDER = 500.0, 2500.0
RETURN_WINDOWS = [  # product class, window in hours, no-receipt limit (yen, null = receipt always needed)
    ("general", 90 * 24, None), ("fresh", 48, 3000.0), ("frozen", 30 * 24, 1500.0)]
NO_RECEIPT_CAP, NO_RECEIPT_MAX, NO_RECEIPT_DAYS = 5000.0, 3, 90
PRICE_PROTECTION_DAYS = 7
SPAN_WINDOWS = 4          # refund windows in a span of listed sale days
POINTS_VALIDITY_MONTHS = 12
REFUND_LEVELS = [  # level, upper bound of refund amount (null = no bound)
    (1, 5000.0), (2, 20000.0), (3, 50000.0), (4, None)]
SLA = [  # priority, first response due (hours), resolution due (hours); 5 business days taken as 5 days
    ("urgent", 0, 1), ("high", 2, 24), ("medium", 4, 48), ("low", 24, 120)]
REGULAR_HOURS = [  # day kind, opens, closes
    ("weekday", "09:00", "22:00"), ("sunday", "09:00", "21:00")]
HOLIDAY_HOURS = [  # month-day, opens, closes (null = closed)
    ("01-01", None, None), ("01-02", "10:00", "18:00"), ("01-03", "10:00", "18:00"),
    ("05-03", "09:00", "20:00"), ("05-04", "09:00", "20:00"), ("05-05", "09:00", "20:00"),
    ("08-13", "09:00", "20:00"), ("08-14", "09:00", "20:00"), ("08-15", "09:00", "20:00"),
    ("12-31", "09:00", "18:00")]
RETENTION = [  # data type, retention in months (null = as long as the account exists)
    ("account", None), ("transactions", 84), ("points", None), ("customer_service", 36), ("app_analytics", 24),
    ("delivery", 12)]
REFUND_SCHEDULE = [  # payment method, refund method, days (min, max)
    ("credit_card", "card", 5, 7), ("debit_card", "card", 3, 5), ("cash", "cash", 0, 0),
    ("mobile_pay", "account", 5, 7), ("gift_card", "new_gift_card", 0, 0)]
# ---------------------------------------------------------------------------

RULE_SCHEMAS = {
    "TIER_RULES": (TIER_RULES, "tier string, level int, min_quarter_spend double, rate double"),
    "REWARDS": (REWARDS, "points_needed int, yen_off int"),
    "DELIVERY_FEES": (DELIVERY_FEES, "tier string, free_from double, fee double"),
    "RETURN_WINDOWS": (RETURN_WINDOWS, "product_class string, window_hours int, no_receipt_limit double"),
    "REFUND_LEVELS": (REFUND_LEVELS, "level int, max_amount double"),
    "SLA": (SLA, "priority string, response_hours int, resolution_hours int"),
    "REGULAR_HOURS": (REGULAR_HOURS, "day_kind string, opens string, closes string"),
    "HOLIDAY_HOURS": (HOLIDAY_HOURS, "month_day string, opens string, closes string"),
    "RETENTION": (RETENTION, "data_type string, months int"),
    "REFUND_SCHEDULE": (REFUND_SCHEDULE, "payment_method string, refund_method string, min_days int, max_days int"),
}


def rules(spark: SparkSession, name: str) -> DataFrame:
    rows, schema = RULE_SCHEMAS[name]
    return spark.createDataFrame(rows, schema)


def points_earned(txns: DataFrame, customers: DataFrame, tier_rules: DataFrame) -> DataFrame:
    """floor(amount / 100) x the customer's tier rate."""
    r = F.broadcast(tier_rules.select(F.col("tier").alias("membership_tier"), "rate"))
    return (txns.select("transaction_id", "customer_id", "transaction_date", "total_amount")
            .join(customers.select("customer_id", "membership_tier"), "customer_id").join(r, "membership_tier")
            .select("transaction_id", "customer_id", "transaction_date", "membership_tier",
                    (F.floor(F.col("total_amount") / 100) * F.col("rate")).alias("points")))


def quarterly_tier(txns: DataFrame, tier_rules: DataFrame) -> DataFrame:
    """Tier per customer and quarter: the level reached by the quarter's
    spend applies at once (upgrade), a lower level only after one quarter of
    grace: effective = max(level this quarter, level last quarter). Quarters
    without purchases are filled in (a dense spine per customer, bounded by
    the customer's active time span)."""
    q = txns.select("customer_id", F.trunc(F.to_date("transaction_date"), "quarter").alias("quarter"), "total_amount")
    spend = q.groupBy("customer_id", "quarter").agg(F.sum("total_amount").alias("spend"))
    span = spend.groupBy("customer_id").agg(F.min("quarter").alias("q0"), F.max("quarter").alias("q1"))
    spine = span.select("customer_id", F.explode(F.sequence("q0", "q1", F.expr("INTERVAL 3 MONTHS"))).alias("quarter"))
    s = spine.join(spend, ["customer_id", "quarter"], "left").fillna(0.0, ["spend"])
    s = s.withColumn("rules", rule_rows(tier_rules, "level", "min_quarter_spend", "tier"))
    top = F.array_max(F.filter("rules", lambda r: r["min_quarter_spend"] <= F.col("spend")))
    reached = s.select("customer_id", "quarter", "spend", "rules", top["level"].alias("reached")).filter("reached IS NOT NULL")
    w = Window.partitionBy("customer_id").orderBy("quarter").rowsBetween(-1, 0)
    eff = reached.withColumn("effective", F.max("reached").over(w))
    named = F.filter("rules", lambda r: r["level"] == F.col("effective"))[0]["tier"]
    return eff.select("customer_id", "quarter", money(F.col("spend")).alias("spend"), "reached", "effective",
                      named.alias("tier"))


def points_expiry(points: DataFrame, customers: DataFrame, months: int = POINTS_VALIDITY_MONTHS) -> DataFrame:
    """Points expire ``months`` after the last purchase; any purchase extends
    all points. A gap longer than that starts a new balance (island);
    Platinum members' points do not expire.

    A balance is a session window whose gap ends at the expiry date of each
    purchase (rows of one task are merged before the shuffle); balances, a
    few rows per customer, are numbered afterwards."""
    p = points.join(customers.select("customer_id", "membership_tier"), "customer_id")
    lasts = F.timestamp_diff("MICROSECOND", F.col("transaction_date"),
                             F.add_months("transaction_date", months).cast("timestamp_ntz"))
    gap = F.when(F.col("membership_tier") == "Platinum", "3650000 days").otherwise(
        F.concat(lasts.cast("string"), F.lit(" microseconds")))
    g = p.groupBy("customer_id", F.session_window("transaction_date", gap).alias("balance")).agg(
        F.min("transaction_date").alias("first_purchase"), F.max("transaction_date").alias("last_purchase"),
        F.sum("points").alias("points"), F.first("membership_tier").alias("tier"))
    g = g.withColumn("island", F.row_number().over(Window.partitionBy("customer_id").orderBy("first_purchase")) - 1)
    return g.select("customer_id", F.col("island").cast("long").alias("island"), "first_purchase", "last_purchase",
                    "points", F.when(F.col("tier") == "Platinum", F.lit(None).cast("date"))
                    .otherwise(F.add_months(F.to_date("last_purchase"), months)).alias("expires_on"))


def rule_rows(rules_df: DataFrame, *cols: str) -> Column:
    """A rule table (a handful of rows) as one array column, so that a lookup
    is an expression on each row: no join, no regrouping."""
    return rules_df.agg(F.sort_array(F.collect_list(F.struct(*cols)))).scalar()


def reward_lookup(balances: DataFrame, rewards: DataFrame) -> DataFrame:
    """Best reward whose threshold is within the balance."""
    best = F.array_max(F.filter("rules", lambda r: r["points_needed"] <= F.col("points")))
    return balances.withColumn("rules", rule_rows(rewards, "points_needed", "yen_off")).select("customer_id", "points", best["points_needed"].alias("points_needed"),
                           best["yen_off"].alias("yen_off"))


def delivery_fee(txns: DataFrame, customers: DataFrame, fees: DataFrame, express: Column) -> DataFrame:
    f = F.broadcast(fees.withColumnRenamed("tier", "membership_tier"))
    j = (txns.select("transaction_id", "customer_id", "total_amount", express.alias("express"))
         .join(customers.select("customer_id", "membership_tier"), "customer_id").join(f, "membership_tier"))
    free = F.col("free_from").isNull() | (F.col("total_amount") >= F.col("free_from"))
    fee = F.when(free, 0.0).otherwise(F.col("fee")) + F.when(F.col("express"), EXPRESS_SURCHARGE).otherwise(0.0)
    return j.select("transaction_id", "membership_tier", "total_amount", "express",
                    (F.col("total_amount") >= MIN_ORDER).alias("deliverable"), fee.alias("delivery_fee"))


def return_eligibility(returns: DataFrame, windows: DataFrame) -> DataFrame:
    """returns(return_id, product_class, purchased_at, returned_at, amount,
    has_receipt) -> within window (elapsed may be negative: not eligible)
    and receipt rule."""
    j = returns.join(F.broadcast(windows), "product_class")
    hours = F.timestamp_diff("SECOND", F.col("purchased_at"), F.col("returned_at")) / 3600.0  # TIMESTAMP_NTZ, no zone
    in_window = (hours >= 0) & (hours <= F.col("window_hours"))
    receipt_ok = F.col("has_receipt") | (F.col("no_receipt_limit").isNotNull() & (F.col("amount") <= F.col("no_receipt_limit")))
    reason = F.when(~in_window, "outside_window").when(~receipt_ok, "receipt_required").otherwise("ok")
    return j.select("return_id", "product_class", hours.alias("hours_elapsed"), (in_window & receipt_ok).alias("eligible"),
                    reason.alias("reason"))


def no_receipt_limit(returns: DataFrame, cap: float = NO_RECEIPT_CAP, n: int = NO_RECEIPT_MAX,
                     days: int = NO_RECEIPT_DAYS) -> DataFrame:
    """No-receipt returns: each at most ``cap``, at most ``n`` per customer in
    a rolling ``days`` window. Returns are first counted per (customer, day);
    the rolling sum runs over that daily table (one row per active day, so a
    customer with a huge number of returns is still a small window), then is
    joined back to the returns."""
    r = returns.filter(~F.col("has_receipt")).withColumn("day", F.to_date("returned_at"))
    daily = r.groupBy("customer_id", "day").agg(F.count(F.lit(1)).alias("n_day"))
    w = Window.partitionBy("customer_id").orderBy(F.datediff(F.col("day"), F.lit("1970-01-01"))).rangeBetween(-days, 0)
    rolling = daily.select("customer_id", "day", F.sum("n_day").over(w).alias("in_window"))
    return r.join(rolling, ["customer_id", "day"]).select(
        "return_id", "customer_id", "day", "amount", "in_window",
        ((F.col("amount") <= cap) & (F.col("in_window") <= n)).alias("allowed"))


def price_protection(purchases: DataFrame, sales: DataFrame, days: int = PRICE_PROTECTION_DAYS) -> DataFrame:
    """Refund of the difference when the same product sold cheaper within
    ``days`` after the purchase. The sale side is pre-aggregated to the
    lowest price per (product, day); these days are listed per product and
    span of SPAN_WINDOWS times the refund window, a day also in the span
    before if a purchase there may look ahead to it. A list holds at most the
    days of its span and one window, and purchases look into it after one
    equi-join, so they are neither multiplied nor regrouped."""
    span = SPAN_WINDOWS * (days + 1)
    number = lambda day: F.datediff(day, F.lit("1970-01-01"))          # noqa: E731
    spans = lambda n: F.floor(n / span).cast("int")                    # noqa: E731
    low = sales.groupBy("product_id", number(F.to_date("sold_at")).alias("sold")).agg(F.min("price").alias("low"))
    low = (low.select("product_id", F.explode(F.sequence(spans(F.col("sold") - days), spans(F.col("sold")))).alias("span"),
                      F.struct("sold", "low").alias("sale"))
           .groupBy("product_id", "span").agg(F.collect_list("sale").alias("sales")))
    bought = purchases.select("purchase_id", "product_id", "quantity", "price", number(F.to_date("purchased_at")).alias("day"))
    best = bought.withColumn("span", spans(F.col("day"))).join(low, ["product_id", "span"])
    in_time = F.filter("sales", lambda x: (x["sold"] >= F.col("day")) & (x["sold"] <= F.col("day") + days))
    best = best.withColumn("lowest", F.array_min(F.transform(in_time, lambda x: x["low"])))
    diff = F.col("price") - F.col("lowest")
    return best.filter(diff > 0).select("purchase_id", "product_id", "price", "lowest",
                                        money(diff * F.col("quantity")).alias("refund"))


def recall_matches(purchases: DataFrame, recalls: DataFrame) -> DataFrame:
    """Customers to contact: bought a recalled product inside the recall's
    purchase window; one contact per (customer, recall)."""
    r = F.broadcast(recalls)
    j = purchases.join(r, (purchases.product_name == r.recalled_name)
                       & (purchases.purchased_at >= r.bought_from) & (purchases.purchased_at < r.bought_until))
    return j.select("recall_id", "customer_id").distinct()


def refund_routing(refunds: DataFrame, levels: DataFrame) -> DataFrame:
    """Approval level: the lowest level whose bound covers the amount."""
    covering = F.filter("rules", lambda r: r["max_amount"].isNull() | (F.col("amount") <= r["max_amount"]))
    return refunds.withColumn("rules", rule_rows(levels, "level", "max_amount")).select("refund_id", "amount", F.array_min(covering)["level"].alias("level")).filter("level IS NOT NULL")


def sla_breach(tickets: DataFrame, sla: DataFrame) -> DataFrame:
    """Response and resolution deadlines by priority; breach rates."""
    j = tickets.join(F.broadcast(sla), "priority")
    resp_due = F.col("opened_at") + F.make_dt_interval(F.lit(0), F.col("response_hours"))
    res_due = F.col("opened_at") + F.make_dt_interval(F.lit(0), F.col("resolution_hours"))
    t = j.select("priority", (F.col("responded_at") > resp_due).alias("resp_breach"),
                 (F.col("resolved_at") > res_due).alias("res_breach"))
    return t.groupBy("priority").agg(
        F.count(F.lit(1)).alias("n_tickets"),
        money(F.avg(F.col("resp_breach").cast("double")), 6).alias("response_breach_rate"),
        money(F.avg(F.col("res_breach").cast("double")), 6).alias("resolution_breach_rate"))


def store_hours(calendar: DataFrame, regular: DataFrame, holidays: DataFrame) -> DataFrame:
    """Opening hours per date: a holiday row overrides the regular hours of
    the day kind (Sunday or other day); null hours on a holiday = closed."""
    c = calendar.select("day", F.date_format("day", "MM-dd").alias("month_day"),
                        F.when(F.dayofweek("day") == 1, "sunday").otherwise("weekday").alias("day_kind"))
    reg = regular.select("day_kind", F.col("opens").alias("r_open"), F.col("closes").alias("r_close"))
    hol = holidays.select("month_day", F.col("opens").alias("h_open"), F.col("closes").alias("h_close"),
                                      F.lit(True).alias("holiday"))
    j = c.join(F.broadcast(reg), "day_kind").join(F.broadcast(hol), "month_day", "left")
    is_h = F.coalesce(F.col("holiday"), F.lit(False))
    return j.select("day", F.when(is_h, F.col("h_open")).otherwise(F.col("r_open")).alias("opens"),
                    F.when(is_h, F.col("h_close")).otherwise(F.col("r_close")).alias("closes"),
                    (is_h & F.col("h_open").isNull()).alias("closed"))


def retention_expired(rows: DataFrame, retention: DataFrame, now: Column) -> DataFrame:
    """Rows past their retention per data type (types kept for the account
    lifetime never expire here)."""
    j = rows.join(F.broadcast(retention), "data_type")
    limit = F.add_months(F.to_date(now), -F.col("months")).cast("timestamp_ntz")
    exp = F.col("months").isNotNull() & (F.col("created_at") < limit)
    return j.groupBy("data_type").agg(F.count(F.lit(1)).alias("n_rows"),
                                      F.count(F.when(exp, 1)).alias("n_expired"))


def refund_schedule(refunds: DataFrame, schedule: DataFrame) -> DataFrame:
    return refunds.join(F.broadcast(schedule), "payment_method", "left").select(
        "refund_id", "payment_method", "refund_method", "min_days", "max_days")
