"""Retail question workload (top sellers, spend, orders, stock, ...).

Conventions: money aggregates are rounded to cents once, at the end; ties
are broken by id so results are deterministic. Dimension joins are written
as plain joins and left to AQE: a dimension that measures under
spark.sql.autoBroadcastJoinThreshold at runtime becomes a broadcast hash
join, a larger one a sort-merge join, so no broadcast is unchecked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import line_amount, money
from ..plans.numbering import number_blocks, offsets, rank_within


ASKING = 1 << 16          # customers that ask one copy of a popularity list's first places


def _money(c: Column) -> Column:
    return money(c)


def top_products(items: DataFrame, products: DataFrame, n: int = 5) -> DataFrame:
    """Top-n products by sales. Aggregate (map-side partial), take the top n
    (TakeOrderedAndProject: a per-partition heap, n rows to the driver-free
    final merge) and only then join the n winners to the product names."""
    sales = (items.groupBy("product_id")
             .agg(_money(F.sum(line_amount())).alias("sales"), F.sum("quantity").alias("units")))
    top = sales.orderBy(F.desc("sales"), "product_id").limit(n)
    return (top.join(products.select("product_id", "name", "category"), "product_id")
            .select("product_id", "name", "category", "units", "sales"))


def cheapest_product(products: DataFrame) -> DataFrame:
    return products.orderBy("price", "product_id").limit(1).select("product_id", "name", "category", "price")


def stock_by_category(products: DataFrame, category: str, prefix: str) -> DataFrame:
    return (products.filter((F.col("category") == category) & F.col("name").startswith(prefix))
            .select("product_id", "name", "category", "stock_quantity", "price"))


def variant_price_compare(products: DataFrame, regular: tuple[str, ...] = ()) -> DataFrame:
    """Prices of every prefixed variant against the regular product of the same
    base name (last word) and category: the one without a prefix, or with one
    of ``regular``. Aggregates per (base, category, variant) instead of
    pairing products, so the work is linear in the product count; a variant
    without a regular product has no premium."""
    words = F.split("name", " ")
    plain = (F.size(words) == 1) | F.element_at(words, 1).isin(*regular)
    p = products.select("category", F.when(plain, "regular").otherwise(F.element_at(words, 1)).alias("variant"),
                        F.element_at(words, -1).alias("base_name"), "price")
    per = p.groupBy("base_name", "category", "variant").agg(
        F.min("price").alias("min_price"), _money(F.avg("price")).alias("avg_price"), F.count(F.lit(1)).alias("n_products"))
    w = Window.partitionBy("base_name", "category")     # a row a variant
    base = F.max(F.when(F.col("variant") == "regular", F.col("min_price"))).over(w)
    return per.withColumn("regular_price", base).filter("variant <> 'regular'").select(
        "base_name", "category", "variant", "min_price", "avg_price", "n_products", "regular_price",
        _money(F.col("min_price") - F.col("regular_price")).alias("premium"))


def customer_spend_month(txns: DataFrame, now: Column, customer_id=None) -> DataFrame:
    """Spend per customer in the calendar month before ``now`` (all customers
    unless one is given). The month bounds are literals, so the date
    predicate is pushed into the parquet scan."""
    start = F.add_months(F.trunc(now, "month"), -1)
    end = F.trunc(now, "month")
    t = txns.filter((F.col("transaction_date") >= start) & (F.col("transaction_date") < end))
    if customer_id is not None:
        t = t.filter(F.col("customer_id") == customer_id)
    return t.groupBy("customer_id").agg(_money(F.sum("total_amount")).alias("spend"),
                                         F.count(F.lit(1)).alias("n_orders"))


def spend_breakdown(txns: DataFrame, items: DataFrame, products: DataFrame, start: Column, end: Column,
                    customer_id=None) -> DataFrame:
    """Spend by category, by visit day and in total, per customer, over
    [start, end): GROUPING SETS over one join."""
    t = txns.filter((F.col("transaction_date") >= start) & (F.col("transaction_date") < end))
    if customer_id is not None:
        t = t.filter(F.col("customer_id") == customer_id)
    j = (t.select("transaction_id", "customer_id", F.to_date("transaction_date").alias("day"))
         .join(items.select("transaction_id", "product_id", line_amount().alias("amount")), "transaction_id")
         .join(products.select("product_id", "category"), "product_id"))
    return (j.groupingSets([["customer_id", "category"], ["customer_id", "day"], ["customer_id"]],
                           "customer_id", "category", "day")
            .agg(_money(F.sum("amount")).alias("spend"), F.grouping_id().cast("int").alias("level")))


def store_finder(stores: DataFrame, place: str) -> DataFrame:
    p = place.lower()
    return (stores.filter(F.lower("city").contains(p) | F.lower("state").contains(p) | F.lower("name").contains(p))
            .select("store_id", "name", "city", "state", "hours"))


def products_under_price(products: DataFrame, category: str, price: float) -> DataFrame:
    return (products.filter((F.col("category") == category) & (F.col("price") <= price))
            .select("product_id", "name", "category", "price", "stock_quantity"))


def popular_in_category(items: DataFrame, products: DataFrame, n: int = 3) -> DataFrame:
    """Most bought products per category. Units are summed per product
    first (partial aggregation), the category is joined on the aggregate and
    the per-category top-n is a rank filter, which Spark plans as a partial
    WindowGroupLimit before the shuffle so a hot category never moves more
    than n rows per map partition."""
    units = items.groupBy("product_id").agg(F.sum("quantity").alias("units"))
    j = units.join(products.select("product_id", "name", "category"), "product_id")
    w = Window.partitionBy("category").orderBy(F.desc("units"), "product_id")
    return (j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select("category", F.col("rank").cast("long").alias("rank"), "product_id", "name", "units"))


def last_n_orders(txns: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("customer_id").orderBy(F.desc("transaction_date"), F.desc("transaction_id"))
    return (txns.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select("customer_id", F.col("rank").cast("long").alias("rank"), "transaction_id",
                    "transaction_date", "total_amount", "status"))


def order_detail(txns: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Order header joined to its lines (flat: one row per line, so a huge
    order is never gathered into one array)."""
    return (txns.select("transaction_id", "customer_id", "transaction_date", "status")
            .join(items.select("transaction_id", "product_id", "line_number", "quantity", "unit_price", "discount"),
                  "transaction_id")
            .join(products.select("product_id", F.col("name").alias("product_name")), "product_id")
            .select("transaction_id", "customer_id", "transaction_date", "status", "line_number", "product_id",
                    "product_name", "quantity", _money(line_amount()).alias("amount")))


def payment_methods(payments: DataFrame) -> DataFrame:
    """Methods per customer (a set bounded by the number of methods)."""
    return payments.groupBy("customer_id").agg(
        F.array_join(F.array_sort(F.collect_set("payment_method")), ",").alias("methods"),
        F.bool_or(F.col("payment_method") == "mobile_pay").alias("has_mobile_pay"))


def low_stock(products: DataFrame, category: str, threshold: int) -> DataFrame:
    return (products.filter((F.col("category") == category) & (F.col("stock_quantity") <= threshold))
            .select("product_id", "name", "category", "stock_quantity"))


def status_payment_summary(txns: DataFrame) -> DataFrame:
    return txns.groupBy("status", "payment_method").agg(
        F.count(F.lit(1)).alias("n_orders"), _money(F.sum("total_amount")).alias("amount"))


def customer_profile(customers: DataFrame) -> DataFrame:
    schema = "dietary array<string>, favorite_categories array<string>, organic_preference boolean"
    p = F.from_json("preferences", schema)
    return customers.select("customer_id", "name", "membership_tier", "city",
                            F.array_join(p["dietary"], ",").alias("dietary"),
                            F.array_join(p["favorite_categories"], ",").alias("favorite_categories"),
                            p["organic_preference"].alias("organic_preference"))


def purchase_history(customers: DataFrame, txns: DataFrame, items: DataFrame, products: DataFrame,
                     stores: DataFrame) -> DataFrame:
    return (items.select("transaction_id", "product_id", "quantity", line_amount().alias("amount"))
            .join(txns.select("transaction_id", "customer_id", "store_id", "transaction_date"), "transaction_id")
            .join(customers.select("customer_id", F.col("name").alias("customer_name")), "customer_id")
            .join(products.select("product_id", F.col("name").alias("product_name")), "product_id")
            .join(stores.select("store_id", F.col("name").alias("store_name")), "store_id")
            .select("customer_id", "customer_name", "transaction_id", "transaction_date", "store_name",
                    "product_name", "quantity", _money(F.col("amount")).alias("amount")))


def item_availability(products: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each requested name: number of products with that name and
    whether any is in stock. ``wanted`` has one column ``name``."""
    # only the wanted names are counted
    names = wanted.select("name").distinct()
    inv = products.join(names, "name", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("n_products"),
                                      F.sum(F.when(F.col("stock_quantity") > 0, 1).otherwise(0)).cast("long").alias("n_in_stock"))
    return (names.join(inv, "name", "left")
            .select("name", F.coalesce("n_products", F.lit(0)).alias("n_products"),
                    F.coalesce("n_in_stock", F.lit(0)).cast("long").alias("n_in_stock"),
                    (F.coalesce("n_in_stock", F.lit(0)) > 0).alias("available")))


def total_reconcile(txns: DataFrame, items: DataFrame, tol: float = 0.01) -> DataFrame:
    """Transactions whose stored total differs from the sum of their lines
    (a transaction without lines counts as 0)."""
    sums = items.groupBy("transaction_id").agg(F.sum(line_amount()).alias("items_total"))
    j = txns.select("transaction_id", "total_amount").join(sums, "transaction_id", "left")
    it = F.coalesce(F.col("items_total"), F.lit(0.0))
    return (j.filter(F.abs(F.col("total_amount") - it) > tol)
            .select("transaction_id", "total_amount", _money(it).alias("items_total"),
                    _money(F.col("total_amount") - it).alias("difference")))


def ref_integrity(customers: DataFrame, products: DataFrame, txns: DataFrame, items: DataFrame,
                  payments: DataFrame) -> DataFrame:
    """Orphan rows across the star: each check is a left_anti join (no pairs)."""
    def orphans(child, key, parent, pkey, label, idcol):
        return (child.join(parent.select(F.col(pkey).alias(key)), key, "left_anti")
                .select(F.lit(label).alias("check"), F.col(idcol).cast("string").alias("row_id")))
    parts = [
        orphans(items, "transaction_id", txns, "transaction_id", "item_without_transaction", "transaction_id"),
        orphans(items, "product_id", products, "product_id", "item_without_product", "product_id"),
        orphans(txns, "customer_id", customers, "customer_id", "transaction_without_customer", "transaction_id"),
        orphans(payments, "customer_id", customers, "customer_id", "payment_without_customer", "customer_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def out_of_stock_alternatives(products: DataFrame, n: int = 3) -> DataFrame:
    """For every sold-out product, the n in-stock products of its category
    priced at or below it, nearest price first (ties: higher id first).

    Exact without pairing a category's products: in-stock and sold-out rows
    share one order (price, in-stock before sold-out at equal price, id); a
    sold-out row's count c of in-stock rows before it is an exclusive prefix
    sum, the in-stock rows get their rank r the same way, and the answer is
    the equi-join on (category, r) for r in (c - n, c]."""
    p = products.select("product_id", "category", "price", "stock_quantity",
                        F.round(F.col("price") * 100).cast("long").alias("cents"),
                        F.when(F.col("stock_quantity") > 0, 0).otherwise(1).alias("kind"))
    p = p.withColumn("_in", F.when(F.col("kind") == 0, 1).otherwise(0))
    order = [F.col("cents"), F.col("kind"), F.col("product_id")]
    # price levels, prices, kinds, then blocks of ids: no window spans a category
    blocks = [F.shiftright("cents", 10), F.col("cents"), F.col("kind"), *number_blocks(F.col("product_id"), 2)]
    ranked = offsets(p, {"_in": "before"}, order, blocks, ["category"])
    instock = ranked.filter(F.col("kind") == 0).select(
        "category", (F.col("before") + 1).alias("r"), F.col("product_id").alias("alt_product_id"),
        F.col("price").alias("alt_price"))
    sold = ranked.filter(F.col("kind") == 1).filter(F.col("before") > 0).select(
        "category", "product_id", "price", "before",
        F.explode(F.sequence(F.greatest(F.col("before") - n + 1, F.lit(1)), F.col("before"))).alias("r"))
    return sold.join(instock, ["category", "r"]).select(
        "product_id", "category", "price", (F.col("before") - F.col("r") + 1).alias("alt_rank"), "alt_product_id",
        "alt_price")


def _popularity(items: DataFrame, products: DataFrame) -> DataFrame:
    units = items.groupBy("product_id").agg(F.sum("quantity").alias("units"))
    return products.select("product_id", "name", "category", "price").join(units, "product_id", "left") \
        .fillna(0.0, ["units"])


def _popular_order() -> tuple[list, list]:
    """(order, blocks) of most popular first: units are whole quantities, so
    the block keys sort like (-units, product_id)."""
    units = -F.col("units").cast("long")
    return ([-F.col("units"), F.col("product_id")],
            [F.shiftright(units, 10), units, *number_blocks(F.col("product_id"), 2)])


def budget_basket(items: DataFrame, products: DataFrame, budget: float) -> DataFrame:
    """Per category, the most popular products taken in order while the
    running total stays within ``budget`` (prices summed in integer cents,
    so the running total is exact). Ranks and running totals are blocked
    prefix sums."""
    pop = _popularity(items, products).withColumn("cents", F.round(F.col("price") * 100).cast("long")) \
        .withColumn("_one", F.lit(1))
    # rank and running total in one pass over one set of block tables
    r = offsets(pop, {"_one": "rank0", "cents": "spent_before"}, *_popular_order(), ["category"])
    total = F.col("spent_before") + F.col("cents")
    return r.filter(total <= round(budget * 100)).select(
        "category", (F.col("rank0") + 1).cast("long").alias("rank"), "product_id", "name", "price",
        (total / 100.0).alias("basket_total"))


def recommend_preferences(customers: DataFrame, txns: DataFrame, items: DataFrame, products: DataFrame,
                          n: int = 5, favorite_weight: float = 2.0) -> DataFrame:
    """Top-n products per customer not bought before, from the categories the
    customer declared as favourite or bought from. Score = favourite weight
    + the category's share of the customer's spend; within a category the
    most popular products come first.

    A customer's categories are read in the order of their scores and only as
    long as the better ones have not yet given n products (early stopping). In
    a category, the places that bought products leave free in the popularity
    list follow from the ranks of the bought ones alone, so exactly the first n
    free places are asked for, by (category, rank); the places that many
    customers ask for are dealt in salted copies."""
    pop = _popularity(items, products)
    ranked = rank_within(pop, ["category"], *_popular_order(), out="prank")
    sizes = products.groupBy("category").agg(F.count(F.lit(1)).alias("listed"))
    own = (items.select("transaction_id", "product_id", line_amount().alias("amount"))
           .join(txns.select("transaction_id", "customer_id"), "transaction_id")
           .groupBy("customer_id", "product_id").agg(F.sum("amount").alias("amount"))
           .join(ranked.select("product_id", "category", "prank"), "product_id"))
    per_cat = own.groupBy("customer_id", "category").agg(F.sum("amount").alias("spend"), F.count(F.lit(1)).alias("n_bought"))
    tot = per_cat.groupBy("customer_id").agg(F.sum("spend").alias("total"))
    favs = customers.select("customer_id", F.explode(F.from_json("preferences", "favorite_categories array<string>",
                                                                  )["favorite_categories"]).alias("category")) \
        .distinct().withColumn("fav", F.lit(True))
    aff = favs.join(per_cat, ["customer_id", "category"], "full_outer").join(tot, "customer_id", "left")
    score = money(F.when(F.col("fav"), F.lit(favorite_weight)).otherwise(F.lit(0.0))
                  + F.coalesce(F.col("spend") / F.col("total"), F.lit(0.0)), 6)
    aff = aff.join(sizes, "category").select(
        "customer_id", "category", score.alias("score"), "listed", F.coalesce("n_bought", F.lit(0)).alias("n_bought"))
    # early stopping: products that strictly better categories still have (a window holds a customer's categories)
    better = Window.partitionBy("customer_id").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("customer_id", "score")
    free = F.col("listed") - F.col("n_bought")
    aff = aff.withColumn("_free", free).withColumn("_before", F.sum("_free").over(better) - F.sum("_free").over(same)) \
        .filter((F.col("_before") < n) & (F.col("_free") > 0))
    # free places: gaps between the ranks of bought products, and the rest of the list behind the last one
    by_rank = Window.partitionBy("customer_id", "category").orderBy("prank")
    gaps = (own.select("customer_id", "category", "prank")
            .select("customer_id", "category", (F.lag("prank", 1, 0).over(by_rank) + 1).alias("start"), (F.col("prank") - 1).alias("stop"),
                    (F.lag("prank", 1, 0).over(by_rank) - F.row_number().over(by_rank) + 1).alias("given")))
    last = own.groupBy("customer_id", "category").agg(F.max("prank").alias("last"))
    inner = gaps.filter((F.col("start") <= F.col("stop")) & (F.col("given") < n)).join(
        aff.select("customer_id", "category", "score"), ["customer_id", "category"])
    tail = aff.join(last, ["customer_id", "category"], "left").withColumn("last", F.coalesce("last", F.lit(0))).select(
        "customer_id", "category", (F.col("last") + 1).alias("start"), F.col("listed").alias("stop"),
        (F.col("last") - F.col("n_bought")).alias("given"), "score").filter((F.col("start") <= F.col("stop")) & (F.col("given") < n))
    places = inner.unionByName(tail).select("customer_id", "category", "score", F.explode(F.sequence(
        F.col("start"), F.least(F.col("stop"), F.col("start") + n - 1 - F.col("given")))).alias("prank"))
    # nearly all customers ask for the first places of a list
    salts = F.ceil(customers.agg(F.count(F.lit(1))).scalar() / ASKING).cast("int")
    hot = F.col("prank") <= 2 * n
    asked = places.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("customer_id"), F.greatest(salts, F.lit(1)))).otherwise(F.lit(0)).cast("int"))
    lists = ranked.select("category", "prank", "product_id", "units", F.explode(F.when(
        hot, F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)).otherwise(F.array(F.lit(0)))).alias("salt"))
    cand = asked.join(lists, ["category", "prank", "salt"])
    w = Window.partitionBy("customer_id").orderBy(F.desc("score"), F.desc("units"), "product_id")
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(
        "customer_id", F.col("rank").cast("long").alias("rank"), "product_id", "category", "score")
