"""Retail (RTL) query bindings over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retail as R
from ..sources import tables as T
from ..sources.tables import Tables, ts_ntz
from .views import with_views as W

# Fixed query parameters (the "question" each query answers).
NOW = "1998-08-15 00:00:00"
BREAKDOWN_START, BREAKDOWN_END = "1998-01-01 00:00:00", "1999-01-01 00:00:00"


def _t(spark, d):
    return Tables(spark, d)


def q_top_products(spark, d):
    t = _t(spark, d)
    return R.top_products(T.transaction_items(t), T.products(t), 5)


SQL_TOP_PRODUCTS = W("""
SELECT s.product_id, p.name, p.category, s.units, s.sales FROM (
  SELECT product_id, (floor((sum(quantity * unit_price - discount)) * 100 + 0.5) / 100) AS sales, sum(quantity) AS units
  FROM transaction_items GROUP BY product_id ORDER BY sales DESC, product_id LIMIT 5) s
JOIN products p USING (product_id)""", "transaction_items", "products")


def q_cheapest(spark, d):
    return R.cheapest_product(T.products(_t(spark, d)))


SQL_CHEAPEST = W("SELECT product_id, name, category, price FROM products ORDER BY price, product_id LIMIT 1", "products")


def q_stock_by_category(spark, d):
    return R.stock_by_category(T.products(_t(spark, d)), "ECONOMY", "small")


SQL_STOCK_BY_CATEGORY = W("""SELECT product_id, name, category, stock_quantity, price FROM products
WHERE category = 'ECONOMY' AND starts_with(name, 'small')""", "products")


def q_variant_price(spark, d):
    # the driver's products all have a prefix; "old" stands for the regular line
    return R.variant_price_compare(T.products(_t(spark, d)), ("old",))


SQL_VARIANT_PRICE = W("""
WITH v AS (SELECT CASE WHEN NOT contains(name, ' ') OR starts_with(name, 'old ') THEN 'regular' ELSE split_part(name, ' ', 1) END AS variant,
  (string_split(name, ' '))[-1] AS base_name, category, price FROM products),
pv AS (SELECT base_name, category, variant, min(price) AS min_price, (floor((avg(price)) * 100 + 0.5) / 100) AS avg_price,
  count(*) AS n_products FROM v GROUP BY ALL),
r AS (SELECT base_name, category, min_price AS regular_price FROM pv WHERE variant = 'regular')
SELECT base_name, category, variant, min_price, avg_price, n_products, regular_price,
  (floor((min_price - regular_price) * 100 + 0.5) / 100) AS premium
FROM pv LEFT JOIN r USING (base_name, category) WHERE variant <> 'regular'""", "products")


def q_spend_month(spark, d):
    return R.customer_spend_month(T.transactions(_t(spark, d)), ts_ntz(NOW))


SQL_SPEND_MONTH = W(f"""SELECT customer_id, (floor((sum(total_amount)) * 100 + 0.5) / 100) AS spend, count(*) AS n_orders FROM transactions
WHERE transaction_date >= date_trunc('month', TIMESTAMP '{NOW}') - INTERVAL 1 MONTH
  AND transaction_date < date_trunc('month', TIMESTAMP '{NOW}') GROUP BY customer_id""", "transactions")


def q_spend_breakdown(spark, d):
    t = _t(spark, d)
    return R.spend_breakdown(T.transactions(t), T.transaction_items(t), T.products(t),
                             ts_ntz(BREAKDOWN_START), ts_ntz(BREAKDOWN_END))


SQL_SPEND_BREAKDOWN = W(f"""
SELECT t.customer_id, p.category, CAST(t.transaction_date AS DATE) AS day,
  (floor((sum(i.quantity * i.unit_price - i.discount)) * 100 + 0.5) / 100) AS spend,
  CAST(GROUPING(t.customer_id, p.category, CAST(t.transaction_date AS DATE)) AS INT) AS level
FROM transactions t JOIN transaction_items i USING (transaction_id) JOIN products p USING (product_id)
WHERE t.transaction_date >= TIMESTAMP '{BREAKDOWN_START}' AND t.transaction_date < TIMESTAMP '{BREAKDOWN_END}'
GROUP BY GROUPING SETS ((t.customer_id, p.category), (t.customer_id, CAST(t.transaction_date AS DATE)), (t.customer_id))""",
                        "transactions", "transaction_items", "products")


def q_store_finder(spark, d):
    return R.store_finder(T.stores(_t(spark, d)), "nation_1")


SQL_STORE_FINDER = W("""SELECT store_id, name, city, state, hours FROM stores
WHERE contains(lower(city), 'nation_1') OR contains(lower(state), 'nation_1') OR contains(lower(name), 'nation_1')""",
                     "stores")


def q_under_price(spark, d):
    return R.products_under_price(T.products(_t(spark, d)), "PROMO", 925.0)


SQL_UNDER_PRICE = W("""SELECT product_id, name, category, price, stock_quantity FROM products
WHERE category = 'PROMO' AND price <= 925.0""", "products")


def q_popular(spark, d):
    t = _t(spark, d)
    return R.popular_in_category(T.transaction_items(t), T.products(t), 3)


SQL_POPULAR = W("""
SELECT category, rank, product_id, name, units FROM (
  SELECT p.category, row_number() OVER (PARTITION BY p.category ORDER BY u.units DESC, u.product_id) AS rank,
    u.product_id, p.name, u.units
  FROM (SELECT product_id, sum(quantity) AS units FROM transaction_items GROUP BY product_id) u
  JOIN products p USING (product_id)) WHERE rank <= 3""", "transaction_items", "products")


def q_last_orders(spark, d):
    return R.last_n_orders(T.transactions(_t(spark, d)), 3)


SQL_LAST_ORDERS = W("""
SELECT customer_id, rank, transaction_id, transaction_date, total_amount, status FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY transaction_date DESC, transaction_id DESC) AS rank
  FROM transactions) WHERE rank <= 3""", "transactions")


def q_order_detail(spark, d):
    t = _t(spark, d)
    return R.order_detail(T.transactions(t), T.transaction_items(t), T.products(t))


SQL_ORDER_DETAIL = W("""
SELECT t.transaction_id, t.customer_id, t.transaction_date, t.status, i.line_number, i.product_id,
  p.name AS product_name, i.quantity, (floor((i.quantity * i.unit_price - i.discount) * 100 + 0.5) / 100) AS amount
FROM transactions t JOIN transaction_items i USING (transaction_id) JOIN products p USING (product_id)""",
                     "transactions", "transaction_items", "products")


def q_payment_methods(spark, d):
    return R.payment_methods(T.payment_history(_t(spark, d)))


SQL_PAYMENT_METHODS = W("""SELECT customer_id, array_to_string(list_sort(list(DISTINCT payment_method)), ',') AS methods,
  bool_or(payment_method = 'mobile_pay') AS has_mobile_pay FROM payment_history GROUP BY customer_id""",
                        "payment_history")


def q_low_stock(spark, d):
    return R.low_stock(T.products(_t(spark, d)), "SMALL", 5)


SQL_LOW_STOCK = W("""SELECT product_id, name, category, stock_quantity FROM products
WHERE category = 'SMALL' AND stock_quantity <= 5""", "products")


def q_status_payment(spark, d):
    return R.status_payment_summary(T.transactions(_t(spark, d)))


SQL_STATUS_PAYMENT = W("""SELECT status, payment_method, count(*) AS n_orders, (floor((sum(total_amount)) * 100 + 0.5) / 100) AS amount
FROM transactions GROUP BY ALL""", "transactions")


def q_profile(spark, d):
    return R.customer_profile(T.customers(_t(spark, d)))


SQL_PROFILE = W("""
SELECT customer_id, name, membership_tier, city,
  array_to_string(from_json(preferences, '{"dietary":["VARCHAR"]}').dietary, ',') AS dietary,
  array_to_string(from_json(preferences, '{"favorite_categories":["VARCHAR"]}').favorite_categories, ',') AS favorite_categories,
  CAST(json_extract(preferences, '$.organic_preference') AS BOOLEAN) AS organic_preference
FROM customers""", "customers")


def q_purchase_history(spark, d):
    t = _t(spark, d)
    return R.purchase_history(T.customers(t, place=False), T.transactions(t), T.transaction_items(t), T.products(t),
                              T.stores(t, place=False))


SQL_PURCHASE_HISTORY = W("""
SELECT c.customer_id, c.name AS customer_name, t.transaction_id, t.transaction_date, s.name AS store_name,
  p.name AS product_name, i.quantity, (floor((i.quantity * i.unit_price - i.discount) * 100 + 0.5) / 100) AS amount
FROM transaction_items i JOIN transactions t USING (transaction_id) JOIN customers c USING (customer_id)
JOIN products p USING (product_id) JOIN stores s ON s.store_id = t.store_id""",
                         "customers", "transactions", "transaction_items", "products", "stores")

WANTED = ["red plate", "small widget", "golden apple", "hot ring"]


def q_availability(spark, d):
    wanted = spark.createDataFrame([(w,) for w in WANTED], "name string")
    return R.item_availability(T.products(_t(spark, d)), wanted)


SQL_AVAILABILITY = W(f"""
WITH wanted AS (SELECT DISTINCT unnest([{", ".join(repr(w) for w in WANTED)}]) AS name),
inv AS (SELECT name, count(*) AS n_products, CAST(sum(CASE WHEN stock_quantity > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_in_stock
  FROM products GROUP BY name)
SELECT w.name, coalesce(n_products, 0) AS n_products, coalesce(n_in_stock, 0) AS n_in_stock,
  coalesce(n_in_stock, 0) > 0 AS available FROM wanted w LEFT JOIN inv USING (name)""", "products")


def q_total_reconcile(spark, d):
    t = _t(spark, d)
    return R.total_reconcile(T.transactions(t), T.transaction_items(t))


SQL_TOTAL_RECONCILE = W("""
WITH s AS (SELECT transaction_id, sum(quantity * unit_price - discount) AS items_total FROM transaction_items GROUP BY 1)
SELECT transaction_id, total_amount, (floor((coalesce(items_total, 0.0)) * 100 + 0.5) / 100) AS items_total,
  (floor((total_amount - coalesce(items_total, 0.0)) * 100 + 0.5) / 100) AS difference
FROM transactions LEFT JOIN s USING (transaction_id)
WHERE abs(total_amount - coalesce(items_total, 0.0)) > 0.01""", "transactions", "transaction_items")


def q_ref_integrity(spark, d):
    t = _t(spark, d)
    return R.ref_integrity(T.customers(t, place=False), T.products(t), T.transactions(t), T.transaction_items(t),
                           T.payment_history(t))


SQL_REF_INTEGRITY = W("""
SELECT 'item_without_transaction' AS "check", CAST(transaction_id AS VARCHAR) AS row_id FROM transaction_items
  WHERE transaction_id NOT IN (SELECT transaction_id FROM transactions)
UNION ALL SELECT 'item_without_product', CAST(product_id AS VARCHAR) FROM transaction_items
  WHERE product_id NOT IN (SELECT product_id FROM products)
UNION ALL SELECT 'transaction_without_customer', CAST(transaction_id AS VARCHAR) FROM transactions
  WHERE customer_id NOT IN (SELECT customer_id FROM customers)
UNION ALL SELECT 'payment_without_customer', CAST(customer_id AS VARCHAR) FROM payment_history
  WHERE customer_id NOT IN (SELECT customer_id FROM customers)""",
                      "customers", "products", "transactions", "transaction_items", "payment_history")


QUERIES = {
    "rtl_top_products": (q_top_products, SQL_TOP_PRODUCTS),
    "rtl_cheapest_product": (q_cheapest, SQL_CHEAPEST),
    "rtl_stock_by_category": (q_stock_by_category, SQL_STOCK_BY_CATEGORY),
    "rtl_variant_price_compare": (q_variant_price, SQL_VARIANT_PRICE),
    "rtl_customer_spend_month": (q_spend_month, SQL_SPEND_MONTH),
    "rtl_spend_breakdown": (q_spend_breakdown, SQL_SPEND_BREAKDOWN),
    "rtl_store_finder": (q_store_finder, SQL_STORE_FINDER),
    "rtl_products_under_price": (q_under_price, SQL_UNDER_PRICE),
    "rtl_popular_in_category": (q_popular, SQL_POPULAR),
    "rtl_last_n_orders": (q_last_orders, SQL_LAST_ORDERS),
    "rtl_order_detail": (q_order_detail, SQL_ORDER_DETAIL),
    "rtl_payment_methods": (q_payment_methods, SQL_PAYMENT_METHODS),
    "rtl_low_stock": (q_low_stock, SQL_LOW_STOCK),
    "rtl_status_payment_summary": (q_status_payment, SQL_STATUS_PAYMENT),
    "rtl_customer_profile": (q_profile, SQL_PROFILE),
    "rtl_purchase_history": (q_purchase_history, SQL_PURCHASE_HISTORY),
    "rtl_item_availability": (q_availability, SQL_AVAILABILITY),
    "rtl_total_reconcile": (q_total_reconcile, SQL_TOTAL_RECONCILE),
    "rtl_ref_integrity": (q_ref_integrity, SQL_REF_INTEGRITY),
}


def q_out_of_stock(spark, d):
    return R.out_of_stock_alternatives(T.products(_t(spark, d)), 3)


SQL_OUT_OF_STOCK = W("""
WITH s AS (SELECT * FROM products WHERE NOT stock_quantity > 0), i AS (SELECT * FROM products WHERE stock_quantity > 0)
SELECT * FROM (SELECT s.product_id, s.category, s.price,
    row_number() OVER (PARTITION BY s.product_id ORDER BY i.price DESC, i.product_id DESC) AS alt_rank,
    i.product_id AS alt_product_id, i.price AS alt_price
  FROM s JOIN i ON i.category = s.category AND round(i.price * 100) <= round(s.price * 100)) WHERE alt_rank <= 3""", "products")

BUDGET = 20000.0


def q_budget(spark, d):
    t = _t(spark, d)
    return R.budget_basket(T.transaction_items(t), T.products(t), BUDGET)


SQL_BUDGET = W(f"""
WITH u AS (SELECT product_id, sum(quantity) AS units FROM transaction_items GROUP BY 1),
pop AS (SELECT p.product_id, p.name, p.category, p.price, coalesce(u.units, 0.0) AS units,
  CAST(round(p.price * 100) AS BIGINT) AS cents FROM products p LEFT JOIN u USING (product_id)),
r AS (SELECT *, row_number() OVER w AS rank, CAST(sum(cents) OVER w AS BIGINT) AS spent FROM pop
  WINDOW w AS (PARTITION BY category ORDER BY units DESC, product_id ROWS UNBOUNDED PRECEDING))
SELECT category, rank, product_id, name, price, CAST(spent AS DOUBLE) / 100.0::DOUBLE AS basket_total FROM r
WHERE spent <= {round(BUDGET * 100)}""", "transaction_items", "products")


def q_recommend(spark, d):
    t = _t(spark, d)
    return R.recommend_preferences(T.customers(t, place=False), T.transactions(t), T.transaction_items(t), T.products(t), 5)


SQL_RECOMMEND = W("""
WITH u AS (SELECT product_id, sum(quantity) AS units FROM transaction_items GROUP BY 1),
pop AS (SELECT p.product_id, p.category, coalesce(u.units, 0.0) AS units FROM products p LEFT JOIN u USING (product_id)),
b AS (SELECT t.customer_id, i.product_id, p.category, i.quantity * i.unit_price - i.discount AS amount
  FROM transaction_items i JOIN transactions t USING (transaction_id) JOIN products p USING (product_id)),
bought AS (SELECT DISTINCT customer_id, product_id FROM b),
pc AS (SELECT customer_id, category, sum(amount) AS spend FROM b GROUP BY ALL),
tot AS (SELECT customer_id, sum(spend) AS total FROM pc GROUP BY 1),
favs AS (SELECT DISTINCT customer_id, unnest(from_json(preferences, '{"favorite_categories":["VARCHAR"]}').favorite_categories) AS category,
  true AS fav FROM customers),
aff AS (SELECT customer_id, category, floor(((CASE WHEN fav THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END)
    + coalesce(spend / total, 0.0::DOUBLE)) * 1000000 + 0.5) / 1000000 AS score
  FROM favs FULL OUTER JOIN pc USING (customer_id, category) LEFT JOIN tot USING (customer_id)),
cand AS (SELECT a.customer_id, p.product_id, p.category, a.score, p.units FROM aff a JOIN pop p USING (category)
  WHERE NOT EXISTS (SELECT 1 FROM bought x WHERE x.customer_id = a.customer_id AND x.product_id = p.product_id))
SELECT customer_id, rank, product_id, category, score FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
  ORDER BY score DESC, units DESC, product_id) AS rank FROM cand) WHERE rank <= 5""",
                  "customers", "transactions", "transaction_items", "products")

QUERIES.update({
    "rtl_out_of_stock_alternatives": (q_out_of_stock, SQL_OUT_OF_STOCK),
    "rtl_budget_basket": (q_budget, SQL_BUDGET),
    "rtl_recommend_preferences": (q_recommend, SQL_RECOMMEND),
})
