"""Synthetic data (GEN) bindings: the driver tables supply the row keys, so
generation grows with them; every pick is reproduced in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gen as G
from ..sources.tables import Tables
from .views import with_views as W

Q = {}


def reg(name, sql=None, views=()):
    def deco(fn):
        Q[name] = (fn, W(sql, *views) if sql else None)
        return fn
    return deco


def _t(s, d):
    return Tables(s, d)


# ------------------------------------------------------------------ SQL side

def pick(key: str, salt: str, n) -> str:
    return f"(CAST(('0x' || substr(md5(concat(CAST({key} AS VARCHAR), ':{salt}')), 1, 8)) AS BIGINT) % ({n}))"


def uni(key: str, salt: str, lo: int, hi: int) -> str:
    return f"({pick(key, salt, hi - lo + 1)} + {lo})"


def lit_list(values) -> str:
    body = "[" + ", ".join(repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'" for v in values) + "]"
    return f"CAST({body} AS DOUBLE[])" if all(isinstance(v, float) for v in values) else body


def choose(key: str, salt: str, values) -> str:
    return f"{lit_list(values)}[{pick(key, salt, len(values))} + 1]"


def weighted(key: str, salt: str, values, weights) -> str:
    u = pick(key, salt, sum(weights))
    acc, parts = 0, []
    for v, w in zip(values, weights):
        acc += w
        parts.append(f"WHEN {u} < {acc} THEN '{v}'")
    return "CASE " + " ".join(parts) + " END"


def sample(key: str, salt: str, values, k: str) -> str:
    return (f"list_transform(list_sort(list_transform({lit_list(values)}, lambda v: {{'h': md5(concat(CAST({key} AS VARCHAR), "
            f"':{salt}:', v)), 'v': v}}))[1:{k}], lambda s: s.v)")


def money_sql(x: str) -> str:
    return f"(floor(({x}) * 100 + 0.5) / 100)"


CITY_NAMES, STATE_NAMES = [c for c, _ in G.CITIES], [s for _, s in G.CITIES]


def customers_sql(src="customer", key="c_custkey + 1"):
    c = pick("i", "city", len(G.CITIES))
    return f"""SELECT i, printf('CUST-%04d', i) AS customer_id, {choose('i', 'first', G.FIRST_NAMES)} AS first_name,
  {choose('i', 'last', G.LAST_NAMES)} AS last_name, {lit_list(CITY_NAMES)}[{c} + 1] AS city, {lit_list(STATE_NAMES)}[{c} + 1] AS state,
  {weighted('i', 'tier', G.MEMBERSHIP_TIERS, G.TIER_WEIGHTS)} AS membership_tier,
  DATE '2020-01-01' + CAST({uni('i', 'join', 0, 1800)} AS INTEGER) AS join_date,
  to_json({{'dietary': {sample('i', 'diet', G.DIETARY, uni('i', 'ndiet', 0, 2))},
            'favorite_categories': {sample('i', 'fav', G.FAVORITES, uni('i', 'nfav', 1, 3))},
            'organic_preference': {pick('i', 'organic', 2)} = 1}})::VARCHAR AS preferences
FROM (SELECT {key} AS i FROM {src})"""


def products_sql():
    n_base = len(G.CATEGORIES) * G.BASE_PER_CATEGORY
    base = f"(CASE WHEN i <= {n_base} THEN i - 1 ELSE {pick('i', 'base', n_base)} END)"
    return f"""SELECT i, printf('PROD-%04d', i) AS product_id,
  concat(CASE WHEN i > {n_base} THEN {choose('i', 'variation', G.VARIATIONS)} ELSE '' END, {lit_list(G.CATEGORIES)}[cat + 1], ' item ',
    CAST(b % {G.BASE_PER_CATEGORY} + 1 AS VARCHAR)) AS name,
  {lit_list(G.CATEGORIES)}[cat + 1] AS category, concat('brand_', CAST(b % 25 AS VARCHAR)) AS brand,
  CASE WHEN i > {n_base} THEN {money_sql(f"bp * (0.8 + {pick('i', 'factor', 70001)} / 100000.0::DOUBLE)")} ELSE bp END AS price,
  CAST({uni('i', 'stock', 0, 500)} AS INTEGER) AS stock_quantity, CAST(cat + 1 AS INTEGER) AS aisle,
  {choose('b', 'unit', G.UNITS)} AS unit
FROM (SELECT i, b, CAST(floor(b / {G.BASE_PER_CATEGORY}) AS BIGINT) AS cat,
    {money_sql(f"{uni('b', 'price', 0, G.BASE_PRICE_SPAN)} + {G.BASE_PRICE_MIN} - 0.02::DOUBLE")} AS bp
  FROM (SELECT p_partkey + 1 AS i, {base.replace('i', 'p_partkey + 1')} AS b FROM part))"""


def transactions_sql():
    return f"""SELECT i, printf('TXN-%05d', i) AS transaction_id,
  printf('CUST-%04d', {pick('i', 'cust', '(SELECT count(*) FROM customer)')} + 1) AS customer_id,
  printf('STORE-%02d', {pick('i', 'store', '(SELECT count(*) FROM supplier)')} + 1) AS store_id,
  TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST({uni('i', 'day', 0, 440)} AS INTEGER)) + to_hours(CAST({uni('i', 'hour', 7, 21)} AS INTEGER))
    + to_minutes(CAST({uni('i', 'minute', 0, 59)} AS INTEGER)) AS transaction_date,
  {choose('i', 'pay', G.PAYMENT_METHODS)} AS payment_method, {weighted('i', 'status', G.STATUSES, G.STATUS_WEIGHTS)} AS status,
  CAST({uni('i', 'nitems', 2, 8)} AS INTEGER) AS n_items
FROM (SELECT o_orderkey + 1 AS i FROM orders)"""


PHONE_SQL = (f"concat({choose('i', 'area', G.AREA_CODES)}, '-', CAST({uni('i', 'ph1', 1000, 9999)} AS VARCHAR), '-', "
             f"CAST({uni('i', 'ph2', 1000, 9999)} AS VARCHAR))")
ZIP_SQL = f"concat(CAST({uni('i', 'zip1', 100, 999)} AS VARCHAR), '-', CAST({uni('i', 'zip2', 1000, 9999)} AS VARCHAR))"
ADDRESS_SQL = (f"concat({choose('i', 'street', G.STREETS)}, CAST({uni('i', 'a1', 1, 30)} AS VARCHAR), '-', "
               f"CAST({uni('i', 'a2', 1, 20)} AS VARCHAR), '-', CAST({uni('i', 'a3', 1, 15)} AS VARCHAR))")


def items_sql():
    line = "concat(CAST(x.i AS VARCHAR), ':', CAST(x.j AS VARCHAR))"
    pick_j = "(CAST(('0x' || substr(md5(concat(CAST(i AS VARCHAR), ':item:', CAST(e[1] AS VARCHAR))), 1, 8)) AS BIGINT) % (e[1] + 1))"
    return f"""WITH txns AS ({transactions_sql()}), products AS ({products_sql()}),
tx AS (SELECT i, transaction_id, (SELECT count(*) FROM part) AS np, least(n_items, (SELECT count(*) FROM part)) AS n FROM txns),
t AS (SELECT *, sum(n) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) - n AS item_base,
  list_reduce(list_transform(range(np - n, np), lambda v: [v]),
    lambda a, e: list_append(a, CASE WHEN list_contains(a, {pick_j}) THEN e[1] ELSE {pick_j} END), []::BIGINT[]) AS ps FROM tx WHERE n > 0),
x AS (SELECT i, transaction_id, item_base, unnest(range(0, n)) AS j, unnest(ps) AS p FROM t)
SELECT printf('ITEM-%06d', CAST(x.item_base + x.j + 1 AS BIGINT)) AS item_id, x.transaction_id, printf('PROD-%04d', x.p + 1) AS product_id,
  CAST({uni(line, 'qty', 1, 5)} AS DOUBLE) AS quantity, pr.price AS unit_price, {choose(line, 'disc', G.DISCOUNTS)} AS discount
FROM x JOIN products pr ON pr.product_id = printf('PROD-%04d', x.p + 1)"""


# ------------------------------------------------------------------ Spark side

def customers(t):
    return G.gen_customers(t.customer.select((F.col("c_custkey") + 1).alias("i")))


def products(t):
    return G.gen_products(t.part.select((F.col("p_partkey") + 1).alias("i")))


def transactions(t):
    n_c = t.customer.agg(F.count(F.lit(1))).scalar()
    n_s = t.supplier.agg(F.count(F.lit(1))).scalar()
    return G.gen_transactions(t.orders.select((F.col("o_orderkey") + 1).alias("i")), n_c, n_s)


def items(t):
    n_p = t.part.agg(F.count(F.lit(1))).scalar()
    return G.gen_transaction_items(transactions(t), products(t), n_p)


@reg("gen_customers", customers_sql())
def q_customers(s, d):
    return customers(_t(s, d))


@reg("gen_contact_fields", f"""WITH c AS ({customers_sql()})
SELECT *, concat('user', {choose('i', 'sep', G.EMAIL_SEPS)}, substr(md5(concat(first_name, last_name)), 1, 8),
    CASE WHEN {pick('i', 'numq', 2)} = 0 THEN '' ELSE CAST({uni('i', 'num', 1, 99)} AS VARCHAR) END, '@', {choose('i', 'domain', G.EMAIL_DOMAINS)}) AS email,
  {PHONE_SQL} AS phone, {ZIP_SQL} AS zip_code, {ADDRESS_SQL} AS address
FROM c""")
def q_contact(s, d):
    return G.gen_contact_fields(customers(_t(s, d)))


@reg("gen_products", products_sql())
def q_products(s, d):
    return products(_t(s, d))


@reg("gen_stores", f"""SELECT i, printf('STORE-%02d', i) AS store_id, concat('store ', CAST(i AS VARCHAR)) AS name,
  {lit_list(CITY_NAMES)}[i % {len(G.CITIES)} + 1] AS city, {lit_list(STATE_NAMES)}[i % {len(G.CITIES)} + 1] AS state,
  {ADDRESS_SQL} AS address, {ZIP_SQL} AS zip_code, {PHONE_SQL} AS phone, '9:00～22:00' AS hours FROM (SELECT s_suppkey + 1 AS i FROM supplier)""")
def q_stores(s, d):
    return G.gen_stores(_t(s, d).supplier.select((F.col("s_suppkey") + 1).alias("i")))


@reg("gen_transactions", transactions_sql())
def q_transactions(s, d):
    return transactions(_t(s, d))


@reg("gen_transaction_items", items_sql())
def q_items(s, d):
    return items(_t(s, d))


@reg("gen_txn_total", f"""WITH it AS ({items_sql()})
SELECT transaction_id, {money_sql(f"sum({money_sql('quantity * unit_price - discount')})")} AS total_amount FROM it GROUP BY transaction_id""")
def q_total(s, d):
    return G.gen_txn_total(items(_t(s, d)))


@reg("gen_payments", f"""WITH c AS ({customers_sql()}),
p AS (SELECT i, printf('PAY-%04d', i) AS payment_id, printf('CUST-%04d', {pick('i', 'pcust', '(SELECT count(*) FROM customer)')} + 1) AS customer_id,
  {choose('i', 'method', G.PAYMENT_METHODS)} AS payment_method, DATE '2024-01-01' + CAST({uni('i', 'created', 0, 440)} AS INTEGER) AS created_date
  FROM (SELECT c_custkey + 1 AS i FROM customer))
SELECT p.payment_id, p.customer_id, p.payment_method,
  CASE WHEN p.payment_method IN ('credit_card', 'debit_card') THEN CAST({uni('p.i', 'last4', 1000, 9999)} AS VARCHAR) END AS card_last4,
  concat(c.state, c.city, {choose('p.i', 'bstreet', G.STREETS)}, CAST({uni('p.i', 'b1', 1, 30)} AS VARCHAR), '-', CAST({uni('p.i', 'b2', 1, 20)} AS VARCHAR),
    '-', CAST({uni('p.i', 'b3', 1, 15)} AS VARCHAR)) AS billing_address, p.created_date
FROM p JOIN c USING (customer_id)""")
def q_payments(s, d):
    t = _t(s, d)
    n_c = t.customer.agg(F.count(F.lit(1))).scalar()
    return G.gen_payments(t.customer.select((F.col("c_custkey") + 1).alias("i")), customers(t), n_c)


QUERIES = Q
