"""DuckDB-side adapter views (same definitions as cartlake.sources.tables)."""

from __future__ import annotations

from ..sources.tables import ODD_PAYLOADS

ODD = "[" + ", ".join(f"'{x}'" for x in ODD_PAYLOADS) + f"][event_id % {len(ODD_PAYLOADS)} + 1]"

ADAPTERS = {
    "customers": """SELECT c_custkey AS customer_id, c_name AS name, n_name AS city, r_name AS state,
  CASE WHEN c_acctbal < 3500 THEN 'Bronze' WHEN c_acctbal < 6500 THEN 'Silver'
       WHEN c_acctbal < 8500 THEN 'Gold' ELSE 'Platinum' END AS membership_tier,
  concat('{"dietary":["d', CAST(c_custkey % 3 AS VARCHAR), '"],"favorite_categories":["',
         CASE c_custkey % 3 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'PROMO' ELSE 'SMALL' END,
         '"],"organic_preference":', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END, '}') AS preferences
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "products": """SELECT p_partkey AS product_id, p_name AS name, p_type AS category, p_brand AS brand,
  p_retailprice AS price, (p_size * 7) % 50 AS stock_quantity FROM part""",
    "transactions": """SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_orderkey % (SELECT count(*) FROM supplier) AS store_id,
  o_orderdate AS transaction_date, o_totalprice AS total_amount,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'credit_card' WHEN '2-HIGH' THEN 'debit_card'
    WHEN '3-MEDIUM' THEN 'cash' WHEN '5-LOW' THEN 'gift_card' ELSE 'mobile_pay' END AS payment_method,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'refunded' ELSE 'pending' END AS status
FROM orders""",
    "transaction_items": """SELECT l_orderkey AS transaction_id, l_partkey AS product_id, l_suppkey AS supplier_id,
  l_linenumber AS line_number, l_quantity AS quantity,
  l_extendedprice / l_quantity AS unit_price, l_extendedprice * l_discount AS discount FROM lineitem""",
    "stores": """SELECT s_suppkey AS store_id, s_name AS name, n_name AS city, r_name AS state,
  CASE WHEN s_suppkey % 2 = 0 THEN '07:00-22:00' ELSE '08:00-21:00' END AS hours
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "payment_history": """SELECT DISTINCT o_custkey AS customer_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'credit_card' WHEN '2-HIGH' THEN 'debit_card'
    WHEN '3-MEDIUM' THEN 'cash' WHEN '5-LOW' THEN 'gift_card' ELSE 'mobile_pay' END AS payment_method
FROM orders""",
    "chat": """SELECT conv_id AS id, TIMESTAMP '2024-01-01 00:00:00' + CAST(conv_id % 3650 AS INT) * INTERVAL '1' DAY AS created_at,
  conv_id // 10 AS user_id, CASE WHEN conv_id % 4 = 0 THEN 'public' ELSE 'private' END AS visibility
FROM conversations GROUP BY conv_id""",
    "message": """SELECT conv_id * 1048576 + turn AS id, conv_id AS chat_id, role, text,
  TIMESTAMP '2024-01-01 00:00:00' + CAST(conv_id % 3650 AS INT) * INTERVAL '1' DAY
    + CAST(turn AS INT) * INTERVAL '1' MINUTE AS created_at,
  CASE WHEN turn % 3 = 2 THEN NULL
       ELSE concat('tr-', CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) END AS trace_id
FROM conversations""",
    "vote_log": """SELECT conv_id * 1048576 + turn AS message_id, conv_id AS chat_id, 1 AS seq, (conv_id + turn) % 2 = 0 AS is_up
FROM conversations WHERE role = 'assistant'
UNION ALL
SELECT conv_id * 1048576 + turn, conv_id, 2, (conv_id + turn) % 2 <> 0
FROM conversations WHERE role = 'assistant' AND conv_id % 3 = 0""",
    "memory_log": """SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'user_memories' WHEN 'click' THEN 'task_summaries'
  ELSE 'conversation_summaries' END AS ns_kind, user_id AS ns_user,
  substr(md5(props), 1, 2) AS mem_key, props AS value, event_type = 'error' AS is_delete FROM events""",
    "spans": """SELECT concat(CAST(user_id AS VARCHAR), '-', CAST(CAST(ts AS DATE) AS VARCHAR)) AS trace_id, event_id AS span_id,
  CASE event_type WHEN 'view' THEN 'sql_query' WHEN 'purchase' THEN 'get_user_memory'
    WHEN 'signup' THEN 'get_current_time' ELSE 'policy_search' END AS name,
  CASE event_type WHEN 'signup' THEN 'LLM' WHEN 'click' THEN 'RETRIEVER' ELSE 'TOOL' END AS span_type,
  ts AS start_time, value AS duration_ms,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status FROM events""",
    "stream_chunk": """SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, ts,
  CASE event_type WHEN 'signup' THEN 'text-start' WHEN 'purchase' THEN 'finish'
    WHEN 'error' THEN 'error' ELSE 'text-delta' END AS type, props AS delta FROM events""",
    "sse_line": """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'data: [DONE]' WHEN event_id % 7 = 0 THEN 'data: {'
  WHEN event_id % 11 = 0 THEN ': ping'
  WHEN event_id % 13 = 0 THEN concat('data: ', @ODD@) ELSE concat('data: ', props) END AS line FROM events""".replace("@ODD@", ODD),
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the adapter CTEs it uses."""
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS (\n{ADAPTERS[n]}\n)" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
