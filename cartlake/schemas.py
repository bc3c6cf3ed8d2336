"""Declared schemas of the retail store (no inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()


def _st(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


RETAIL = {
    "customers": _st(("customer_id", S), ("first_name", S), ("last_name", S), ("email", S), ("phone", S),
                     ("address", S), ("city", S), ("state", S), ("zip_code", S), ("membership_tier", S),
                     ("join_date", S), ("preferences", S)),
    "products": _st(("product_id", S), ("name", S), ("category", S), ("brand", S), ("price", D),
                    ("stock_quantity", I), ("aisle", I), ("unit", S)),
    "stores": _st(("store_id", S), ("name", S), ("address", S), ("city", S), ("state", S), ("zip_code", S),
                  ("hours", S), ("phone", S)),
    "transactions": _st(("transaction_id", S), ("customer_id", S), ("store_id", S), ("transaction_date", S),
                        ("total_amount", D), ("payment_method", S), ("status", S)),
    "transaction_items": _st(("item_id", S), ("transaction_id", S), ("product_id", S), ("quantity", I),
                             ("unit_price", D), ("discount", D)),
    "payment_history": _st(("payment_id", S), ("customer_id", S), ("payment_method", S), ("card_last4", S),
                           ("billing_address", S), ("created_date", S)),
    "policy_docs_chunked": _st(("chunk_id", S), ("doc_name", S), ("content", S), ("chunk_index", I)),
}

PREFERENCES = "dietary array<string>, favorite_categories array<string>, organic_preference boolean"
