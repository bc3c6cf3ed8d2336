"""Sources, sinks and catalog (SRC) bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..plans.session import scratch_path
from ..sources import io as IO
from ..sources import tables as T
from ..sources.packed import pack_documents, packed_docs
from ..sources.tables import Tables, ts_ntz
from .views import with_views as W

Q = {}
NOW = "2024-01-15 12:00:00"


def reg(name, sql=None, views=()):
    def deco(fn):
        Q[name] = (fn, W(sql, *views) if sql else None)
        return fn
    return deco


def _t(s, d):
    return Tables(s, d)


@reg("src_markdown_docs", "SELECT CAST(doc_id AS VARCHAR) AS doc_name, text FROM documents")
def q_markdown(s, d):
    """All documents, packed into files and read back."""
    path = scratch_path(s, "docs")
    pack_documents(_t(s, d).documents, path, "doc_id")
    return packed_docs(s, path)


@reg("src_write_overwrite", "SELECT * FROM transactions", ("transactions",))
def q_write(s, d):
    path = scratch_path(s, "transactions")
    IO.write_overwrite(T.transactions(_t(s, d)).limit(1), path)
    IO.write_overwrite(T.transactions(_t(s, d)), path)
    return s.read.parquet(path)


@reg("src_append_accounted", "SELECT * FROM transaction_items UNION ALL SELECT * FROM transaction_items", ("transaction_items",))
def q_append(s, d):
    t, path = _t(s, d), scratch_path(s, "items")
    IO.append_accounted(T.transaction_items(t), path)
    IO.append_accounted(T.transaction_items(t), path)
    return s.read.parquet(path)


@reg("src_create_table", """SELECT concat('ITEM-', CAST(transaction_id AS VARCHAR), '-', CAST(line_number AS VARCHAR)) AS item_id,
  CAST(transaction_id AS VARCHAR) AS transaction_id, CAST(product_id AS VARCHAR) AS product_id, CAST(quantity AS INTEGER) AS quantity,
  unit_price, discount FROM transaction_items""", ("transaction_items",))
def q_create(s, d):
    return s.table(_created(s, d))


def _created(s, d):
    path = scratch_path(s, "tbl")
    name = "cartlake_items_" + path[-12:]           # a table of its own for every run
    t = T.transaction_items(_t(s, d))
    rows = t.select(F.concat(F.lit("ITEM-"), F.col("transaction_id").cast("string"), F.lit("-"), F.col("line_number").cast("string")),
                    "transaction_id", "product_id", "quantity", "unit_price", "discount")
    IO.create_table(s, name, schemas.RETAIL["transaction_items"], path)             # empty at first
    IO.create_table(s, name, schemas.RETAIL["transaction_items"], path, rows)       # and replaced
    return name


@reg("src_table_check")
def q_check(s, d):
    return IO.table_check(s, [_created(s, d), "cartlake_missing_table"])


@reg("src_table_columns")
def q_columns(s, d):
    return IO.table_columns(T.transactions(_t(s, d)))


@reg("src_catalog_inventory")
def q_inventory(s, d):
    T.transactions(_t(s, d)).createOrReplaceTempView("cartlake_transactions_view")
    return IO.catalog_inventory(s)


@reg("src_spans_recent", f"SELECT * FROM spans WHERE start_time > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR", ("spans",))
def q_recent(s, d):
    return IO.spans_recent(T.spans(_t(s, d)), ts_ntz(NOW), "1 HOUR")


@reg("src_sse_payloads", """SELECT event_id, line, substr(line, 7) AS payload FROM sse_line
WHERE starts_with(line, 'data: ') AND line <> 'data: [DONE]' AND coalesce(json_valid(substr(line, 7)), false)
  AND CASE json_type(substr(line, 7)) WHEN 'NULL' THEN false WHEN 'BOOLEAN' THEN CAST(substr(line, 7) AS BOOLEAN)
    WHEN 'VARCHAR' THEN json_extract_string(substr(line, 7), '$') <> '' WHEN 'ARRAY' THEN true WHEN 'OBJECT' THEN true
    ELSE CAST(json_extract_string(substr(line, 7), '$') AS DOUBLE) <> 0 END""", ("sse_line",))
def q_sse(s, d):
    return IO.sse_payloads(T.sse_line(_t(s, d)))


QUERIES = Q
