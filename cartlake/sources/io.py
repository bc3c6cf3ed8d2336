"""Sources, sinks and catalog operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .snapshots import create_or_replace

def markdown_docs(spark: SparkSession, path: str, suffix: str = ".md") -> DataFrame:
    """Whole files under ``path`` whose name ends with ``suffix``; doc_name
    is the file name without the suffix (an empty file is no document). Order is irrelevant downstream (chunk
    ids depend on the document name and position only), so nothing is sorted.
    A corpus that is not a file a document: packed.packed_docs."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter=f"*{suffix}")
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\Q" + suffix + r"\E$", "")
    return df.select(name.alias("doc_name"), F.col("value").alias("text"))


def write_overwrite(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Overwrite ``path`` with ``df``; the row count is observed during the
    same job (no second pass over the data)."""
    obs = Observation("rows")
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").format(fmt).save(path)
    return int(obs.get["rows"])


def append_accounted(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """One atomic append job (no row batches); returns the rows landed."""
    obs = Observation("rows")
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("append").format(fmt).save(path)
    return int(obs.get["rows"])


def create_table(spark: SparkSession, name: str, schema: T.StructType, root: str, rows: DataFrame | None = None) -> DataFrame:
    """Create-or-replace a table with an explicit schema, holding ``rows``
    (by position, cast to it); readers see the old or the new one, never none
    (sources/snapshots.py)."""
    create_or_replace(spark, name, schema, root, rows)
    return spark.table(name)


def table_check(spark: SparkSession, names: list[str]) -> DataFrame:
    """Existence of every required table (metadata only) plus an all-present row."""
    rows = [(n, bool(spark.catalog.tableExists(n))) for n in names]
    rows.append(("*", all(e for _, e in rows)))
    return spark.createDataFrame(rows, "table string, present boolean")


def table_columns(df: DataFrame) -> DataFrame:
    """Column name/type list of a DataFrame or table (schema metadata)."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields if not f.name.startswith("#")]
    return df.sparkSession.createDataFrame(rows, "name string, type string")


def catalog_inventory(spark: SparkSession, max_schemas: int | None = None, skip=("information_schema",)) -> DataFrame:
    """Tables with their columns, and the functions, of the databases (all of
    them unless ``max_schemas`` is given; skipped ones count towards it)."""
    rows = []
    for db in spark.catalog.listDatabases()[:max_schemas]:
        if db.name in skip:
            continue
        for t in spark.catalog.listTables(db.name):
            name = t.name if t.isTemporary else f"{db.name}.{t.name}"
            rows.extend(("table", db.name, t.name, c.name, c.dataType) for c in spark.catalog.listColumns(name))
        rows.extend(("function", db.name, f.name, None, f.className)
                    for f in spark.catalog.listFunctions(db.name) if not f.isTemporary and f.namespace)
    return spark.createDataFrame(rows, "kind string, schema string, name string, column string, detail string")


def spans_recent(spans: DataFrame, now: Column, interval: str = "1 HOUR") -> DataFrame:
    """Spans started within ``interval`` before ``now`` (a literal bound, so
    the predicate is pushed into the scan)."""
    return spans.filter(F.col("start_time") > now - F.expr(f"INTERVAL {interval}"))


def sse_payloads(lines: DataFrame, col: str = "line") -> DataFrame:
    """``data: `` lines except ``[DONE]``, parsed as JSON; unparsable and
    falsy payloads (null, any zero, "", false) are dropped."""
    body = F.col(col).substr(F.lit(7), F.length(col))
    keep = F.col(col).startswith("data: ") & (F.col(col) != "data: [DONE]")
    parsed = lines.filter(keep).select("*", body.alias("payload"), F.try_parse_json(body).alias("v"))
    kind = F.schema_of_variant("v")
    falsy = (F.is_variant_null("v") | (F.try_variant_get("v", "$", "boolean") == F.lit(False)) & (kind == "BOOLEAN")
             | (F.try_variant_get("v", "$", "string") == "") & (kind == "STRING")
             | (F.try_variant_get("v", "$", "double") == 0) & ~kind.isin("STRING", "BOOLEAN"))
    return parsed.filter(F.col("v").isNotNull() & ~F.coalesce(falsy, F.lit(False))).drop("v")
