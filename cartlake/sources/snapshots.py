"""Snapshots behind one pointer.

Data is written to folders of its own first; then one small row, the pointer,
says which folders make up the present version. A reader takes the newest
pointer and with it a version that no later commit changes; a writer that
stops between data and pointer leaves the old version in force.

Pointers rotate through SLOTS folders: a new one replaces the oldest, never
the newest, so there is a whole one at any moment and their number stays
bounded. There is one writer at a time (a streaming query, or a job between
its triggers); folders no pointer names may be retired by the store's own
lifecycle rules."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLOTS = 8
POINTER = "version long, state string"


def pointer_path(root: str) -> str:
    return f"{root.rstrip('/')}/_pointer"


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """(version, state) of the newest pointer; (0, {}) where there is none."""
    try:
        # a slot may be replaced while it is read: it is the oldest one then
        rows = spark.read.schema(POINTER).option("ignoreMissingFiles", "true").json(pointer_path(root))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    newest = rows.groupBy().agg(F.max(F.struct("version", "state")).alias("p")).first().p
    return (newest.version, json.loads(newest.state)) if newest else (0, {})


def publish(spark: SparkSession, root: str, version: int, state: dict) -> int:
    """Make ``state`` the version after ``version``."""
    row = spark.createDataFrame([(version + 1, json.dumps(state))], POINTER).coalesce(1)
    row.write.mode("overwrite").json(f"{pointer_path(root)}/slot={(version + 1) % SLOTS}")
    return version + 1


def new_folder(root: str, kind: str) -> str:
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex[:12]}"


def create_or_replace(spark: SparkSession, name: str, schema: T.StructType, root: str, rows: DataFrame | None = None) -> int:
    """Create or replace the table ``name`` with an explicit schema: ``rows``
    (none: an empty table), by position and cast to it, are written first, then
    the pointer moves and the catalog entry is exchanged by one ALTER. A
    reader sees the old or the new table, and keeps the one it began with."""
    if rows is None:
        rows = spark.createDataFrame([], schema)
    if len(rows.columns) != len(schema.fields):
        raise ValueError(f"{len(rows.columns)} columns for {len(schema.fields)}")
    rows = rows.toDF(*schema.fieldNames()).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    folder, (version, _) = new_folder(root, "table"), latest(spark, root)
    rows.write.parquet(folder)
    version = publish(spark, root, version, {"folders": [folder]})
    columns = ", ".join(f"`{f.name}`" for f in schema.fields)
    body = f"AS SELECT {columns} FROM parquet.`{folder}`"
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER VIEW {name} {body}")
    else:
        spark.sql(f"CREATE VIEW {name} {body}")
    return version


def read(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """The present version of a table."""
    folders = latest(spark, root)[1].get("folders", [])
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
