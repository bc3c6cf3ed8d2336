"""Stores that streams feed: the upsert store (a snapshot and the log not
folded into it yet) and the levelled index of chunk vectors.

Both publish through a snapshot pointer (sources/snapshots.py): what is
written becomes visible at once, and a crash before that leaves the last
version in force."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import snapshots as P

# ------------------------------------------------------------- upsert store

KEYS = ["ns_kind", "ns_user", "mem_key"]
ENTRY = "ns_kind string, ns_user string, mem_key string, value string, seq long, is_delete boolean"


def last_entries(log: DataFrame) -> DataFrame:
    """The latest operation of every key, deletes included."""
    last = log.groupBy(*KEYS).agg(F.max_by(F.struct("value", "is_delete"), "seq").alias("v"), F.max("seq").alias("seq"))
    return last.select(*KEYS, "v.value", "seq", "v.is_delete")


def _not_folded(spark: SparkSession, log_path: str, folded: int, entry: str) -> DataFrame | None:
    """Batches of the log after ``folded``; folders up to it may be gone."""
    from pyspark.errors import AnalysisException

    try:
        log = spark.read.option("basePath", log_path).schema(entry + ", batch_id long").parquet(log_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return log.filter(F.col("batch_id") > folded)


def _entries(spark: SparkSession, log_path: str, state: dict, entry: str) -> list[DataFrame]:
    log = _not_folded(spark, log_path, state.get("folded", -1), entry)
    parts = [spark.read.schema(entry).parquet(*state["folders"])] if state.get("folders") else []
    return parts + ([log.drop("batch_id")] if log is not None else [])


def store_now(spark: SparkSession, log_path: str, root: str, entry: str = ENTRY) -> DataFrame:
    """Live entries: the snapshot and the log behind it, latest per key.
    ``entry`` is the log's schema, where keys have other types."""
    parts = _entries(spark, log_path, P.latest(spark, root)[1], entry) or [spark.createDataFrame([], entry)]
    return last_entries(reduce(DataFrame.unionByName, parts)).filter(~F.col("is_delete")).drop("is_delete")


def compact_log(spark: SparkSession, log_path: str, root: str, entry: str = ENTRY) -> int:
    """Fold the log's batches into a new snapshot and publish it with the last
    folded batch; run between triggers. Folded batches may then be retired.
    Deletes stay as entries, so that an older put arriving later stays deleted.
    Without new batches nothing is written. Returns the version in force."""
    version, state = P.latest(spark, root)
    log = _not_folded(spark, log_path, state.get("folded", -1), entry)
    newest = None if log is None else log.agg(F.max("batch_id")).first()[0]
    if newest is None:
        return version
    new = log.filter(F.col("batch_id") <= newest).drop("batch_id")      # not a batch that came meanwhile
    if state.get("folders"):
        new = spark.read.schema(entry).parquet(*state["folders"]).unionByName(new)
    folder = P.new_folder(root, "store")
    last_entries(new).write.parquet(folder)
    return P.publish(spark, root, version, {"folders": [folder], "folded": int(newest)})


# ------------------------------------------------------------- levelled index

BUCKETS = 64           # of documents, in every run
FANOUT = 4             # runs of a level that are merged into one of the next
TOP = 6                # level of the base run
HASHES = 4             # bits a document sets in its bucket's Bloom filter
FILTER_BITS = 1 << 14  # of a bucket's filter
CHUNK = ["chunk_id", "doc_name", "content", "embedding"]


def _bucket(doc: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int")


def _bits(doc: Column) -> Column:
    """The HASHES positions of a document in a Bloom filter."""
    return F.array_distinct(F.array(*[F.pmod(F.xxhash64(doc, F.lit(k)), F.lit(FILTER_BITS)).cast("int") for k in range(HASHES)]))


def _marks(rows: DataFrame) -> DataFrame:
    """Per bucket its least and greatest document and its Bloom filter, as the
    64-bit words that are not zero."""
    docs = rows.select("bucket", "doc_name").distinct()
    word = docs.select("bucket", F.explode(_bits(F.col("doc_name"))).alias("bit")).groupBy("bucket", (F.col("bit") / 64).cast("int").alias("word")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("bits"))
    edges = docs.groupBy("bucket").agg(F.min("doc_name").alias("low"), F.max("doc_name").alias("high"))
    return word.join(edges, "bucket")


def write_run(rows: DataFrame, root: str, run: str, buckets: int = BUCKETS) -> None:
    """A run: rows (CHUNK, action, batch) in one folder a bucket, sorted by
    document and chunk, and the marks of its buckets."""
    spark = rows.sparkSession
    path = _run_folder(root, run)
    rows = rows.select(*CHUNK, "action", "batch", _bucket(F.col("doc_name"), buckets).alias("bucket"))
    # a run may be written again (a replayed batch): only whole ones are published
    (rows.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(4))).sortWithinPartitions("bucket", "doc_name", "chunk_id")
     .write.mode("overwrite").partitionBy("bucket").parquet(path))
    written = spark.read.schema(rows.schema).option("basePath", path).parquet(path)
    _marks(written).write.mode("overwrite").parquet(f"{root.rstrip('/')}/marks/{run}")


def create_index(spark: SparkSession, index: DataFrame, root: str, buckets: int = BUCKETS) -> int:
    """Version 1 of the index: all chunks in one run of the top level."""
    rows = index.select(*CHUNK, F.lit("insert").alias("action"), F.lit(-1).cast("long").alias("batch"))
    write_run(rows, root, "base", buckets)
    state = {"runs": [{"run": "base", "level": TOP}], "schema": rows.schema.json(), "buckets": buckets, "merges": 0}
    return P.publish(spark, root, 0, state)


def _read_runs(spark: SparkSession, root: str, state: dict, folders: list[str]) -> DataFrame:
    import json

    from pyspark.sql import types as T

    schema = T.StructType.fromJson(json.loads(state["schema"]))
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{root.rstrip('/')}/runs").parquet(*folders)
    return rows.select(*schema.fieldNames())


def _run_folder(root: str, run: str) -> str:
    return f"{root.rstrip('/')}/runs/run={run}"


def live(rows: DataFrame) -> DataFrame:
    """Merge on read: the last change of every chunk, deleted ones dropped."""
    last = rows.groupBy("chunk_id").agg(
        F.max_by(F.struct("doc_name", "content", "embedding", "action", "batch"), "batch").alias("r"))
    return last.filter("r.action <> 'delete'").select("chunk_id", "r.doc_name", "r.content", "r.embedding")


def index_now(spark: SparkSession, root: str) -> DataFrame:
    """The index as of the newest pointer."""
    state = P.latest(spark, root)[1]
    return live(_read_runs(spark, root, state, [_run_folder(root, r["run"]) for r in state["runs"]]))


def may_hold(spark: SparkSession, root: str, state: dict, docs: DataFrame) -> list[str]:
    """Folders (one a run and bucket) that may hold rows of ``docs``
    (doc_name): those whose bounds and Bloom filter admit one of them. The list
    is bounded by runs (FANOUT a level) times buckets."""
    runs = [r["run"] for r in state["runs"]]
    asked = docs.select("doc_name").distinct().select("doc_name", _bucket(F.col("doc_name"), state["buckets"]).alias("bucket"),
                                                      _bits(F.col("doc_name")).alias("places"))
    bits = asked.select("doc_name", "bucket", F.size("places").alias("n"), F.explode("places").alias("bit")) \
        .withColumn("word", (F.col("bit") / 64).cast("int"))
    found = []
    for run in runs:
        marks = spark.read.parquet(f"{root.rstrip('/')}/marks/{run}").withColumn("run", F.lit(run))
        found.append(marks.select("run", "bucket", "word", "bits", "low", "high"))
    met = bits.join(reduce(DataFrame.unionByName, found), ["bucket", "word"]).filter(
        F.col("doc_name").between(F.col("low"), F.col("high")) & (F.expr("shiftright(bits, bit % 64) & 1") == 1))
    whole = met.groupBy("run", "bucket", "doc_name").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("hits")).filter("hits = n")
    return [f"{_run_folder(root, r.run)}/bucket={r.bucket}" for r in whole.select("run", "bucket").distinct().collect()]


def merge_levels(spark: SparkSession, root: str, version: int, state: dict) -> tuple[int, dict]:
    """While a level has FANOUT runs, merge them into one of the next level:
    the last change of each chunk. Deletes stay until they meet the base, in
    the top level."""
    levels: dict[int, list[str]] = {}
    for r in state["runs"]:
        levels.setdefault(r["level"], []).append(r["run"])
    full = next((at for at in sorted(levels) if len(levels[at]) >= FANOUT), None)
    if full is None:
        return version, state
    runs = levels[full]
    rows = _read_runs(spark, root, state, [_run_folder(root, r) for r in runs])
    last = rows.groupBy("chunk_id").agg(
        F.max_by(F.struct("doc_name", "content", "embedding", "action", "batch"), "batch").alias("r"))
    if full == TOP:
        last = last.filter("r.action <> 'delete'")
    merged = f"m{state['merges']}"
    write_run(last.select("chunk_id", "r.doc_name", "r.content", "r.embedding", "r.action", "r.batch"), root, merged, state["buckets"])
    state = state | {"runs": [r for r in state["runs"] if r["run"] not in runs] + [{"run": merged, "level": min(full + 1, TOP)}],
                     "merges": state["merges"] + 1}
    return merge_levels(spark, root, P.publish(spark, root, version, state), state)


def index_changes(old: DataFrame, new: DataFrame, embedder) -> DataFrame:
    """One step of the triggered sync (chunk_id, doc_name, content): the
    change set - one full outer join on chunk_id comparing md5 digests - with
    a vector for every inserted or updated chunk; only these are embedded."""
    o = old.select("chunk_id", F.col("doc_name").alias("old_doc"), F.md5("content").alias("old_md5"))
    n = new.select("chunk_id", F.col("doc_name").alias("new_doc"), F.md5("content").alias("new_md5"), "content")
    j = o.join(n, "chunk_id", "full_outer")
    action = (F.when(F.col("old_md5").isNull(), "insert").when(F.col("new_md5").isNull(), "delete")
              .when(F.col("old_md5") != F.col("new_md5"), "update"))
    j = j.select("chunk_id", F.coalesce("new_doc", "old_doc").alias("doc_name"), action.alias("action"), "content") \
        .filter(F.col("action").isNotNull())
    changed = embedder(j.filter(F.col("action") != "delete"), col="content", out="embedding")
    gone = j.filter(F.col("action") == "delete").withColumn("embedding", F.lit(None).cast(changed.schema["embedding"].dataType))
    return changed.unionByName(gone)


def sync_batch(spark: SparkSession, root: str, batch: int, snapshot: DataFrame, embedder) -> list[str]:
    """Apply one micro-batch (all chunks of the documents it touches; a removed
    document is one row with a null chunk). Reads only the run folders that may
    hold them; returns these folders. A replayed batch changes nothing."""
    version, state = P.latest(spark, root)
    if batch <= state.get("batch", -1):
        return []
    docs = snapshot.select("doc_name").distinct()
    folders = may_hold(spark, root, state, docs)
    old = live(_read_runs(spark, root, state, folders).join(docs, "doc_name", "left_semi"))
    changes = index_changes(old, snapshot.filter(F.col("chunk_id").isNotNull()), embedder)
    run = f"b{batch}"
    write_run(changes.withColumn("batch", F.lit(batch).cast("long")), root, run, state["buckets"])
    state = state | {"runs": [*state["runs"], {"run": run, "level": 0}], "batch": batch}
    merge_levels(spark, root, P.publish(spark, root, version, state), state)
    return folders


def index_sync_stream(snapshots: DataFrame, root: str, checkpoint: str, embedder, seen=None):
    """Triggered sync of document snapshots (doc_name, chunk_id, content) into
    the index at ``root``, a run a micro-batch. ``seen`` is told each batch's
    number and the folders it read."""
    def write(df, batch_id):
        df = df.persist()           # read for its documents and for its chunks
        try:
            folders = sync_batch(df.sparkSession, root, batch_id, df, embedder)
            if seen:
                seen(batch_id, folders)
        finally:
            df.unpersist()
    return (snapshots.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


cloudpickle.register_pickle_by_value(sys.modules[__name__])
