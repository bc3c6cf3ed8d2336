"""Stores behind a snapshot pointer: replace under readers, the upsert store
with retired logs and crashes, the levelled index."""

import os
import shutil
import tempfile
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlake.operators import rag as G
from cartlake.queries import rag as QR
from cartlake.sources import snapshots as P
from cartlake.sources.tables import Tables
from cartlake.streaming import stores as ST
from conftest import SF_SMALL


def fresh(name):
    return tempfile.mkdtemp(prefix=f"cartlake-{name}-")


# ---------------------------------------------------------------- pointer, tables

def test_pointer_rotates(spark):
    root = fresh("pointer")
    assert P.latest(spark, root) == (0, {})
    for v in range(P.SLOTS + 2):
        assert P.publish(spark, root, v, {"v": v}) == v + 1
        assert P.latest(spark, root) == (v + 1, {"v": v})
    assert len(os.listdir(root + "/_pointer")) == P.SLOTS


def test_reader_during_replace_sees_old_or_new(spark):
    root, name = fresh("table"), "cartlake_replaced"
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    P.create_or_replace(spark, name, schema, root, spark.range(100).selectExpr("id", "'old'"))
    held = spark.table(name)                # a reader that began with version 1
    seen, stop = [], threading.Event()

    def reader():
        while not stop.is_set():
            try:
                seen.append(tuple(sorted((r.v, r["count"]) for r in spark.table(name).groupBy("v").count().collect())))
            except Exception as e:          # noqa: BLE001
                seen.append(("error", str(e)[:200]))
    thread = threading.Thread(target=reader)
    thread.start()
    try:
        for n in range(5):
            P.create_or_replace(spark, name, schema, root, spark.range(10 * n + 1).selectExpr("id", f"'v{n}'"))
    finally:
        stop.set()
        thread.join()
    allowed = {(("old", 100),), *(((f"v{n}", 10 * n + 1),) for n in range(5))}
    assert seen and set(seen) <= allowed
    assert {r.v for r in held.collect()} == {"old"}
    assert P.read(spark, root, schema).count() == 41 and spark.table(name).schema == schema
    spark.sql(f"DROP VIEW {name}")


def test_replace_with_other_schema_and_empty(spark):
    root, name = fresh("table"), "cartlake_reshaped"
    P.create_or_replace(spark, name, T.StructType([T.StructField("a", T.LongType())]), root, spark.range(3))
    two = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.DoubleType())])
    P.create_or_replace(spark, name, two, root)
    assert spark.table(name).schema == two and spark.table(name).count() == 0
    with pytest.raises(ValueError):
        P.create_or_replace(spark, name, two, root, spark.range(3))
    spark.sql(f"DROP VIEW {name}")


# ---------------------------------------------------------------- upsert store

def entries(spark, rows):
    return spark.createDataFrame([("k", "u", key, value, seq, value is None) for key, value, seq in rows], ST.ENTRY)


def put(spark, log, batch, rows):
    entries(spark, rows).write.mode("overwrite").parquet(f"{log}/batch_id={batch}")


def state(spark, log, root):
    return {r.mem_key: (r.value, r.seq) for r in ST.store_now(spark, log, root).collect()}


def test_store_keeps_all_keys_when_logs_are_retired(spark):
    d = fresh("store")
    log, root = d + "/log", d + "/store"
    assert state(spark, log, root) == {}
    put(spark, log, 0, [("a", "1", 1), ("b", "1", 2), ("gone", "1", 3)])
    put(spark, log, 1, [("a", "2", 4), ("gone", None, 5)])
    assert state(spark, log, root) == {"a": ("2", 4), "b": ("1", 2)}
    assert ST.compact_log(spark, log, root) == 1
    shutil.rmtree(log)                                          # the folded batches are retired
    assert state(spark, log, root) == {"a": ("2", 4), "b": ("1", 2)}
    put(spark, log, 2, [("c", "9", 6), ("b", "0", 0), ("gone", "late", 4)])     # two of them older than what is stored
    assert state(spark, log, root) == {"a": ("2", 4), "b": ("1", 2), "c": ("9", 6)}
    assert ST.compact_log(spark, log, root) == 2
    shutil.rmtree(log)
    assert state(spark, log, root) == {"a": ("2", 4), "b": ("1", 2), "c": ("9", 6)}
    assert ST.compact_log(spark, log, root) == 2                # nothing to fold
    put(spark, log, 3, [("gone", "back", 7)])
    assert state(spark, log, root)["gone"] == ("back", 7)


def test_crash_between_write_and_swap_loses_nothing(spark, monkeypatch):
    d = fresh("store")
    log, root = d + "/log", d + "/store"
    put(spark, log, 0, [("a", "1", 1)])
    ST.compact_log(spark, log, root)
    put(spark, log, 1, [("a", "2", 2), ("b", "1", 3)])
    before = P.latest(spark, root)

    def crash(*_):
        raise RuntimeError("stopped before the pointer")
    monkeypatch.setattr(P, "publish", crash)
    with pytest.raises(RuntimeError):
        ST.compact_log(spark, log, root)
    monkeypatch.undo()
    assert P.latest(spark, root) == before
    assert state(spark, log, root) == {"a": ("2", 2), "b": ("1", 3)}
    assert ST.compact_log(spark, log, root) == 2
    # a batch that is written again after it was folded changes nothing
    put(spark, log, 1, [("a", "2", 2), ("b", "1", 3)])
    assert state(spark, log, root) == {"a": ("2", 2), "b": ("1", 3)}


# ---------------------------------------------------------------- levelled index

def embedder(df, col, out):
    return G.embed(df, 16, col, out)


def chunks(spark, docs):
    return spark.createDataFrame([(f"{d}-{i}", d, c) for d, cs in docs.items() for i, c in enumerate(cs)],
                                 "chunk_id string, doc_name long, content string")


def snapshot(spark, docs):
    rows = [(f"{d}-{i}", d, c) for d, cs in docs.items() for i, c in enumerate(cs)] + [(None, d, None) for d, cs in docs.items() if not cs]
    return spark.createDataFrame(rows, "chunk_id string, doc_name long, content string")


def test_levels_reach_every_snapshot_and_read_few_files(spark, monkeypatch):
    monkeypatch.setattr(ST, "FANOUT", 2)
    root = fresh("index")
    docs = {d: [f"text {d} {i}" for i in range(3)] for d in range(200)}
    ST.create_index(spark, embedder(chunks(spark, docs), "content", "embedding"), root, buckets=16)
    for batch in range(ST.FANOUT ** 2 + 1):
        d = (batch * 37) % 200
        change = {d: [] if batch % 5 == 4 else [f"batch {batch}", *docs[d][1:], f"more {batch}"], 1000 + batch: ["new"]}
        docs |= change
        folders = ST.sync_batch(spark, root, batch, snapshot(spark, change), embedder)
        # two documents: at most two buckets of any run
        state = P.latest(spark, root)[1]
        assert len({f.rsplit("/", 1)[1] for f in folders}) <= 2
        assert ST.sync_batch(spark, root, batch, snapshot(spark, change), embedder) == []      # replayed
    levels = [r["level"] for r in state["runs"]]
    assert sorted(levels) == [0, 2, ST.TOP]                     # 5 batches: one run of 4, one left, the base
    now = {(r.chunk_id, r.doc_name, r.content) for r in ST.index_now(spark, root).collect()}
    assert now == {(f"{d}-{i}", d, c) for d, cs in docs.items() for i, c in enumerate(cs)}
    total = len(ST._read_runs(spark, root, state, [ST._run_folder(root, r["run"]) for r in state["runs"]]).inputFiles())
    asked = spark.createDataFrame([(37,), (5000,)], "doc_name long")
    some = ST._read_runs(spark, root, state, ST.may_hold(spark, root, state, asked))
    assert 0 < len(some.inputFiles()) < total / 8
    assert some.filter("doc_name = 37").select("chunk_id").distinct().count() == 4      # none is missed
    never = ST.may_hold(spark, root, state, spark.createDataFrame([(10 ** 9,)], "doc_name long"))
    assert never == []


def test_base_drops_deletes(spark, monkeypatch):
    monkeypatch.setattr(ST, "TOP", 1)
    monkeypatch.setattr(ST, "FANOUT", 2)
    root = fresh("index")
    docs = {d: [f"text {d}"] for d in range(10)}
    ST.create_index(spark, embedder(chunks(spark, docs), "content", "embedding"), root, buckets=4)
    for batch, d in enumerate([3, 4, 3, 5]):
        docs[d] = [] if batch < 2 else [f"again {batch}"]
        ST.sync_batch(spark, root, batch, snapshot(spark, {d: docs[d]}), embedder)
    state = P.latest(spark, root)[1]
    rows = ST._read_runs(spark, root, state, [ST._run_folder(root, r["run"]) for r in state["runs"]])
    assert len(state["runs"]) == 1 and rows.filter("action = 'delete'").count() == 0
    assert {r.doc_name for r in ST.index_now(spark, root).collect()} == set(range(10)) - {4}


def test_index_sync_stream_reaches_the_snapshot(spark):
    """Micro-batches of whole documents, removed ones as a row without chunk."""
    t = Tables(spark, SF_SMALL)
    old, new = QR.para_chunks(QR.docs(t)), QR.para_chunks(QR.new_docs(t))
    d = fresh("sync")
    ST.create_index(spark, G.embed(old, dim=16), d + "/index")
    gone = old.select("doc_name").distinct().join(new.select("doc_name").distinct(), "doc_name", "left_anti")
    snap = new.select("doc_name", "chunk_id", "content").unionByName(gone, allowMissingColumns=True)
    for k in range(3):
        snap.filter(F.col("doc_name") % 3 == k).coalesce(1).write.mode("append").parquet(d + "/new")
    read = {}
    source = spark.readStream.schema(snap.schema).option("maxFilesPerTrigger", 1).parquet(d + "/new")
    ST.index_sync_stream(source, d + "/index", d + "/ckpt", embedder, read.__setitem__).awaitTermination()
    assert sorted(read) == [0, 1, 2]
    state = P.latest(spark, d + "/index")[1]
    log = ST._read_runs(spark, d + "/index", state, [ST._run_folder(d + "/index", f"b{k}") for k in range(3)])
    want = {r.chunk_id: r.action for r in ST.index_changes(old, new, embedder).collect()}
    assert {"insert", "update", "delete"} <= set(want.values())
    assert {r.chunk_id: r.action for r in log.collect()} == want
    assert log.filter("(action = 'delete') <> (embedding IS NULL)").count() == 0
    now = ST.index_now(spark, d + "/index")
    assert {(r.chunk_id, r.content) for r in now.collect()} == {(r.chunk_id, r.content) for r in new.collect()}
    # the source has nothing new: a restart reads no run
    ST.index_sync_stream(source, d + "/index", d + "/ckpt", embedder, read.__setitem__).awaitTermination()
    assert sorted(read) == [0, 1, 2]
