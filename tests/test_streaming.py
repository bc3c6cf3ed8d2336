"""Each streaming operator, run over a parquet file source in several
micro-batches, equals its batch twin."""

import glob
import os
import shutil
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from cartlake.sources import streamdata as SD
from cartlake.sources import tables as T
from cartlake.sources.tables import Tables
from cartlake.streaming import stateful as SF
from cartlake.streaming import stores as ST
from cartlake.streaming import streams as S
from conftest import SF_SMALL


def _rows(df, cols=None):
    cols = cols or sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)


@pytest.fixture(scope="module")
def chunk_dir(spark):
    d = tempfile.mkdtemp(prefix="cartlake-stream-")
    # event-time ordered files, as a log source delivers them: the file source
    # takes files in modification-time order, so write the slices one by one
    chunks = T.stream_chunk(Tables(spark, SF_SMALL)).withColumn("slice", F.dayofmonth("ts") / 8)
    chunks = chunks.withColumn("slice", F.floor("slice"))
    for k in range(5):
        chunks.filter(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(d + "/chunks")
        time.sleep(1.1)
    Tables(spark, SF_SMALL).events.repartition(4).write.parquet(d + "/events")
    return d


def _stream(spark, path, batch):
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


CHUNKS = [(S.assemble_text, "assemble"), (S.outcome, "outcome"), (S.ttl_sessions, "ttl")]


def _closed_sessions_equal_batch(spark, name, op, stream, batch):
    """Append mode emits a session once the watermark has passed its end:
    what came out is the batch result, without the sessions still open."""
    _run(op(stream, watermark="10 minutes"), "append", name)
    got, exp = spark.table(name), op(batch)
    cols = sorted(exp.columns)
    max_ts = batch.agg(F.max("ts")).first()[0]
    limit = F.lit(max_ts) - F.expr("INTERVAL 2 HOURS")
    assert got.count() > 0
    assert set(_rows(got, cols)) <= set(_rows(exp, cols))
    assert set(_rows(exp.filter(F.col("session_start") < limit), cols)) <= set(_rows(got, cols))


@pytest.mark.parametrize("op,name", CHUNKS)
def test_session_stream_equals_batch(spark, chunk_dir, op, name):
    batch = spark.read.parquet(chunk_dir + "/chunks")
    _closed_sessions_equal_batch(spark, f"s_{name}", op, _stream(spark, chunk_dir + "/chunks", batch), batch)


@pytest.fixture(scope="module")
def ordered_events(spark):
    """Events in event-time order over several files."""
    d = tempfile.mkdtemp(prefix="cartlake-events-") + "/e"
    ev = Tables(spark, SF_SMALL).events.withColumn("slice", F.floor(F.dayofmonth("ts") / 8))
    for k in range(5):
        ev.filter(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(d)
        time.sleep(1.1)
    return d


@pytest.mark.parametrize("op,rows,name", [(S.trace_id, SD.raw_events, "trace"), (S.active_stream, SD.registrations, "active")])
def test_event_session_stream_equals_batch(spark, ordered_events, op, rows, name):
    ev = spark.read.parquet(ordered_events)
    _closed_sessions_equal_batch(spark, f"s_{name}", op, rows(_stream(spark, ordered_events, ev)), rows(ev))


def test_stateless_streams(spark, chunk_dir):
    ev = spark.read.parquet(chunk_dir + "/events")
    for name, op, rows in (("done", S.done_items, SD.raw_events), ("items", S.agent_items, SD.agent_updates),
                           ("decision", S.resume_decision, SD.endings)):
        _run(op(rows(_stream(spark, chunk_dir + "/events", ev))), "append", f"s_{name}")
        assert _rows(spark.table(f"s_{name}")) == _rows(op(rows(ev)))


def test_expand_and_resume_streams(spark, chunk_dir):
    t = Tables(spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="cartlake-results-")
    SD.results(t).repartition(3).write.parquet(d + "/r")
    batch = spark.read.parquet(d + "/r")
    _run(S.expand_parts(_stream(spark, d + "/r", batch)), "append", "s_expand")
    assert _rows(spark.table("s_expand")) == _rows(S.expand_parts(batch))
    chunks = spark.read.parquet(chunk_dir + "/chunks")
    chats = T.chat(t)
    asked = chats.select(F.col("id").alias("chat_id"), "user_id", F.lit(2).alias("cursor"))
    active = chats.filter("id % 2 = 0").select(F.col("id").alias("chat_id"), (F.col("id") % 20).alias("stream_id"))
    _run(S.resume(_stream(spark, chunk_dir + "/chunks", chunks), asked, active, chats), "append", "s_resume")
    exp = S.resume(chunks, asked, active, chats)
    assert _rows(spark.table("s_resume")) == _rows(exp) and exp.count() > 0


def test_resume_rules(spark):
    chunks = spark.createDataFrame([("s1", i, "text-delta", str(i)) for i in range(4)], "stream_id string, seq long, type string, delta string")
    active = spark.createDataFrame([(1, "s1"), (9, "s1")], "chat_id long, stream_id string")
    chats = spark.createDataFrame([(1, 7, "private"), (2, 7, "public")], "id long, user_id long, visibility string")
    asked = spark.createDataFrame([(1, 7, 2), (1, 8, 0), (2, 7, 0), (9, 5, None)], "chat_id long, user_id long, cursor long")
    got = sorted((r.chat_id, r.user_id, r.seq) for r in S.resume(chunks, asked, active, chats).collect())
    # the owner from the cursor on; a stranger not; no active stream: nothing; a chat not stored yet: all
    assert got == [(1, 7, 2), (1, 7, 3)] + [(9, 5, i) for i in range(4)]


def test_approval_stream_equals_batch_in_any_order(spark, chunk_dir):
    """Several unordered files: the state keeps what later rows may need."""
    ev = spark.read.parquet(chunk_dir + "/events")
    final = {}

    def keep(df, _bid):
        for r in df.collect():
            final[r.request_id] = (r.request_id, r.state, r.action)

    st = S.approval_state_stream(SD.approval_events(_stream(spark, chunk_dir + "/events", ev)), "60 days")
    q = st.writeStream.foreachBatch(keep).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(q.recentProgress) > 2
    exp = {r.request_id: (r.request_id, r.state, r.action) for r in S.approval_state(SD.approval_events(ev)).collect()}
    assert final == exp


def test_upsert_stream_log_compacts_to_batch(spark):
    t = Tables(spark, SF_SMALL)
    log = T.memory_log(t)
    d = tempfile.mkdtemp(prefix="cartlake-upsert-")
    log.repartition(3).write.parquet(d + "/in")
    q = S.upsert_stream(_stream(spark, d + "/in", log), d + "/log", d + "/ckpt")
    q.awaitTermination()
    written = spark.read.parquet(d + "/log").drop("batch_id")
    assert _rows(S.upsert_store(written)) == _rows(S.upsert_store(log))
    entry = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema)
    assert _rows(ST.store_now(spark, d + "/log", d + "/store", entry)) == _rows(S.upsert_store(log))
    ST.compact_log(spark, d + "/log", d + "/store", entry)
    assert _rows(ST.store_now(spark, d + "/log", d + "/store", entry)) == _rows(S.upsert_store(log))


def test_assembly_on_list_state_equals_batch(spark, chunk_dir):
    batch = spark.read.parquet(chunk_dir + "/chunks")
    _closed_sessions_equal_batch(spark, "s_assembly", lambda df, **kw: S.assemble_text_stream(df, **kw) if kw else S.assemble_text(df),
                                 _stream(spark, chunk_dir + "/chunks", batch), batch)


def test_assembly_survives_a_restart(spark, chunk_dir):
    """Stopped after every file and begun again from its checkpoint."""
    batch, d = spark.read.parquet(chunk_dir + "/chunks"), tempfile.mkdtemp(prefix="cartlake-restart-")
    out = []
    for k in range(5):
        files = sorted(glob.glob(chunk_dir + "/chunks/part-*.parquet"), key=os.path.getmtime)
        os.makedirs(d + "/in", exist_ok=True)
        shutil.copy(files[k], d + "/in/")
        q = S.assemble_text_stream(spark.readStream.schema(batch.schema).parquet(d + "/in")).writeStream \
            .foreachBatch(lambda df, _: out.extend(map(tuple, df.select(*COLS).collect()))) \
            .option("checkpointLocation", d + "/ckpt").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    exp = set(_rows(S.assemble_text(batch), COLS))
    assert len(out) == len(set(out)) and set(out) <= exp and len(out) > len(exp) / 2


COLS = ["n_deltas", "session_start", "stream_id", "text"]


def test_late_rows_are_counted(spark):
    """One row behind the watermark is dropped, and counted as dropped."""
    d = tempfile.mkdtemp(prefix="cartlake-late-") + "/in"
    shape = "stream_id long, seq long, ts timestamp_ntz, type string, delta string"
    for hour, minute in (("10", "00"), ("12", "00"), ("09", "00"), ("13", "00")):
        spark.createDataFrame([(1, 1, f"2024-01-01 {hour}:{minute}:00", "text-delta", "x")], shape.replace("timestamp_ntz", "string")) \
            .withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(d)
        time.sleep(1.1)
    batch = spark.read.parquet(d)
    told = []
    counter = SF.LateRows(lambda name, batch_id, n: told.append((name, n)))
    spark.streams.addListener(counter)
    try:
        for name, op in (("late_ttl", S.ttl_sessions), ("late_text", S.assemble_text_stream)):
            _run(op(_stream(spark, d, batch), watermark="10 minutes"), "append", name)
            for _ in range(100):
                if counter.dropped.get(name):
                    break
                time.sleep(0.1)
    finally:
        spark.streams.removeListener(counter)
    assert counter.dropped == {"late_ttl": 1, "late_text": 1} and sorted(told) == [("late_text", 1), ("late_ttl", 1)]
    assert sorted(str(r.session_start) for r in spark.table("late_text").collect()) == ["2024-01-01 10:00:00", "2024-01-01 12:00:00"]
