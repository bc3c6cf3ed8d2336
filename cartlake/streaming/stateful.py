"""Stateful stream operators on the arbitrary-state API (state variables and
event-time timers, kept in RocksDB), and the count of late rows."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
APPROVAL_TIMEOUT_MS = 24 * 3600 * 1000


def use_rocksdb(spark: SparkSession) -> None:
    """State on disk of the executors, with checkpoints in the shared folder;
    the state API needs it, and state outgrows the heap otherwise."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class LateRows(StreamingQueryListener):
    """Counts the rows that stateful operators dropped because they came after
    the watermark (as the operators see them: an aggregation has merged the
    rows of a key within a task before). ``spark.streams.addListener(LateRows())``."""

    def __init__(self, report=None):
        self.dropped: dict[str, int] = {}
        self.report = report

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        late = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        key = p.name or str(p.id)
        self.dropped[key] = self.dropped.get(key, 0) + late
        if late and self.report:
            self.report(key, p.batchId, late)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def millis(ts) -> int:
    import pandas as pd

    return pd.Timestamp(ts).value // 1_000_000


class Approvals(StatefulProcessor):
    """Per request: the latest request's seq (value state) and the decisions
    after it (list state), so rows may come in any order and any number of
    batches; all is dropped a day after the last event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.request = handle.getValueState("request", "seq long")
        self.decisions = handle.getListState("decisions", "seq long, kind string")
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        request = self.request.get()[0] if self.request.exists() else -1
        decisions = dict(self.decisions.get()) if self.decisions.exists() else {}
        latest = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            latest = max(latest, millis(pdf["ts"].max()))
            for seq, kind in zip(pdf["seq"], pdf["kind"]):
                if kind == "requested":
                    request = max(request, int(seq))
                else:
                    decisions[int(seq)] = kind
        kept = [(s, k) for s, k in sorted(decisions.items()) if s > request]
        self.request.update((request,))
        if kept:
            self.decisions.put(kept)
        elif self.decisions.exists():
            self.decisions.clear()
        until = latest + APPROVAL_TIMEOUT_MS
        before = self.until.get()[0] if self.until.exists() else None
        if before is None or until > before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(until)
            self.until.update((until,))
        if request >= 0:
            state = kept[0][1] if kept else "pending"
            yield pd.DataFrame({"request_id": [key[0]], "state": [state],
                                "action": [{"approved": "continue", "denied": "stop"}.get(state, "wait")]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.request.clear()
        self.decisions.clear()
        self.until.clear()
        yield from ()

    def close(self) -> None:
        pass


def approval_state_stream(ev: DataFrame, watermark: str) -> DataFrame:
    """Streaming twin of the approval state machine (events with their time
    ``ts``; update mode): a request's present state whenever it gets rows."""
    use_rocksdb(ev.sparkSession)
    ev = ev.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return ev.groupBy("request_id").transformWithStateInPandas(
        statefulProcessor=Approvals(), outputStructType="request_id long, state string, action string",
        outputMode="Update", timeMode="EventTime")


class Assembly(StatefulProcessor):
    """Per stream: its deltas (list state), cut into sessions by gaps over
    ``ttl``; a session is emitted, in the order of its deltas, and forgotten
    when the watermark has passed its end (timer)."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "ms long, micros long, seq long, spoken boolean, delta string")

    def sessions(self, rows):
        """Rows by time, in lists that end where a gap over ttl follows."""
        found = []
        for r in sorted(rows, key=lambda r: r[1]):
            if found and r[1] <= found[-1][-1][1] + self.ttl * 1000:
                found[-1].append(r)
            else:
                found.append([r])
        return found

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        new = []
        for pdf in rows:
            for ts, seq, kind, delta in zip(pdf["ts"], pdf["seq"], pdf["type"], pdf["delta"]):
                micros = ts.value // 1000
                new.append((micros // 1000, micros, int(seq), kind == "text-delta", delta))
        self.rows.appendList(new)
        for session in self.sessions(self.rows.get()):
            self.handle.registerTimer(session[-1][0] + self.ttl)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now, kept, out = expiredTimerInfo.getExpiryTimeInMs(), [], []
        for session in self.sessions(self.rows.get() if self.rows.exists() else []):
            if session[-1][0] + self.ttl > now:
                kept += session
                continue
            spoken = sorted((r[2], r[4]) for r in session if r[3])
            out.append((key[0], pd.Timestamp(session[0][1], unit="us"), "".join(d or "" for _, d in spoken), len(spoken)))
        if kept:
            self.rows.put(kept)
        elif self.rows.exists():
            self.rows.clear()
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "session_start", "text", "n_deltas"])

    def close(self) -> None:
        pass


def assemble_text_stream(chunks: DataFrame, ttl_ms: int, watermark: str) -> DataFrame:
    """Streaming twin of ``assemble_text`` (append mode)."""
    use_rocksdb(chunks.sparkSession)
    key = chunks.schema["stream_id"].dataType.simpleString()
    chunks = chunks.select("stream_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "type", "delta").withWatermark("ts", watermark)
    out = chunks.groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=Assembly(ttl_ms),
        outputStructType=f"stream_id {key}, session_start timestamp, text string, n_deltas int",
        outputMode="Append", timeMode="EventTime")
    return out.withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
