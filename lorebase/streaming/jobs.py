"""Structured Streaming: sessions, working memory with a life, incremental reflection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def sessions(events: DataFrame, by: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by gap over a stream; append mode emits a session when the watermark has passed it."""
    w = events.withWatermark(at, late).groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("members"))
    return w.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "members")


def windows(events: DataFrame, at: str, *by: str, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling or sliding counts with a watermark; rows later than it are dropped by contract."""
    g = events.withWatermark(at, late).groupBy(F.window(at, size, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), *by, "n")


LIVE = "owner_id string, key string, value string, at_us bigint, live boolean"


#: Groups that keys are dealt to by a hash; part of a checkpoint, so it stays as it is.
SLOTS = 1024
_HELD = pa.schema([("owner_id", pa.string()), ("key", pa.string()), ("value", pa.string()), ("at_us", pa.int64()), ("ends", pa.int64())])


class LatestValue(StatefulProcessor):
    """The latest value of each key of a slot by event time, until its life is over.

    Value state holds a slot's entries (key, value, time in microseconds, end of life in milliseconds)
    as one Arrow table, since each touch of state and timers costs the same whatever it holds; an
    event-time timer stands at the first end.  A write that is older than what is held changes nothing,
    whenever it comes; of writes at one time the greatest value counts, null least.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "entries binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = self._read()
        now = before.append_column("come", pa.array(np.full(len(before), -1, np.int64)))
        seen = 0
        for frame in rows:
            new = pa.Table.from_pandas(frame[["owner_id", "key", "value", "at_us"]], _HELD.remove(4), preserve_index=False)
            ends = frame["at_us"].to_numpy(np.int64) // 1000 + np.maximum(1, frame["ttl_ms"].to_numpy(np.int64))
            new = new.append_column(_HELD.field(4), pa.array(ends)).append_column("come", pa.array(np.arange(seen, seen + len(frame))))
            seen += len(frame)
            now = _last(pa.concat_tables([now, new]))
        changed = now.filter(pc.greater_equal(now["come"], 0))
        if len(changed):
            self._write(before, now.drop_columns("come"))
            yield _rows(changed, True)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        before = self._read()
        # All that ended, as a timer of each entry's own would tell: those up to the watermark are called.
        over = pc.less_equal(before["ends"], timerValues.getCurrentWatermarkInMs())
        gone = before.filter(over)
        if len(gone):
            self._write(before, before.filter(pc.invert(over)))
            yield _rows(gone.set_column(2, _HELD.field(2), pa.nulls(len(gone), pa.string())), False)

    def close(self) -> None:
        pass

    def _read(self) -> pa.Table:
        held = self.held.get()
        return _HELD.empty_table() if held is None else pa.ipc.open_stream(held[0]).read_all()

    def _write(self, before: pa.Table, now: pa.Table) -> None:
        old, new = (pc.min(t["ends"]).as_py() for t in (before, now))
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        if not len(now):
            self.held.clear()
            return
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, _HELD) as stream:
            stream.write_table(now)
        self.held.update((out.getvalue().to_pybytes(),))


def _last(entries: pa.Table) -> pa.Table:
    """Of each key's entries the last by time and value; of equal ones the one that came first."""
    entries = entries.combine_chunks()
    order = pc.sort_indices(entries, [("owner_id", "ascending"), ("key", "ascending"), ("at_us", "ascending"), ("value", "ascending"), ("come", "descending")], null_placement="at_start")
    entries = entries.take(order)
    owner, key = (_numbered(entries[c]) for c in ("owner_id", "key"))
    ends = np.ones(len(entries), bool)
    ends[:-1] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    return entries.filter(pa.array(ends))


def _numbered(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values, nulls among them, as equal numbers."""
    whole = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return pc.dictionary_encode(whole, null_encoding="encode").indices.to_numpy()


def _rows(entries: pa.Table, live: bool) -> pd.DataFrame:
    return entries.select(["owner_id", "key", "value", "at_us"]).to_pandas().assign(live=live)


def working_memory(writes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Changes of the latest value by (owner_id, key): a live row when a later write comes, one that isn't when its life is over.

    writes: owner_id, key, value, at (event time), ttl_ms (how long it lives from then on); rows
    without a time are left out, and rows later than ``late`` by the watermark.  The session keeps
    state in RocksDB (:func:`stateful`).
    """
    rows = writes.filter(F.col("at").isNotNull()).select(F.col("owner_id").cast("string"), F.col("key").cast("string"), F.col("value").cast("string"), F.col("at").cast("timestamp"), F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), F.col("ttl_ms").cast("bigint"))
    return rows.withColumn("slot", F.pmod(F.xxhash64("owner_id", "key"), F.lit(SLOTS))).withWatermark("at", late).groupBy("slot").transformWithStateInPandas(LatestValue(), LIVE, "append", "eventTime")


def stateful(spark: SparkSession) -> SparkSession:
    """A session of its own whose streaming state lies in RocksDB, as ``transformWithState`` needs."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    return own


def reflect(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, dream: Callable[[int], None] | None = None, every: int = 5) -> StreamingQuery:
    """Reflect on what is new, batch by batch, until nothing is left; every fifth batch also runs ``dream``.

    Which experiences are processed is kept by the checkpoint; the batch id makes a step repeatable.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        step(batch, batch_id)
        if dream is not None and (batch_id + 1) % every == 0:
            dream(batch_id)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reflect_periodically(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 minutes") -> StreamingQuery:
    """A worker that reflects on what has come in, once in each interval, until it is stopped."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that a stream has to give now, written to a table and read back."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
