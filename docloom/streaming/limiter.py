"""Fixed windows that start at a key's first hit: as a batch, and as a stream whose state goes away with its window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "key string, ts timestamp, hits int, allowed boolean"
#: What transformWithState needs of a session.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _numbered(ts: np.ndarray, start: int | None, n: int, width: int) -> tuple[np.ndarray, int | None, int]:
    """Numbers of ascending times (microseconds) in windows of a key whose last window began at start and has n hits; then that window's start and hits."""
    out, at = np.zeros(len(ts), np.int64), 0
    while at < len(ts):
        if start is None or ts[at] >= start + width:
            start, n = int(ts[at]), 0
        end = int(np.searchsorted(ts, start + width, "left"))
        out[at:end] = n + 1 + np.arange(end - at)
        n, at = n + end - at, end
    return out, start, n


def limited(hits: DataFrame, seconds: float, most: int) -> DataFrame:
    """SCHEMA for hits (key, ts): the hit's number in its window, and whether it is allowed.

    Hits are dealt by key, sorted, and stream by: between batches only the open window's start and count are held, so a key of any
    size takes bounded memory; each window costs one search. Null times are left out."""
    width, spark = int(seconds * 1e6), hits.sparkSession
    rows = hits.where("ts is not null").select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "ts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, n, first = None, None, 0, True
        for b in batches:
            if not len(b):
                continue
            keys, ts = b["key"].to_pylist(), b["ts"].cast(pa.int64()).to_numpy()
            out = np.zeros(len(b), np.int64)
            edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for lo, hi in zip(edges, edges[1:]):
                if first or keys[lo] != key:
                    key, start, n, first = keys[lo], None, 0, False
                out[lo:hi], start, n = _numbered(ts[lo:hi], start, n, width)
            yield pa.RecordBatch.from_arrays([b["key"], b["ts"], pa.array(out, pa.int32()), pa.array(out <= most)], ["key", "ts", "hits", "allowed"])

    return dealt.mapInArrow(run, SCHEMA)


class Windows(StatefulProcessor):
    """A key's open window, until the watermark has passed its end."""

    def __init__(self, seconds: float, most: int):
        self.width, self.most = int(seconds * 1e6), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, n long")

    def handleInputRows(self, key, rows, timerValues):
        ts = np.sort(np.concatenate([f["ts"].astype("datetime64[us]").astype("int64").to_numpy() for f in rows]))
        start, n = self.window.get() or (None, 0)  # each call is a message to the JVM: one to read, one to write, two more for a new window
        was = start
        numbers, start, n = _numbered(ts, start, n, self.width)
        self.window.update((start, n))
        if was != start:
            if was is not None:
                self.handle.deleteTimer((was + self.width) // 1000)
            self.handle.registerTimer((start + self.width) // 1000)
        yield pd.DataFrame({"key": key[0], "ts": ts.view("datetime64[us]"), "hits": numbers.astype("int32"), "allowed": numbers <= self.most})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.window.clear()  # a later hit is after this window's end, and begins one of its own
        return iter(())

    def close(self) -> None:
        pass


def limited_stream(hits: DataFrame, seconds: float, most: int, late: str = "1 hour") -> DataFrame:
    """The same over a stream of hits in order of time but for lateness late; what comes later than that is dropped by the watermark.

    The state of a key is its window's start and count; a timer at the window's end takes it away. The session needs PROVIDER."""
    rows = hits.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Windows(seconds, most), SCHEMA, "append", "eventTime")
