"""Keyed history of every source over the life of a stream.

The state of a source is the time of its last row and its last vectors, in the state store;
nothing of it is read or written again for sources that a micro-batch has no rows of. An
event-time timer drops the state of a source once the watermark is ``idle`` past its last
row. Rows are taken in arrival order of batches and time order within one.

The rows that one source sends in one micro-batch are held in one task, next to its ``tail``
vectors. A hot source is thus bounded by the batch: limit it with the source's
``maxFilesPerTrigger`` or ``maxBytesPerTrigger``, or take ``jobs.stream_history``, which slices
the rows of a source over tasks but writes its tails anew with each batch. Rows behind the
watermark are dropped and counted like in the windows.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from emberlog.durable import fresh_path
from emberlog.operators.embeddings import ROLLING, WINDOWS, _window_stats

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_in_rocksdb(spark):
    """Queries started here keep their state in RocksDB; the session's own setting comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class SourceHistory(StatefulProcessor):
    """Gap to the row before and, with vectors, their figures against the rows before."""

    def __init__(self, windows, exclude_self, idle_ms, with_vectors):
        self.windows, self.exclude_self, self.idle_ms, self.with_vectors = windows, exclude_self, idle_ms, with_vectors
        self.tail = max(windows) if with_vectors else 0

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", "us long")
        if self.with_vectors:
            self.vectors = handle.getListState("vectors", "vec array<double>")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["row_us", "row_key"], kind="stable")
        us = pdf["row_us"].to_numpy(np.int64)
        before = self.last.get() if self.last.exists() else None
        gaps = np.diff(us, prepend=us[0] if before is None else before[0])
        out = pd.DataFrame({"key": pdf["row_key"].to_numpy(), "by": [key[0]] * len(pdf), "gap": gaps / 1e6})
        if self.with_vectors:
            held = [v[0] for v in self.vectors.get()] if self.vectors.exists() else []
            m = np.array([*held, *pdf["row_vec"]], dtype=np.float64)
            at = np.arange(len(held), len(m))
            figures = [_window_stats(m, at, w, 1, self.exclude_self) for w in self.windows]
            out = pd.concat([out, pd.DataFrame(np.concatenate(figures, axis=1))], axis=1)
            self.vectors.put([(v.tolist(),) for v in m[-self.tail :]])
        newest = int(us.max() if before is None else max(us.max(), before[0]))
        self.last.update((newest,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest // 1000 + self.idle_ms)
        out.columns = ["key", "by", "gap", *self.names()]
        yield out

    def names(self):
        return [f"{n}_{w}" for w in self.windows for n in ROLLING] if self.with_vectors else []

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        if self.with_vectors:
            self.vectors.clear()
        return iter(())

    def close(self):
        pass


def keyed_history(stream, vec=None, windows=WINDOWS, exclude_self=True, watermark="10 minutes", idle_seconds=86_400,
                  by="source", ts="ts", key="log_id"):
    """Streaming table of ``key``, ``by``, ``gap`` in seconds (0 on a source's first row) and the vector figures."""
    # names without a leading underscore: the worker gets rows as named tuples
    rows = stream.withWatermark(ts, watermark).select(
        F.col(by).alias("row_by"), F.col(ts), F.col(key).alias("row_key"), F.unix_micros(ts).alias("row_us"),
        *([F.transform(F.col(vec), lambda x: x.cast("double")).alias("row_vec")] if vec else []))
    worker = SourceHistory(tuple(windows), exclude_self, int(idle_seconds * 1000), bool(vec))
    types = {n: stream.schema[n].dataType.simpleString() for n in (key, by)}
    schema = ", ".join([f"key {types[key]}", f"by {types[by]}", "gap double", *[f"{n} double" for n in worker.names()]])
    out = rows.groupBy("row_by").transformWithStateInPandas(worker, schema, "append", "EventTime")
    return out.withColumnsRenamed({"key": key, "by": by})


def run_history(stream, path=None, **options):
    """Process what is there; the result table so far. A second run with the same ``path`` goes on with the state."""
    spark = stream.sparkSession
    path = path or fresh_path(spark, "history")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/out/id={batch_id}")

    with state_in_rocksdb(spark):
        query = (
            keyed_history(stream, **options).writeStream.option("checkpointLocation", f"{path}/checkpoint")
            .foreachBatch(keep).trigger(availableNow=True).start())
        query.awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("id")


def kept_sources(spark, path, by="source"):
    """Sources that the state store of a run holds, with the time of their last row."""
    held = spark.read.format("statestore").option("stateVarName", "last").load(f"{path}/checkpoint")
    return held.select(F.col("key.row_by").alias(by), F.timestamp_micros("value.us").alias("last_ts"))
