"""Change streams: a stateful fold of file operations, and event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.sources import store

# What the kinds of events stand for, as in the batch form.
OPS = {"signup": "create", "view": "modify", "click": "modify", "error": "delete", "purchase": "rename"}


def fold(held: str, op: str) -> str:
    """One step of the coalescing of a key's operations; an empty string is none."""
    if not held:
        return op
    if op == "delete":
        return {"create": "", "modify": "delete"}.get(held, held)
    return held


#: Operations as numbers of one byte.
_NAMED = ["create", "modify", "delete", "rename"]
_CODE = {op: i for i, op in enumerate(_NAMED)}


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, seen = state.get if state.exists else ("", 0)
    # Frames are cut by number of rows and come in any order, so the order is that of all of them; a change takes 17 bytes here.
    parts = [(f["ts"].to_numpy(), f["seq"].to_numpy(), np.array([_CODE[op] for op in f["op"]], np.int8)) for f in frames]
    ts, seq, op = (np.concatenate(x) for x in zip(*parts, strict=True))
    for code in op[np.lexsort((seq, ts))].tolist():
        held = fold(held, _NAMED[code])
    seen += len(op)
    state.update((held, seen))
    yield pd.DataFrame({"key": [key[0]], "seen": [seen], "op": [held]})


def coalesce_stream(changes: DataFrame) -> DataFrame:
    """(key, seen, op) after each micro-batch that touches a key; the state is one short row per key.

    The changes of a micro-batch count in the order of time, and after those of the micro-batches before it.
    """
    return changes.groupBy("key").applyInPandasWithState(_step, "key long, seen long, op string", "op string, seen long", "update", GroupStateTimeout.NoTimeout)


class Debounce(StatefulProcessor):
    """Holds a key's changes until none has come for ``quiet`` milliseconds of event time; then what they come to is given out once."""

    def __init__(self, quiet: int) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "op string, n long, last long")

    def _out(self, key: tuple, op: str, n: int, last: int) -> dict:
        return {"key": key[0], "fired": pd.Timestamp(last + self.quiet, unit="ms", tz="UTC"), "n": n, "op": op}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        op, n, last = self.held.get() if self.held.exists() else ("", 0, None)
        before, out = last, []
        for frame in rows:
            for ts, one in frame.sort_values(["ts", "seq"])[["ts", "op"]].itertuples(index=False):
                at = int(ts.timestamp() * 1000)
                if last is not None and at - last >= self.quiet:
                    out.append(self._out(key, op, n, last))
                    op, n = "", 0
                op, n, last = fold(op, one), n + 1, at if last is None else max(last, at)
        self.held.update((op, n, last))
        if before is not None and before != last:
            self.handle.deleteTimer(before + self.quiet)
        if before != last:
            self.handle.registerTimer(last + self.quiet)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.held.exists():
            op, n, last = self.held.get()
            if last + self.quiet <= expiredTimerInfo.getExpiryTimeInMs():
                self.held.clear()
                yield pd.DataFrame([self._out(key, op, n, last)])

    def close(self) -> None:
        pass


#: What keeps the state of ``debounced``: on disk, a file of changes for each micro-batch.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def debounced(changes: DataFrame, quiet: int, late: str = "0 seconds") -> DataFrame:
    """(key, fired, n, op) of a stream (key, ts, seq, op): a burst of changes gives one row when nothing has followed it for ``quiet`` milliseconds.

    Time is that of the events, ``late`` their greatest delay. Timers and the few words held per key are part of the stream's state, so a
    restarted stream neither forgets a burst nor gives one out twice. The session must use ``ROCKS``.
    """
    timed = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    key = changes.schema["key"].dataType.simpleString()
    return timed.groupBy("key").transformWithStateInPandas(Debounce(quiet), f"key {key}, fired timestamp, n long, op string", "append", "EventTime")


def _events(spark: SparkSession, path: str, apart: bool = True) -> DataFrame:
    """The table, a file or a folder of files, as a stream: a micro-batch for each file, or one for all."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if apart:
        stream = stream.option("maxFilesPerTrigger", 1)
    return stream.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, as a stream takes no plain path of one file


def _kind():
    return F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in OPS.items()], F.lit("modify"))


def replayed(spark: SparkSession, path: str) -> DataFrame:
    """The operations left after the whole event table went through the stream.

    Files of a table follow no order of time, so all that are there make one micro-batch. Each micro-batch appends its updates to a
    table (a retried batch overwrites its own folder); the last one of a key counts.
    """
    out = store.scratch(spark, "changes")

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    changes = _events(spark, path, apart=False).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), _kind().alias("op"))
    query = coalesce_stream(changes).writeStream.outputMode("update").option("checkpointLocation", store.scratch(spark, "state")).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    last = spark.read.schema("key long, seen long, op string").parquet(out).groupBy("key").agg(F.max_by("op", "seen").alias("op"))
    return last.where("op <> ''")


#: Milliseconds without a change that end a burst of the replayed events.
QUIET = 3_600_000


def replayed_bursts(spark: SparkSession, path: str) -> DataFrame:
    """The bursts of the event table's changes that have ended when the stream has read all of it."""
    out = store.scratch(spark, "bursts")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    before = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        changes = _events(spark, path).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), _kind().alias("op"))
        query = debounced(changes, QUIET).writeStream.outputMode("append").option("checkpointLocation", store.scratch(spark, "state")).trigger(availableNow=True).foreachBatch(sink).start()
        query.awaitTermination()
    finally:
        spark.conf.set(ROCKS[0], before) if before else spark.conf.unset(ROCKS[0])
    return spark.read.schema("key long, fired timestamp, n long, op string").parquet(out).select("key", F.col("fired").cast("timestamp_ntz").alias("fired"), "n", "op")


def windowed(spark: SparkSession, path: str) -> DataFrame:
    """Events per hour and kind by event time; rows more than a day late are left out, windows come when they close or at the end.

    An extension: the library's model has no event time of its own.
    """
    out = store.scratch(spark, "windows")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    rows = _events(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    counts = rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    flat = counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")
    query = flat.writeStream.outputMode("update").option("checkpointLocation", store.scratch(spark, "state")).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    updates = spark.read.schema("start timestamp, event_type string, n long, total double").parquet(out)
    last = updates.groupBy("start", "event_type").agg(F.max_by("total", "n").alias("total"), F.max("n").alias("n"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
