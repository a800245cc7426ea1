"""Streams that keep state between runs: high-water marks, trailing frames, file lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pluvia.functions.times import minutes
from pluvia.operators.ordering import keep_last
from pluvia.operators.state import advance_marks, newer_rows

# A batch reads the version before its own, so older ones are not needed again.
KEEP_VERSIONS = 2


def _version(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/version={batch_id}"


def _read_version(
    spark: SparkSession, path: str, batch_id: int, schema: str, initial: DataFrame | None = None
) -> DataFrame:
    if batch_id >= 0:
        return spark.read.schema(schema).parquet(_version(path, batch_id))
    return spark.createDataFrame([], schema) if initial is None else initial


def _forget(spark: SparkSession, path: str, batch_id: int) -> None:
    """Remove the version that no batch can ask for any more."""
    old = batch_id - KEEP_VERSIONS
    if old >= 0:
        folder = spark._jvm.org.apache.hadoop.fs.Path(_version(path, old))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def latest_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The state after the last batch that was written."""
    found = spark.read.schema(f"{schema}, version bigint").parquet(path)
    last = found.agg(F.max("version").alias("version"))
    return found.join(F.broadcast(last), "version").drop("version")


def high_water_batches(
    state_path: str, out_path: str, key: str, ts: str, key_type: str,
    initial: DataFrame | None = None,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: append rows newer than their key's mark, then move the marks.

    Batch ``n`` reads state version ``n - 1`` and writes version ``n``, and its output
    goes to a folder of its own, so a batch that runs again gives the same result.
    The rows of a busy key stay spread over tasks; only marks are kept per key.
    ``initial`` holds the marks before the first batch.
    """
    schema = f"{key} {key_type}, last_update timestamp"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = _read_version(spark, state_path, batch_id - 1, schema, initial)
        batch.persist()  # read for the rows and again for the marks
        fresh = newer_rows(batch, state, key, ts).drop("last_update")
        fresh.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch={batch_id}")
        marks = advance_marks(batch, state, key, ts)
        marks.write.mode("overwrite").parquet(_version(state_path, batch_id))
        batch.unpersist()
        _forget(spark, state_path, batch_id)

    return run


def last_files_batches(
    state_path: str, col: str = "path", n: int = 50
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: keep the ``n`` greatest distinct names seen so far."""

    def run(batch: DataFrame, batch_id: int) -> None:
        known = _read_version(batch.sparkSession, state_path, batch_id - 1, f"{col} string")
        top = keep_last(known.unionByName(batch.select(col)), col, n)
        top.write.mode("overwrite").parquet(_version(state_path, batch_id))
        _forget(batch.sparkSession, state_path, batch_id)

    return run


class HighWaterMarks(StatefulProcessor):
    """Per-key mark: emits rows newer than the mark the batch started with.

    The mark moves once a batch is done and never on rows it rejected.
    """

    def __init__(self, key: str, ts: str):
        self.key, self.ts = key, ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "last_update timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        mark = self.mark.get()[0] if self.mark.exists() else None
        top = mark
        for pdf in rows:
            fresh = pdf if mark is None else pdf[pdf[self.ts] > pd.Timestamp(mark)]
            if not fresh.empty:
                newest = fresh[self.ts].max().to_pydatetime()
                top = newest if top is None or newest > top else top
                yield fresh
        if top is not None and top != mark:
            self.mark.update((top,))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        marks = initialState["last_update"].dropna()
        if not marks.empty:
            self.mark.update((marks.max().to_pydatetime(),))

    def close(self) -> None:
        pass


def high_water_stream(
    stream: DataFrame, key: str, ts: str, initial: DataFrame | None = None
) -> DataFrame:
    """Rows newer than their key's mark, with the mark in keyed state (RocksDB).

    ``initial`` holds the marks (``last_update``) before the first batch.

    A key's rows of one batch pass through one task as a sequence of Arrow chunks;
    where a single key may carry much of the data use :func:`high_water_batches`.
    """
    known = stream.where(F.col(key).isNotNull())
    return known.groupBy(key).transformWithStateInPandas(
        statefulProcessor=HighWaterMarks(key, ts),
        outputStructType=known.schema,
        outputMode="Append",
        timeMode="None",
        initialState=None if initial is None else initial.where(F.col(key).isNotNull()).groupBy(key),
    )


def trailing_frames(
    stream: DataFrame,
    n: int,
    step: int = 10,
    late_minutes: int = 10,
    source: str = "source",
    ts: str = "frame_ts",
    values: str = "values",
) -> DataFrame:
    """Model inputs as frames arrive: each frame with the ``n - 1`` steps before it.

    Every frame sends itself to the ``n`` keys that need it and the keys collect at
    most ``n`` frames, so a busy source spreads over its keys and late frames still
    count. A key is reported when nothing more can arrive for it; ``frames`` holds
    ``lag, frame_ts, values`` newest first, without the missing ones.
    """
    wait = late_minutes + (n - 1) * step
    sent = stream.select(
        F.col(source).alias("source"), F.col(ts).cast("timestamp").alias("frame_ts"),
        F.col(values).alias("values"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("lag"),
    )
    keyed = sent.withColumn("key_ts", F.col("frame_ts") + minutes(F.col("lag") * step))
    keyed = keyed.withWatermark("key_ts", f"{wait} minutes")
    frames = F.sort_array(F.collect_list(F.struct("lag", "frame_ts", "values")))
    samples = keyed.groupBy("source", "key_ts").agg(frames.alias("frames"))
    return samples.where(F.get("frames", F.lit(0))["lag"] == 0)


class TrailingFrames(StatefulProcessor):
    """Frames of one source and stretch of time, by their time; a timer reports each.

    A frame is kept once. When the watermark passes it nothing earlier can arrive, so it goes out
    with the steps before it, and the one that only it still needed is removed. A last timer clears the
    stretch. Times are microseconds, timers milliseconds.
    """

    def __init__(self, n: int, step: int, block: int):
        self.n, self.step, self.block = n, step * 60_000_000, block * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getMapState("frames", "at long", "values array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        for pdf in rows:
            for at, values in zip(pdf["at"].tolist(), pdf["values"], strict=True):
                self.frames.updateValue((at,), (None if values is None else [float(v) for v in values],))
                if at // self.block == key[1]:
                    self.handle.registerTimer(at // 1000)
        self.handle.registerTimer(((key[1] + 1) * self.block + self.n * self.step) // 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if at >= (key[1] + 1) * self.block:
            self.frames.clear()
            return
        lags = [k for k in range(self.n) if self.frames.containsKey((at - k * self.step,))]
        found = [self.frames.getValue((at - k * self.step,))[0] for k in lags]
        yield pd.DataFrame({"source": [key[0]], "at": [at], "lags": [lags], "found": [found]})
        old = (at - (self.n - 1) * self.step,)
        if self.n > 1 and self.frames.containsKey(old):
            self.frames.removeKey(old)

    def close(self) -> None:
        pass


def trailing_frames_state(
    stream: DataFrame,
    n: int,
    step: int = 10,
    late_minutes: int = 10,
    source: str = "source",
    ts: str = "frame_ts",
    values: str = "values",
    block_minutes: int = 1440,
) -> DataFrame:
    """:func:`trailing_frames` with every frame once in keyed state (RocksDB).

    A source is cut into stretches of ``block_minutes``, so that a busy one spreads over many keys; only
    the last ``n - 1`` steps of a stretch are sent to the next one as well. Times of frames are whole
    milliseconds. A frame that comes again replaces the earlier one.
    """
    block = block_minutes * 60_000_000
    timed = stream.select(
        F.col(source).alias("source"), F.col(ts).cast("timestamp").alias("frame_ts"),
        F.col(values).cast("array<double>").alias("values"),
    ).withWatermark("frame_ts", f"{late_minutes} minutes")
    at = F.unix_micros("frame_ts")
    stretch = lambda t: F.floor(t / F.lit(block)).cast("long")
    reach = F.array_distinct(F.array(stretch(at), stretch(at + F.lit((n - 1) * step * 60_000_000))))
    sent = timed.select("source", F.explode(reach).alias("block"), "frame_ts", at.alias("at"), "values")
    out = sent.where("source is not null and frame_ts is not null").groupBy("source", "block").transformWithStateInPandas(
        statefulProcessor=TrailingFrames(n, step, block_minutes),
        outputStructType="source string, at long, lags array<int>, found array<array<double>>",
        outputMode="Append",
        timeMode="EventTime",
    )
    moment = lambda lag: F.timestamp_micros(F.col("at") - lag.cast("long") * F.lit(step * 60_000_000))
    pairs = F.zip_with("lags", "found", lambda lag, v: F.struct(
        lag.alias("lag"), moment(lag).alias("frame_ts"), v.alias("values")
    ))
    return out.select("source", F.timestamp_micros("at").alias("key_ts"), pairs.alias("frames"))
