"""Stream queries: one pass over the stored tables, results read back as a table.

A windowed result is reported once its watermark has passed, so the newest windows
of the pass are still open; the SQL texts say so.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions.arrays import map_values
from pluvia.functions.times import minutes
from pluvia.plans import views as V
from pluvia.plans.registry import query
from pluvia.session import ensure_checkpoint_dir
from pluvia.streaming import state as SS
from pluvia.streaming import windows as W


def _folder(spark: SparkSession) -> str:
    """New folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/streams/{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table's files as a stream, whether it is one file or a folder of files.

    A stream source takes a folder or a pattern but no single file, so the table's own path
    is given as a pattern. Reading the schema fails if there is no such table.
    """
    schema = V.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _readings(spark, sf):
    return _stream(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("station_id"), "ts", "value", "event_type"
    )


def _finish(spark: SparkSession, writer) -> None:
    cores = spark.sparkContext.defaultParallelism
    with W.state_settings(spark, partitions=cores, rocksdb=True):
        q = W.scheduled(writer).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def _run(df: DataFrame) -> DataFrame:
    """Run an append stream to its end and read its result."""
    spark = df.sparkSession
    folder = _folder(spark)
    writer = df.writeStream.format("parquet").outputMode("append")
    _finish(
        spark,
        writer.option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out"),
    )
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def _naive(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query(
    "stream_tumbling_frames",
    f"""WITH w AS (SELECT {V.SQL_MARK} AS start, event_type, avg(value) AS mean, count(*) AS n
      FROM events GROUP BY 1, 2)
    SELECT start, start + INTERVAL 10 MINUTE AS "end", event_type, round(mean * n, 4) AS total, n FROM w
    WHERE start + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def _tumbling(spark, sf):
    r = W.event_time(_readings(spark, sf), "ts")
    out = _run(W.tumbling_frames(r, "ts", ["event_type"], "value"))
    total = F.round(F.col("mean") * F.col("n"), 4).alias("total")
    return _naive(out, "start", "end").select("start", "end", "event_type", total, "n")


@query(
    "stream_rolling_hours",
    """WITH h AS (SELECT date_trunc('hour', ts) AS h, value, event_type FROM events),
    w AS (SELECT h - to_hours(CAST(o AS INT)) AS start, event_type, avg(value) AS mean, count(*) AS n
      FROM h CROSS JOIN (SELECT unnest(generate_series(0, 5)) AS o) GROUP BY 1, 2)
    SELECT start, start + INTERVAL 6 HOUR AS "end", event_type, round(mean * n, 4) AS total, n FROM w
    WHERE start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def _rolling(spark, sf):
    r = W.event_time(_readings(spark, sf), "ts")
    out = _run(W.rolling_hours(r, "ts", ["event_type"], "value"))
    total = F.round(F.col("mean") * F.col("n"), 4).alias("total")
    return _naive(out, "start", "end").select("start", "end", "event_type", total, "n")


@query(
    "stream_first_sightings",
    "SELECT DISTINCT user_id AS station_id, event_type FROM events",
)
def _sightings(spark, sf):
    r = W.event_time(_readings(spark, sf), "ts").select("station_id", "event_type", "ts")
    return _run(W.first_sightings(r, ["station_id", "event_type"], "ts")).drop("ts")


_NEWER = f"""WITH {V.SQL_STATE} SELECT event_id, user_id AS station_id, ts FROM events
  LEFT JOIN state ON state.station_id = events.user_id
  WHERE ts > coalesce(last_update, TIMESTAMP '1900-01-01 00:00:00')"""


@query("stream_high_water", _NEWER)
def _high_water(spark, sf):
    folder = _folder(spark)
    marks = V.station_state(spark, sf).withColumn("last_update", F.col("last_update").cast("timestamp"))
    r = _readings(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    step = SS.high_water_batches(
        f"{folder}/marks", f"{folder}/out", "station_id", "ts", "bigint", marks
    )
    writer = r.writeStream.foreachBatch(step)
    _finish(spark, writer.option("checkpointLocation", f"{folder}/checkpoint"))
    out = spark.read.schema(r.schema).parquet(f"{folder}/out")
    return _naive(out, "ts").select("event_id", "station_id", "ts")


@query("stream_high_water_state", _NEWER)
def _high_water_state(spark, sf):
    marks = V.station_state(spark, sf).withColumn("last_update", F.col("last_update").cast("timestamp"))
    r = _readings(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _run(SS.high_water_stream(r, "station_id", "ts", marks))
    return _naive(out, "ts").select("event_id", "station_id", "ts")


@query(
    "stream_last_files",
    """SELECT DISTINCT 'f_' || strftime(ts, '%Y%m%d%H%M') AS path FROM events
    ORDER BY path DESC LIMIT 50""",
)
def _last_files(spark, sf):
    folder = _folder(spark)
    names = _readings(spark, sf).select(
        F.concat(F.lit("f_"), F.date_format("ts", "yyyyMMddHHmm")).alias("path")
    )
    step = SS.last_files_batches(f"{folder}/state")
    writer = names.writeStream.foreachBatch(step)
    _finish(spark, writer.option("checkpointLocation", f"{folder}/checkpoint"))
    return SS.latest_state(spark, f"{folder}/state", "path string")


@query(
    "stream_latest_height",
    """WITH h AS (SELECT DISTINCT ts AS height_ts FROM events WHERE event_type = 'click'),
    v AS (SELECT DISTINCT ts FROM events WHERE event_type = 'view'),
    seen AS (SELECT least((SELECT max(ts) FROM v) - INTERVAL 10 MINUTE,
      (SELECT max(height_ts) FROM h) - INTERVAL 2 HOUR) AS mark)
    SELECT ts, CASE WHEN height_ts >= ts - INTERVAL 2 HOUR THEN height_ts END AS height_ts
    FROM v ASOF LEFT JOIN h ON v.ts >= h.height_ts
    WHERE ts <= (SELECT mark FROM seen) - INTERVAL 2 HOUR""",
)
def _latest_height(spark, sf):
    kind = lambda k: _readings(spark, sf).where(F.col("event_type") == k).select("ts")
    rain = W.event_time(kind("view"), "ts", "rain")
    height = W.event_time(kind("click").withColumnRenamed("ts", "height_ts"), "height_ts", "height")
    return _naive(_run(W.latest_height(rain, height)), "ts", "height_ts")


@query(
    "stream_trailing_frames",
    f"""WITH {V.SQL_CELLS}, f AS (SELECT vec_id, sum(value) AS total FROM cells GROUP BY 1),
    lags AS (SELECT CAST(unnest(generate_series(0, 5)) AS INT) AS lag)
    SELECT TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(k.vec_id * 10 AS INT)) AS key_ts, lag,
      round(f.total, 4) AS total FROM f k CROSS JOIN lags JOIN f ON f.vec_id = k.vec_id - lag
    WHERE k.vec_id <= (SELECT max(vec_id) - 1 FROM embeddings)""",
)
def _trailing(spark, sf):
    f = _frames(spark, sf).select(F.lit("sat").alias("source"), "frame_ts", "values")
    out = _run(SS.trailing_frames(f, 6))
    lags = out.select("key_ts", F.explode("frames").alias("_f"))
    total = F.aggregate("_f.values", F.lit(0.0), lambda s, v: s + v)
    return _naive(
        lags.select("key_ts", "_f.lag", F.round(total, 4).alias("total")), "key_ts"
    )


@query(
    "stream_trailing_state",
    f"""WITH {V.SQL_CELLS}, f AS (SELECT vec_id, sum(value) AS total FROM cells GROUP BY 1),
    lags AS (SELECT CAST(unnest(generate_series(0, 5)) AS INT) AS lag)
    SELECT 's' || (k.vec_id % 2) AS source, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(k.vec_id * 10 AS INT)) AS key_ts,
      lag, round(f.total, 4) AS total FROM f k CROSS JOIN lags JOIN f ON f.vec_id = k.vec_id - 2 * lag
    WHERE k.vec_id <= (SELECT max(vec_id) - 1 FROM embeddings)""",
)
def _trailing_state(spark, sf):
    """Two sources that report every twenty minutes, in turn."""
    place = F.concat(F.lit("s"), F.pmod("vec_id", F.lit(2)).cast("string")).alias("source")
    rain = map_values(
        F.col("embedding"), lambda e: F.greatest(F.lit(0.0), F.lit(40.0) * e.cast("double"))
    )
    f = _stream(spark, sf, "embeddings").select(
        place, V.mark_ts(F.col("vec_id")).cast("timestamp").alias("frame_ts"), rain.alias("values")
    )
    out = _run(SS.trailing_frames_state(f, 6, step=20, block_minutes=360))
    lags = out.select("source", "key_ts", F.explode("frames").alias("_f"))
    total = F.aggregate("_f.values", F.lit(0.0), lambda s, v: s + v)
    return _naive(lags.select("source", "key_ts", "_f.lag", F.round(total, 4).alias("total")), "key_ts")


def _frames(spark, sf):
    rain = map_values(
        F.col("embedding"), lambda e: F.greatest(F.lit(0.0), F.lit(40.0) * e.cast("double"))
    )
    return _stream(spark, sf, "embeddings").select(
        V.mark_ts(F.col("vec_id")).cast("timestamp").alias("frame_ts"), rain.alias("values")
    )


@query(
    "stream_scores",
    f"""WITH {V.SQL_PREDICTIONS} SELECT lag, count(*) AS cells, round(sum(abs(p - t)), 3) AS abs_error,
      CAST(sum(CAST(p > 2 AND t > 2 AS INT)) AS BIGINT) AS tp,
      CAST(sum(CAST(p > 2 OR t > 2 AS INT)) AS BIGINT) AS den
    FROM pairs WHERE model = 'persistence' GROUP BY 1""",
)
def _scores(spark, sf):
    preds = W.event_time(_frames(spark, sf).withColumnRenamed("frame_ts", "issue_ts"), "issue_ts")
    preds = preds.select(
        F.lit("persistence").alias("model"), "issue_ts", "values",
        F.explode(F.sequence(F.lit(1), F.lit(18))).alias("lag"),
    )
    preds = preds.withColumn("valid_ts", F.col("issue_ts") + minutes(F.col("lag") * 10)).drop("lag")
    seen = W.event_time(_frames(spark, sf).withColumnRenamed("values", "observed"), "frame_ts")
    out = _run(W.frame_scores(W.matched_forecasts(preds, seen), [2]))
    lag = (F.timestamp_diff("MINUTE", "issue_ts", "valid_ts") / 10).cast("int").alias("lag")
    return out.groupBy(lag).agg(
        F.sum("cells").alias("cells"), F.round(F.sum("abs_error"), 3).alias("abs_error"),
        F.sum("tp_2").alias("tp"), F.sum("den_2").alias("den"),
    )
