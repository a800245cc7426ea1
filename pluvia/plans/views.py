"""The driver's tables seen as rainfall data, with the same views as SQL text.

``embeddings`` play 8x8 frames (one per 10 minutes) and radar rays of 64 bins,
``events`` station readings and scan times, ``lineitem`` radar volumes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions.arrays import map_values
from pluvia.functions.times import floor_minutes, minutes
from pluvia.operators.verify import HORIZON
from pluvia.session import spread

NI = NJ = 8
BINS = 64
RAYS = 50
T0 = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def mark_ts(n):
    """Time of the ``n``-th ten-minute mark."""
    return F.lit(T0).cast("timestamp_ntz") + minutes(n * 10)


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Packed frames ``vec_id, frame_ts, values``."""
    rain = map_values(
        F.col("embedding"), lambda e: F.greatest(F.lit(0.0), F.lit(40.0) * e.cast("double"))
    )
    return spread(table(spark, sf, "embeddings"), "vec_id").select(
        "vec_id", mark_ts(F.col("vec_id")).alias("frame_ts"), rain.alias("values")
    )


def predictions(spark: SparkSession, sf: str, horizon: int = HORIZON) -> DataFrame:
    """Two simple models: the issue frame itself, and the same fading with lead time."""
    base = frames(spark, sf).withColumn(
        "lag", F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    )
    fade = F.lit(1.0) - F.lit(0.05) * F.col("lag")
    kinds = F.explode(
        F.array(
            F.struct(F.lit("persistence").alias("model"), F.lit(1.0).alias("factor")),
            F.struct(F.lit("damped").alias("model"), fade.alias("factor")),
        )
    )
    both = base.withColumn("_m", kinds)
    return both.select(
        F.col("_m.model").alias("model"),
        F.col("vec_id").alias("issue"),
        F.col("frame_ts").alias("issue_ts"),
        (F.col("frame_ts") + minutes(F.col("lag") * 10)).alias("valid_ts"),
        "lag",
        map_values(F.col("values"), lambda v: v * F.col("_m.factor")).alias("values"),
    )


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("station_id"), "ts", "value", "event_type"
    )


def station_state(spark: SparkSession, sf: str) -> DataFrame:
    """Marks of stations that reported before mid-month."""
    old = readings(spark, sf).where(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return old.groupBy("station_id").agg(F.max("ts").alias("last_update"))


def sparse_cells(spark: SparkSession, sf: str) -> DataFrame:
    """4x4 frames with gaps on ten-minute marks: mean reading per cell."""
    r = readings(spark, sf)
    return r.groupBy(
        floor_minutes(F.col("ts"), 10).alias("frame_ts"),
        F.pmod("event_id", F.lit(4)).cast("int").alias("i"),
        F.pmod(F.floor(F.col("event_id") / 4), F.lit(4)).cast("int").alias("j"),
    ).agg(F.avg("value").alias("value"))


def marks(spark: SparkSession, sf: str, event_type: str | None = None) -> DataFrame:
    """Distinct ten-minute marks with a reading (of one kind)."""
    r = readings(spark, sf)
    if event_type is not None:
        r = r.where(F.col("event_type") == event_type)
    return r.select(floor_minutes(F.col("ts"), 10).alias("frame_ts")).distinct()


def mark_frames(spark: SparkSession, sf: str, event_type: str | None = None) -> DataFrame:
    """One packed value per mark: ``[sum, count]`` of its readings."""
    r = readings(spark, sf)
    if event_type is not None:
        r = r.where(F.col("event_type") == event_type)
    return r.groupBy(floor_minutes(F.col("ts"), 10).alias("frame_ts")).agg(
        F.array(F.round(F.sum("value"), 4), F.count(F.lit(1)).cast("double")).alias("values")
    )


def volume(spark: SparkSession, sf: str) -> DataFrame:
    """Radar volume cells ``scan_id, elev_idx, ray, bin, raw`` from order lines."""
    li = spread(table(spark, sf, "lineitem"), "l_orderkey")
    return li.groupBy(
        F.floor(F.col("l_orderkey") / 600).alias("scan_id"),
        F.col("l_linenumber").alias("elev_idx"),
        F.pmod("l_partkey", F.lit(360)).cast("int").alias("ray"),
        F.pmod("l_suppkey", F.lit(20)).cast("int").alias("bin"),
    ).agg(F.max("l_quantity").alias("raw"))


def sweeps(spark: SparkSession, sf: str) -> DataFrame:
    """Packed rays of sweeps: 100 rays each at scattered azimuths."""
    f = frames(spark, sf)
    start = F.pmod(F.col("vec_id") * 7919, F.lit(3600)) / 10.0
    return f.select(
        F.floor(F.col("vec_id") / 100).alias("scan_id"),
        F.pmod("vec_id", F.lit(100)).cast("int").alias("ray_idx"),
        start.alias("start_az"),
        F.pmod(start + 1.0, F.lit(360.0)).alias("stop_az"),
        "values",
    )


def composites(spark: SparkSession, sf: str) -> DataFrame:
    """Radar composites of 50 rays x 64 bins, one per 10 minutes."""
    return frames(spark, sf).select(
        F.floor(F.col("vec_id") / RAYS).alias("scan_id"),
        F.pmod("vec_id", F.lit(RAYS)).cast("int").alias("ray"),
        "values",
    )


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Satellite pixels of a slanted 8x8 scan per frame."""
    cells = frames(spark, sf).select(
        "vec_id", F.col("frame_ts").alias("creation"), F.posexplode("values").alias("k", "value")
    )
    row, col = F.floor(F.col("k") / 8).cast("int"), F.pmod("k", F.lit(8)).cast("int")
    return cells.select(
        "vec_id", "creation", row.alias("row"), col.alias("col"),
        (F.lit(-22.0) - row * F.lit(0.1) - col * F.lit(0.01)).alias("lat"),
        (F.lit(-44.0) + col * F.lit(0.1) + row * F.lit(0.02)).alias("lon"),
        "value",
    )


def target_grid(spark: SparkSession, n: int = 6) -> DataFrame:
    """Static ``n x n`` target grid; its outer cells lie outside the pixels' hull."""
    k = F.col("id")
    return spark.range(n * n).select(
        k.alias("target"),
        (F.lit(-21.95) - F.floor(k / n) * F.lit(0.153)).alias("lat"),
        (F.lit(-43.95) + F.pmod(k, F.lit(n)) * F.lit(0.147)).alias("lon"),
    )


# The same views as SQL text.
SQL_CELLS = """cells AS (
  SELECT vec_id, k, CAST(floor(k / 8.0) AS INT) AS i, CAST(k % 8 AS INT) AS j,
         greatest(0.0, 40.0 * CAST(e AS DOUBLE)) AS value
  FROM (SELECT vec_id, unnest(generate_series(0, len(embedding) - 1)) AS k,
               unnest(embedding) AS e FROM embeddings))"""

SQL_PREDICTIONS = f"""{SQL_CELLS},
lags AS (SELECT CAST(unnest(generate_series(1, 18)) AS INT) AS lag),
predictions AS (
  SELECT m.model, c.vec_id AS issue, c.vec_id + l.lag AS valid, l.lag, c.k, c.i, c.j,
         CASE WHEN m.model = 'damped' THEN c.value * (1.0 - 0.05 * l.lag) ELSE c.value END AS value
  FROM cells c CROSS JOIN lags l CROSS JOIN (VALUES ('persistence'), ('damped')) m(model)),
pairs AS (
  SELECT p.model, p.lag, p.issue, p.valid, p.k, p.i, p.j,
         greatest(p.value, 0.0) AS p, greatest(c.value, 0.0) AS t
  FROM predictions p JOIN cells c ON c.vec_id = p.valid AND c.k = p.k)"""

SQL_MARK = "time_bucket(INTERVAL '10 minutes', ts)"

SQL_STATE = """state AS (
  SELECT user_id AS station_id, max(ts) AS last_update FROM events
  WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1)"""

SQL_VOLUME = """volume AS (
  SELECT CAST(floor(l_orderkey / 600.0) AS BIGINT) AS scan_id, l_linenumber AS elev_idx,
         CAST(l_partkey % 360 AS INT) AS ray, CAST(l_suppkey % 20 AS INT) AS bin,
         max(l_quantity) AS raw
  FROM lineitem GROUP BY 1, 2, 3, 4)"""

SQL_COMPOSITES = f"""{SQL_CELLS},
comp AS (SELECT CAST(floor(vec_id / 50.0) AS BIGINT) AS scan, CAST(vec_id % 50 AS INT) AS ray,
         CAST(k AS INT) AS bin, value FROM cells)"""

SQL_SWEEPS = f"""{SQL_CELLS},
rays0 AS (
  SELECT DISTINCT CAST(floor(vec_id / 100.0) AS BIGINT) AS scan_id,
         CAST(vec_id % 100 AS INT) AS ray_idx, vec_id,
         ((vec_id * 7919) % 3600) / 10.0::DOUBLE AS start_az FROM cells),
rays1 AS (SELECT *, CASE WHEN start_az + 1.0 >= 360 THEN start_az - 359.0 ELSE start_az + 1.0 END
          AS stop_az FROM rays0),
rays AS (SELECT scan_id, ray_idx, vec_id,
         CAST(floor(CASE WHEN start_az + 0.5 >= 360 THEN start_az - 359.5 ELSE start_az + 0.5 END)
              AS INT) AS ray_bin FROM rays1)"""

SQL_PIXELS = f"""{SQL_CELLS},
pixels AS (SELECT vec_id, i AS r, j AS c, -22.0::DOUBLE - i * 0.1::DOUBLE - j * 0.01::DOUBLE AS lat,
           -44.0::DOUBLE + j * 0.1::DOUBLE + i * 0.02::DOUBLE AS lon, value FROM cells),
targets AS (SELECT n AS target, -21.95::DOUBLE - floor(n / 6.0) * 0.153::DOUBLE AS lat,
            -43.95::DOUBLE + (n % 6) * 0.147::DOUBLE AS lon
            FROM (SELECT unnest(generate_series(0, 35)) AS n))"""
