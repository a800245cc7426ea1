"""Queries over files: scans as a data source, and every store written to a new folder and read back."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions.arrays import map_values
from pluvia.functions.radar import unpack
from pluvia.functions.times import minutes
from pluvia.operators import verify
from pluvia.operators.samples import bucketed_samples
from pluvia.plans import views as V
from pluvia.plans.queries_streams import _folder, _naive, _run
from pluvia.plans.registry import query
from pluvia.session import spread
from pluvia.sources import files, scans, sinks, tables
from pluvia.streaming import windows as W

PRODUCT = "ABI-L2-MCMIPF"
FROM = datetime(2024, 1, 1, 0, 20)


def _new_folder(spark: SparkSession) -> str:
    return f"{_folder(spark)}/files"


def _grids(spark, sf) -> DataFrame:
    """Scans ``scan_id`` of as many rows as the composite has rays, 64 columns each."""
    rays = F.sort_array(F.collect_list(F.struct("ray", "values")))
    return V.composites(spark, sf).groupBy("scan_id").agg(F.transform(rays, lambda r: r["values"]).alias("rows"))


# --- satellite scans -------------------------------------------------------------------------


def _satellite_folder(spark, sf) -> str:
    """Two bands a scan: the frame, and half of it plus one."""
    scans.register(spark)
    flat = F.flatten("rows")
    packed = _grids(spark, sf).select(
        F.lit(PRODUCT).alias("product"), V.mark_ts(F.col("scan_id")).alias("creation"),
        F.array(F.lit("CMI_C08"), F.lit("CMI_C09")).alias("band"),
        F.transform(F.sequence(F.lit(0), F.lit(V.BINS - 1)), lambda k: F.lit(0.06) + k * F.lit(0.0005)).alias("x"),
        F.transform(F.sequence(F.lit(0), F.size("rows") - 1), lambda k: F.lit(-0.05) - k * F.lit(0.0005)).alias("y"),
        F.array(flat, F.transform(flat, lambda v: v * 0.5 + 1.0)).alias("values"),
    )
    folder = _new_folder(spark)
    packed.write.format("satellite_scan").mode("append").save(folder)
    return folder


_SQL_LOCATED = f"""WITH {V.SQL_COMPOSITES},
p AS (SELECT scan, ray, bin, value, TIMESTAMP '{V.T0}' + to_minutes(CAST(scan * 10 AS INT)) AS creation,
  0.06 + bin * 0.0005::DOUBLE AS x, -0.05 - ray * 0.0005::DOUBLE AS y FROM comp),
d AS (SELECT *, cos(x) * cos(y) AS dx, sin(x) AS dy, cos(x) * sin(y) AS dz FROM p),
q AS (SELECT *, dx * dx + dy * dy + pow(6378137.0 / 6356752.31414, 2) * dz * dz AS a,
  -2.0 * 42164160.0 * dx AS b, pow(42164160.0, 2) - pow(6378137.0, 2) AS c FROM d),
r AS (SELECT *, (-b - sqrt(b * b - 4 * a * c)) / (2 * a) AS rs FROM q WHERE b * b - 4 * a * c >= 0),
located AS (SELECT creation, ray, bin, value,
  degrees(atan(pow(6378137.0 / 6356752.31414, 2) * rs * dz /
    sqrt(pow(42164160.0 - rs * dx, 2) + pow(rs * dy, 2)))) AS lat,
  -75.0 - degrees(atan(-rs * dy / (42164160.0 - rs * dx))) AS lon FROM r)"""


@query(
    "satellite_scan_files",
    f"""{_SQL_LOCATED}
    SELECT creation, 'CMI_C09' AS band, ray AS "row", bin AS col, round(lat, 5) AS lat, round(lon, 5) AS lon,
      round(value * 0.5 + 1, 4) AS value FROM located
    WHERE lat BETWEEN -20.5 AND -14 AND lon BETWEEN -53 AND -40 AND creation >= TIMESTAMP '{FROM}'""",
)
def _satellite_files(spark, sf):
    pixels = scans.satellite_pixels(
        spark, _satellite_folder(spark, sf), PRODUCT, ["CMI_C09"], (-20.5, -14.0), (-53.0, -40.0), FROM,
        height=42164160.0 - 6378137.0,
    )
    return pixels.withColumns({c: F.round(c, n) for c, n in (("lat", 5), ("lon", 5), ("value", 4))})


@query(
    "satellite_scan_stream",
    f"""WITH {V.SQL_COMPOSITES}, b AS (SELECT scan, value, 'CMI_C08' AS band FROM comp
      UNION ALL SELECT scan, value * 0.5 + 1, 'CMI_C09' FROM comp)
    SELECT TIMESTAMP '{V.T0}' + to_minutes(CAST(scan * 10 AS INT)) AS start, band, count(*) AS n,
      round(avg(value), 4) AS mean FROM b
    WHERE scan * 10 + 10 <= (SELECT max(scan) * 10 - 10 FROM comp) GROUP BY scan, band""",
)
def _satellite_stream(spark, sf):
    folder = _satellite_folder(spark, sf)
    arriving = spark.readStream.format("satellite_scan").option("settleSeconds", "0").load(folder)
    out = _run(W.tumbling_frames(W.event_time(arriving, "creation"), "creation", ["band"], "value"))
    return _naive(out, "start").select("start", "band", "n", F.round("mean", 4).alias("mean"))


# --- radar volumes ---------------------------------------------------------------------------


@query(
    "radar_volume_files",
    f"""WITH {V.SQL_COMPOSITES},
    raw AS (SELECT scan, ray, bin, floor(value) + 32 * (bin % 3) AS raw FROM comp),
    v AS (SELECT scan, ray // 25 + 1 AS elev_idx, ray % 25 AS ray_idx,
      CASE WHEN raw > 0 THEN pow(10.0, (raw * 0.5 - 32) / 10) ELSE 0.0 END AS v FROM raw)
    SELECT TIMESTAMP '{V.T0}' + to_minutes(CAST(scan * 10 AS INT)) AS scan_ts, CAST(elev_idx AS INT) AS elev_idx,
      CAST(ray_idx AS INT) AS ray_idx, round((elev_idx - 1) * 25 + ray_idx + 0.25::DOUBLE, 2) AS start_az,
      count(*) AS bins, round(sum(v), 4) AS total FROM v
    WHERE scan >= 2 GROUP BY scan, elev_idx, ray_idx""",
)
def _radar_files(spark, sf):
    rays = scans.volume_rays(spark, _radar_folder(spark, sf), "DBZH", FROM)
    values = F.transform("raw", lambda v: unpack(v, F.col("gain"), F.col("offset"), F.col("feature")))
    return rays.select(
        "scan_ts", "elev_idx", "ray_idx", F.round("start_az", 2).alias("start_az"),
        F.size("raw").cast("long").alias("bins"),
        F.round(F.aggregate(values, F.lit(0.0), lambda s, v: s + v), 4).alias("total"),
    )


def _radar_folder(spark, sf) -> str:
    """Sweeps of 25 rays; two variables."""
    scans.register(spark)
    raw = F.transform("rows", lambda row: F.transform(row, lambda v, k: F.floor(v) + F.lit(32) * F.pmod(k, F.lit(3))))
    raw = F.transform(raw, lambda row: row.cast("array<double>"))
    n = F.ceil(F.size("rows") / 25).cast("int")
    numbered = _grids(spark, sf).select(V.mark_ts(F.col("scan_id")).alias("scan_ts"), raw.alias("raw"), n.alias("n"))
    per_sweep = lambda f: F.transform(F.sequence(F.lit(0), F.col("n") - 1), f)
    azimuth = lambda shift: per_sweep(
        lambda s: F.transform(F.slice("raw", s * 25 + 1, F.lit(25)), lambda _, r: (s * 25 + r).cast("double") + F.lit(shift))
    )
    sweeps = per_sweep(lambda s: F.slice("raw", s * 25 + 1, F.lit(25)))
    zeros = F.transform(sweeps, lambda s: F.transform(s, lambda row: map_values(row, lambda v: v * 0.0)))
    packed = numbered.select(
        "scan_ts", F.array(F.lit("data2"), F.lit("data3")).alias("variable"),
        per_sweep(lambda s: F.lit(0.5) + s).alias("elevation"),
        azimuth(0.25).alias("start_az"), azimuth(1.25).alias("stop_az"),
        F.lit(0.5).alias("gain"), F.lit(-32.0).alias("offset"), F.array(sweeps, zeros).alias("raw"),
    )
    folder = _new_folder(spark)
    packed.write.format("radar_volume").mode("append").save(folder)
    return folder


@query(
    "radar_rays_udtf",
    f"""WITH {V.SQL_COMPOSITES}, raw AS (SELECT scan, ray, bin, floor(value) + 32 * (bin % 3) AS raw FROM comp)
    SELECT TIMESTAMP '{V.T0}' + to_minutes(CAST(scan * 10 AS INT)) AS scan_ts, CAST(ray // 25 + 1 AS INT) AS elev_idx,
      CAST(ray % 25 AS INT) AS ray_idx, count(*) AS bins, CAST(sum(raw) AS BIGINT) AS total
    FROM raw WHERE scan % 2 = 1 GROUP BY scan, ray""",
)
def _radar_udtf(spark, sf):
    """Volume files of a manifest, expanded by an Arrow table function."""
    folder = _radar_folder(spark, sf)
    manifest = files.radar_files(files.list_files(spark, folder), "2024", "2025")
    odd = manifest.where(F.pmod(F.substring("scan_time", 11, 2).cast("int") / 10, F.lit(2)) == 1)
    rays = scans.expand_files(odd, "radar_volume", ["data2"])
    total = F.aggregate("raw", F.lit(0.0), lambda s, v: s + v)
    return rays.select(
        "scan_ts", "elev_idx", "ray_idx", F.size("raw").cast("long").alias("bins"), total.cast("long").alias("total")
    )


# --- archives and tables ---------------------------------------------------------------------


def _zip_batches(folder: str):
    """Stand-in: one archive per event type with a member per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, inner = scans.open_store(folder)
        store.create_dir(inner, recursive=True)
        for pdf in batches:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, text in zip(pdf["member"], pdf["body"], strict=True):
                    z.writestr(name, text)
            name = f"{uuid.uuid4().hex}.zip"
            with store.open_output_stream(f"{inner}/{name}", compression=None) as file:
                file.write(out.getvalue())
            yield pd.DataFrame({"archive": [name]})

    return run


@query(
    "archive_members",
    """SELECT 'station/' || event_id || '.csv' AS member, length(event_type) + 2 + length(CAST(user_id AS VARCHAR)) AS n_bytes,
      event_type FROM events""",
)
def _archives(spark, sf):
    """Members of zip archives, their bytes, and the first field of the text in them."""
    folder = _new_folder(spark)
    rows = spread(V.readings(spark, sf), "event_id").select(
        F.format_string("station/%d.csv", "event_id").alias("member"),
        F.concat_ws(",", "event_type", F.concat(F.col("station_id").cast("string"), F.lit("\n"))).alias("body"),
    )
    written = rows.mapInPandas(_zip_batches(folder), "archive string")
    names = _stored(written).withColumnRenamed("archive", "name")
    found = files.read_archives(spark, folder, "*.zip")
    # Attempts that Spark did not accept may have left archives behind.
    found = found.join(names, F.element_at(F.split("archive", "/"), -1) == names["name"], "left_semi")
    text = F.decode("bytes", "UTF-8")
    # What format_string makes of a missing id; no id is spelled so.
    member = F.nullif("member", F.lit("station/null.csv")).alias("member")
    return found.select(
        member, F.length("bytes").cast("long").alias("n_bytes"), F.substring_index(text, ",", 1).alias("event_type")
    )


def _stored(df: DataFrame) -> DataFrame:
    folder = _new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_READINGS = "SELECT event_id, user_id AS station_id, ts, round(value, 4) AS value, event_type FROM events"


def _rounded(spark, sf) -> DataFrame:
    return V.readings(spark, sf).withColumn("value", F.round("value", 4))


@query("csv_folder", _READINGS)
def _csv(spark, sf):
    """Written as a folder of CSV files and read back as one table by a given schema."""
    rows = _rounded(spark, sf)
    folder = _new_folder(spark)
    sinks.write_format(rows, folder, "csv")
    return tables.read_csv_folder(spark, folder, rows.schema)


@query("read_by_extension", f"{_READINGS} UNION ALL {_READINGS} WHERE event_type = 'click'")
def _by_extension(spark, sf):
    """The same rows in either format; the name says which it is."""
    rows = _rounded(spark, sf)
    folder = _new_folder(spark)
    sinks.write_format(rows, f"{folder}/all.parquet", "parquet")
    sinks.write_format(rows.where("event_type = 'click'"), f"{folder}/clicks.csv", "csv")
    parts = [tables.read_by_extension(spark, f"{folder}/{n}", rows.schema) for n in ("all.parquet", "clicks.csv")]
    return parts[0].unionByName(parts[1])


@query(
    "staging_load",
    """SELECT event_id, user_id AS station_id FROM events WHERE user_id % 3 = 1
    UNION ALL SELECT event_id, user_id FROM events WHERE user_id % 3 = 2""",
)
def _staging(spark, sf):
    """Loaded, replaced by other rows, then added to; the last published version is read."""
    rows = V.readings(spark, sf).select("event_id", "station_id")
    folder = _new_folder(spark)
    for k, mode in enumerate(("append", "overwrite", "append")):
        sinks.publish_table(rows.where(F.pmod("station_id", F.lit(3)) == k), folder, mode)
    return sinks.published(spark, folder, rows.schema)


@query(
    "manifest_append",
    """SELECT DISTINCT user_id || '.h5' AS path FROM events e
    WHERE (SELECT max(value) FROM events f WHERE f.user_id = e.user_id) >= 10""",
)
def _manifest(spark, sf):
    """Two rounds of processed files; failed ones are left out, and known ones are not done again."""
    done = V.readings(spark, sf).groupBy("station_id").agg((F.max("value") >= 10).alias("ok"))
    done = done.select(F.concat(F.col("station_id").cast("string"), F.lit(".h5")).alias("path"), "ok", "station_id")
    folder = _new_folder(spark)
    sinks.append_manifest(done.where("station_id % 2 = 0"), folder)
    known = spark.read.schema("path string").parquet(folder)
    sinks.append_manifest(files.not_yet_seen(done, known), folder)
    return spark.read.schema("path string").parquet(folder)


# --- stores ----------------------------------------------------------------------------------


@query(
    "frame_store",
    f"""WITH {V.SQL_CELLS}, f AS (SELECT vec_id, vec_id % 2 AS place, value::FLOAT AS value FROM cells)
    SELECT CASE place WHEN 0 THEN 'rio' ELSE 'mdn' END AS location,
      TIMESTAMP '{V.T0}' + to_minutes(CAST(vec_id * 10 AS INT)) AS frame_ts, round(sum(value::DOUBLE), 3) AS total,
      (SELECT round(avg(value::DOUBLE), 4) FROM f) AS train_mean
    FROM f WHERE place = 0 GROUP BY vec_id, place""",
)
def _frame_store(spark, sf):
    """Frames of two locations in one store with their attributes; one location is read back."""
    frames = V.frames(spark, sf).select(
        F.lit("sat").alias("source"),
        F.when(F.pmod("vec_id", F.lit(2)) == 0, "rio").otherwise("mdn").alias("location"), "frame_ts", "values",
    )
    cells = frames.select(F.explode("values").alias("v")).where("v is not null")
    stats = cells.agg(
        F.avg("v").alias("train_mean"), F.stddev_pop("v").alias("train_std"),
        F.avg(F.log1p("v")).alias("train_log_mean"), F.stddev_pop(F.log1p("v")).alias("train_log_std"),
    )
    keys = frames.orderBy(F.desc("frame_ts")).limit(3).select("frame_ts")
    folder = _new_folder(spark)
    meta = sinks.dataset_meta(frames, "RRQPE", "-", V.NI, V.NJ, 10, stats, keys)
    sinks.write_frames(frames, meta, folder)
    back = spark.read.parquet(f"{folder}/frames").where("location = 'rio'")
    total = F.aggregate(F.col("values").cast("array<double>"), F.lit(0.0), lambda s, v: s + v)
    # One row of attributes.
    mean = spark.read.parquet(f"{folder}/meta").select(F.round("train_mean", 4).alias("train_mean"))
    return back.select("location", "frame_ts", F.round(total, 3).alias("total")).crossJoin(F.broadcast(mean))


@query(
    "frame_store_bucketed",
    f"""WITH {V.SQL_CELLS}, f AS (SELECT vec_id, sum(value) AS total FROM cells GROUP BY 1),
    lags AS (SELECT CAST(unnest(generate_series(-2, 3)) AS INT) AS lag)
    SELECT CASE k.vec_id % 2 WHEN 0 THEN 'rio' ELSE 'mdn' END AS location,
      TIMESTAMP '{V.T0}' + to_minutes(CAST(k.vec_id * 10 AS INT)) AS key_ts, lag, round(f.total, 4) AS total
    FROM f k CROSS JOIN lags LEFT JOIN f ON f.vec_id = k.vec_id - 2 * lag""",
)
def _frame_buckets(spark, sf):
    """Frames of two locations in buckets by location and time slot; samples need no shuffle."""
    frames = V.frames(spark, sf).select(
        F.lit("sat").alias("source"),
        F.when(F.pmod("vec_id", F.lit(2)) == 0, "rio").otherwise("mdn").alias("location"), "frame_ts", "values",
    )
    name = f"frames_{uuid.uuid4().hex}"
    sinks.write_frame_buckets(frames, name, _new_folder(spark), 4, 2, 20, slot_minutes=360, buckets=8)
    out = bucketed_samples(spark, name, 4, 2, 20)
    total = F.aggregate("values", F.lit(0.0), lambda s, v: s + v)
    return out.select("location", "key_ts", "lag", F.round(total, 4).alias("total"))


@query(
    "composite_store",
    f"""WITH {V.SQL_COMPOSITES}
    SELECT scan AS scan_id, ray, TIMESTAMP '{V.T0}' + to_minutes(CAST(scan * 10 AS INT)) AS scan_ts,
      count(*) AS bins, round(sum(value), 4) AS total, 250.0::DOUBLE AS rscale FROM comp
    WHERE scan * 10 < 24 * 60 GROUP BY scan, ray""",
)
def _composite_store(spark, sf):
    """Composites by process, variable and date; the first day is read back, list columns as they were."""
    rows = V.composites(spark, sf).withColumns({
        "scan_ts": V.mark_ts(F.col("scan_id")), "process_type": F.lit("ppi"), "feature": F.lit("DBZH"),
    })
    folder = _new_folder(spark)
    sinks.write_composites(rows, folder)
    day = spark.read.parquet(folder).where("process_type = 'ppi' and feature = 'DBZH' and date = DATE '2024-01-01'")
    back = tables.read_composites(day)
    return back.select(
        "scan_id", "ray", "scan_ts", F.size("values").cast("long").alias("bins"),
        F.round(F.aggregate("values", F.lit(0.0), lambda s, v: s + v), 4).alias("total"), "rscale",
    )


@query(
    "metrics_store",
    f"""WITH {V.SQL_PREDICTIONS}
    SELECT model, lag, round(avg(abs(p - t)), 4) AS mae,
      coalesce(CAST(round(sum((p > 16 AND t > 16)::INT) / nullif(sum((p > 16 OR t > 16)::INT), 0), 4) AS VARCHAR), 'nan') AS csi
    FROM pairs GROUP BY model, lag""",
)
def _metrics_store(spark, sf):
    """Scores as CSV; a score that no cell decides is spelled ``nan``."""
    matched = verify.match_forecasts(V.predictions(spark, sf), V.frames(spark, sf), "inner")
    cells = verify.paired_cells(matched, ["model", "lag"])
    scores = verify.score(cells, ["model", "lag"], {"mae": verify.mae, "csi": verify.csi(16.0)})
    folder = _new_folder(spark)
    sinks.write_metrics(scores.select("model", "lag", F.round("mae", 4).alias("mae"), F.round("csi", 4).alias("csi")), folder)
    return tables.read_csv_folder(spark, folder, "model string, lag int, mae double, csi string")
