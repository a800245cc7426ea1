"""Scan, state, quality and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia.functions import names, scalars
from pluvia.functions.arrays import crop_centre, downsample4, pad_centre, subgrid
from pluvia.functions.geo import cell_lat, cell_lon
from pluvia.functions.radar import mean_azimuth, pack, unpack
from pluvia.operators import quality as Q
from pluvia.operators import state as ST
from pluvia.operators.grid import map_order, pivot_to_rows, unpack_frames
from pluvia.operators.ordering import keep_last
from pluvia.plans import views as V
from pluvia.plans.registry import query
from pluvia.sources import files as FL
from pluvia.sources import models as M
from pluvia.sources import sinks, tables


def r6(c):
    return F.round(c, 6)


def _ntz(text):
    return F.lit(text).cast("timestamp_ntz")


# --- scans -------------------------------------------------------------------


@query(
    "time_range_scan",
    """SELECT event_id, user_id AS station_id, ts AS datetime, value AS precipitation FROM events
    WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-12 18:00:00'""",
)
def _time_range(spark, sf):
    r = V.readings(spark, sf).drop("event_type").withColumnsRenamed(
        {"ts": "datetime", "value": "precipitation"}
    )
    stored = sinks.with_partitions(r, "datetime").withColumns(
        {"update_time": F.current_timestamp(), "model_version": F.lit("1")}
    )
    return tables.time_range(stored, "2024-01-10 06:00:00", "2024-01-12 18:00:00")


@query(
    "sql_pull",
    "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1",
)
def _sql_pull(spark, sf):
    text = "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM {r} GROUP BY 1"
    return tables.query(spark, text, r=V.readings(spark, sf))


@query(
    "partition_columns",
    """SELECT CAST(year(ts) AS INT) AS ano_particao, CAST(month(ts) AS INT) AS mes_particao,
      CAST(ts AS DATE) AS data_particao, count(*) AS n FROM events GROUP BY 1, 2, 3""",
)
def _partitions(spark, sf):
    parted = sinks.with_partitions(V.readings(spark, sf), "ts")
    return parted.groupBy(*tables.PARTITION_COLUMNS).agg(F.count(F.lit(1)).alias("n"))


_FILES = """files AS (SELECT event_id,
  ['ABI-L2-RRQPEF', 'ABI-L2-ACHAF', 'ABI-L2-DMWF'][CAST(user_id % 3 AS INT) + 1] AS product, ts,
  CAST(year(ts) AS INT) AS year, CAST(dayofyear(ts) AS INT) AS doy, CAST(hour(ts) AS INT) AS hour,
  event_type FROM events),
named AS (SELECT *, printf('%s/%d/%03d/%02d/OR_%s_G16_s%d.nc', product, year, doy, hour, product,
  event_id) AS path FROM files)"""


def _files(spark, sf):
    product = F.get(
        F.array(F.lit("ABI-L2-RRQPEF"), F.lit("ABI-L2-ACHAF"), F.lit("ABI-L2-DMWF")),
        F.pmod("station_id", F.lit(3)).cast("int"),
    )
    f = V.readings(spark, sf).select(
        "event_id", "event_type", "ts", product.alias("product"), F.year("ts").alias("year"),
        F.dayofyear("ts").alias("doy"), F.hour("ts").alias("hour"),
    )
    return f.withColumn(
        "path",
        F.format_string("%s/%d/%03d/%02d/OR_%s_G16_s%d.nc", "product", "year", "doy", "hour",
                        "product", "event_id"),
    )


@query(
    "product_bands",
    f"""WITH {_FILES} SELECT event_id, unnest(CASE product WHEN 'ABI-L2-RRQPEF' THEN ['RRQPE']
      WHEN 'ABI-L2-ACHAF' THEN ['HT'] ELSE ['wind_direction', 'wind_speed', 'temperature',
      'pressure'] END) AS band, product = 'ABI-L2-DMWF' AS named FROM files""",
)
def _bands(spark, sf):
    return FL.with_bands(_files(spark, sf)).select("event_id", F.explode("bands").alias("band"), "named")


@query(
    "files_of_hours",
    f"""WITH {_FILES}, h AS (SELECT DISTINCT year, doy, hour FROM files WHERE event_type = 'error'
      ORDER BY 1 DESC, 2 DESC, 3 DESC LIMIT 6)
    SELECT path FROM named SEMI JOIN h USING (year, doy, hour)""",
)
def _files_of_hours(spark, sf):
    f = _files(spark, sf)
    hours = FL.hours_needed(f.where(F.col("event_type") == "error")).limit(6)
    return FL.files_of_hours(f, hours).select("path")


@query(
    "files_of_day",
    f"""WITH {_FILES} SELECT path FROM named WHERE year = 2024 AND doy = 15
      AND product IN ('ABI-L2-RRQPEF', 'ABI-L2-ACHAF')""",
)
def _files_of_day(spark, sf):
    return FL.files_of_day(_files(spark, sf), ["ABI-L2-RRQPEF", "ABI-L2-ACHAF"], 2024, 15).select(
        "path"
    )


@query(
    "manifest_anti",
    f"""WITH {_FILES} SELECT path FROM named WHERE path NOT IN
      (SELECT path FROM named WHERE ts < TIMESTAMP '2024-01-20 00:00:00')""",
)
def _manifest(spark, sf):
    f = _files(spark, sf)
    return FL.not_yet_seen(f, f.where(F.col("ts") < _ntz("2024-01-20 00:00:00"))).select("path")


@query(
    "union_files",
    f"""WITH {_FILES} SELECT path FROM named WHERE event_type IN ('view', 'click')
    UNION SELECT path FROM named WHERE hour < 12""",
)
def _union_files(spark, sf):
    f = _files(spark, sf)
    some = f.where(F.col("event_type").isin("view", "click")).select("path")
    return FL.union_files([some, f.where(F.col("hour") < 12).select("path")])


@query(
    "radar_file_range",
    """WITH f AS (SELECT event_id, 'vol/x.MDN.' || strftime(ts, '%Y%m%dT%H%M%SZ') || '.PVOL.h5' ||
      CASE WHEN user_id % 4 = 0 THEN '' ELSE '.gz' END AS path, strftime(ts, '%Y%m%dT%H%M%SZ') AS t
      FROM events)
    SELECT event_id, path, t AS scan_time, path LIKE '%.gz' AS is_archive FROM f
    WHERE t >= '20240112T120000Z' AND t <= '20240112T200000Z'""",
)
def _radar_files(spark, sf):
    r = V.readings(spark, sf)
    tail = F.when(F.pmod("station_id", F.lit(4)) == 0, "").otherwise(".gz")
    f = r.select(
        "event_id",
        F.concat(F.lit("vol/x.MDN."), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"),
                 F.lit(".PVOL.h5"), tail).alias("path"),
    )
    return FL.radar_files(f, "20240112T120000Z", "20240112T200000Z")


@query(
    "directories",
    f"""WITH {_FILES} SELECT DISTINCT unnest([product || '/', product || '/' || year || '/',
      product || '/' || year || '/' || printf('%03d', doy) || '/',
      product || '/' || year || '/' || printf('%03d/%02d', doy, hour) || '/']) AS directory
    FROM files""",
)
def _directories(spark, sf):
    return FL.directories(_files(spark, sf))


@query(
    "files_by_name",
    f"""WITH {_FILES} SELECT path, split_part(path, '/', -1) AS base,
      split_part(split_part(path, '/', -1), '.', 1) AS stem, 'nc' AS extension,
      split_part(split_part(path, '/', -1), '_', 1) || '_' || product AS prefix
    FROM named WHERE path LIKE 'ABI-L2-ACHAF/2024/01%' AND path LIKE '%.nc'""",
)
def _by_name(spark, sf):
    f = FL.by_name(_files(spark, sf), "ABI-L2-ACHAF/2024/01", ".nc")
    p = F.col("path")
    return tables.with_extension(f).select(
        "path", names.base_name(p).alias("base"), names.file_stem(p).alias("stem"), "extension",
        names.dataset_prefix(names.base_name(p)).alias("prefix"),
    )


@query(
    "composite_names",
    """SELECT event_id, 'MDN-CMAX-DBZH-' || strftime(ts, '%Y%m%d-%H%M%S') AS name, 'CMAX' AS process,
      'DBZH' AS feature, strftime(ts, '%Y%m%d') AS date, strftime(ts, '%H%M%S') AS time FROM events""",
)
def _composite_names(spark, sf):
    named = V.readings(spark, sf).select(
        "event_id", names.composite_name(F.lit("CMAX"), F.lit("DBZH"), F.col("ts")).alias("name")
    )
    return named.withColumns(names.parse_composite_name(F.col("name")))


@query(
    "registry_explode",
    """SELECT CAST(c_custkey AS VARCHAR) AS model, c_name AS model_file, c_nationkey > 12 AS needs_cuda
    FROM customer""",
)
def _registry(spark, sf):
    entry = F.concat_ws(
        "", F.lit('"'), F.col("c_custkey"), F.lit('":{"model_file":"'), "c_name",
        F.lit('","needs_cuda":'), (F.col("c_nationkey") > 12).cast("string"), F.lit("}"),
    )
    text = F.concat_ws("", F.lit("{"), entry, F.lit("}"))
    stored = V.table(spark, sf, "customer").select(
        F.from_json(text, f"map<string,{M.REGISTRY_ENTRY}>").alias("models")
    )
    return M.registry_rows(stored, "models").select("model", "model_file", "needs_cuda")


@query(
    "model_settings",
    """SELECT CAST(s_suppkey AS VARCHAR) AS model, unnest(['overwrite', 'accelerator', 'num_workers',
      'compile', 'batch_to_predict', 'n_before']) AS setting,
      unnest(CASE WHEN s_nationkey < 8 THEN ['true', 'gpu', NULL, NULL, '16', NULL]
        ELSE ['true', 'gpu', '8', 'false', CASE WHEN s_nationkey > 15 THEN '4' ELSE '8' END,
        CASE WHEN s_nationkey > 15 THEN CAST(s_nationkey AS VARCHAR) END] END) AS value
    FROM supplier""",
)
def _settings(spark, sf):
    s = V.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("model"), "s_nationkey"
    )
    own = F.create_map(F.lit("overwrite"), F.lit("true"), F.lit("batch_to_predict"), F.lit("16"))
    registry = s.withColumn("args", F.when(F.col("s_nationkey") < 8, own))
    params = s.where(F.col("s_nationkey") > 15).select(
        "model",
        F.create_map(F.lit("batch_to_predict"), F.lit("4"), F.lit("n_before"),
                     F.col("s_nationkey").cast("string")).alias("params"),
    )
    out = M.model_settings(registry, {"accelerator": "gpu"}, params)
    keys = [*M.DEFAULT_SETTINGS, "n_before"]
    pairs = F.explode(F.array(*[
        F.struct(F.lit(k).alias("setting"), F.element_at("settings", k).alias("value"))
        for k in keys]))
    return out.select("model", pairs.alias("_p")).select("model", "_p.*")


@query(
    "usable_models",
    """SELECT CAST(c_custkey AS VARCHAR) AS model FROM customer
    WHERE NOT (c_nationkey > 12) AND c_mktsegment <> 'BUILDING'
      AND c_custkey IN (SELECT o_custkey FROM orders)""",
)
def _usable(spark, sf):
    registry = V.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("model"),
        F.when(F.col("c_nationkey") > 12, True).alias("needs_cuda"),
        F.when(F.col("c_mktsegment") == "BUILDING", False).alias("plot"),
    )
    preds = V.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("model"))
    return Q.usable_models(registry, preds, cuda=False, for_plot=True).select("model")


@query(
    "composite_defaults",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 500.0::DOUBLE ELSE 250.0 END
      AS rscale, 0.0::DOUBLE AS rstart, true AS compressed FROM lineitem""",
)
def _defaults(spark, sf):
    li = V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "A", 500.0).alias("rscale")
    )
    return tables.read_composites(li)


# --- state -------------------------------------------------------------------


@query(
    "new_rows_only",
    """SELECT event_id, user_id AS station_id, event_type FROM events e WHERE NOT EXISTS (
      SELECT 1 FROM events s WHERE s.ts < TIMESTAMP '2024-01-08 00:00:00'
      AND s.user_id = e.user_id AND s.event_type = e.event_type)""",
)
def _new_rows(spark, sf):
    r = V.readings(spark, sf)
    state = r.where(F.col("ts") < _ntz("2024-01-08 00:00:00")).select("station_id", "event_type")
    return ST.new_rows(r, state, ["station_id", "event_type"]).select(
        "event_id", "station_id", "event_type"
    )


@query(
    "updated_state",
    """WITH s AS (SELECT DISTINCT user_id, event_type FROM events
      WHERE ts < TIMESTAMP '2024-01-08 00:00:00')
    SELECT user_id AS station_id, event_type, count(*) AS n FROM (SELECT * FROM s UNION ALL
      SELECT user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM s
        WHERE s.user_id = e.user_id AND s.event_type = e.event_type)) GROUP BY 1, 2""",
)
def _updated_state(spark, sf):
    r = V.readings(spark, sf)
    cols = ["station_id", "event_type"]
    state = r.where(F.col("ts") < _ntz("2024-01-08 00:00:00")).select(*cols).distinct()
    return ST.updated_state(r, state, cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


@query(
    "high_water_filter",
    f"""WITH {V.SQL_STATE} SELECT event_id, user_id AS station_id, ts FROM events
    LEFT JOIN state ON state.station_id = events.user_id
    WHERE ts > coalesce(last_update, TIMESTAMP '1900-01-01 00:00:00')""",
)
def _high_water(spark, sf):
    out = ST.newer_rows(V.readings(spark, sf), V.station_state(spark, sf), "station_id", "ts")
    return out.select("event_id", "station_id", "ts")


@query(
    "advance_marks",
    f"""WITH {V.SQL_STATE} SELECT user_id AS station_id, max(ts) AS last_update FROM events GROUP BY 1""",
)
def _advance(spark, sf):
    return ST.advance_marks(V.readings(spark, sf), V.station_state(spark, sf), "station_id", "ts")


@query(
    "latest_per_key",
    "SELECT user_id AS station_id, max(ts) AS ts FROM events GROUP BY 1",
)
def _latest(spark, sf):
    return ST.latest_per_key(V.readings(spark, sf), "station_id", "ts")


@query(
    "keep_last_50",
    """SELECT path FROM (SELECT DISTINCT 'f_' || strftime(ts, '%Y%m%d%H%M') AS path FROM events)
    ORDER BY path DESC LIMIT 50""",
)
def _keep_last(spark, sf):
    f = V.readings(spark, sf).select(
        F.concat(F.lit("f_"), F.date_format("ts", "yyyyMMddHHmm")).alias("path")
    )
    return keep_last(f, "path", 50)


@query(
    "key_difference",
    """WITH b AS (SELECT DISTINCT o_custkey AS k FROM orders), s AS (SELECT c_custkey AS k FROM customer)
    SELECT coalesce(b.k, s.k) AS key, CASE WHEN s.k IS NULL THEN 'batch_only' ELSE 'state_only' END
      AS side FROM b FULL JOIN s ON b.k = s.k WHERE b.k IS NULL OR s.k IS NULL""",
)
def _key_difference(spark, sf):
    b = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    s = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return ST.key_difference(b, s, "key")


@query(
    "table_freshness",
    """SELECT 'orders-lines' AS pair, (SELECT max(o_orderdate) FROM orders) <
      (SELECT max(l_shipdate) FROM lineitem) AS is_fresher
    UNION ALL SELECT 'lines-orders', (SELECT max(l_shipdate) FROM lineitem) <
      (SELECT max(o_orderdate) FROM orders)""",
)
def _freshness(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderdate").alias("date"))
    li = V.table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("date"))
    name = lambda df, n: df.select(F.lit(n).alias("pair"), "is_fresher")
    return name(ST.is_fresher(o, li), "orders-lines").unionByName(
        name(ST.is_fresher(li, o), "lines-orders")
    )


@query(
    "state_upsert",
    """WITH s AS (SELECT user_id AS k, max(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1),
    c AS (SELECT user_id AS k, max(ts) AS t FROM events
      WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1)
    SELECT k AS station_id, t AS last_update FROM c UNION ALL
    SELECT k, t FROM s WHERE k NOT IN (SELECT k FROM c)""",
)
def _upsert(spark, sf):
    r = V.readings(spark, sf)
    state = ST.latest_per_key(r.where(F.col("event_type") == "view"), "station_id", "ts", "last_update")
    fresh = r.where((F.col("event_type") == "click") & (F.col("ts") >= _ntz("2024-01-30 00:00:00")))
    changes = ST.latest_per_key(fresh, "station_id", "ts", "last_update")
    return ST.upsert(state, changes, ["station_id"])


@query(
    "state_keys",
    """SELECT event_id, 'clima.' || event_type || CASE WHEN user_id % 2 = 0 THEN '.files' ELSE '' END
      AS key, 'dev.clima.' || event_type AS dev_key FROM events""",
)
def _state_keys(spark, sf):
    kind = F.col("event_type")
    name = F.when(F.pmod("station_id", F.lit(2)) == 0, "files")
    return V.readings(spark, sf).select(
        "event_id", names.state_key(F.lit("clima"), kind, name).alias("key"),
        names.state_key(F.lit("clima"), kind, dev=True).alias("dev_key"),
    )


@query(
    "state_json",
    """SELECT '{"station_id":' || user_id || ',"event_type":"' || event_type || '"}' AS text,
      user_id AS station_id, event_type, count(*) AS n FROM events GROUP BY 2, 3""",
)
def _state_json(spark, sf):
    text = names.encode_state("station_id", "event_type")
    stored = V.readings(spark, sf).select(text.cast("binary").alias("bytes")).select(
        tables.decode_text("bytes").alias("text")
    )
    counted = stored.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    back = names.decode_state(F.col("text"), "station_id bigint, event_type string")
    return counted.select("text", back.alias("_s"), "n").select("text", "_s.*", "n")


# --- quality -----------------------------------------------------------------

_POINTS = """pts AS (SELECT event_id, -30.0::DOUBLE + (event_id % 150) * 0.1::DOUBLE AS lat,
  -50.0::DOUBLE + (user_id % 120) * 0.1::DOUBLE AS lon, value FROM events)"""


def _points(spark, sf):
    return V.readings(spark, sf).select(
        "event_id",
        (F.lit(-30.0) + F.pmod("event_id", F.lit(150)) * F.lit(0.1)).alias("lat"),
        (F.lit(-50.0) + F.pmod("station_id", F.lit(120)) * F.lit(0.1)).alias("lon"),
        "value",
    )


@query(
    "bbox_filter",
    f"""WITH {_POINTS} SELECT event_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM pts
    WHERE lat > -26.0 AND lat < -19.0 AND lon > -47.0 AND lon < -40.0""",
)
def _bbox(spark, sf):
    return Q.bounding_box(_points(spark, sf)).select("event_id", r6("lat").alias("lat"), r6("lon").alias("lon"))


@query(
    "drop_invalid",
    """SELECT event_id, value FROM events WHERE event_type IN ('view', 'purchase')""",
)
def _drop_invalid(spark, sf):
    odd = (
        F.when(F.col("event_type") == "click", F.lit(float("nan")))
        .when(F.col("event_type") == "error", F.lit(float("inf")))
        .when(F.col("event_type") == "signup", F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    r = V.readings(spark, sf).withColumn("value", odd)
    return Q.drop_invalid(r, ["value"]).select("event_id", "value")


@query(
    "pixel_rows",
    f"""WITH {_POINTS} SELECT event_id, value, 'OR_ABI' AS name FROM pts
    WHERE lat > -26.0 AND lat < -19.0 AND lon > -47.0 AND lon < -40.0""",
)
def _pixel_rows(spark, sf):
    out = FL.pixel_rows(
        _points(spark, sf), Q.LAT_BOUNDS, Q.LON_BOUNDS, ["value"], F.lit("OR_ABI_L2_x")
    )
    return out.select("event_id", "value", "name")


@query(
    "threshold_zero",
    """SELECT event_id, CASE WHEN value / 50 < 0.2 THEN 0 ELSE round(value / 50, 6) END AS v FROM events""",
)
def _threshold(spark, sf):
    v = scalars.threshold_to_zero(F.col("value") / 50)
    return V.readings(spark, sf).select("event_id", r6(v).alias("v"))


@query(
    "fill_predictions",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE value END AS "1h_prediction",
      '3' AS model_version, '2024-01-01 00:00:00' AS reference_datetime FROM events""",
)
def _fill(spark, sf):
    r = V.readings(spark, sf).select(
        "event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("1h_prediction")
    )
    return Q.with_model_info(Q.fill_predictions(r, ["1h_prediction"]), "3", "2024-01-01 00:00:00")


@query(
    "cast_known",
    """SELECT CAST(user_id AS BIGINT) AS station_id, ts AS datetime, value AS precipitation, event_type
    FROM events""",
)
def _cast_known(spark, sf):
    r = V.readings(spark, sf).select(
        F.col("station_id").cast("string"), F.col("ts").cast("string").alias("datetime"),
        F.col("value").cast("string").alias("precipitation"), "event_type",
    )
    types = {**Q.READING_TYPES, "datetime": "timestamp_ntz"}
    return Q.cast_known(r, types)


@query(
    "range_check",
    "SELECT event_id, value FROM events WHERE value >= 20 AND event_type <> 'click'",
)
def _range(spark, sf):
    r = V.readings(spark, sf)
    v = F.when(F.col("event_type") == "click", F.lit(float("nan"))).otherwise(F.col("value"))
    return Q.at_least(r.withColumn("value", v), "value", 20.0).select("event_id", "value")


@query(
    "value_column",
    f"""WITH {_FILES} SELECT event_id, CASE WHEN product = 'ABI-L2-DMWF' THEN 'CMI_C08' ELSE 'CMI' END
      AS col FROM files""",
)
def _value_column(spark, sf):
    f = _files(spark, sf)
    product = F.when(F.col("product") == "ABI-L2-DMWF", Q.MULTI_BAND_PRODUCT).otherwise(F.col("product"))
    return f.select("event_id", Q.value_column(product, F.lit("CMI"), F.lit("C08")).alias("col"))


@query(
    "unique_not_null",
    """SELECT 'unique_o_orderkey' AS rule, 0::BIGINT AS failures
    UNION ALL SELECT 'unique_o_custkey', count(*) FROM
      (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'not_null_o_orderkey', count(*) FROM orders WHERE o_orderkey IS NULL
    UNION ALL SELECT 'not_null_status', count(*) FROM orders WHERE o_orderstatus = 'P'""",
)
def _unique(spark, sf):
    o = V.table(spark, sf, "orders").withColumn(
        "status", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    )
    return Q.column_tests(o, ["o_orderkey", "o_custkey"], ["o_orderkey", "status"])


_SWEEPS = """sw AS (SELECT l_orderkey AS scan_ts, 250.0 + CASE WHEN l_shipmode_ THEN 1 ELSE 0 END AS rscale,
  0.0 AS rstart, CASE WHEN l_tax > 0.07 THEN 0.0 ELSE 0.5 END AS gain, l_discount > 0.09 AS odd,
  CASE WHEN l_quantity > 30 THEN 360 ELSE 359 END AS nrays, 1000 AS nbins
  FROM (SELECT *, l_returnflag = 'R' AS l_shipmode_ FROM lineitem))"""


def _sweep_table(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("scan_ts"),
        F.when(F.col("l_returnflag") == "R", 251.0).otherwise(250.0).alias("rscale"),
        F.lit(0.0).alias("rstart"),
        F.when(F.col("l_tax") > 0.07, 0.0).otherwise(0.5).alias("gain"),
        F.lit(-32.0).alias("offset"),
        F.when(F.col("l_quantity") > 30, 360).otherwise(359).alias("nrays"),
        F.lit(1000).alias("nbins"),
        Q.mask_mismatch(
            F.when(F.col("l_discount") <= 0.09, F.col("l_tax")), F.col("l_tax")
        ).alias("az_mask_mismatch"),
    )


_RULES = f"""WITH {_SWEEPS}, g AS (SELECT scan_ts, min(rscale) <> max(rscale) AS a,
  min(gain) <> max(gain) AS b, min(gain) <= 0 AS c, max(nrays) <> 360 AS d, bool_or(odd) AS e
  FROM sw GROUP BY 1),
 failed AS (SELECT scan_ts, 'rscale differs' AS rule, 'skip' AS severity FROM g WHERE a
  UNION ALL SELECT scan_ts, 'gain differs', 'abort' FROM g WHERE b
  UNION ALL SELECT scan_ts, 'gain not positive', 'abort' FROM g WHERE c
  UNION ALL SELECT scan_ts, 'wrong ray count', 'skip' FROM g WHERE d
  UNION ALL SELECT scan_ts, 'azimuth masks differ', 'abort' FROM g WHERE e)"""


@query("scan_rules", f"{_RULES} SELECT * FROM failed")
def _scan_rules(spark, sf):
    return Q.scan_rules(_sweep_table(spark, sf))


@query(
    "good_scans",
    f"""{_RULES} SELECT l_orderkey AS scan_ts, count(*) AS sweeps FROM lineitem
    WHERE l_orderkey NOT IN (SELECT scan_ts FROM failed) GROUP BY 1""",
)
def _good_scans(spark, sf):
    sweeps = _sweep_table(spark, sf)
    good = Q.good_scans(sweeps, Q.scan_rules(sweeps))
    return good.groupBy("scan_ts").agg(F.count(F.lit(1)).alias("sweeps"))


@query(
    "same_layout",
    """SELECT count(DISTINCT len(embedding)) <= 1 AS same_layout FROM embeddings""",
)
def _layout(spark, sf):
    meta = V.frames(spark, sf).select(
        F.lit(10).alias("timestep"), F.lit(8).alias("ni"),
        F.floor(F.size("values") / 8).alias("nj"),
    )
    return Q.same_layout(meta)


@query(
    "comparable_scans",
    """WITH s AS (SELECT s_suppkey, s_nationkey FROM supplier)
    SELECT a.s_suppkey AS left_scan, b.s_suppkey AS right_scan FROM s a JOIN s b
    ON a.s_nationkey = b.s_nationkey AND b.s_suppkey = a.s_suppkey + 1""",
)
def _comparable(spark, sf):
    s = V.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("scan"), F.lit(1000).alias("nbins"), F.lit(360).alias("nrays"),
        F.lit(250.0).alias("rscale"), F.lit(0.0).alias("rstart"),
        F.col("s_nationkey").cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
    )
    a, b = s.withColumn("next", F.col("scan") + 1).alias("a"), s.alias("b")
    same = Q.comparable_scans("a", "b")
    return a.join(b, [F.col("a.next") == F.col("b.scan"), *same]).select(
        F.col("a.scan").alias("left_scan"), F.col("b.scan").alias("right_scan")
    )


@query(
    "train_stats",
    f"""WITH {V.SQL_CELLS} SELECT round(avg(value), 6) AS train_mean,
      round(stddev_pop(value), 6) AS train_std, round(avg(ln(1.0 + value)), 6) AS train_log_mean,
      round(stddev_pop(ln(1.0 + value)), 6) AS train_log_std FROM cells""",
)
def _train_stats(spark, sf):
    stats = Q.training_stats(unpack_frames(V.frames(spark, sf), V.NJ, ["vec_id"]))
    return stats.select(*[r6(c).alias(c) for c in stats.columns])


@query(
    "minmax_stats",
    "SELECT min(value) AS min, max(value) AS max FROM events WHERE event_type <> 'click'",
)
def _minmax_stats(spark, sf):
    r = V.readings(spark, sf)
    v = F.when(F.col("event_type") == "click", F.lit(float("nan"))).otherwise(F.col("value"))
    return Q.minmax_stats(r.withColumn("value", v), "value")


# --- scalars -----------------------------------------------------------------


@query(
    "minmax_rescale",
    """WITH s AS (SELECT min(value) AS a, max(value) AS b FROM events)
    SELECT event_id, round((value - a) / (b - a), 6) AS value FROM events CROSS JOIN s""",
)
def _rescale(spark, sf):
    out = Q.rescale_column(V.readings(spark, sf), "value")
    return out.select("event_id", r6("value").alias("value"))


@query(
    "minmax_inverse",
    "SELECT event_id, round(value / 500 * 81.770131684971, 6) AS value FROM events",
)
def _inverse(spark, sf):
    v = scalars.inverse_min_max(F.col("value") / 500)
    return V.readings(spark, sf).select("event_id", r6(v).alias("value"))


@query(
    "transforms",
    """SELECT event_id, round((ln(1.0 + value) - 0.3) / 3.6, 6) AS t0,
      round(least(ln(1.0 + value) / 7.2, 1.0), 6) AS t1, round(ln(1.0 + value), 6) AS t2,
      value AS t2_sat, value AS t3, round(tanh(ln(1.0 + value) / 4), 6) AS t4,
      round((ln(1.0 + value) - 0.3) / 3.6, 6) AS t5,
      round(greatest(least((ln(1.0 + value) - 0.08) / (3 * 0.39), 1.0), -1.0), 6) AS clipped
    FROM events""",
)
def _transforms(spark, sf):
    v = F.col("value")
    t = {f"t{k}": r6(scalars.normalise(v, k, 0.3, 1.2)) for k in range(6)}
    t["t2_sat"] = scalars.normalise(v, 2, 0.3, 1.2, satellite=True)
    t["clipped"] = r6(scalars.normalise_clipped(v, 3.0))
    return V.readings(spark, sf).select("event_id", *[c.alias(n) for n, c in t.items()])


@query(
    "inverse_transforms",
    """WITH x AS (SELECT event_id, value / 500 AS x FROM events)
    SELECT event_id, round(exp(x * 3.6 + 0.3) - 1, 5) AS t0, round(exp(x * 7.2) - 1, 4) AS t1,
      round(exp(x) - 1, 6) AS t2, round(x, 6) AS t3, round(exp(0.5 * ln((1 + x) / (1 - x)) * 4) - 1, 3) AS t4,
      round(exp(x * 3.6 + 0.3) - 1, 5) AS t5, round(exp(x * 1.17 + 0.08) - 1, 6) AS clipped FROM x""",
)
def _inverse_transforms(spark, sf):
    x = F.col("value") / 500
    digits = {0: 5, 1: 4, 2: 6, 3: 6, 4: 3, 5: 5}
    t = {f"t{k}": F.round(scalars.denormalise(x, k, 0.3, 1.2), d) for k, d in digits.items()}
    t["clipped"] = r6(scalars.denormalise_clipped(x, 3.0))
    return V.readings(spark, sf).select("event_id", *[c.alias(n) for n, c in t.items()])


@query(
    "zr_relation",
    """SELECT event_id, round(223.0 * pow(pow(10.0, value / 100), 1.56) / 1e6, 6) AS z,
      round(223.0 * pow(pow(10.0, value / 100), 1.53) / 1e6, 6) AS z_forward FROM events""",
)
def _zr(spark, sf):
    v = F.col("value") / 10
    return V.readings(spark, sf).select(
        "event_id", r6(scalars.reflectivity(v) / 1e6).alias("z"),
        r6(scalars.reflectivity(v, b=scalars.ZR_B_FORWARD) / 1e6).alias("z_forward"),
    )


@query(
    "db_transform",
    """WITH x AS (SELECT event_id, value / 100 AS x FROM events)
    SELECT event_id, CASE WHEN x < 0.1 THEN -15.0 ELSE round(10 * log10(x), 6) END::DOUBLE AS db,
      CASE WHEN x > 0 THEN round(10 * log10(x), 6) END AS display, round(pow(10.0, x / 10), 6) AS linear,
      CASE WHEN x <= 0.001 THEN 0 ELSE x END AS flushed FROM x""",
)
def _db(spark, sf):
    x = F.col("value") / 100
    return V.readings(spark, sf).select(
        "event_id", r6(scalars.to_db(x)).alias("db"), r6(scalars.display_dbz(x)).alias("display"),
        r6(scalars.from_db(x)).alias("linear"),
        scalars.flush_near_zero(x, 0.001).alias("flushed"),
    )


@query(
    "colour_class",
    """WITH c AS (SELECT event_id, value / 4 AS v FROM events)
    SELECT event_id, CAST((v >= 0.02) AS INT) + CAST(least(floor(v / 10), 9) AS INT) AS class,
      (['#FFFFFF', '#66BCFB', '#BEDD58', '#F6D001', '#FD9201', '#F64801', '#EF0101', '#BC0101',
        '#870101', '#550101', '#200101'])[CAST((v >= 0.02) AS INT)
        + CAST(least(floor(v / 10), 9) AS INT) + 1] AS colour FROM c""",
)
def _colour(spark, sf):
    v = F.col("value") / 4
    return V.readings(spark, sf).select(
        "event_id", scalars.rain_class(v).alias("class"), scalars.rain_colour(v).alias("colour")
    )


@query(
    "opacity",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 256 AS r, 190 + l_suppkey % 66 AS g,
      210 + CAST(l_quantity AS BIGINT) % 46 AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN least(r, g, b, 255) <= 200 THEN 255
      ELSE CAST(floor(least(255, sqrt((255 - r) ** 2 + (255 - g) ** 2 + (255 - b) ** 2))) AS INT) END
      AS alpha FROM p""",
)
def _opacity(spark, sf):
    r = F.pmod("l_partkey", F.lit(256))
    g = F.lit(190) + F.pmod("l_suppkey", F.lit(66))
    b = F.lit(210) + F.pmod(F.col("l_quantity").cast("long"), F.lit(46))
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        scalars.opacity(*[c.cast("double") for c in (r, g, b)], F.lit(255.0)).alias("alpha"),
    )


@query(
    "index_to_latlon",
    f"""WITH {V.SQL_PREDICTIONS}, g AS (SELECT issue, i, j, lag,
      CASE WHEN value < 0.2 THEN 0 ELSE value END AS v FROM predictions
      WHERE model = 'persistence' AND lag IN (6, 12, 18))
    SELECT issue, round(-22.6 - (i + 1) * 0.1::DOUBLE, 6) AS latitude, round(-43.9 + (j + 1) * 0.1::DOUBLE, 6) AS longitude,
      round(max(CASE WHEN lag = 6 THEN v END), 6) AS "1h_prediction",
      round(max(CASE WHEN lag = 12 THEN v END), 6) AS "2h_prediction",
      round(max(CASE WHEN lag = 18 THEN v END), 6) AS "3h_prediction" FROM g GROUP BY 1, 2, 3""",
)
def _index_to_latlon(spark, sf):
    preds = V.predictions(spark, sf).where(
        (F.col("model") == "persistence") & F.col("lag").isin(6, 12, 18)
    )
    cells = unpack_frames(preds, V.NJ, ["issue", "lag"])
    located = cells.select(
        "issue", "lag", scalars.threshold_to_zero(F.col("value")).alias("v"),
        r6(cell_lat(F.col("i"), 8, -23.4, -22.6)).alias("latitude"),
        r6(cell_lon(F.col("j"), 8, -43.9, -43.1)).alias("longitude"),
    )
    wide = located.groupBy("issue", "latitude", "longitude").pivot("lag", [6, 12, 18]).agg(
        r6(F.max("v"))
    )
    named = {"6": "1h_prediction", "12": "2h_prediction", "18": "3h_prediction"}
    return map_order(wide.withColumnsRenamed(named))


@query(
    "latlon_matrix",
    f"""WITH {V.SQL_CELLS} SELECT vec_id, round(-22.6 - (i + 1) * 0.1::DOUBLE, 6) AS lat,
      round(-43.9 + (j + 1) * 0.1::DOUBLE, 6) AS lon, j AS pos, round(value, 6) AS value FROM cells""",
)
def _latlon_matrix(spark, sf):


    cells = unpack_frames(V.frames(spark, sf), V.NJ, ["vec_id"]).select(
        "vec_id", r6(cell_lat(F.col("i"), 8, -23.4, -22.6)).alias("lat"),
        r6(cell_lon(F.col("j"), 8, -43.9, -43.1)).alias("lon"), "value",
    )
    rows = pivot_to_rows(cells, ["vec_id"])
    out = rows.select("vec_id", "lat", F.posexplode("row").alias("pos", "value"))
    return out.select(
        "vec_id", "lat", r6(cell_lon(F.col("pos"), 8, -43.9, -43.1)).alias("lon"), "pos",
        r6("value").alias("value"),
    )


def _block_sql(where, new_i, new_j, agg="value"):
    return f"""WITH {V.SQL_CELLS} SELECT vec_id, CAST(({new_i}) * 100 + ({new_j}) AS INT) AS pos,
      round({agg}, 6) AS value FROM cells WHERE {where}"""


def _positions(df, size):
    cells = df.select("vec_id", F.posexplode("values").alias("k", "v"))
    return cells.select(
        "vec_id",
        (F.floor(F.col("k") / size) * 100 + F.pmod("k", F.lit(size))).cast("int").alias("pos"),
        r6("v").alias("value"),
    )


@query(
    "downsample4",
    f"""WITH {V.SQL_CELLS} SELECT vec_id, CAST((i // 4) * 100 + j // 4 AS INT) AS pos,
      round(avg(value), 6) AS value FROM cells WHERE i % 4 IN (1, 2) AND j % 4 IN (1, 2) GROUP BY 1, 2""",
)
def _downsample(spark, sf):
    f = V.frames(spark, sf).withColumn("values", downsample4(F.col("values"), 8, 8))
    return _positions(f, 2)


@query(
    "centre_crop",
    _block_sql("i BETWEEN 1 AND 5 AND j BETWEEN 1 AND 5", "i - 1", "j - 1"),
)
def _crop(spark, sf):
    f = V.frames(spark, sf).withColumn("values", crop_centre(F.col("values"), 8, 8, 5))
    return _positions(f, 5)


@query(
    "subgrid",
    _block_sql("i BETWEEN 2 AND 5 AND j BETWEEN 1 AND 3", "i - 2", "j - 1"),
)
def _subgrid(spark, sf):
    f = V.frames(spark, sf).withColumn("values", subgrid(F.col("values"), 8, 2, 6, 1, 4))
    return _positions(f, 3)


@query(
    "centre_pad",
    f"""WITH {V.SQL_CELLS}, a AS (SELECT unnest(generate_series(0, 10)) AS n)
    SELECT e.vec_id, CAST(p.n * 100 + q.n AS INT) AS pos, round(coalesce(value, 0), 6) AS value
    FROM embeddings e CROSS JOIN a p CROSS JOIN a q
    LEFT JOIN cells c ON c.vec_id = e.vec_id AND c.i = p.n - 1 AND c.j = q.n - 1""",
)
def _pad(spark, sf):
    f = V.frames(spark, sf).withColumn("values", pad_centre(F.col("values"), 8, 8, 11))
    return _positions(f, 11)


# --- radar values ------------------------------------------------------------


@query(
    "unpack_radar",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity - 5 AS raw FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN raw <= 0 THEN 0 ELSE
      round(pow(10.0, (raw * 0.5 - 32) / 10), 6) END AS dbzh,
      CASE WHEN raw > 0 THEN raw * 0.5 - 32 END AS kdp, raw * 0.5 - 32 AS vrad, raw * 0.5 AS zero_offset
    FROM r""",
)
def _unpack_radar(spark, sf):
    raw = F.col("l_quantity") - 5
    g, o = F.lit(0.5), F.lit(-32.0)
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        r6(unpack(raw, g, o, F.lit("DBZH"))).alias("dbzh"),
        unpack(raw, g, o, F.lit("KDP")).alias("kdp"),
        unpack(raw, g, o, F.lit("VRAD")).alias("vrad"),
        unpack(raw, g, F.lit(0.0), F.lit("KDP")).alias("zero_offset"),
    )


@query(
    "pack_radar",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity - 5 AS raw FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN raw <= 0 THEN 0 ELSE raw END AS dbzh,
      CASE WHEN raw <= 0 THEN 0 ELSE raw END AS kdp FROM r""",
)
def _pack_radar(spark, sf):
    raw, g, o = F.col("l_quantity") - 5, F.lit(0.5), F.lit(-32.0)
    back = lambda f: r6(pack(unpack(raw, g, o, F.lit(f)), g, o, F.lit(f)))
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", back("DBZH").alias("dbzh"), back("KDP").alias("kdp")
    )


@query(
    "mean_azimuth",
    """WITH a AS (SELECT l_orderkey, l_linenumber, (l_partkey % 360)::DOUBLE AS s,
      l_quantity AS w FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN s + w / 2 >= 360 THEN s + w / 2 - 360
      ELSE s + w / 2 END, 6) AS azimuth FROM a""",
)
def _mean_azimuth(spark, sf):
    s = F.pmod("l_partkey", F.lit(360)).cast("double")
    stop = F.pmod(s + F.col("l_quantity"), F.lit(360.0))
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(mean_azimuth(s, stop)).alias("azimuth")
    )
