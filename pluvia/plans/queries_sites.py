"""Queries over several places: two locations, two radar sites, two sides of a key."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia.functions.arrays import map_values
from pluvia.functions.times import floor_minutes, minutes
from pluvia.operators import objects
from pluvia.operators import samples as S
from pluvia.operators import state as ST
from pluvia.operators.interpolate import interpolation_weights
from pluvia.operators.scoring import stack_inputs
from pluvia.operators.verify import match_forecasts, paired_cells, score
from pluvia.plans import views as V
from pluvia.plans.frames import radar_frames
from pluvia.plans.queries_radar import _LABELS, _ragged, _tri_sql, THRESHOLD, r6
from pluvia.plans.registry import query
from pluvia.sources.sinks import prediction_rows

AT = ["location"]

# Stations of odd and even numbers are two locations that share their times.
_MARKED = f"""mf AS (SELECT CAST(user_id % 2 AS INT) AS location, event_type, {V.SQL_MARK} AS frame_ts,
  round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3)"""

# Frames of odd and even numbers likewise.
_LOCATED = f"""{V.SQL_CELLS},
lc AS (SELECT CAST(vec_id % 2 AS INT) AS location, vec_id // 2 AS pos, k, value FROM cells),
lags AS (SELECT CAST(unnest(generate_series(1, 4)) AS INT) AS lag)"""
_POS_TS = "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(pos * 10 AS INT))"


def _marked(spark, sf, kind=None):
    r = V.readings(spark, sf).withColumn("location", F.pmod("station_id", F.lit(2)).cast("int"))
    if kind is not None:
        r = r.where(F.col("event_type") == kind)
    return r.groupBy("location", floor_minutes(F.col("ts"), 10).alias("frame_ts")).agg(
        F.array(F.round(F.sum("value"), 4)).alias("values")
    )


def _located(spark, sf):
    f = V.frames(spark, sf)
    place = F.pmod("vec_id", F.lit(2)).cast("int").alias("location")
    return f.select(place, V.mark_ts(F.floor(F.col("vec_id") / 2)).alias("frame_ts"), "values")


def _forecasts(spark, sf):
    """Forecasts of every located frame that fade with the lag."""
    f = _located(spark, sf).withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(4))))
    fade = F.lit(1.0) - F.lit(0.05) * F.col("lag")
    return f.select(
        F.lit("damped").alias("model"), "location", F.col("frame_ts").alias("issue_ts"),
        (F.col("frame_ts") + minutes(F.col("lag") * 10)).alias("valid_ts"), "lag",
        map_values(F.col("values"), lambda v: v * fade).alias("values"),
    )


def _total(values):
    return F.round(F.aggregate(values, F.lit(0.0), lambda s, v: s + v), 4)


@query(
    "lead_pairs_by_location",
    f"""WITH {_MARKED}, f AS (SELECT location, frame_ts, total FROM mf WHERE event_type = 'view'),
    leads AS (SELECT CAST(unnest(generate_series(1, 3)) AS INT) AS lead)
    SELECT k.location, k.frame_ts AS key_ts, lead,
      CASE WHEN a.total IS NOT NULL AND b.total IS NOT NULL THEN a.total END AS previous,
      CASE WHEN a.total IS NOT NULL AND b.total IS NOT NULL THEN b.total END AS target
    FROM f k CROSS JOIN leads
    LEFT JOIN f a ON a.location = k.location AND a.frame_ts = k.frame_ts + to_minutes((lead - 1) * 10)
    LEFT JOIN f b ON b.location = k.location AND b.frame_ts = k.frame_ts + to_minutes(lead * 10)""",
)
def _lead_pairs(spark, sf):
    f = _marked(spark, sf, "view")
    keys = f.select("location", F.col("frame_ts").alias("key_ts"))
    pairs = S.lead_pairs(keys, f, 3, on=AT)
    first = lambda c: F.get(c, F.lit(0)).alias(c)
    return pairs.select("location", "key_ts", "lead", first("previous"), first("target"))


@query(
    "multi_source_by_location",
    f"""WITH {_MARKED}, a AS (SELECT * FROM mf WHERE event_type = 'view'),
    b AS (SELECT * FROM mf WHERE event_type = 'click'),
    k AS (SELECT location, frame_ts AS key_ts FROM a INTERSECT SELECT location, frame_ts FROM b),
    lags AS (SELECT CAST(unnest(generate_series(0, 3)) AS INT) AS lag)
    SELECT k.location, key_ts, 'x' AS kind, 0 AS source, lag, lag * 2 AS channel, total FROM k
      JOIN lags ON lag < 3 LEFT JOIN a ON a.location = k.location AND a.frame_ts = key_ts - to_minutes(lag * 10)
    UNION ALL SELECT k.location, key_ts, 'y', 0, lag, (lag - 1) * 2, total FROM k
      JOIN lags ON lag BETWEEN 1 AND 2
      LEFT JOIN a ON a.location = k.location AND a.frame_ts = key_ts + to_minutes(lag * 10)
    UNION ALL SELECT k.location, key_ts, 'x', 1, lag, 6 + lag, total FROM k
      JOIN lags ON lag < 2 LEFT JOIN b ON b.location = k.location AND b.frame_ts = key_ts - to_minutes(lag * 10)""",
)
def _multi_source(spark, sf):
    sources = [
        S.Source(_marked(spark, sf, "view"), 3, 2, channels=2),
        S.Source(_marked(spark, sf, "click"), 2, 0, channels=1),
    ]
    out = S.multi_source_samples(sources, by=AT)
    return out.select(
        "location", "key_ts", "kind", "source", "lag", "channel", F.get("values", F.lit(0)).alias("total")
    )


@query(
    "with_predictions_by_location",
    f"""WITH {_LOCATED} SELECT location, {_POS_TS} AS key_ts, lag AS lead,
      round(sum(value * (1.0 - 0.05 * lag)), 4) AS total FROM lc CROSS JOIN lags GROUP BY 1, 2, 3""",
)
def _with_predictions(spark, sf):
    keys = _located(spark, sf).select("location", F.col("frame_ts").alias("key_ts"))
    out = S.with_predictions(keys, _forecasts(spark, sf), 4, by=AT)
    return out.select("location", "key_ts", "lead", _total("values").alias("total"))


@query(
    "scores_by_location",
    f"""WITH {_LOCATED} SELECT p.location, lag, round(avg(abs(p.value * (1.0 - 0.05 * lag) - t.value)), 6) AS mae
    FROM lc p CROSS JOIN lags JOIN lc t ON t.location = p.location AND t.pos = p.pos + lag AND t.k = p.k
    GROUP BY 1, 2""",
)
def _scores(spark, sf):
    matched = match_forecasts(_forecasts(spark, sf), _located(spark, sf), "inner", by=AT)
    out = score(paired_cells(matched, ["location", "lag"]), ["location", "lag"], ["MAE"])
    return out.select("location", "lag", r6(F.col("MAE")).alias("mae"))


@query(
    "stack_inputs_by_location",
    f"""WITH {_LOCATED} SELECT k.location, {_POS_TS.replace('pos', 'k.pos')} AS key_ts,
      round(sum(coalesce(f.total, 0) * (o.lag + 1)), 3) AS weighted
    FROM (SELECT DISTINCT location, pos FROM lc) k
    CROSS JOIN (SELECT unnest(generate_series(0, 2)) AS lag) o
    LEFT JOIN (SELECT location, pos, sum(value) AS total FROM lc GROUP BY 1, 2) f
      ON f.location = k.location AND f.pos = k.pos - o.lag GROUP BY 1, 2""",
)
def _stack_inputs(spark, sf):
    f = _located(spark, sf)
    keys = f.select("location", F.col("frame_ts").alias("key_ts"))
    x = stack_inputs(S.past_frames(keys, f, 3, on=AT), 8, 8, by=AT)
    lag = lambda k: F.floor(k / F.lit(64)) + 1
    weighted = F.aggregate(
        F.transform("x", lambda v, k: v * lag(k)), F.lit(0.0), lambda s, v: s + v
    )
    return x.select("location", "key_ts", F.round(weighted, 3).alias("weighted"))


@query(
    "despeckle_time_by_site",
    f"""WITH RECURSIVE {_LABELS},
    placed AS (SELECT *, CAST(scan % 2 AS INT) AS site, scan // 2 AS seq FROM labelled),
    ov AS (SELECT a.scan, a.site, a.seq, a.ray, a.bin, a.value, a.label, count(b.scan) AS n_overlaps FROM placed a
      LEFT JOIN placed b ON b.site = a.site AND b.seq IN (a.seq - 1, a.seq + 1) AND b.ray = a.ray AND b.bin = a.bin
      GROUP BY 1, 2, 3, 4, 5, 6, 7),
    best AS (SELECT *, max(n_overlaps) OVER (PARTITION BY scan, label) AS object_overlaps FROM ov)
    SELECT scan, site, ray, bin, round(value, 6) AS value, label, n_overlaps, object_overlaps FROM best
    WHERE object_overlaps >= 1""",
)
def _despeckle_time(spark, sf):
    rays = V.composites(spark, sf)
    site = F.pmod("scan_id", F.lit(2)).cast("int").alias("site")
    scans = rays.select("scan_id", F.floor(F.col("scan_id") / 2).alias("seq"), site).distinct()
    out = objects.despeckle_time(rays, scans, V.BINS, V.RAYS, [-1, 1], THRESHOLD, by=["site"])
    return out.withColumn("value", r6("value"))


_TWO_SITES = f"""{V.SQL_CELLS},
pixels AS (SELECT vec_id, CAST(vec_id % 2 AS INT) AS site, i AS r, j AS c,
  -22.0::DOUBLE - i * 0.1::DOUBLE - j * 0.01::DOUBLE - (vec_id % 2) * 0.2::DOUBLE AS lat,
  -44.0::DOUBLE + j * 0.1::DOUBLE + i * 0.02::DOUBLE AS lon, value FROM cells),
targets AS (SELECT n AS target, -21.95::DOUBLE - floor(n / 6.0) * 0.153::DOUBLE AS lat,
  -43.95::DOUBLE + (n % 6) * 0.147::DOUBLE AS lon FROM (SELECT unnest(generate_series(0, 35)) AS n))"""


@query(
    "radar_frames_by_site",
    f"""WITH {_TWO_SITES}, {_tri_sql("pixels", "targets")},
    m AS (SELECT DISTINCT {V.SQL_MARK} AS frame_ts FROM events),
    both_sites AS (SELECT CAST(unnest([0, 1, 2]) AS INT) AS site),
    sc AS (SELECT vec_id, CAST(vec_id % 2 AS INT) AS site, TIMESTAMP '2024-01-01 00:00:00'
      + to_seconds(CAST((vec_id // 2) * 600 - (vec_id % 7) * 60 + 30 AS INT)) AS scan_ts FROM embeddings),
    c AS (SELECT frame_ts, site, scan_ts, vec_id, row_number() OVER (PARTITION BY frame_ts, site
      ORDER BY date_trunc('minute', scan_ts) DESC, scan_ts) AS rn FROM m JOIN sc
      ON date_trunc('minute', scan_ts) BETWEEN frame_ts - INTERVAL 4 MINUTE AND frame_ts)
    SELECT s.site, m.frame_ts, c.scan_ts, t.target, round(value, 6) AS value FROM m CROSS JOIN both_sites s
    CROSS JOIN targets t LEFT JOIN c ON c.frame_ts = m.frame_ts AND c.site = s.site AND rn = 1
    LEFT JOIN hit ON hit.vec_id = c.vec_id AND hit.target = t.target""",
)
def _radar_frames(spark, sf):
    """Two radars that scan at their own times, one 0.2 degrees further south, and one that is silent."""
    p = V.pixels(spark, sf)
    site = F.pmod("vec_id", F.lit(2)).cast("int")
    p = p.withColumns({"site": site, "lat": F.col("lat") - F.pmod("vec_id", F.lit(2)) * F.lit(0.2)})
    weights = None
    for k in (0, 1):
        geometry = p.where(F.col("site") == k).select("row", "col", "lat", "lon").distinct()
        own = interpolation_weights(geometry, V.target_grid(spark), tile=0.1).withColumn("site", F.lit(k))
        weights = own if weights is None else weights.unionByName(own)
    minute = F.floor(F.col("vec_id") / 2) * 10 - F.pmod("vec_id", F.lit(7))
    late = F.make_dt_interval(mins=minute.cast("int"), secs=F.lit(30))
    scans = p.withColumn("scan_ts", F.lit(V.T0).cast("timestamp_ntz") + late)
    marks = V.marks(spark, sf).select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("site"), "frame_ts")
    out = radar_frames(scans, marks, weights, n_targets=36, by=["site"])
    return out.withColumn("value", r6("value"))


@query(
    "key_difference_sides",
    """WITH b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey % 2 = 0),
    s AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0)
    SELECT coalesce(b.k, s.k) AS key, CASE WHEN s.k IS NULL THEN 'batch_only' ELSE 'state_only' END
      AS side FROM b FULL JOIN s ON b.k = s.k WHERE b.k IS NULL OR s.k IS NULL""",
)
def _key_difference(spark, sf):
    b = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    s = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return ST.key_difference(b.where("key % 2 = 0"), s.where("key % 3 = 0"), "key")


@query(
    "ragged_order",
    f"""WITH {V.SQL_VOLUME}, l AS (SELECT scan_id, ray, bin, count(*) AS n,
      string_agg(elev_idx, ',' ORDER BY elev_idx) AS items FROM volume GROUP BY 1, 2, 3)
    SELECT scan_id, string_agg(items, ',' ORDER BY ray, bin) AS flat,
      string_agg(CAST(n AS VARCHAR), ',' ORDER BY ray, bin) AS lengths FROM l GROUP BY 1""",
)
def _ragged_order(spark, sf):
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return _ragged(spark, sf).select("scan_id", text("flat"), text("lengths"))


@query(
    "objects_by_propagation",
    f"WITH RECURSIVE {_LABELS} SELECT scan, ray, bin, round(value, 6) AS value, label FROM labelled",
)
def _propagated(spark, sf):
    cells = objects.echo_cells(V.composites(spark, sf), THRESHOLD)
    return objects.label_by_propagation(cells, V.BINS, V.RAYS).withColumn("value", r6("value"))


@query(
    "objects_by_tiles",
    f"WITH RECURSIVE {_LABELS} SELECT scan, ray, bin, round(value, 6) AS value, label FROM labelled",
)
def _tiled(spark, sf):
    cells = objects.echo_cells(V.composites(spark, sf), THRESHOLD)
    return objects.label_by_tiles(cells, V.BINS, V.RAYS, 16, 16).withColumn("value", r6("value"))


@query(
    "prediction_rows",
    f"""WITH {V.SQL_CELLS}, f AS (SELECT vec_id, sum(value) AS total FROM cells GROUP BY 1)
    SELECT 'fading' AS model, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(vec_id * 10 AS INT)) AS issue_ts,
      TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((vec_id + lead) * 10 AS INT)) AS valid_ts,
      round(total / lead, 4) AS total FROM f CROSS JOIN (SELECT unnest(generate_series(1, 3)) AS lead)""",
)
def _prediction_rows(spark, sf):
    f = V.frames(spark, sf)
    part = lambda n: map_values(F.col("values"), lambda v: v / n)
    horizon = F.array(part(1.0), part(2.0), part(3.0))
    rows = prediction_rows(
        f.select(F.lit("fading").alias("model"), F.col("frame_ts").alias("issue_ts"), horizon.alias("horizon"))
    )
    return rows.select("model", "issue_ts", "valid_ts", _total("values").alias("total"))
