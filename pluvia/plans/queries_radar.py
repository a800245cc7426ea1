"""Radar, geolocation, object, motion and frame-building queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pluvia.functions import geo
from pluvia.functions.arrays import positions, smooth_symmetric
from pluvia.functions.radar import REFERENCE_LAT, REFERENCE_LON, bin_range
from pluvia.operators import align, objects
from pluvia.operators import radar as R
from pluvia.operators.grid import (
    block_motion,
    block_shifts,
    ensemble_mean_packed,
    evolve,
    extrapolate,
    extrapolate_moved,
    unpack_frames,
    warp,
)
from pluvia.operators.interpolate import apply_weights, interpolate, interpolation_weights
from pluvia.operators.samples import past_frames
from pluvia.operators.scoring import score_frames, stack_inputs
from pluvia.plans import views as V
from pluvia.plans.frames import radar_frames, satellite_frames
from pluvia.plans.registry import query

SWEEP = ["scan_id"]


def r6(c):
    return F.round(c, 6)


def _rays(spark, sf):
    return R.with_ray_bin(V.sweeps(spark, sf))


_BINS360 = "b360 AS (SELECT CAST(unnest(generate_series(0, 359)) AS INT) AS ray_bin)"
_HIST = f"""{V.SQL_SWEEPS}, {_BINS360}, scans AS (SELECT DISTINCT scan_id FROM rays),
hist AS (SELECT s.scan_id, b.ray_bin, count(r.vec_id) AS n FROM scans s CROSS JOIN b360 b
  LEFT JOIN rays r ON r.scan_id = s.scan_id AND r.ray_bin = b.ray_bin GROUP BY 1, 2)"""


@query("azimuth_histogram", f"WITH {_HIST} SELECT * FROM hist")
def _hist(spark, sf):
    return R.azimuth_histogram(_rays(spark, sf), SWEEP)


@query(
    "azimuth_faults",
    f"""WITH {_HIST} SELECT scan_id, ray_bin, CASE WHEN n = 0 THEN 'missing' ELSE 'repeated' END AS fault
    FROM hist WHERE n <> 1""",
)
def _faults(spark, sf):
    h = R.azimuth_histogram(_rays(spark, sf), SWEEP)
    tag = lambda df, t: df.select("scan_id", "ray_bin", F.lit(t).alias("fault"))
    return tag(R.missing_sectors(h), "missing").unionByName(tag(R.repeated_sectors(h), "repeated"))


@query(
    "nonzero_repeats",
    f"""WITH {_HIST}, rep AS (SELECT r.scan_id, r.ray_bin, r.ray_idx, r.vec_id FROM rays r
      JOIN hist h USING (scan_id, ray_bin) WHERE h.n > 1)
    SELECT scan_id, ray_bin, ray_idx FROM rep
    EXCEPT SELECT rep.scan_id, ray_bin, ray_idx FROM rep JOIN
      (SELECT vec_id FROM cells GROUP BY 1 HAVING max(value) = 0) z USING (vec_id)""",
)
def _nonzero(spark, sf):
    rays = _rays(spark, sf)
    rep = R.repeated_sectors(R.azimuth_histogram(rays, SWEEP)).select("scan_id", "ray_bin")
    cols = ["scan_id", "ray_bin", "ray_idx"]
    repeats = rays.join(rep, ["scan_id", "ray_bin"], "left_semi")
    zero = repeats.where(~F.exists("values", lambda v: v != 0))
    return repeats.select(*cols).exceptAll(zero.select(*cols))


_MERGED = f"""{V.SQL_SWEEPS},
sec AS (SELECT scan_id, ray_bin, count(*) AS n, min(ray_idx) AS f FROM rays GROUP BY 1, 2),
nb AS (SELECT *, coalesce(lag(f) OVER w, last_value(f) OVER u) AS pf,
  coalesce(lead(f) OVER w, first_value(f) OVER u) AS nf FROM sec
  WINDOW w AS (PARTITION BY scan_id ORDER BY ray_bin),
  u AS (PARTITION BY scan_id ORDER BY ray_bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
live AS (SELECT vec_id FROM cells GROUP BY 1 HAVING max(value) <> 0),
contrib AS (
  SELECT r.scan_id, r.ray_bin, r.vec_id FROM rays r JOIN nb USING (scan_id, ray_bin)
    WHERE n = 1 OR r.vec_id IN (SELECT vec_id FROM live)
  UNION ALL SELECT nb.scan_id, nb.ray_bin, r.vec_id FROM nb JOIN rays r
    ON r.scan_id = nb.scan_id AND r.ray_idx = nb.pf WHERE n > 1
  UNION ALL SELECT nb.scan_id, nb.ray_bin, r.vec_id FROM nb JOIN rays r
    ON r.scan_id = nb.scan_id AND r.ray_idx = nb.nf WHERE n > 1),
merged AS (SELECT scan_id, ray_bin, CAST(k AS INT) AS bin, median(value) AS value
  FROM contrib JOIN cells USING (vec_id) GROUP BY 1, 2, 3)"""


@query(
    "repeat_median",
    f"WITH {_MERGED} SELECT scan_id, ray_bin, bin, round(value, 6) AS value FROM merged",
)
def _repeat_median(spark, sf):
    merged = R.merge_repeats(_rays(spark, sf), SWEEP)
    return merged.select("scan_id", "ray_bin", F.posexplode("values").alias("bin", "value")).withColumn(
        "value", r6("value")
    )


def _gap_sql(weight):
    return f"""WITH {_MERGED}, have AS (SELECT DISTINCT scan_id, ray_bin FROM merged),
    nxt AS (SELECT scan_id, ray_bin, coalesce(lead(ray_bin) OVER w,
      first_value(ray_bin) OVER w + 360) AS nb FROM have
      WINDOW w AS (PARTITION BY scan_id ORDER BY ray_bin)),
    steps AS (SELECT scan_id, ray_bin, nb, unnest(generate_series(0, nb - ray_bin - 1)) AS s FROM nxt)
    SELECT st.scan_id, CAST((st.ray_bin + s) % 360 AS INT) AS ray_bin, a.bin,
      round(CASE WHEN s = 0 THEN a.value ELSE a.value * (1 - {weight}) + b.value * {weight} END, 6) AS value,
      s > 0 AS filled
    FROM steps st JOIN merged a ON a.scan_id = st.scan_id AND a.ray_bin = st.ray_bin
    JOIN merged b ON b.scan_id = st.scan_id AND b.ray_bin = st.nb % 360 AND b.bin = a.bin"""


def _regular(spark, sf, weights):
    out = R.regularise(V.sweeps(spark, sf), SWEEP, weights=weights)
    return out.select(
        "scan_id", "ray_bin", F.posexplode("values").alias("bin", "value"), "filled"
    ).withColumn("value", r6("value"))


@query("gap_fill", _gap_sql("(s::DOUBLE / (nb - st.ray_bin))"))
def _gap_fill(spark, sf):
    return _regular(spark, sf, "distance")


@query("gap_fill_reversed", _gap_sql("(1 - s::DOUBLE / (nb - st.ray_bin))"))
def _gap_fill_reversed(spark, sf):
    return _regular(spark, sf, "reference")


@query(
    "circular_runs",
    f"""WITH {_HIST}, m AS (SELECT scan_id, ray_bin FROM hist WHERE n = 0),
    g AS (SELECT *, ray_bin - row_number() OVER (PARTITION BY scan_id ORDER BY ray_bin) AS g FROM m),
    r AS (SELECT scan_id, g, min(ray_bin) AS lo, max(ray_bin) AS hi FROM g GROUP BY 1, 2),
    e AS (SELECT scan_id, max(CASE WHEN hi = 359 THEN lo END) AS tail,
      max(CASE WHEN lo = 0 THEN hi END) AS head FROM r GROUP BY 1),
    f AS (SELECT g.scan_id, g.ray_bin, r.lo, r.hi, e.tail, e.head,
      e.tail > 0 AND e.head IS NOT NULL AND (r.lo = 0 OR r.lo = e.tail) AS wrap
      FROM g JOIN r USING (scan_id, g) JOIN e USING (scan_id))
    SELECT scan_id, ray_bin, CASE WHEN wrap THEN tail ELSE lo END AS run_start,
      CAST(CASE WHEN wrap THEN 360 - tail + head + 1 ELSE hi - lo + 1 END AS INT) AS run_length,
      CAST((ray_bin - CASE WHEN wrap THEN tail ELSE lo END + 360) % 360 AS INT) AS run_pos FROM f""",
)
def _runs(spark, sf):
    missing = R.missing_sectors(R.azimuth_histogram(_rays(spark, sf), SWEEP))
    return R.circular_runs(missing, SWEEP, "ray_bin", 360)


@query(
    "cmax",
    f"""WITH {V.SQL_VOLUME} SELECT scan_id, ray, bin, max(raw) AS value,
      arg_max(elev_idx, raw * 100 - elev_idx) AS elev_idx FROM volume GROUP BY 1, 2, 3""",
)
def _cmax(spark, sf):
    return R.composite(V.volume(spark, sf), ["scan_id", "ray", "bin"])


@query(
    "cmax_geometry",
    f"""WITH {V.SQL_VOLUME} SELECT scan_id, ray, bin, max(raw) AS value,
      arg_max(elev_idx, raw * 100 - elev_idx) AS elev_idx,
      ray + 0.25::DOUBLE * arg_max(elev_idx, raw * 100 - elev_idx) AS start_az FROM volume GROUP BY 1, 2, 3""",
)
def _cmax_geometry(spark, sf):
    v = V.volume(spark, sf).withColumn(
        "start_az", F.col("ray") + F.lit(0.25) * F.col("elev_idx")
    )
    return R.composite_with_geometry(v, ["scan_id", "ray", "bin"], ["start_az"])


@query(
    "composite_minimum",
    f"WITH {V.SQL_VOLUME} SELECT scan_id, ray, bin, min(raw) AS value, count(*) AS n FROM volume GROUP BY 1, 2, 3",
)
def _cmin(spark, sf):
    lowest = lambda v, e: {"value": F.min(v), "n": F.count(e)}
    return R.composite(V.volume(spark, sf), ["scan_id", "ray", "bin"], operator=lowest)


def _ragged(spark, sf):
    lists = V.volume(spark, sf).groupBy("scan_id", "ray", "bin").agg(
        F.sort_array(F.collect_list("elev_idx")).alias("elevs")
    )
    return R.flatten_ragged(lists, SWEEP, ["ray", "bin"], "elevs")


@query(
    "ragged_flatten",
    f"""WITH {V.SQL_VOLUME} SELECT scan_id, count(*) AS items, count(DISTINCT ray * 100 + bin) AS lists,
      CAST(sum(elev_idx) AS BIGINT) AS total FROM volume GROUP BY 1""",
)
def _ragged_flatten(spark, sf):
    return _ragged(spark, sf).select(
        "scan_id", F.size("flat").cast("long").alias("items"),
        F.size("lengths").cast("long").alias("lists"),
        F.aggregate("flat", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"),
    )


@query(
    "ragged_rebuild",
    f"""WITH {V.SQL_VOLUME}, l AS (SELECT scan_id, ray, bin, count(*) AS n,
      string_agg(elev_idx, ',' ORDER BY elev_idx) AS items FROM volume GROUP BY 1, 2, 3)
    SELECT scan_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY ray, bin) - 1 AS INT) AS pos,
      items FROM l""",
)
def _ragged_rebuild(spark, sf):
    out = R.rebuild_ragged(_ragged(spark, sf), SWEEP)
    text = F.array_join(F.transform("items", lambda v: v.cast("string")), ",")
    return out.select("scan_id", "pos", text.alias("items"))


# --- alignment ---------------------------------------------------------------

_VIEWS = "v AS (SELECT DISTINCT ts FROM events WHERE event_type = 'view')"
_CLICKS = "h AS (SELECT DISTINCT ts AS h_ts FROM events WHERE event_type = 'click')"


def _sides(spark, sf):
    r = V.readings(spark, sf)
    rain = r.where(F.col("event_type") == "view")
    height = r.where(F.col("event_type") == "click").select(F.col("ts").alias("h_ts"), "station_id")
    return rain, height


@query(
    "asof_height",
    f"""WITH {_CLICKS} SELECT e.event_id, e.ts, h.h_ts FROM events e
    ASOF LEFT JOIN h ON e.ts >= h.h_ts WHERE e.event_type = 'view'""",
)
def _asof(spark, sf):
    rain, height = _sides(spark, sf)
    return align.attach_latest(rain, height, "ts", "h_ts").select("event_id", "ts", "h_ts")


@query(
    "asof_by_station",
    """WITH h AS (SELECT DISTINCT user_id, ts AS h_ts FROM events WHERE event_type = 'click')
    SELECT e.event_id, e.ts, h.h_ts FROM events e
    ASOF LEFT JOIN h ON e.user_id = h.user_id AND e.ts >= h.h_ts WHERE e.event_type = 'view'""",
)
def _asof_by(spark, sf):
    rain, height = _sides(spark, sf)
    return align.attach_latest(rain, height, "ts", "h_ts", by=["station_id"]).select(
        "event_id", "ts", "h_ts"
    )


@query(
    "asof_offset",
    f"""WITH {_CLICKS}, m AS (SELECT DISTINCT {V.SQL_MARK} AS target_ts FROM events)
    SELECT target_ts, h_ts FROM (SELECT *, target_ts + INTERVAL 5 MINUTE AS due FROM m) t
    ASOF LEFT JOIN h ON t.due >= h.h_ts""",
)
def _asof_offset(spark, sf):
    _, height = _sides(spark, sf)
    targets = V.marks(spark, sf).withColumnRenamed("frame_ts", "target_ts")
    return align.match_times(targets, height, "target_ts", "h_ts", offset_minutes=5)


@query(
    "asof_tolerance",
    f"""WITH {_CLICKS}, m AS (SELECT DISTINCT {V.SQL_MARK} AS target_ts FROM events)
    SELECT target_ts, CASE WHEN h_ts >= due - INTERVAL 30 MINUTE THEN h_ts END AS h_ts
    FROM (SELECT *, target_ts + INTERVAL 5 MINUTE AS due FROM m) t ASOF LEFT JOIN h ON t.due >= h.h_ts""",
)
def _asof_tolerance(spark, sf):
    _, height = _sides(spark, sf)
    targets = V.marks(spark, sf).withColumnRenamed("frame_ts", "target_ts")
    return align.match_times(
        targets, height, "target_ts", "h_ts", offset_minutes=5, tolerance_minutes=30
    )


@query(
    "scan_in_minutes",
    f"""WITH {_CLICKS}, m AS (SELECT DISTINCT {V.SQL_MARK} AS target_ts FROM events),
    c AS (SELECT target_ts, h_ts, row_number() OVER (PARTITION BY target_ts
      ORDER BY date_trunc('minute', h_ts) DESC, h_ts) AS rn FROM m JOIN h
      ON date_trunc('minute', h_ts) BETWEEN target_ts - INTERVAL 4 MINUTE AND target_ts)
    SELECT m.target_ts, c.h_ts AS scan_ts FROM m LEFT JOIN c ON c.target_ts = m.target_ts AND rn = 1""",
)
def _scan_minutes(spark, sf):
    _, height = _sides(spark, sf)
    targets = V.marks(spark, sf).withColumnRenamed("frame_ts", "target_ts")
    return align.first_scan_in_minutes(targets, height.withColumnRenamed("h_ts", "scan_ts"))


# --- geolocation -------------------------------------------------------------


@query(
    "geostationary_to_latlon",
    """WITH p AS (SELECT l_orderkey, l_linenumber, -0.16 + (l_partkey % 160) * 0.002::DOUBLE AS x,
      -0.16 + (l_suppkey % 80) * 0.004::DOUBLE AS y FROM lineitem),
    d AS (SELECT *, cos(x) * cos(y) AS dx, sin(x) AS dy, cos(x) * sin(y) AS dz FROM p),
    q AS (SELECT *, dx * dx + dy * dy + pow(6378137.0 / 6356752.31414, 2) * dz * dz AS a,
      -2.0 * 42164160.0 * dx AS b, pow(42164160.0, 2) - pow(6378137.0, 2) AS c FROM d),
    r AS (SELECT *, CASE WHEN b * b - 4 * a * c >= 0 THEN (-b - sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * a) END
      AS rs FROM q)
    SELECT l_orderkey, l_linenumber, round(degrees(atan(pow(6378137.0 / 6356752.31414, 2) * rs * dz /
      sqrt(pow(42164160.0 - rs * dx, 2) + pow(rs * dy, 2)))), 5) AS lat,
      round(-75.0 - degrees(atan(-rs * dy / (42164160.0 - rs * dx))), 5) AS lon FROM r""",
)
def _geos(spark, sf):
    p = V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.lit(-0.16) + F.pmod("l_partkey", F.lit(160)) * F.lit(0.002)).alias("x"),
        (F.lit(-0.16) + F.pmod("l_suppkey", F.lit(80)) * F.lit(0.004)).alias("y"),
    )
    out = geo.geostationary_to_latlon(p, "x", "y", height=42164160.0 - geo.GEOS_EQ)
    return out.select(
        "l_orderkey", "l_linenumber", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon")
    )


@query(
    "parallax_shift",
    """WITH p AS (SELECT event_id, -30.0 + (event_id % 150) * 0.1::DOUBLE AS lat,
      -50.0 + (user_id % 120) * 0.1::DOUBLE AS lon, value * 30 AS h FROM events),
    u AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS ux, cos(radians(lat)) * sin(radians(lon)) AS uy,
      sin(radians(lat)) AS uz, 42157200.0 * cos(radians(-75.2)) AS sx, 42157200.0 * sin(radians(-75.2)) AS sy
      FROM p),
    s AS (SELECT *, sx - 6371000.0 * ux AS vx, sy - 6371000.0 * uy AS vy, -6371000.0 * uz AS vz FROM u),
    t AS (SELECT *, h / (vx * ux + vy * uy + vz * uz) AS t FROM s),
    g AS (SELECT event_id, 6371000.0 * ux + t * vx AS px, 6371000.0 * uy + t * vy AS py,
      6371000.0 * uz + t * vz AS pz FROM t)
    SELECT event_id, round(degrees(atan2(pz, sqrt(px * px + py * py))), 5) AS lat,
      round(degrees(atan2(py, px)), 5) AS lon FROM g""",
)
def _parallax(spark, sf):
    p = V.readings(spark, sf).select(
        "event_id",
        (F.lit(-30.0) + F.pmod("event_id", F.lit(150)) * F.lit(0.1)).alias("lat"),
        (F.lit(-50.0) + F.pmod("station_id", F.lit(120)) * F.lit(0.1)).alias("lon"),
        (F.col("value") * 30).alias("h"),
    )
    out = geo.parallax_shift(p, "h")
    return out.select("event_id", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


_VINCENTY_STEP = """s{n} AS (SELECT *, sig0 + bb * sin(sig) * (cos(2 * s1 + sig) + bb / 4 * (cos(sig)
  * (-1 + 2 * pow(cos(2 * s1 + sig), 2)) - bb / 6 * cos(2 * s1 + sig) * (-3 + 4 * pow(sin(sig), 2))
  * (-3 + 4 * pow(cos(2 * s1 + sig), 2)))) AS nsig FROM {prev}),
t{n} AS (SELECT * EXCLUDE (sig, nsig), nsig AS sig FROM s{n})"""

_VINCENTY = (
    f"""WITH {V.SQL_VOLUME}, d AS (SELECT DISTINCT ray, bin FROM volume),
c AS (SELECT ray, bin, radians(ray) AS az, (bin + 0.5) * 5000.0::DOUBLE AS dist,
  6378137.0::DOUBLE AS a, 1 / 298.257223563::DOUBLE AS f,
  radians(-22.9932804107666::DOUBLE) AS phi, -43.58795928955078::DOUBLE AS lon0 FROM d),
c1 AS (SELECT *, a * (1 - f) AS b, atan((1 - f) * tan(phi)) AS u1 FROM c),
c2 AS (SELECT *, atan2(tan(u1), cos(az)) AS s1, cos(u1) * sin(az) AS sal FROM c1),
c3 AS (SELECT *, 1 - sal * sal AS cc, (1 - sal * sal) * (a * a - b * b) / (b * b) AS uu FROM c2),
c4 AS (SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS aa,
  uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS bb FROM c3),
c5 AS (SELECT *, dist / (b * aa) AS sig0, dist / (b * aa) AS sig FROM c4), """
    + ", ".join(_VINCENTY_STEP.format(n=n, prev="c5" if n == 0 else f"t{n - 1}") for n in range(4))
    + """,
e AS (SELECT *, f / 16 * cc * (4 + f * (4 - 3 * cc)) AS c_,
  sin(u1) * sin(sig) - cos(u1) * cos(sig) * cos(az) AS q FROM t3)
SELECT ray, bin, round(degrees(atan2(sin(u1) * cos(sig) + cos(u1) * sin(sig) * cos(az),
    (1 - f) * sqrt(sal * sal + q * q))), 6) AS lat,
  round(lon0 + degrees(atan2(sin(sig) * sin(az), cos(u1) * cos(sig) - sin(u1) * sin(sig) * cos(az))
    - (1 - c_) * f * sal * (sig + c_ * sin(sig) * (cos(2 * s1 + sig) + c_ * cos(sig)
    * (-1 + 2 * pow(cos(2 * s1 + sig), 2))))), 6) AS lon FROM e"""
)


@query("polar_to_latlon", _VINCENTY)
def _polar(spark, sf):
    dim = V.volume(spark, sf).select("ray", "bin").distinct()
    dim = dim.withColumns(
        {"az": F.col("ray").cast("double"), "dist": bin_range(F.col("bin"), 0.0, 5000.0)}
    )
    out = geo.polar_to_latlon(dim, "az", "dist", REFERENCE_LAT, REFERENCE_LON)
    return out.select("ray", "bin", r6("lat").alias("lat"), r6("lon").alias("lon"))


def _tri_sql(pixels, targets):
    """CTEs from a pixel table: triangles, weights and the value at every target."""
    return f"""quads AS (SELECT a.vec_id, a.r, a.c, a.lat AS ya, a.lon AS xa, a.value AS va,
    b.lat AS yb, b.lon AS xb, b.value AS vb, c.lat AS yc, c.lon AS xc, c.value AS vc,
    d.lat AS yd, d.lon AS xd, d.value AS vd
  FROM {pixels} a JOIN {pixels} b ON b.vec_id = a.vec_id AND b.r = a.r AND b.c = a.c + 1
  JOIN {pixels} c ON c.vec_id = a.vec_id AND c.r = a.r + 1 AND c.c = a.c
  JOIN {pixels} d ON d.vec_id = a.vec_id AND d.r = a.r + 1 AND d.c = a.c + 1),
good AS (SELECT * FROM quads WHERE ((yb - ya) * (xc - xa) - (xb - xa) * (yc - ya))
  * ((yc - yd) * (xb - xd) - (xc - xd) * (yb - yd)) > 0),
tri AS (
  SELECT vec_id, r * 1000 + c * 4 AS tid, ya AS y1, xa AS x1, va AS v1, yb AS y2, xb AS x2,
    vb AS v2, yc AS y3, xc AS x3, vc AS v3 FROM good
  UNION ALL
  SELECT vec_id, r * 1000 + c * 4 + 1, yd, xd, vd, yc, xc, vc, yb, xb, vb FROM good),
wts AS (SELECT *, ((y2 - y3) * (t.lon - x3) + (x3 - x2) * (t.lat - y3)) /
    ((y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3)) AS w1,
  ((y3 - y1) * (t.lon - x3) + (x1 - x3) * (t.lat - y3)) /
    ((y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3)) AS w2
  FROM tri JOIN {targets} t ON t.lat BETWEEN least(y1, y2, y3) AND greatest(y1, y2, y3)
    AND t.lon BETWEEN least(x1, x2, x3) AND greatest(x1, x2, x3)),
hit AS (SELECT vec_id, target, arg_min(w1 * v1 + w2 * v2 + (1 - w1 - w2) * v3, tid) AS value
  FROM wts WHERE w1 >= -1e-12 AND w2 >= -1e-12 AND 1 - w1 - w2 >= -1e-12 GROUP BY 1, 2)"""


_TRI = f"{V.SQL_PIXELS}, {_tri_sql('pixels', 'targets')}"


@query(
    "interp_grid",
    f"""WITH {_TRI} SELECT e.vec_id, t.target, round(h.value, 6) AS value FROM embeddings e
    CROSS JOIN targets t LEFT JOIN hit h ON h.vec_id = e.vec_id AND h.target = t.target""",
)
def _interp(spark, sf):
    out = interpolate(
        V.pixels(spark, sf), V.target_grid(spark), ["vec_id"], tile=0.1, n_targets=36
    )
    return out.withColumn("value", r6("value"))


@query(
    "interp_static_weights",
    f"WITH {_TRI} SELECT vec_id, target, round(value, 6) AS value FROM hit",
)
def _interp_weights(spark, sf):
    p = V.pixels(spark, sf)
    geometry = p.select("row", "col", "lat", "lon").distinct()
    weights = interpolation_weights(geometry, V.target_grid(spark), tile=0.1)
    return apply_weights(p, weights, ["vec_id"], n_targets=36).withColumn("value", r6("value"))


# --- frame building ----------------------------------------------------------


@query(
    "satellite_frames",
    f"""WITH {_TRI}, m AS (SELECT DISTINCT {V.SQL_MARK} AS frame_ts FROM events),
    sc AS (SELECT vec_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(vec_id * 10 AS INT)) AS creation
      FROM embeddings),
    a AS (SELECT frame_ts, due, vec_id, creation FROM (SELECT *, frame_ts + INTERVAL 5 MINUTE AS due FROM m) t
      ASOF LEFT JOIN sc ON t.due >= sc.creation),
    u AS (SELECT frame_ts, CASE WHEN creation >= due - INTERVAL 20 MINUTE THEN vec_id END AS vec_id,
      CASE WHEN creation >= due - INTERVAL 20 MINUTE THEN creation END AS creation FROM a)
    SELECT frame_ts, creation, 0 AS ch, t.target, round(value, 6) AS value FROM u CROSS JOIN targets t
    LEFT JOIN hit ON hit.vec_id = u.vec_id AND hit.target = t.target""",
)
def _satellite_frames(spark, sf):
    rain = V.pixels(spark, sf).drop("vec_id")
    scans = V.frames(spark, sf).select(F.col("frame_ts").alias("creation"))
    out = satellite_frames(
        rain, V.marks(spark, sf), [V.target_grid(spark)], tolerance_minutes=20, tile=0.1,
        scans=scans,
    )
    return out.withColumn("value", r6("value"))


_SHIFTED = f"""{V.SQL_PIXELS},
u AS (SELECT *, 2000 + 100 * value AS h, cos(radians(lat)) * cos(radians(lon)) AS ux,
  cos(radians(lat)) * sin(radians(lon)) AS uy, sin(radians(lat)) AS uz,
  42157200.0 * cos(radians(-75.2)) AS sx, 42157200.0 * sin(radians(-75.2)) AS sy FROM pixels),
s AS (SELECT *, sx - 6371000.0 * ux AS vx, sy - 6371000.0 * uy AS vy, -6371000.0 * uz AS vz FROM u),
t AS (SELECT *, h / (vx * ux + vy * uy + vz * uz) AS t FROM s),
g AS (SELECT vec_id, r, c, value, 6371000.0 * ux + t * vx AS px, 6371000.0 * uy + t * vy AS py,
  6371000.0 * uz + t * vz AS pz FROM t),
moved AS (SELECT vec_id, r, c, value, degrees(atan2(pz, sqrt(px * px + py * py))) AS lat,
  degrees(atan2(py, px)) AS lon FROM g),
both_grids AS (SELECT target, lat, lon FROM targets UNION ALL
  SELECT 100 + n, -21.95::DOUBLE - floor(n / 3.0) * 0.153::DOUBLE,
    -43.95::DOUBLE + (n % 3) * 0.147::DOUBLE FROM (SELECT unnest(generate_series(0, 8)) AS n))"""


@query(
    "satellite_parallax_frames",
    f"""WITH {_SHIFTED}, {_tri_sql("moved", "both_grids")},
    m AS (SELECT DISTINCT {V.SQL_MARK} AS frame_ts FROM events),
    sc AS (SELECT vec_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(vec_id * 10 AS INT)) AS creation
      FROM embeddings),
    a AS (SELECT frame_ts, due, vec_id, creation FROM (SELECT *, frame_ts + INTERVAL 5 MINUTE AS due FROM m) q
      ASOF LEFT JOIN sc ON q.due >= sc.creation),
    used AS (SELECT frame_ts, CASE WHEN creation >= due - INTERVAL 20 MINUTE THEN vec_id END AS vec_id,
      CASE WHEN creation >= due - INTERVAL 20 MINUTE THEN creation END AS creation FROM a)
    SELECT frame_ts, creation, CAST(g.target >= 100 AS INT) AS ch, g.target % 100 AS target,
      round(value, 5) AS value FROM used CROSS JOIN both_grids g
    LEFT JOIN hit ON hit.vec_id = used.vec_id AND hit.target = g.target""",
)
def _parallax_frames(spark, sf):
    rain = V.pixels(spark, sf).drop("vec_id")
    heights = rain.withColumn("height", F.lit(2000.0) + F.col("value") * 100).drop("value")
    grids = [V.target_grid(spark), V.target_grid(spark, 3)]
    scans = V.frames(spark, sf).select(F.col("frame_ts").alias("creation"))
    out = satellite_frames(
        rain, V.marks(spark, sf), grids, heights, tolerance_minutes=20, tile=0.1,
        scans=scans, height_scans=scans,
    )
    return out.withColumn("value", F.round("value", 5))


@query(
    "radar_frames",
    f"""WITH {_TRI}, m AS (SELECT DISTINCT {V.SQL_MARK} AS frame_ts FROM events),
    sc AS (SELECT vec_id, TIMESTAMP '2024-01-01 00:00:00'
      + to_seconds(CAST(vec_id * 600 - (vec_id % 7) * 60 + 30 AS INT)) AS scan_ts FROM embeddings),
    c AS (SELECT frame_ts, scan_ts, vec_id, row_number() OVER (PARTITION BY frame_ts
      ORDER BY date_trunc('minute', scan_ts) DESC, scan_ts) AS rn FROM m JOIN sc
      ON date_trunc('minute', scan_ts) BETWEEN frame_ts - INTERVAL 4 MINUTE AND frame_ts)
    SELECT m.frame_ts, c.scan_ts, t.target, round(value, 6) AS value FROM m CROSS JOIN targets t
    LEFT JOIN c ON c.frame_ts = m.frame_ts AND rn = 1 LEFT JOIN hit ON hit.vec_id = c.vec_id AND hit.target = t.target""",
)
def _radar_frames(spark, sf):
    p = V.pixels(spark, sf)
    geometry = p.select("row", "col", "lat", "lon").distinct()
    weights = interpolation_weights(geometry, V.target_grid(spark), tile=0.1)
    late = F.make_dt_interval(
        mins=(F.col("vec_id") * 10 - F.pmod("vec_id", F.lit(7))).cast("int"), secs=F.lit(30)
    )
    scans = p.withColumn("scan_ts", F.lit(V.T0).cast("timestamp_ntz") + late)
    out = radar_frames(scans, V.marks(spark, sf), weights, n_targets=36)
    return out.withColumn("value", r6("value"))


# --- objects -----------------------------------------------------------------


@query(
    "smooth_rays",
    f"""WITH {V.SQL_COMPOSITES}, o AS (SELECT CAST(unnest(generate_series(-2, 1)) AS INT) AS o),
    m AS (SELECT scan, ray, bin, CASE WHEN bin + o < 0 THEN -(bin + o) - 1
      WHEN bin + o > 63 THEN 127 - (bin + o) ELSE bin + o END AS src FROM comp CROSS JOIN o)
    SELECT m.scan, m.ray, m.bin, round(avg(c.value), 6) AS value FROM m JOIN comp c
    ON c.scan = m.scan AND c.ray = m.ray AND c.bin = m.src GROUP BY 1, 2, 3""",
)
def _smooth(spark, sf):
    rays = V.composites(spark, sf).withColumn("values", smooth_symmetric(F.col("values"), 4))
    return rays.select(
        F.col("scan_id").alias("scan"), "ray", F.posexplode("values").alias("bin", "value")
    ).withColumn("value", r6("value"))


THRESHOLD = 4.0

_LABELS = f"""{V.SQL_COMPOSITES},
obj AS (SELECT scan, ray, bin, value, ray * 64 + bin AS cell FROM comp WHERE value >= {THRESHOLD}),
edges AS (SELECT a.scan, a.cell AS src, b.cell AS dst FROM obj a
  JOIN (SELECT unnest([-1, 0, 1]) AS dr) r ON true JOIN (SELECT unnest([-1, 0, 1]) AS db) d ON true
  JOIN obj b ON b.scan = a.scan AND b.ray = (a.ray + dr + 50) % 50 AND b.bin = a.bin + db),
lab(scan, cell, label) USING KEY (scan, cell) AS (
  SELECT scan, cell, cell FROM obj
  UNION
  SELECT e.scan, e.dst, min(l.label) FROM lab l JOIN edges e ON e.scan = l.scan AND e.src = l.cell
  JOIN recurring.lab cur ON cur.scan = e.scan AND cur.cell = e.dst
  WHERE l.label < cur.label GROUP BY 1, 2),
labelled AS (SELECT o.scan, o.ray, o.bin, o.value, CAST(l.label AS BIGINT) AS label
  FROM obj o JOIN lab l USING (scan, cell))"""


def _labelled(spark, sf):
    cells = objects.echo_cells(V.composites(spark, sf), THRESHOLD)
    return objects.label_objects(cells, V.BINS, V.RAYS)


@query(
    "objects",
    f"WITH RECURSIVE {_LABELS} SELECT scan, ray, bin, round(value, 6) AS value, label FROM labelled",
)
def _objects(spark, sf):
    return _labelled(spark, sf).withColumn("value", r6("value"))


_STATS = f"""{_LABELS},
nbr AS (SELECT l.*, l.ray + dr AS nr, l.bin + db AS nb FROM labelled l
  JOIN (SELECT * FROM (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) n(dr, db)) ON true),
per AS (SELECT n.scan, n.ray, n.bin, n.label, n.value, sum(coalesce(m.value, 0)) AS around,
  sum(CASE WHEN n.nr BETWEEN 0 AND 49 AND n.nb BETWEEN 0 AND 63
    AND (m.label IS NULL OR m.label <> n.label) THEN 1 ELSE 0 END) AS border
  FROM nbr n LEFT JOIN labelled m ON m.scan = n.scan AND m.ray = n.nr AND m.bin = n.nb
  GROUP BY 1, 2, 3, 4, 5),
st AS (SELECT scan, label, count(*) AS size, count(*)::DOUBLE / nullif(sum(border), 0) AS ratio,
  avg(abs(value - around / 4) / value) AS variation FROM per GROUP BY 1, 2)"""


@query(
    "object_stats",
    f"""WITH RECURSIVE {_STATS} SELECT scan, label, size, round(ratio, 6) AS ratio,
      round(variation, 6) AS variation FROM st""",
)
def _object_stats(spark, sf):
    stats = objects.object_stats(_labelled(spark, sf), THRESHOLD, V.BINS, V.RAYS)
    return stats.groupBy("scan", "label").agg(
        F.max("size").alias("size"), r6(F.max("ratio")).alias("ratio"),
        r6(F.max("variation")).alias("variation"),
    )


@query(
    "despeckle",
    f"""WITH RECURSIVE {_STATS} SELECT l.scan, l.ray, l.bin, round(l.value, 6) AS value, l.label
    FROM labelled l JOIN st USING (scan, label)
    WHERE NOT (size < 10 OR coalesce(ratio < 0.4, false) OR variation > 100)""",
)
def _despeckle(spark, sf):
    out = objects.despeckle(
        V.composites(spark, sf), V.BINS, V.RAYS, THRESHOLD, min_size=10, min_ratio=0.4,
        max_variation=100,
    )
    return out.select("scan", "ray", "bin", r6("value").alias("value"), "label")


@query(
    "despeckle_time",
    f"""WITH RECURSIVE {_LABELS},
    ov AS (SELECT a.scan, a.ray, a.bin, a.value, a.label, count(b.scan) AS n_overlaps FROM labelled a
      LEFT JOIN labelled b ON b.scan IN (a.scan - 1, a.scan + 1) AND b.ray = a.ray AND b.bin = a.bin
      GROUP BY 1, 2, 3, 4, 5),
    best AS (SELECT *, max(n_overlaps) OVER (PARTITION BY scan, label) AS object_overlaps FROM ov)
    SELECT scan, ray, bin, round(value, 6) AS value, label, n_overlaps, object_overlaps FROM best
    WHERE object_overlaps >= 2""",
)
def _despeckle_time(spark, sf):
    rays = V.composites(spark, sf)
    scans = rays.select("scan_id", F.col("scan_id").alias("seq")).distinct()
    out = objects.despeckle_time(
        rays, scans, V.BINS, V.RAYS, [-1, 1], THRESHOLD, min_intersections=2
    )
    return out.withColumn("value", r6("value"))


# --- motion ------------------------------------------------------------------


def _motion_arrays(across, down):
    """Packed ``du`` (same in every cell) and ``dv`` (by cell) columns."""
    return {
        "du": F.array_repeat(across, 64),
        "dv": F.transform(positions(64), lambda k: (F.pmod(k, F.lit(5)) - 2) * F.lit(down)),
    }


_MOVE = """mv AS (SELECT vec_id, i, j, k, value,
  j + ((vec_id % 3) - 1) * 0.75::DOUBLE AS x, i + ((k % 5) - 2) * 0.6::DOUBLE AS y FROM cells)"""


def _moved(spark, sf, mode, padding):
    across = (F.pmod("vec_id", F.lit(3)) - 1) * F.lit(0.75)
    f = V.frames(spark, sf).withColumns(_motion_arrays(across, 0.6))
    return warp(f, 8, 8, ["vec_id"], mode, padding).withColumn("value", r6("value"))


@query(
    "warp_nearest",
    f"""WITH {V.SQL_CELLS}, {_MOVE}, s AS (SELECT vec_id, i, j,
      CAST(round_even(greatest(least(y, 7), 0), 0) AS INT) AS si,
      CAST(round_even(greatest(least(x, 7), 0), 0) AS INT) AS sj FROM mv)
    SELECT s.vec_id, s.i, s.j, round(c.value, 6) AS value FROM s JOIN cells c
    ON c.vec_id = s.vec_id AND c.i = s.si AND c.j = s.sj""",
)
def _warp_nearest(spark, sf):
    return _moved(spark, sf, "nearest", "border")


def _bilinear_sql(clamp):
    y, x = ("greatest(least(y, 7), 0)", "greatest(least(x, 7), 0)") if clamp else ("y", "x")
    return f"""WITH {V.SQL_CELLS}, {_MOVE},
    f AS (SELECT vec_id, i, j, {y} AS y, {x} AS x, floor({y}) AS i0, floor({x}) AS j0 FROM mv),
    c4 AS (SELECT *, i0 + a AS ci, j0 + b AS cj,
      (CASE a WHEN 0 THEN 1 - (y - i0) ELSE y - i0 END) * (CASE b WHEN 0 THEN 1 - (x - j0) ELSE x - j0 END) AS w
      FROM f JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) q(a, b) ON true)
    SELECT c4.vec_id, c4.i, c4.j, round(sum(w * coalesce(c.value, 0)), 6) AS value FROM c4
    LEFT JOIN cells c ON c.vec_id = c4.vec_id AND c.i = ci AND c.j = cj GROUP BY 1, 2, 3"""


@query("warp_bilinear", _bilinear_sql(False))
def _warp_bilinear(spark, sf):
    return _moved(spark, sf, "bilinear", "zeros")


@query("warp_bilinear_border", _bilinear_sql(True))
def _warp_border(spark, sf):
    return _moved(spark, sf, "bilinear", "border")


@query(
    "evolve",
    f"""WITH RECURSIVE {V.SQL_CELLS}, ev(vec_id, lead, i, j, value) AS (
      SELECT vec_id, 0, i, j, value FROM cells
      UNION ALL
      SELECT c.vec_id, p.lead + 1, c.i, c.j, p.value + 0.1::DOUBLE * (p.lead + 1)
      FROM cells c JOIN ev p ON p.vec_id = c.vec_id AND p.lead < 4
        AND p.i = CAST(round_even(greatest(least(c.i + ((c.k % 5) - 2) * 0.6::DOUBLE, 7), 0), 0) AS INT)
        AND p.j = CAST(round_even(greatest(least(c.j + (((c.vec_id + p.lead + 1) % 3) - 1) * 0.75::DOUBLE, 7), 0), 0) AS INT))
    SELECT vec_id, CAST(lead AS INT) AS lead, i, j, round(value, 6) AS value FROM ev WHERE lead > 0""",
)
def _evolve(spark, sf):
    f = V.frames(spark, sf).select("vec_id", "values")
    motion = f.select(
        "vec_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("lead")
    )
    across = (F.pmod(F.col("vec_id") + F.col("lead"), F.lit(3)) - 1) * F.lit(0.75)
    gain = F.array_repeat(F.lit(0.1) * F.col("lead"), 64)
    motion = motion.withColumns({**_motion_arrays(across, 0.6), "intensity": gain})
    out = evolve(f, motion, 8, 8, 4, key="vec_id")
    return unpack_frames(out, 8, ["vec_id", "lead"]).withColumn("value", r6("value"))


def _frame_pairs(spark, sf):
    f = V.frames(spark, sf).select("vec_id", "values")
    prev = f.select((F.col("vec_id") + 1).alias("vec_id"), F.col("values").alias("prev"))
    return f.withColumnRenamed("values", "cur").join(prev, "vec_id", "inner")


_BLOCKS = f"""{V.SQL_CELLS},
sh AS (SELECT a.s AS di, b.s AS dj FROM (SELECT unnest([-1, 0, 1]) AS s) a
  CROSS JOIN (SELECT unnest([-1, 0, 1]) AS s) b),
ssd AS (SELECT c.vec_id, CAST(c.i // 4 AS INT) AS bi, CAST(c.j // 4 AS INT) AS bj, di, dj,
  sum((c.value - p.value) ** 2) AS ssd FROM cells c CROSS JOIN sh JOIN cells p
  ON p.vec_id = c.vec_id - 1 AND p.i = greatest(least(c.i - di, 7), 0)
  AND p.j = greatest(least(c.j - dj, 7), 0) GROUP BY 1, 2, 3, 4, 5),
motion AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, bi, bj
  ORDER BY ssd, di * di + dj * dj, di, dj) AS rn FROM ssd) WHERE rn = 1)"""


@query(
    "motion_block",
    f"""WITH {_BLOCKS} SELECT vec_id, bi, bj, CAST(di AS INT) AS di, CAST(dj AS INT) AS dj,
      round(ssd, 4) AS ssd FROM motion""",
)
def _motion(spark, sf):
    out = block_motion(_frame_pairs(spark, sf), 8, 8, 4, 1, key="vec_id")
    return out.withColumn("ssd", F.round("ssd", 4))


@query(
    "extrapolate",
    f"""WITH {_BLOCKS}, l AS (SELECT CAST(unnest([1, 2, 3]) AS INT) AS lead)
    SELECT c.vec_id, lead, c.i, c.j, round(s.value, 6) AS value FROM cells c CROSS JOIN l
    JOIN motion m ON m.vec_id = c.vec_id AND m.bi = c.i // 4 AND m.bj = c.j // 4
    JOIN cells s ON s.vec_id = c.vec_id AND s.i = greatest(least(c.i - lead * di, 7), 0)
      AND s.j = greatest(least(c.j - lead * dj, 7), 0)""",
)
def _extrapolate(spark, sf):
    moved = block_shifts(_frame_pairs(spark, sf), 8, 8, 4, 1, key="vec_id")
    out = extrapolate_moved(moved, 8, 8, 4, 3, key="vec_id", values="cur")
    return unpack_frames(out, 8, ["vec_id", "lead"]).withColumn("value", r6("value"))


@query(
    "extrapolate_missing",
    f"""WITH {_BLOCKS}, l AS (SELECT CAST(unnest([1, 2, 3]) AS INT) AS lead),
    moved AS (SELECT c.vec_id, lead, round(sum(s.value), 4) AS total FROM cells c CROSS JOIN l
      JOIN motion m ON m.vec_id = c.vec_id AND m.bi = c.i // 4 AND m.bj = c.j // 4
      JOIN cells s ON s.vec_id = c.vec_id AND s.i = greatest(least(c.i - lead * di, 7), 0)
        AND s.j = greatest(least(c.j - lead * dj, 7), 0) GROUP BY 1, 2)
    SELECT e.vec_id, l.lead, total FROM embeddings e CROSS JOIN l
    LEFT JOIN moved m ON m.vec_id = e.vec_id AND m.lead = l.lead""",
)
def _extrapolate_missing(spark, sf):
    """The first frame has no motion: its forecasts are missing, not absent."""
    motion = block_shifts(_frame_pairs(spark, sf), 8, 8, 4, 1, key="vec_id")
    out = extrapolate(V.frames(spark, sf), motion, 8, 8, 4, 3, key="vec_id")
    total = F.aggregate("values", F.lit(0.0), lambda s, v: s + v)
    return out.select("vec_id", "lead", F.round(total, 4).alias("total"))


@query(
    "motion_pyramid",
    f"""WITH {V.SQL_COMPOSITES},
    small AS (SELECT scan, CAST(ray // 2 AS INT) AS i, CAST(bin // 2 AS INT) AS j, avg(value) AS value
      FROM comp WHERE ray < 48 GROUP BY 1, 2, 3),
    sh AS (SELECT a.s AS di, b.s AS dj FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS s) a
      CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS s) b),
    coarse AS (SELECT c.scan, CAST(c.i // 4 AS INT) AS bi, CAST(c.j // 4 AS INT) AS bj, di, dj,
      sum((c.value - p.value) ** 2) AS ssd FROM small c CROSS JOIN sh JOIN small p ON p.scan = c.scan - 1
      AND p.i = greatest(least(c.i - di, 23), 0) AND p.j = greatest(least(c.j - dj, 31), 0) GROUP BY 1, 2, 3, 4, 5),
    first AS (SELECT * FROM coarse QUALIFY row_number() OVER (PARTITION BY scan, bi, bj
      ORDER BY ssd, di * di + dj * dj, di, dj) = 1),
    one AS (SELECT a.s AS di, b.s AS dj FROM (SELECT unnest([-1, 0, 1]) AS s) a
      CROSS JOIN (SELECT unnest([-1, 0, 1]) AS s) b),
    fine AS (SELECT c.scan, f.bi, f.bj, 2 * f.di + o.di AS di, 2 * f.dj + o.dj AS dj,
      sum((c.value - p.value) ** 2) AS ssd FROM comp c
      JOIN first f ON f.scan = c.scan AND f.bi = c.ray // 8 AND f.bj = c.bin // 8 CROSS JOIN one o
      JOIN comp p ON p.scan = c.scan - 1 AND p.ray = greatest(least(c.ray - 2 * f.di - o.di, 47), 0)
      AND p.bin = greatest(least(c.bin - 2 * f.dj - o.dj, 63), 0) WHERE c.ray < 48 GROUP BY 1, 2, 3, 4, 5)
    SELECT scan AS scan_id, bi, bj, CAST(di AS INT) AS di, CAST(dj AS INT) AS dj, round(ssd, 3) AS ssd FROM fine
    QUALIFY row_number() OVER (PARTITION BY scan, bi, bj ORDER BY ssd, di * di + dj * dj, di, dj) = 1""",
)
def _motion_pyramid(spark, sf):
    """Composites of 48 x 64 cells: searched on half the size first, then refined."""
    rays = V.composites(spark, sf).where("ray < 48")
    lines = F.sort_array(F.collect_list(F.struct("ray", "values")))
    packed = rays.groupBy("scan_id").agg(F.flatten(F.transform(lines, lambda r: r["values"])).alias("cur"))
    whole = packed.where(F.size("cur") == 48 * V.BINS)
    prev = whole.select((F.col("scan_id") + 1).alias("scan_id"), F.col("cur").alias("prev"))
    found = block_shifts(whole.join(prev, "scan_id"), 48, V.BINS, 8, 2, "scan_id", levels=1)
    blocks = found.select("scan_id", F.posexplode("shifts").alias("b", "s"))
    return blocks.select(
        "scan_id", F.floor(F.col("b") / 8).cast("int").alias("bi"), F.pmod("b", F.lit(8)).alias("bj"),
        "s.di", "s.dj", F.round("s.ssd", 3).alias("ssd"),
    )


@query(
    "ensemble_mean",
    f"""WITH {V.SQL_PREDICTIONS}, m AS (SELECT unnest([0, 1, 2, 3]) AS member)
    SELECT model, issue, lag, i, j, round(avg(value * (1 + 0.05 * member)), 6) AS value
    FROM predictions CROSS JOIN m WHERE lag <= 2 GROUP BY 1, 2, 3, 4, 5""",
)
def _ensemble(spark, sf):
    preds = V.predictions(spark, sf, 2)
    members = preds.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(3))))
    members = members.withColumn(
        "values", F.transform("values", lambda v: v * (1 + F.lit(0.05) * F.col("member")))
    )
    out = ensemble_mean_packed(members, ["model", "issue", "lag"], 8)
    return out.withColumn("value", r6("value"))


@query(
    "score_model",
    f"""WITH {V.SQL_CELLS}, o AS (SELECT unnest([0, 1, 2]) AS o), l AS (SELECT CAST(unnest([1, 2]) AS INT) AS lead),
    n AS (SELECT vec_id, k, i, j, ln(1.0 + value) / 1.2 AS x FROM cells),
    m AS (SELECT e.vec_id, c.k, sum(coalesce(n.x, 0)) / 3 AS x FROM embeddings e
      CROSS JOIN (SELECT DISTINCT k FROM cells) c CROSS JOIN o
      LEFT JOIN n ON n.vec_id = e.vec_id - o AND n.k = c.k GROUP BY 1, 2)
    SELECT 'mean3' AS model, vec_id AS issue, lead, CAST(k AS INT) AS cell,
      round(exp(greatest(x * (1 - 0.1 * lead), 0) * 1.2) - 1, 6) AS value FROM m CROSS JOIN l""",
)
def _score_model(spark, sf):
    f = V.frames(spark, sf)
    keys = f.select(F.col("frame_ts").alias("key_ts"), F.col("vec_id").alias("issue"))
    samples = stack_inputs(past_frames(keys, f, 3), 8, 8)

    def mean3(x):
        steady = x.mean(axis=1)
        return np.stack([steady * 0.9, steady * 0.8], axis=1)

    out = score_frames(samples, mean3, "mean3", 3, 2, 8, 8, transform=5, mean=0.0, std=0.4)
    named = out.join(f.select(F.col("frame_ts").alias("issue_ts"), F.col("vec_id").alias("issue")), "issue_ts")
    return named.select(
        "model", "issue", "lead", F.posexplode("values").alias("cell", "value")
    ).withColumn("value", r6("value"))
