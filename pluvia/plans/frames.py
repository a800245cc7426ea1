"""Frame building from satellite pixels and from radar composites."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.functions.geo import SATELLITE_ALT, SATELLITE_LAT, SATELLITE_LON, parallax_shift
from pluvia.operators.align import attach_latest, first_scan_in_minutes, match_times
from pluvia.operators.interpolate import (
    apply_weights,
    interpolate_between,
    interpolate_packed,
    static_targets,
)
from pluvia.session import fits_broadcast, stored


def with_cloud_height(
    rain: DataFrame,
    heights: DataFrame,
    tile: float = 0.25,
    unknown: str = "drop",
    scans: DataFrame | None = None,
    height_scans: DataFrame | None = None,
) -> DataFrame:
    """Rain pixels with the cloud height of the latest height scan at or before them.

    ``rain``: ``creation, row, col, lat, lon, value``; ``heights``: the same with
    ``height``. The scans are matched on distinct times; heights are then
    interpolated at the pixel positions, which meet on parts of the map. Pixels with no
    known height are dropped, or kept with a NULL height. ``scans`` and
    ``height_scans`` (``creation``, one row per scan) save reading the pixels for the
    times alone.
    """
    h = heights.withColumnRenamed("creation", "creation_h")
    times_h = h if height_scans is None else height_scans.withColumnRenamed("creation", "creation_h")
    matched = match_times(rain if scans is None else scans, times_h, "creation", "creation_h")
    return _at_heights(rain, h, matched, tile, unknown)


def _at_heights(rain: DataFrame, heights: DataFrame, matched: DataFrame, tile: float, unknown: str) -> DataFrame:
    """Pixels of the matched scans (``creation, creation_h``) with the height there."""
    matched = F.broadcast(matched) if fits_broadcast(matched) else matched
    pixels = rain.join(matched, "creation", "inner")
    known = pixels.where("creation_h is not null")
    found = interpolate_between(heights, known, ["creation_h"], "height", tile, keep=unknown != "drop")
    found = found.drop("creation_h")
    if unknown == "drop":
        return found
    rest = pixels.where("creation_h is null").drop("creation_h")
    return found.unionByName(rest.withColumn("height", F.lit(None).cast("double")))


def correct_parallax(
    rain: DataFrame,
    heights: DataFrame,
    tile: float = 0.25,
    unknown: str = "drop",
    sat_lon: float = SATELLITE_LON,
    sat_lat: float = SATELLITE_LAT,
    sat_alt: float = SATELLITE_ALT,
    scans: DataFrame | None = None,
    height_scans: DataFrame | None = None,
) -> DataFrame:
    """Rain pixels moved below their clouds, once per scan."""
    located = with_cloud_height(rain, heights, tile, unknown, scans, height_scans)
    moved = parallax_shift(
        located, "height", sat_lon=sat_lon, sat_lat=sat_lat, sat_alt=sat_alt, unknown=unknown
    )
    return moved.where("lat is not null and lon is not null").drop("height")


def satellite_frames(
    rain: DataFrame,
    target_times: DataFrame,
    grids: list[DataFrame],
    heights: DataFrame | None = None,
    offset_minutes: int = 5,
    tolerance_minutes: int | None = None,
    tile: float = 0.25,
    unknown: str = "drop",
    scans: DataFrame | None = None,
    height_scans: DataFrame | None = None,
) -> DataFrame:
    """Cells of every target time on every grid; grid ``n`` is channel ``n``.

    Every target time has every cell of every grid, NULL where no scan or no pixel
    tells its value. Only the scans that some target time uses are corrected (with
    ``heights``) and interpolated, each once for all grids. A scan's cells travel as one row to
    the target times and appear there. ``grids`` hold ``target, lat, lon``; they are
    configuration and small. ``scans`` and ``height_scans`` (``creation``, one row per scan) serve
    the matching of times; without them the times are gathered from the pixels. The matched times,
    a row per target time, are stored first: all that follows joins with that table.
    """
    used = match_times(
        target_times, rain if scans is None else scans, "frame_ts", "creation",
        offset_minutes=offset_minutes, tolerance_minutes=tolerance_minutes,
    )
    if heights is not None:
        times_h = heights if height_scans is None else height_scans
        needed = used.select("creation").where("creation is not null").distinct()
        matched = match_times(needed, times_h.withColumnRenamed("creation", "creation_h"), "creation", "creation_h")
        used = used.join(matched, "creation", "left")
    used = stored(used)
    wanted = used.where("creation is not null").drop("frame_ts").distinct()
    if heights is None:
        pixels = rain.join(F.broadcast(wanted) if fits_broadcast(wanted) else wanted, "creation", "left_semi")
    else:
        h = heights.withColumnRenamed("creation", "creation_h")
        located = _at_heights(rain, h, wanted, tile, unknown)
        pixels = parallax_shift(located, "height", unknown=unknown).drop("height")
    targets = None
    for ch, grid in enumerate(grids):
        g = grid.select(F.struct(F.lit(ch).alias("ch"), "target").alias("target"), "lat", "lon")
        targets = g if targets is None else targets.unionByName(g)
    known = static_targets(targets)
    if known is None:
        raise ValueError("the grids are too large to be configuration")
    cells = interpolate_packed(
        pixels, known.column("lat").to_numpy(), known.column("lon").to_numpy(), ["creation"], "value"
    )
    spark = rain.sparkSession
    names = spark.createDataFrame(
        known.select(["target"]).append_column("_at", pa.array(range(known.num_rows), pa.int32()))
    )
    frames = used.select("frame_ts", "creation").join(cells, "creation", "left")
    missing = F.array_repeat(F.lit(None).cast("double"), known.num_rows)
    each = frames.select("frame_ts", "creation", F.posexplode(F.coalesce("values", missing)).alias("_at", "value"))
    kind = grids[0].schema["target"].dataType
    return each.join(F.broadcast(names), "_at").select(
        "frame_ts", "creation", F.col("target.ch").cast("int").alias("ch"),
        F.col("target.target").cast(kind).alias("target"), "value",
    )


def radar_frames(
    composites: DataFrame,
    target_times: DataFrame,
    weights: DataFrame,
    back: int = 4,
    n_targets: int | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """Cells of every target time from the scan of its minute or up to ``back`` earlier.

    ``composites``: ``by, scan_ts, row (ray), col (bin), value``. ``by`` names the site: each has its own
    target times, scans and weights. With ``n_targets`` every target time has all targets
    ``0..n-1``, NULL where no scan or no beam tells the value; without it only the targets that the
    weights know, and a target time without a scan keeps one row with NULL cell.
    """
    by = by or []
    used = first_scan_in_minutes(target_times, composites, "frame_ts", "scan_ts", by, back)
    needed = composites.join(used.select(*by, "scan_ts").distinct(), [*by, "scan_ts"], "left_semi")
    cells = apply_weights(needed, weights, [*by, "scan_ts"], n_targets=n_targets, on=by)
    if n_targets is None:
        found = used.join(cells, [*by, "scan_ts"], "left")
    else:
        kind = weights.schema["target"].dataType
        wanted = used.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_targets - 1))).alias("target"))
        wanted = wanted.withColumn("target", F.col("target").cast(kind))
        found = wanted.join(cells, [*by, "scan_ts", "target"], "left")
    return found.select(*by, "frame_ts", "scan_ts", "target", "value")


def stale_targets(
    target_times: DataFrame, scans: DataFrame, offset_minutes: int = 5
) -> DataFrame:
    """Target times with the age of the scan they would use."""
    got = attach_latest(target_times, scans, "frame_ts", "creation", offset_minutes=offset_minutes)
    return got.withColumn("age", F.col("frame_ts") - F.col("creation"))
