"""Radar volumes: azimuth regularisation, gap filling and vertical compositing.

Rays are packed: one row per (sweep, ray) with the range bins in an array. A sweep
has a few hundred rays, so windows over one sweep stay small however many scans
there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.functions.arrays import int_div
from pluvia.functions.radar import NRAYS, mean_azimuth, ray_bin
from pluvia.session import extended


def with_ray_bin(
    rays: DataFrame, start: str = "start_az", stop: str = "stop_az", nrays: int = NRAYS
) -> DataFrame:
    """Azimuth sector of every ray; rays without a known azimuth are dropped."""
    known = rays.where(
        F.col(start).isNotNull() & F.col(stop).isNotNull() & ~F.isnan(start) & ~F.isnan(stop)
    )
    return known.withColumn("ray_bin", ray_bin(mean_azimuth(F.col(start), F.col(stop)), nrays))


def azimuth_histogram(rays: DataFrame, by: list[str], nrays: int = NRAYS) -> DataFrame:
    """Number of rays in every sector of every sweep, empty sectors included."""
    counts = rays.groupBy(*by, "ray_bin").agg(F.count(F.lit(1)).alias("n"))
    blanks = rays.select(*by).distinct().select(
        *by, F.explode(F.sequence(F.lit(0), F.lit(nrays - 1))).alias("ray_bin"),
        F.lit(0).cast("long").alias("n"),
    )
    return counts.unionByName(blanks).groupBy(*by, "ray_bin").agg(F.sum("n").alias("n"))


def repeated_sectors(histogram: DataFrame) -> DataFrame:
    return histogram.where(F.col("n") > 1)


def missing_sectors(histogram: DataFrame) -> DataFrame:
    return histogram.where(F.col("n") == 0)


def _median(values: Column) -> Column:
    """Median of the known elements; the array is sorted once."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        return (F.get(s, int_div(n - 1, 2)) + F.get(s, int_div(n, 2))) / 2

    ordered = F.array(F.array_sort(F.filter(values, lambda v: v.isNotNull())))
    return F.get(F.transform(ordered, middle), F.lit(0))


def _struct_of(rays: DataFrame) -> str:
    return f"struct<values:{rays.schema['values'].dataType.simpleString()}>"


def merge_repeats(rays: DataFrame, by: list[str]) -> DataFrame:
    """One ray per sector.

    Rays that share a sector are replaced by the bin-wise median of the repeats
    that are not all zero and of the first ray in the nearest occupied sector on
    either side. All medians use the rays as measured.
    """
    sector = Window.partitionBy(*by, "ray_bin")
    order = Window.partitionBy(*by).orderBy("ray_bin")
    start, end = Window.unboundedPreceding, Window.unboundedFollowing
    # A sweep is placed once; all windows and the grouping work on that.
    placed = rays.repartition(*by).select(
        *by, "ray_bin", "values", F.count(F.lit(1)).over(sector).alias("_n"),
        (F.row_number().over(sector.orderBy("ray_idx")) == 1).alias("_leads"),
    )
    leader = F.when(F.col("_leads"), F.struct("values"))
    last = lambda lo, hi: F.last(leader, ignorenulls=True).over(order.rangeBetween(lo, hi))
    first = lambda lo, hi: F.first(leader, ignorenulls=True).over(order.rangeBetween(lo, hi))
    placed = placed.withColumns(
        {
            "_before": F.coalesce(last(start, -1), last(start, end)),
            "_after": F.coalesce(first(1, end), first(start, end)),
        }
    )
    several = F.col("_n") > 1
    own = F.when(~several | F.exists("values", lambda v: v != 0), F.struct("values"))
    near = F.when(several & F.col("_leads"), F.array("_before", "_after"))
    all_ = F.concat(F.array(own), F.coalesce(near, F.array().cast(f"array<{_struct_of(rays)}>")))
    kept = placed.select(*by, "ray_bin", F.explode(all_).alias("_e")).where("_e is not null")
    grouped = kept.groupBy(*by, "ray_bin").agg(F.collect_list("_e.values").alias("_v"))
    size = F.array_max(F.transform("_v", lambda v: F.size(v)))
    merged = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda b: _median(F.transform("_v", lambda v: F.get(v, b))),
    )
    single = F.size("_v") == 1
    return grouped.select(
        *by, "ray_bin", F.when(single, F.get("_v", F.lit(0))).otherwise(merged).alias("values")
    )


def fill_gaps(
    rays: DataFrame, by: list[str], nrays: int = NRAYS, weights: str = "distance"
) -> DataFrame:
    """Fill every run of empty sectors from the rays before and after it, around north too.

    ``distance`` weights the nearer ray more. ``reference`` uses the reversed
    weights. Each ray writes the gap that follows it, so one window per sweep does.
    """
    if weights not in ("distance", "reference"):
        raise ValueError("weights must be 'distance' or 'reference'")
    order = Window.partitionBy(*by).orderBy("ray_bin")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    linked = rays.select(
        *by,
        "ray_bin",
        "values",
        F.coalesce(F.lead("ray_bin").over(order), F.first("ray_bin").over(whole) + nrays).alias(
            "_next"
        ),
        F.coalesce(F.lead("values").over(order), F.first("values").over(whole)).alias("_nv"),
    )
    steps = linked.withColumn(
        "_k", F.explode(F.sequence(F.lit(0), F.col("_next") - F.col("ray_bin") - 1))
    )
    far = F.col("_k") / (F.col("_next") - F.col("ray_bin"))
    w_next = far if weights == "distance" else 1 - far
    steps = steps.withColumn("_w", w_next)
    blend = F.zip_with(
        "values", "_nv", lambda a, b: a * (F.lit(1.0) - F.col("_w")) + b * F.col("_w")
    )
    return steps.select(
        *by,
        F.pmod(F.col("ray_bin") + F.col("_k"), F.lit(nrays)).alias("ray_bin"),
        F.when(F.col("_k") == 0, F.col("values")).otherwise(blend).alias("values"),
        (F.col("_k") > 0).alias("filled"),
    )


def regularise(
    rays: DataFrame, by: list[str], nrays: int = NRAYS, weights: str = "distance"
) -> DataFrame:
    """Exactly one ray per sector: repeats merged, gaps filled."""
    binned = rays if "ray_bin" in rays.columns else with_ray_bin(rays, nrays=nrays)
    return fill_gaps(merge_repeats(binned, by), by, nrays, weights)


def circular_runs(df: DataFrame, by: list[str], idx: str, n: int) -> DataFrame:
    """Runs of consecutive indices on a circle of ``n``.

    Adds the run's first index, its length and the position inside the run. A run
    that passes ``n-1`` continues at 0. ``by`` groups hold at most ``n`` indices.
    """
    bad = F.raise_error(F.concat(F.lit("index outside the circle: "), F.col(idx).cast("string")))
    checked = df.select(
        *by, F.when(F.col(idx).between(0, n - 1), F.col(idx)).otherwise(bad.cast("int")).alias(idx)
    ).distinct()
    order = Window.partitionBy(*by).orderBy(idx)
    islands = checked.withColumn("_g", F.col(idx) - F.row_number().over(order))
    group = Window.partitionBy(*by, "_g")
    runs = islands.withColumns(
        {"_lo": F.min(idx).over(group), "_hi": F.max(idx).over(group)}
    )
    whole = Window.partitionBy(*by)
    tail_lo = F.max(F.when(F.col("_hi") == n - 1, F.col("_lo"))).over(whole)
    head_hi = F.max(F.when(F.col("_lo") == 0, F.col("_hi"))).over(whole)
    runs = runs.withColumns({"_tail": tail_lo, "_head": head_hi})
    wraps = F.col("_tail").isNotNull() & F.col("_head").isNotNull() & (F.col("_tail") > 0)
    in_head = wraps & (F.col("_lo") == 0)
    in_tail = wraps & (F.col("_lo") == F.col("_tail"))
    start = F.when(in_head, F.col("_tail")).otherwise(F.col("_lo"))
    length = F.when(
        in_head | in_tail, F.lit(n) - F.col("_tail") + F.col("_head") + 1
    ).otherwise(F.col("_hi") - F.col("_lo") + 1)
    return runs.select(
        *by,
        idx,
        start.alias("run_start"),
        length.alias("run_length"),
        F.pmod(F.col(idx) - start, F.lit(n)).alias("run_pos"),
    )


# (cell value, elevation index) -> aggregates of one vertical column.
Compositor = Callable[[Column, Column], dict[str, Column]]


def column_maximum(value: Column, elevation: Column) -> dict[str, Column]:
    """Largest value over the elevations and the first elevation that has it."""
    return {
        "value": F.max(value),
        "elev_idx": F.max_by(elevation, F.struct(value, -elevation)),
    }


def composite(
    cells: DataFrame,
    keys: list[str],
    value: str = "raw",
    elevation: str = "elev_idx",
    operator: Compositor = column_maximum,
) -> DataFrame:
    """One value per vertical column of a volume.

    All elevations of a cell meet in one aggregation with partial sums on the map
    side; a volume read as one file therefore shuffles one row per column.
    """
    aggs = operator(F.col(value), F.col(elevation))
    return cells.groupBy(*keys).agg(*[c.alias(a) for a, c in aggs.items()])


def composite_with_geometry(
    cells: DataFrame, keys: list[str], geometry: list[str], value: str = "raw",
    elevation: str = "elev_idx",
) -> DataFrame:
    """Column maximum with the azimuth, time or elevation of the chosen cell."""
    first_max = F.struct(F.col(value), -F.col(elevation))
    picked = F.max_by(F.struct(F.col(elevation), *[F.col(g) for g in geometry]), first_max)
    best = cells.groupBy(*keys).agg(F.max(value).alias("value"), picked.alias("_p"))
    return best.select(*keys, "value", f"_p.{elevation}", *[f"_p.{g}" for g in geometry])


def flatten_ragged(df: DataFrame, by: list[str], order: list[str], arr: str) -> DataFrame:
    """Per scan, all list elements in cell order and the list lengths."""
    lists = F.array_sort(F.collect_list(F.struct(*order, F.col(arr).alias("_l"))))
    grouped = df.groupBy(*by).agg(lists.alias("_s"))
    return grouped.select(
        *by,
        F.flatten(F.transform("_s", lambda s: s["_l"])).alias("flat"),
        F.transform("_s", lambda s: F.size(s["_l"])).alias("lengths"),
    )


def rebuild_ragged(df: DataFrame, by: list[str]) -> DataFrame:
    """Inverse of :func:`flatten_ragged`: one row per list, numbered from 0.

    The lists are slices of the row's items, so nothing is shuffled. Lengths that do not add up to
    the items are an error.
    """
    kind = df.schema["flat"].dataType.elementType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, flat = batch.column("lengths"), batch.column("flat")
            row = lengths.value_parent_indices()
            n = lengths.flatten().cast(pa.int64()).to_numpy()
            if lengths.null_count or flat.null_count or int(n.sum()) != len(flat.flatten()):
                raise ValueError("lengths do not add up to the items")
            offs = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            first = np.cumsum(pc.list_value_length(lengths).to_numpy()) - pc.list_value_length(lengths).to_numpy()
            pos = np.arange(len(n)) - first[row.to_numpy()]
            columns = [batch.column(c).take(row) for c in by]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(pos.astype(np.int32)), pa.ListArray.from_arrays(offs, flat.flatten())],
                [*by, "pos", "items"],
            )

    schema = extended(df.select(*by), f"pos int, items array<{kind}>")
    return df.select(*by, "flat", "lengths").mapInArrow(cut, schema)
