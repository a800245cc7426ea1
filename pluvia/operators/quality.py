"""Projections, predicates and data-quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.functions.geo import LAT_BOUNDS, LON_BOUNDS
from pluvia.functions.radar import EXPECTED_BINS, NRAYS
from pluvia.functions.scalars import null_unless_finite, zero_missing

# Column types of the station and radar-mean tables.
READING_TYPES = {
    "station_id": "bigint",
    "datetime": "timestamp",
    "precipitation": "double",
    "latitude": "double",
    "longitude": "double",
    "altitude": "bigint",
    "horizontal_reflectivity_mean": "double",
}
MULTI_BAND_PRODUCT = "ABI-L2-MCMIPF"


def cast_known(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Cast the mapped columns that exist; the others stay as they are."""
    types = READING_TYPES if types is None else types
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in df.columns})


def drop_invalid(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where every column is a finite number (infinities of either sign are dropped)."""
    clean = df.withColumns(
        {c: null_unless_finite(F.col(c)).cast(df.schema[c].dataType) for c in columns}
    )
    return clean.na.drop("any", subset=columns)


def bounding_box(
    df: DataFrame,
    lat_bounds: tuple[float, float] | None = LAT_BOUNDS,
    lon_bounds: tuple[float, float] | None = LON_BOUNDS,
    lat: str = "lat",
    lon: str = "lon",
) -> DataFrame:
    """Points strictly inside the bounds; ``None`` leaves an axis unbounded."""
    for col, bounds in ((lat, lat_bounds), (lon, lon_bounds)):
        if bounds:
            df = df.where((F.col(col) > bounds[0]) & (F.col(col) < bounds[1]))
    return df


def with_model_info(df: DataFrame, model_version: object, reference: str) -> DataFrame:
    return df.withColumns(
        {"model_version": F.lit(model_version), "reference_datetime": F.lit(reference)}
    )


def fill_predictions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Prediction columns as doubles with missing values as 0."""
    return df.withColumns({c: zero_missing(F.col(c)) for c in columns})


def value_column(product: Column, value: Column, band: Column) -> Column:
    """Name of the value column: the multi-band product stores one column per band."""
    return F.when(product == MULTI_BAND_PRODUCT, F.concat_ws("_", value, band)).otherwise(value)


def at_least(df: DataFrame, col: str, bound: float) -> DataFrame:
    """Rows whose value is known and not below the bound."""
    return df.where(F.col(col).isNotNull() & ~F.isnan(col) & (F.col(col) >= bound))


def scan_rules(sweeps: DataFrame, scan: str = "scan_ts") -> DataFrame:
    """Failed consistency rules of every scan, from its sweep table.

    One row per (scan, rule). ``severity`` says what a failure means: ``skip`` the
    scan, ``abort`` the run, or ``warn``.
    """

    def varies(c: str) -> Column:
        return ~F.min(c).eqNullSafe(F.max(c))

    rules = {
        "rscale differs": ("skip", varies("rscale")),
        "rstart differs": ("skip", varies("rstart")),
        "gain differs": ("abort", varies("gain")),
        "offset differs": ("abort", varies("offset")),
        "gain not positive": ("abort", F.min("gain") <= 0),
        "wrong ray count": ("skip", F.max("nrays") != NRAYS),
        "unusual bin count": ("warn", F.max("nbins") != EXPECTED_BINS),
    }
    if "az_mask_mismatch" in sweeps.columns:
        rules["azimuth masks differ"] = ("abort", F.max(F.col("az_mask_mismatch").cast("int")) > 0)
    flags = sweeps.groupBy(scan).agg(
        F.array(
            *[
                F.when(
                    failed, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))
                )
                for r, (s, failed) in rules.items()
            ]
        ).alias("_f")
    )
    failed = flags.select(scan, F.explode(F.array_compact("_f")).alias("_r"))
    return failed.select(scan, "_r.rule", "_r.severity")


def good_scans(df: DataFrame, failures: DataFrame, scan: str = "scan_ts") -> DataFrame:
    """Rows of scans without a failure that rejects the scan."""
    bad = failures.where(F.col("severity") != "warn").select(scan).distinct()
    return df.join(bad, scan, "left_anti")


def mask_mismatch(start: Column, stop: Column) -> Column:
    """True where only one end of a ray's azimuth or time is known."""
    known = lambda c: c.isNotNull() & ~F.isnan(c)
    return known(start) != known(stop)


def column_tests(
    df: DataFrame, unique: list[str] | None = None, not_null: list[str] | None = None
) -> DataFrame:
    """Failures per column test: repeated values for ``unique``, rows for ``not_null``."""
    parts = []
    for c in unique or []:
        repeated = df.where(F.col(c).isNotNull()).groupBy(c).count().where("count > 1")
        parts.append(repeated.agg(F.count(F.lit(1)).alias("failures")).select(
            F.lit(f"unique_{c}").alias("rule"), "failures"))
    nulls = not_null or []
    if nulls:
        counted = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in nulls])
        parts.append(counted.select(F.explode(F.array(*[
            F.struct(F.lit(f"not_null_{c}").alias("rule"), F.col(c).alias("failures"))
            for c in nulls])).alias("_r")).select("_r.rule", "_r.failures"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def same_layout(meta: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: whether all datasets share timestep and frame size."""
    layout = F.struct(*(columns or ["timestep", "ni", "nj"]))
    return meta.agg((F.count_distinct(layout) <= 1).alias("same_layout"))


GEOMETRY = ["nbins", "nrays", "rscale", "rstart", "lat", "lon"]


def comparable_scans(left: str, right: str) -> list[Column]:
    """Join condition for scans of equal geometry, for two aliased scan tables."""
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in GEOMETRY]


def usable_models(
    registry: DataFrame, predictions: DataFrame | None = None, cuda: bool = True,
    for_plot: bool = False,
) -> DataFrame:
    """Models that can be used: CUDA at hand if needed, plottable, with predictions."""
    ok = registry
    if not cuda:
        ok = ok.where(~F.coalesce("needs_cuda", F.lit(False)))
    if for_plot:
        ok = ok.where(F.coalesce("plot", F.lit(True)))
    if predictions is not None:
        ok = ok.join(predictions.select("model").distinct(), "model", "left_semi")
    return ok


def minmax_stats(df: DataFrame, col: str) -> DataFrame:
    """Smallest and largest finite value."""
    v = null_unless_finite(F.col(col))
    return df.agg(F.min(v).alias("min"), F.max(v).alias("max"))


def rescale_column(df: DataFrame, col: str) -> DataFrame:
    """Column rescaled to [0, 1] by its own range; a constant column becomes NULL."""
    stats = df.agg(
        F.struct(
            F.min(null_unless_finite(F.col(col))).alias("low"),
            F.max(null_unless_finite(F.col(col))).alias("high"),
        )
    ).scalar()
    v = F.col(col)
    return df.withColumn(col, F.try_divide(v - stats["low"], stats["high"] - stats["low"]))


def training_stats(cells: DataFrame, col: str = "value", by: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of the values and of their ``log1p``."""
    v = zero_missing(F.col(col))
    return cells.groupBy(*(by or [])).agg(
        F.avg(v).alias("train_mean"),
        F.stddev_pop(v).alias("train_std"),
        F.avg(F.log1p(v)).alias("train_log_mean"),
        F.stddev_pop(F.log1p(v)).alias("train_log_std"),
    )
