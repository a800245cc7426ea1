"""Value cleaning, normalisation and unit conversion as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of the inverse min-max step, Z-R coefficients, decibel
# settings and the normalisation constants of the satellite models.
MINMAX_DATA = (0.0, 81.770131684971)
ZR_A, ZR_B, ZR_B_FORWARD = 223.0, 1.56, 1.53
DB_THRESHOLD, DB_ZERO, NEAR_ZERO = 0.1, -15.0, 1e-4
CLIP_MEAN, CLIP_STD = 0.08, 0.39
RAIN_FLOOR = 0.2

# Lower bound and colour of each rain class; white below the first.
RAIN_CLASSES = [
    (0.02, "#66BCFB"),
    (10.0, "#BEDD58"),
    (20.0, "#F6D001"),
    (30.0, "#FD9201"),
    (40.0, "#F64801"),
    (50.0, "#EF0101"),
    (60.0, "#BC0101"),
    (70.0, "#870101"),
    (80.0, "#550101"),
    (90.0, "#200101"),
]
DRY_COLOUR = "#FFFFFF"


def nan_to_null(v: Column) -> Column:
    return F.nullif(v.cast("double"), F.lit(float("nan")))


def is_finite(v: Column) -> Column:
    """True for a number that is neither NaN nor infinite; false for NULL."""
    d = v.cast("double")
    # NaN sorts above every number, so one range test covers all three cases.
    return F.coalesce((d > F.lit(-math.inf)) & (d < F.lit(math.inf)), F.lit(False))


def null_unless_finite(v: Column) -> Column:
    return F.when(is_finite(v), v)


def threshold_to_zero(v: Column, floor: float = RAIN_FLOOR) -> Column:
    return F.when(v < floor, F.lit(0.0)).otherwise(v)


def zero_missing(v: Column) -> Column:
    """NULL or NaN becomes 0, everything else a double."""
    return F.coalesce(nan_to_null(v), F.lit(0.0))


def clean_score(v: Column) -> Column:
    """Non-finite and non-positive values count as no rain."""
    return F.when(is_finite(v) & (v > 0), v.cast("double")).otherwise(F.lit(0.0))


def clamp_negative(v: Column) -> Column:
    return F.greatest(v, F.lit(0.0))


def min_max(v: Column, low: Column, high: Column) -> Column:
    """Rescale to [0, 1]; a constant column gives NULL."""
    return F.try_divide(v - low, high - low)


def inverse_min_max(
    v: Column,
    data: tuple[float, float] = MINMAX_DATA,
    feature: tuple[float, float] = (0.0, 1.0),
) -> Column:
    return (v - feature[0]) / (feature[1] - feature[0]) * (data[1] - data[0]) + data[0]


def normalise(v: Column, kind: int, mean: float, std: float, satellite: bool = False) -> Column:
    """The six model input transforms, by number. Missing values count as 0."""
    x = zero_missing(v)
    log = F.log1p(x)
    if kind in (0, 5):
        return (log - mean) / (3 * std)
    if kind == 1:
        return F.least(log / (6 * std), F.lit(1.0))
    if kind == 2:
        return x if satellite else log
    if kind == 3:
        return x
    if kind == 4:
        return F.tanh(log / 4)
    raise ValueError(f"unknown transform {kind}")


def denormalise(v: Column, kind: int, mean: float, std: float, satellite: bool = False) -> Column:
    """Inverse of :func:`normalise` (up to the upper clamp of kind 1)."""
    if kind in (0, 5):
        return F.expm1(v * 3 * std + mean)
    if kind == 1:
        return F.expm1(v * 6 * std)
    if kind == 2:
        return v if satellite else F.expm1(v)
    if kind == 3:
        return v
    if kind == 4:
        return F.expm1(F.atanh(v) * 4)
    raise ValueError(f"unknown transform {kind}")


def normalise_clipped(
    v: Column, factor: float, mean: float = CLIP_MEAN, std: float = CLIP_STD
) -> Column:
    scaled = (F.log1p(zero_missing(v)) - mean) / (factor * std)
    return F.greatest(F.least(scaled, F.lit(1.0)), F.lit(-1.0))


def denormalise_clipped(
    v: Column, factor: float, mean: float = CLIP_MEAN, std: float = CLIP_STD
) -> Column:
    return F.expm1(v * factor * std + mean)


def reflectivity(dbr: Column, a: float = ZR_A, b: float = ZR_B) -> Column:
    """Rain rate in decibels to reflectivity by the Z-R power law."""
    return F.lit(a) * F.pow(F.pow(F.lit(10.0), dbr / 10), F.lit(b))


def to_db(v: Column, threshold: float = DB_THRESHOLD, zero: float = DB_ZERO) -> Column:
    """Decibels; values below the threshold (and missing ones) get the zero value."""
    return F.when(v >= threshold, 10 * F.log10(v)).otherwise(F.lit(zero))


def from_db(v: Column) -> Column:
    return F.pow(F.lit(10.0), v / 10)


def flush_near_zero(v: Column, tolerance: float = NEAR_ZERO) -> Column:
    return F.when(F.abs(v) <= tolerance, F.lit(0.0)).otherwise(v)


def display_dbz(v: Column) -> Column:
    """Decibels for display; NULL where there is no echo."""
    return F.when(v > 0, 10 * F.log10(v))


def rain_class(v: Column) -> Column:
    """How many class bounds the value reaches: 0 (dry) to 10."""
    reached = [F.when(v >= bound, F.lit(1)).otherwise(F.lit(0)) for bound, _ in RAIN_CLASSES]
    total = reached[0]
    for r in reached[1:]:
        total = total + r
    return total


def rain_colour(v: Column) -> Column:
    colours = F.array(F.lit(DRY_COLOUR), *[F.lit(c) for _, c in RAIN_CLASSES])
    return F.get(colours, rain_class(v))


def opacity(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Opaque unless every channel is bright; then by distance to white."""
    distance = F.sqrt(sum((F.lit(255.0) - c) * (F.lit(255.0) - c) for c in (r, g, b)))
    return F.when(F.least(r, g, b, a) <= 200, F.lit(255)).otherwise(
        F.least(distance, F.lit(255.0)).cast("int")
    )


def sample_mass(v: Column) -> Column:
    """Saturating rain amount ``1 - exp(-v)`` used to weight samples."""
    return F.lit(1.0) - F.exp(-zero_missing(v))
