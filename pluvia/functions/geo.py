"""Map projections and geodesy as Column arithmetic.

Longer formulas run as a chain of projections over a DataFrame, so that each
intermediate value is computed once and the whole chain stays in generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84 ellipsoid and GRS80 axes of the geostationary projection.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
GEOS_EQ, GEOS_POL = 6378137.0, 6356752.31414
EARTH_RADIUS = 6371000.0

# Satellite position used for the parallax shift, and map bounds.
SATELLITE_LON, SATELLITE_LAT, SATELLITE_ALT = -75.2, 0.0, 35786200.0
LAT_BOUNDS, LON_BOUNDS = (-26.0, -19.0), (-47.0, -40.0)


def cell_lat(i: Column, ni: int, min_lat: float, max_lat: float) -> Column:
    """Latitude of row ``i`` counted from the northern edge."""
    return F.lit(max_lat) - (i + F.lit(1)) * F.lit((max_lat - min_lat) / ni)


def cell_lon(j: Column, nj: int, min_lon: float, max_lon: float) -> Column:
    """Longitude of column ``j`` counted from the western edge."""
    return F.lit(min_lon) + (j + F.lit(1)) * F.lit((max_lon - min_lon) / nj)


def geostationary_to_latlon(
    df: DataFrame,
    x: str,
    y: str,
    height: float = 35786023.0,
    lon0: float = -75.0,
    sweep: str = "x",
    lat: str = "lat",
    lon: str = "lon",
) -> DataFrame:
    """Scan angles (radians) to latitude and longitude; NULL off the disk."""
    big_h = height + GEOS_EQ
    k = (GEOS_EQ / GEOS_POL) ** 2
    cx, sx, cy, sy = F.cos(x), F.sin(x), F.cos(y), F.sin(y)
    # Direction of sight: the sweep axis decides which angle turns first.
    if sweep == "x":
        direction = {"_dx": cx * cy, "_dy": sx, "_dz": cx * sy}
    elif sweep == "y":
        direction = {"_dx": cx * cy, "_dy": sx * cy, "_dz": sy}
    else:
        raise ValueError("sweep must be 'x' or 'y'")
    out = df.withColumns(direction)
    out = out.withColumns(
        {
            "_a": F.expr(f"_dx * _dx + _dy * _dy + {k!r}D * _dz * _dz"),
            "_b": F.expr(f"-2.0D * {big_h!r}D * _dx"),
        }
    )
    out = out.withColumn("_disc", F.expr(f"_b * _b - 4.0D * _a * {big_h**2 - GEOS_EQ**2!r}D"))
    out = out.withColumn(
        "_r", F.when(F.col("_disc") >= 0, (-F.col("_b") - F.sqrt("_disc")) / (2 * F.col("_a")))
    )
    out = out.withColumns(
        {
            "_px": F.lit(big_h) - F.col("_r") * F.col("_dx"),
            "_py": -F.col("_r") * F.col("_dy"),
            "_pz": F.col("_r") * F.col("_dz"),
        }
    )
    out = out.withColumns(
        {
            lat: F.degrees(F.atan(F.lit(k) * F.col("_pz") / F.hypot("_px", "_py"))),
            lon: F.lit(lon0) - F.degrees(F.atan(F.col("_py") / F.col("_px"))),
        }
    )
    return out.drop("_dx", "_dy", "_dz", "_a", "_b", "_disc", "_r", "_px", "_py", "_pz")


def parallax_shift(
    df: DataFrame,
    height: str,
    lat: str = "lat",
    lon: str = "lon",
    sat_lon: float = SATELLITE_LON,
    sat_lat: float = SATELLITE_LAT,
    sat_alt: float = SATELLITE_ALT,
    unknown: str = "drop",
) -> DataFrame:
    """Move each cloud pixel to the ground point below the cloud.

    ``unknown`` says what happens where no cloud height is known: ``drop`` gives
    a NULL position, ``keep`` leaves the pixel where it was.
    """
    la, lo = math.radians(sat_lat), math.radians(sat_lon)
    far = EARTH_RADIUS + sat_alt
    sat = (
        far * math.cos(la) * math.cos(lo),
        far * math.cos(la) * math.sin(lo),
        far * math.sin(la),
    )
    rlat, rlon = F.radians(lat), F.radians(lon)
    axes = ("x", "y", "z")
    out = df.withColumns(
        {
            "_ux": F.cos(rlat) * F.cos(rlon),
            "_uy": F.cos(rlat) * F.sin(rlon),
            "_uz": F.sin(rlat),
        }
    )
    out = out.withColumns(
        {f"_s{a}": F.lit(s) - F.lit(EARTH_RADIUS) * F.col(f"_u{a}") for a, s in zip(axes, sat)}
    )
    out = out.withColumn("_d", F.expr("sqrt(_sx * _sx + _sy * _sy + _sz * _sz)"))
    # Height along the line of sight, as a multiple of the (unnormalised) sight vector.
    out = out.withColumn(
        "_t", F.col(height) / F.expr("_sx * _ux + _sy * _uy + _sz * _uz")
    )
    out = out.withColumns(
        {f"_p{a}": F.lit(EARTH_RADIUS) * F.col(f"_u{a}") + F.col("_t") * F.col(f"_s{a}")
         for a in axes}
    )
    new_lat = F.degrees(F.atan2("_pz", F.hypot("_px", "_py")))
    new_lon = F.degrees(F.atan2("_py", "_px"))
    if unknown == "keep":
        new_lat, new_lon = F.coalesce(new_lat, F.col(lat)), F.coalesce(new_lon, F.col(lon))
    elif unknown != "drop":
        raise ValueError("unknown must be 'drop' or 'keep'")
    out = out.withColumns({lat: new_lat, lon: new_lon})
    return out.drop(*[f"_{p}{a}" for p in "usp" for a in axes], "_d", "_t")


def polar_to_latlon(
    df: DataFrame,
    azimuth: str,
    distance: str,
    lat0: float,
    lon0: float,
    lat: str = "lat",
    lon: str = "lon",
    rounds: int = 4,
) -> DataFrame:
    """End point on WGS84 of a path of given azimuth and length (Vincenty direct).

    Four rounds of the inner correction are exact to well under a millimetre at
    radar range. Meant for the static (ray, bin) dimension, computed once.
    """
    b = WGS84_A * (1 - WGS84_F)
    phi = math.radians(lat0)
    u1 = math.atan((1 - WGS84_F) * math.tan(phi))
    su, cu, tu = math.sin(u1), math.cos(u1), math.tan(u1)
    ep2 = (WGS84_A**2 - b**2) / b**2
    az = F.radians(azimuth)
    out = df.withColumns({"_sa": F.sin(az), "_ca": F.cos(az)})
    out = out.withColumns(
        {
            "_s1": F.atan2(F.lit(tu), F.col("_ca")),
            "_sal": F.lit(cu) * F.col("_sa"),
        }
    )
    out = out.withColumn("_c2", F.expr("1.0D - _sal * _sal"))
    out = out.withColumn("_u2", F.col("_c2") * ep2)
    out = out.withColumns(
        {
            "_A": F.expr("1 + _u2 / 16384.0D * (4096 + _u2 * (-768 + _u2 * (320 - 175 * _u2)))"),
            "_B": F.expr("_u2 / 1024.0D * (256 + _u2 * (-128 + _u2 * (74 - 47 * _u2)))"),
        }
    )
    out = out.withColumn("_sig0", F.col(distance) / (F.lit(b) * F.col("_A")))
    out = out.withColumn("_sig", F.col("_sig0"))
    for _ in range(rounds):
        out = out.withColumns(
            {"_cm": F.expr("cos(2.0D * _s1 + _sig)"), "_ss": F.sin("_sig"), "_cs": F.cos("_sig")}
        )
        out = out.withColumn(
            "_sig",
            F.expr(
                "_sig0 + _B * _ss * (_cm + _B / 4 * (_cs * (-1 + 2 * _cm * _cm)"
                " - _B / 6 * _cm * (-3 + 4 * _ss * _ss) * (-3 + 4 * _cm * _cm)))"
            ),
        )
    out = out.withColumns(
        {"_cm": F.expr("cos(2.0D * _s1 + _sig)"), "_ss": F.sin("_sig"), "_cs": F.cos("_sig")}
    )
    f = WGS84_F
    out = out.withColumns(
        {
            "_q": F.expr(f"{su!r}D * _ss - {cu!r}D * _cs * _ca"),
            "_C": F.expr(f"{f!r}D / 16 * _c2 * (4 + {f!r}D * (4 - 3 * _c2))"),
        }
    )
    out = out.withColumns(
        {
            lat: F.degrees(
                F.atan2(
                    F.expr(f"{su!r}D * _cs + {cu!r}D * _ss * _ca"),
                    F.lit(1 - f) * F.hypot("_sal", "_q"),
                )
            ),
            "_lam": F.atan2(F.expr("_ss * _sa"), F.expr(f"{cu!r}D * _cs - {su!r}D * _ss * _ca")),
        }
    )
    shift = F.expr(
        f"(1 - _C) * {f!r}D * _sal * (_sig + _C * _ss * (_cm + _C * _cs * (-1 + 2 * _cm * _cm)))"
    )
    out = out.withColumn(lon, F.lit(lon0) + F.degrees(F.col("_lam") - shift))
    return out.drop(
        "_sa", "_ca", "_s1", "_sal", "_c2", "_u2", "_A", "_B", "_sig0", "_sig",
        "_cm", "_ss", "_cs", "_q", "_C", "_lam",
    )
