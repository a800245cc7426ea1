"""Hand-worked cases for the column functions."""

import math
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pluvia.functions import geo, names, radar, scalars, times
from pluvia.functions.arrays import (
    crop_centre, downsample4, max_pool, pad_centre, smooth_symmetric,
)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def lit_ts(text):
    return F.lit(text).cast("timestamp_ntz")


def test_date_features_leap_day(spark):
    f = times.date_features(lit_ts("2024-02-29 06:30:00"))
    row = one(spark, *[c.alias(n) for n, c in f.items()])
    assert list(row) == pytest.approx([2 / 12, 29 / 31, 6 / 24, 0.5])


def test_hour_bounds_example(spark):
    b = times.hour_bounds(lit_ts("2024-11-13 12:00:00"), 6)
    row = one(spark, b["start"], b["end"], b["end_local"])
    assert list(row) == ["2024-11-13 06:00:00", "2024-11-13 12:00:00", "2024-11-13 09:00:00"]


def test_bad_datetime_is_an_error(spark):
    with pytest.raises(Exception):
        one(spark, times.parse_datetime(F.lit("13/11/2024")))


def test_target_times_count_and_order(spark):
    marks = one(spark, times.target_times(lit_ts("2024-01-01 10:37:12")))[0]
    assert len(marks) == 48 and marks[0] == datetime(2024, 1, 1, 10, 30)
    assert marks == sorted(marks, reverse=True)


def test_prediction_keys(spark):
    keys = one(spark, times.prediction_keys(lit_ts("2024-01-01 23:50:00"), 2))[0]
    assert keys == ["20240101/2350/20240102-0000", "20240101/2350/20240102-0010"]


def test_clean_score(spark):
    vals = [float("nan"), float("inf"), float("-inf"), -1.0, 0.0, 2.5]
    cols = [scalars.clean_score(F.lit(v)) for v in vals] + [
        scalars.clean_score(F.lit(None).cast("double"))
    ]
    assert list(one(spark, *cols)) == [0, 0, 0, 0, 0, 2.5, 0]


def test_min_max_of_constant_is_null(spark):
    assert one(spark, scalars.min_max(F.lit(3.0), F.lit(3.0), F.lit(3.0)))[0] is None


def test_opacity_cases(spark):
    px = [(255, 255, 255, 255), (200, 10, 10, 255), (250, 250, 250, 255)]
    got = one(spark, *[scalars.opacity(*[F.lit(float(c)) for c in p]) for p in px])
    assert list(got) == [0, 255, 8]


def test_rain_colours(spark):
    got = one(spark, *[scalars.rain_colour(F.lit(v)) for v in (0.0, 0.02, 10.0, 89.9, 500.0)])
    assert list(got) == ["#FFFFFF", "#66BCFB", "#BEDD58", "#550101", "#200101"]


@pytest.mark.parametrize("kind", [0, 2, 3, 4, 5])
def test_transform_inverse(spark, kind):
    v = [0.0, 0.3, 7.0, 60.0]
    cols = [
        scalars.denormalise(scalars.normalise(F.lit(x), kind, 0.3, 1.2), kind, 0.3, 1.2) for x in v
    ]
    assert list(one(spark, *cols)) == pytest.approx(v, abs=1e-9)


def test_transform_one_clamps(spark):
    assert one(spark, scalars.normalise(F.lit(1e9), 1, 0.0, 1.0))[0] == 1.0


def test_radar_unpack_pack(spark):
    raw, g, o = F.lit(0.0), F.lit(0.5), F.lit(-32.0)
    assert one(spark, radar.unpack(raw, g, o, F.lit("DBZH")))[0] == 0.0
    assert one(spark, radar.unpack(raw, g, o, F.lit("KDP")))[0] is None
    assert one(spark, radar.unpack(raw, g, o, F.lit("VRAD")))[0] == -32.0
    assert one(spark, radar.pack(F.lit(0.0), g, o, F.lit("DBZH")))[0] == 0.0
    back = radar.pack(radar.unpack(F.lit(100.0), g, o, F.lit("ZDR")), g, o, F.lit("ZDR"))
    assert one(spark, back)[0] == pytest.approx(100.0)


def test_mean_azimuth_across_north(spark):
    pairs = [(359.5, 0.5, 0.0), (10.0, 11.0, 10.5), (0.2, 359.2, 359.7)]
    for start, stop, mid in pairs:
        got = one(spark, radar.mean_azimuth(F.lit(start), F.lit(stop)))[0]
        assert math.isclose((got - mid + 180) % 360, 180, abs_tol=1e-9)


def test_state_keys(spark):
    a, b = F.lit("clima"), F.lit("chuva")
    got = one(spark, names.state_key(a, b), names.state_key(a, b, F.lit("files"), dev=True))
    assert list(got) == ["clima.chuva", "dev.clima.chuva.files"]


def test_file_name_parts(spark):
    p = F.lit("a/b.c/OR_ABI-L2_x.part.nc")
    got = one(spark, names.file_stem(p), names.file_extension(p), names.dataset_prefix(
        names.base_name(p)))
    assert list(got) == ["OR_ABI-L2_x", "nc", "OR_ABI-L2"]


def test_geostationary_worked_example(spark):
    df = spark.createDataFrame([(-0.024052, 0.095340), (0.2, 0.2)], "x double, y double")
    rows = geo.geostationary_to_latlon(
        df, "x", "y", height=42164160.0 - geo.GEOS_EQ, lon0=-75.0
    ).collect()
    assert (rows[0].lat, rows[0].lon) == pytest.approx((33.846162, -84.690932), abs=1e-6)
    assert rows[1].lat is None and rows[1].lon is None


def test_vincenty_worked_example(spark):
    df = spark.createDataFrame([(306.86816, 54972.271)], "az double, d double")
    row = geo.polar_to_latlon(df, "az", "d", -37.95103341666667, 144.42486788888888).first()
    assert (row.lat, row.lon) == pytest.approx((-37.652821, 143.926496), abs=1e-6)


def test_parallax(spark):
    df = spark.createDataFrame(
        [(-22.9, -43.3, 15000.0), (-22.9, -43.3, 0.0), (-22.9, -43.3, None)],
        "lat double, lon double, h double",
    )
    rows = geo.parallax_shift(df, "h").collect()
    assert (rows[0].lat, rows[0].lon) == pytest.approx((-22.8295, -43.4223), abs=1e-4)
    assert (rows[1].lat, rows[1].lon) == pytest.approx((-22.9, -43.3))
    assert rows[2].lat is None
    kept = geo.parallax_shift(df, "h", unknown="keep").collect()
    assert (kept[2].lat, kept[2].lon) == (-22.9, -43.3)


def packed(spark, values):
    return spark.createDataFrame([(values,)], "v array<double>")


def test_downsample4_block(spark):
    df = packed(spark, [float(k) for k in range(16)])
    assert df.select(downsample4(F.col("v"), 4, 4)).first()[0] == [7.5]


def test_crop_then_pad(spark):
    df = packed(spark, [float(k) for k in range(36)])
    c = df.select(crop_centre(F.col("v"), 6, 6, 3).alias("v"))
    a = np.arange(36.0).reshape(6, 6)
    assert c.first()[0] == a[1:4, 1:4].ravel().tolist()
    p = c.select(pad_centre(F.col("v"), 3, 3, 6)).first()[0]
    want = np.zeros((6, 6))
    want[1:4, 1:4] = a[1:4, 1:4]
    assert p == want.ravel().tolist()


@settings(max_examples=8, deadline=None)
@given(st.integers(5, 9), st.integers(5, 9), st.integers(0, 10**6))
def test_max_pool_matches_numpy(spark, ni, nj, seed):
    a = np.random.default_rng(seed).random((ni, nj))
    got = packed(spark, a.ravel().tolist()).select(max_pool(F.col("v"), ni, nj)).first()[0]
    want = [a[i : i + 5, j : j + 5].max() for i in range(0, ni - 4, 2) for j in range(0, nj - 4, 2)]
    assert got == pytest.approx(want)


@settings(max_examples=8, deadline=None)
@given(st.integers(1, 6), st.integers(7, 12), st.integers(0, 10**6))
def test_smooth_matches_numpy(spark, w, n, seed):
    a = np.random.default_rng(seed).random(n)
    got = packed(spark, a.tolist()).select(smooth_symmetric(F.col("v"), w)).first()[0]
    before, after = w // 2, (w - 1) // 2
    ext = np.pad(a, (before, after), mode="symmetric")
    want = [ext[k : k + w].mean() for k in range(n)]
    assert got == pytest.approx(want)


def test_velocities_keep_their_sign(spark):
    rows = spark.createDataFrame([("VRAD",), ("VRADH",)], "feature string")
    args = F.lit(-4), F.lit(0.5), F.lit(1.0), F.col("feature")
    plain, both = radar.unpack(*args), radar.unpack(*args, radar.ALL_VELOCITIES)
    got = rows.select(plain.alias("plain"), both.alias("both")).collect()
    assert [tuple(r) for r in got] == [(-1.0, -1.0), (None, -1.0)]
