"""Scan files as a data source, halo tiles, seams, runs and stores by version or bucket."""

import gzip
import io
import json
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.operators import grid, interpolate, objects, samples, verify
from pluvia.plans.report import score_report
from pluvia.sources import scans, sinks
from pluvia.streaming import state as SS
from pluvia.streaming import windows as W
from tests.test_plans import plan, shuffles, static_plans  # noqa: F401
from tests.test_streaming import FAR, at, drain, feed

T = datetime(2024, 1, 1, 6)


def satellite_rows(spark, n=4):
    rows = [
        ("ABI-L2-RRQPEF", T + timedelta(minutes=10 * k), ["RRQPE"], [0.01, 0.02, 0.03], [-0.01, -0.02],
         [[float(k * 10 + c) for c in range(6)]]) for k in range(n)
    ]
    return spark.createDataFrame(rows, scans.SatelliteKind.packed)


def read_files(df):
    """Files that a plan opens, from the partitions its reader makes."""
    return df.rdd.getNumPartitions()


def test_satellite_files_round_trip_and_prune_by_name(spark, tmp_path):
    scans.register(spark)
    path = str(tmp_path / "s")
    satellite_rows(spark).write.format("satellite_scan").mode("append").save(path)
    names = sorted(p.name for p in (tmp_path / "s").iterdir())
    assert len(names) == 4 and all(n.startswith("OR_ABI-L2-RRQPEF-M6_G16_s2024001") for n in names)
    (tmp_path / "s" / "notes.txt").write_text("no scan")
    load = spark.read.format("satellite_scan").load
    df = load(path)
    got = {(r.creation, r.band, r.row, r.col): (r.x, r.y, r.value) for r in df.collect()}
    assert len(got) == 24 and got[T + timedelta(minutes=20), "RRQPE", 1, 2] == (0.03, -0.02, 25.0)
    assert read_files(df) == 4
    late = load(path).where(F.col("creation") > F.lit(T + timedelta(minutes=10)).cast("timestamp_ntz"))
    assert read_files(late) == 2 and late.count() == 12
    one = load(path).where((F.col("creation") == F.lit(T).cast("timestamp_ntz")) & (F.col("value") > 3))
    assert read_files(one) == 1 and one.count() == 2
    assert load(path).where("band = 'other'").count() == 0
    # A name that lies before the bound is never opened, so what it holds does not matter.
    (tmp_path / "s" / names[0]).write_bytes(b"broken")
    assert late.count() == 12
    with pytest.raises(Exception, match="unknown container"):
        load(path).count()


def test_satellite_pixels_choose_bands_times_and_bounds(spark, tmp_path):
    path = str(tmp_path / "s")
    scans.register(spark)
    satellite_rows(spark).write.format("satellite_scan").mode("append").save(path)
    every = scans.satellite_pixels(spark, path, "ABI-L2-RRQPEF")
    assert every.count() == 24
    lat = [r.lat for r in every.collect()]
    some = scans.satellite_pixels(
        spark, path, "ABI-L2-RRQPEF", lat_bounds=(min(lat), sorted(lat)[5]), start=T, end=T + timedelta(minutes=20)
    )
    assert {r.creation for r in some.collect()} <= {T, T + timedelta(minutes=10)}
    assert all(min(lat) <= r.lat <= sorted(lat)[5] for r in some.collect())
    with pytest.raises(ValueError, match="unsupported"):
        scans.satellite_pixels(spark, path, "NOPE")


def volume_bytes(sweeps=2, rays=3, bins=4):
    arrays, attrs = {}, {}
    for s in range(1, sweeps + 1):
        attrs[f"dataset{s}/where/elangle"] = 0.5 * s
        attrs[f"dataset{s}/how/startazA"] = [float(r) for r in range(rays)]
        attrs[f"dataset{s}/how/stopazA"] = [r + 1.0 for r in range(rays)]
        for d in ("data2", "data10"):
            attrs |= {f"dataset{s}/{d}/what/gain": 0.5, f"dataset{s}/{d}/what/offset": -32.0}
            arrays[f"dataset{s}/{d}/data"] = np.arange(rays * bins).reshape(rays, bins) + s
    out = io.BytesIO()
    np.savez_compressed(out, **arrays, attrs=np.array(json.dumps(attrs)))
    return out.getvalue()


def test_radar_volumes_alone_and_compressed(spark, tmp_path):
    scans.register(spark)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a-MDN.20240101060000.PVOL.npz").write_bytes(volume_bytes())
    (tmp_path / "sub" / "b-MDN.20240101061000.PVOL.npz.gz").write_bytes(gzip.compress(volume_bytes()))
    df = spark.read.format("radar_volume").load(str(tmp_path))
    assert df.count() == 2 * 2 * 2 * 3
    rays = scans.volume_rays(spark, str(tmp_path), "DBZH", start=T + timedelta(minutes=5)).collect()
    assert {(r.scan_ts, r.feature) for r in rays} == {(T + timedelta(minutes=10), "DBZH")}
    assert sorted((r.elev_idx, r.ray_idx, r.start_az, r.raw[0]) for r in rays)[:2] == [(1, 0, 0.0, 1.0), (1, 1, 1.0, 5.0)]
    listed = spark.createDataFrame([(str(p),) for p in tmp_path.rglob("*.npz*")] + [("/x/none.txt",)], "path string")
    by_table = scans.expand_files(listed, "radar_volume", ["data10"])
    assert by_table.count() == 12 and {r.variable for r in by_table.collect()} == {"data10"}


def own_format(data):
    """A decoder by name."""
    rows = [line.split(",") for line in data.decode().splitlines()]
    values = np.array(rows, float)
    return {"x": np.zeros(values.shape[1]), "y": np.zeros(values.shape[0]), "HT": values}


def test_decoder_by_name_and_missing_paths(spark, tmp_path):
    scans.register(spark)
    (tmp_path / "OR_ABI-L2-ACHAF-M6_G16_s20240010600000_e.csv").write_text("1,2\n3,4\n")
    reader = spark.read.format("satellite_scan").option("decoder", "tests.test_scans:own_format")
    assert sorted(r.value for r in reader.load(str(tmp_path)).collect()) == [1.0, 2.0, 3.0, 4.0]
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("satellite_scan").load(str(tmp_path / "nowhere")).count()


def test_overwriting_replaces_scans_only(spark, tmp_path):
    scans.register(spark)
    path = str(tmp_path / "s")
    satellite_rows(spark, 3).write.format("satellite_scan").mode("append").save(path)
    (tmp_path / "s" / "notes.txt").write_text("kept")
    satellite_rows(spark, 1).write.format("satellite_scan").mode("overwrite").save(path)
    assert spark.read.format("satellite_scan").load(path).count() == 6
    assert sorted(p.name[:5] for p in (tmp_path / "s").iterdir()) == ["OR_AB", "notes"]


def test_scans_as_a_stream(spark, tmp_path):
    scans.register(spark)
    path = str(tmp_path / "s")
    satellite_rows(spark, 2).write.format("satellite_scan").mode("append").save(path)
    stream = spark.readStream.format("satellite_scan").option("settleSeconds", "0.2").load(path)
    time.sleep(0.4)
    assert drain(stream, spark, tmp_path, "out").count() == 12
    satellite_rows(spark, 1).write.format("satellite_scan").mode("append").save(path)
    time.sleep(0.4)
    # The second run reads the new file only.
    assert drain(stream, spark, tmp_path, "out").count() == 18


# --- loads that are seen whole ---------------------------------------------------------------


def test_a_failed_load_leaves_the_old_rows(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "a int"
    assert sinks.published(spark, path, schema).count() == 0
    sinks.publish_table(spark.createDataFrame([(1,), (2,)], schema), path)
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).cast("int").alias("a"))
    with pytest.raises(Exception, match="broken"):
        sinks.publish_table(bad, path, "overwrite")
    with pytest.raises(ValueError, match="not accepted"):
        sinks.publish_table(spark.createDataFrame([(9,)], schema), path, "append", lambda t: t.count() == 2)
    assert sorted(r.a for r in sinks.published(spark, path, schema).collect()) == [1, 2]
    sinks.publish_table(spark.createDataFrame([(3,)], schema), path)
    sinks.publish_table(spark.createDataFrame([(4,)], schema), path, "overwrite")
    assert [r.a for r in sinks.published(spark, path, schema).collect()] == [4]
    assert sinks.published(spark, path, schema, version=1).count() == 3
    with pytest.raises(ValueError):
        sinks.published(spark, path, schema, version=7)


# --- halo tiles ------------------------------------------------------------------------------


def scattered(n, seed=0, holes=0):
    rng = np.random.default_rng(seed)
    pts = [
        (1, r, c, -22 - 0.1 * r + 0.03 * rng.random(), -43 + 0.1 * c + 0.03 * rng.random(), float(rng.random()))
        for r in range(n) for c in range(n)
    ]
    for k in rng.choice(len(pts), holes, replace=False):
        pts[k] = (*pts[k][:3], None, *pts[k][4:])
    return pts


POINT = "s int, row int, col int, lat double, lon double, value double"


@pytest.mark.parametrize("size", [1, 3, 64])
def test_tiles_find_the_same_values_as_rows(spark, size):
    points = spark.createDataFrame(scattered(9, holes=9), POINT)
    rng = np.random.default_rng(1)
    y, x = -22 - 0.9 * rng.random(200) + 0.05, -43 + 0.9 * rng.random(200)
    targets = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(y, x))], "target long, lat double, lon double")
    hits = interpolate.locate(interpolate.triangles(points, ["s"], ["value"]), targets, ["s"], [], 0.2)
    rows = hits.select("target", "tri", F.expr("w1 * value1 + w2 * value2 + w3 * value3").alias("v"))
    want = {r.target: r.v for r in rows.groupBy("target").agg(F.min_by("v", "tri").alias("v")).collect()}
    packed = interpolate.interpolate_packed(points, y, x, ["s"], size=size).first()["values"]
    assert {k: v for k, v in enumerate(packed) if v is not None} == pytest.approx(want)
    at_pixels = targets.withColumn("s", F.lit(1)).withColumnRenamed("lat", "lat")
    between = interpolate.interpolate_between(points, at_pixels, ["s"], "value", 0.02, size=size)
    assert {r.target: r.value for r in between.collect()} == pytest.approx(want)
    kept = interpolate.interpolate_between(points, at_pixels, ["s"], "value", 0.02, keep=True, size=size)
    assert kept.count() == 200 and kept.where("value is not null").count() == len(want)


def test_a_tile_moves_its_pixels_once_but_for_the_border(spark):
    tiles = interpolate.scan_tiles(spark.createDataFrame(scattered(8), POINT), ["s"], "value", size=4)
    assert sorted(len(r.px) for r in tiles.collect()) == [16, 20, 20, 25]


# --- objects ---------------------------------------------------------------------------------


@pytest.mark.parametrize("density", [0.3, 0.45, 0.7])
def test_tiles_with_seams_label_like_one_array(spark, density):
    rng = np.random.default_rng(5)
    array = (rng.random((3, 24, 20)) < density) * 5.0
    rays = [(s, r, array[s, r].tolist()) for s in range(3) for r in range(24)]
    cells = objects.echo_cells(spark.createDataFrame(rays, "scan_id int, ray int, values array<double>"), 1.0)
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(objects.label_objects(cells, 20, 24))
    assert key(objects.label_by_tiles(cells, 20, 24, 5, 7)) == want
    assert key(objects.label_by_tiles(cells, 20, 24, 1, 1)) == want
    assert key(objects.label_by_tiles(cells, 20, 24)) == want


def test_a_snake_through_all_tiles_is_one_object(spark):
    array = np.zeros((16, 16))
    array[::2] = 5.0
    array[1::4, -1] = array[3::4, 0] = 5.0
    rays = spark.createDataFrame([(0, r, array[r].tolist()) for r in range(16)], "scan_id int, ray int, values array<double>")
    found = objects.label_by_tiles(objects.echo_cells(rays, 1.0), 16, 16, 3, 3)
    assert {r.label for r in found.collect()} == {0}


def test_runs_hold_the_cells(spark):
    rays = [(0, 0, [5.0, None, 5.0, 2.0, 5.0]), (0, 1, []), (0, 2, [0.0] * 5), (1, 3, [5.0] * 5), (1, 4, None)]
    frame = spark.createDataFrame(rays, "scan_id int, ray int, values array<double>")
    runs = {(r.scan, r.ray): [(x.first, x.last, x.value) for x in r.runs] for r in objects.echo_runs(frame, 4.0).collect()}
    assert runs == {(0, 0): [(0, 0, [5.0]), (2, 2, [5.0]), (4, 4, [5.0])], (1, 3): [(0, 4, [5.0] * 5)]}
    smooth = objects.echo_runs(frame.where("ray = 0"), 3.0, smooth_window=1).first().runs
    assert [(x.first, x.last, x.core) for x in smooth] == [(0, 0, [True]), (2, 2, [True]), (4, 4, [True])]


# --- motion ----------------------------------------------------------------------------------


def test_pyramid_finds_shifts_beyond_the_full_search(spark):
    i, j = np.indices((64, 64))
    blob = lambda a, b: np.exp(-((i - a) ** 2 + (j - b) ** 2) / 120.0)
    prev, cur = blob(26, 24), blob(26 + 9, 24 + 6)
    pairs = spark.createDataFrame([(1, cur.ravel().tolist(), prev.ravel().tolist())], "k int, cur array<double>, prev array<double>")
    found = grid.block_shifts(pairs, 64, 64, 32, 3, "k", levels=2).first().shifts
    full = grid.block_shifts(pairs, 64, 64, 32, 12, "k").first().shifts
    assert (found[2].di, found[2].dj) == (full[2].di, full[2].dj) == (9, 6)
    with pytest.raises(ValueError):
        grid.block_shifts(pairs, 64, 64, 32, 3, "k", levels=6)


# --- samples from buckets --------------------------------------------------------------------


def test_samples_from_buckets_need_no_shuffle(spark, tmp_path, static_plans):  # noqa: F811
    frames = spark.range(300).select(
        F.lit("sat").alias("source"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("location"),
        (F.lit(T).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.floor(F.col("id") / 2) * 10).cast("int"))).alias("frame_ts"),
        F.array(F.col("id").cast("double")).alias("values"),
    )
    sinks.write_frame_buckets(frames, "frames_in_buckets", str(tmp_path / "b"), 6, 3, slot_minutes=240, buckets=4)
    out = samples.bucketed_samples(spark, "frames_in_buckets", 6, 3)
    text = plan(out)
    assert "Exchange" not in text and "Bucketed: true" in text
    keys = frames.select("source", "location", F.col("frame_ts").alias("key_ts"))
    past = samples.past_frames(keys, frames, 6, on=["source", "location"]).select("location", "key_ts", "lag", "values")
    future = samples.future_frames(keys, frames, 3, on=["source", "location"]).select(
        "location", "key_ts", (-F.col("lead")).alias("lag"), "values"
    )
    got = out.select("location", "key_ts", "lag", "values")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(past.unionByName(future))
    spark.sql("DROP TABLE frames_in_buckets")


def test_lead_pairs_move_frames_twice_and_keep_repeated_keys(spark, static_plans):  # noqa: F811
    frames = spark.createDataFrame([(T + timedelta(minutes=10 * k), [float(k)]) for k in (0, 1, 2, 4)], "frame_ts timestamp_ntz, values array<double>")
    keys = spark.createDataFrame([(T,), (T,)], "key_ts timestamp_ntz")
    pairs = samples.lead_pairs(keys, frames, 3)
    assert shuffles(pairs) == 3
    got = sorted((r.lead, r.previous, r.target) for r in pairs.collect() if r.previous)
    assert got == [(1, [0.0], [1.0])] * 2 + [(2, [1.0], [2.0])] * 2
    assert pairs.where("lead = 3 and target is null").count() == 2


# --- scores by functions of arrays -----------------------------------------------------------


def test_user_metrics(spark):
    p = [("m", 1, T, [1.0, None, 3.0]), ("m", 1, T + timedelta(minutes=10), [2.0]), ("n", 1, T, None)]
    preds = spark.createDataFrame(p, "model string, lag int, valid_ts timestamp_ntz, values array<double>")
    truth = spark.createDataFrame([(T, [1.0, 1.0, 1.0]), (T + timedelta(minutes=10), [0.0, 5.0])], "frame_ts timestamp_ntz, values array<double>")
    bias = verify.UserMetric(
        lambda p, t: [np.nansum(p - t), np.count_nonzero(~np.isnan(p - t))], 2, lambda s, n: F.try_divide(s, n)
    )
    out = score_report(preds, truth, metrics=["MAE"], user={"bias": bias}).collect()
    got = {r.model: (r.MAE, r.bias, r.best_bias) for r in out}
    # Missing cells count as no rain, a missing forecast not at all.
    assert got["m"] == (2.0, pytest.approx(-0.4), True) and got["n"][:2] == (None, None)
    wrong = verify.UserMetric(lambda p, t: [0.0], 2, lambda s, n: s)
    with pytest.raises(Exception, match="another number of parts"):
        score_report(preds, truth, metrics=["MAE"], user={"wrong": wrong}).collect()


# --- trailing frames in keyed state ----------------------------------------------------------


def test_trailing_frames_from_state_equal_the_other_way(spark, tmp_path):
    schema = "source string, frame_ts timestamp, values array<double>"
    frames = [("s", at(10 * k), [float(k)]) for k in range(40) if k % 7 != 5]
    batches = [frames[:9], frames[10:20] + frames[9:10], frames[20:], [("s", FAR, [0.0])], [("s", FAR, [0.0])]]
    stream = feed(spark, tmp_path / "in", batches, schema)
    seen = lambda df: {
        r.key_ts: [(f.lag, f.frame_ts, f["values"][0]) for f in r.frames] for r in df.collect() if r.key_ts < FAR
    }
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    with W.state_settings(spark, partitions=2, rocksdb=True):
        state = seen(drain(SS.trailing_frames_state(stream, 4, block_minutes=60), spark, tmp_path, "st"))
    want = {
        at(10 * k): [(g, at(10 * (k - g)), float(k - g)) for g in range(4) if k - g >= 0 and (k - g) % 7 != 5]
        for k in range(40) if k % 7 != 5
    }
    assert state == want
