"""Hand-made and brute-force cases for the table operators."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pluvia.operators import align, grid, interpolate, objects, ordering, quality, samples, state
from pluvia.operators import radar as R
from pluvia.operators import verify
from pluvia.operators.scoring import score_frames, stack_inputs
from pluvia.plans.frames import correct_parallax, satellite_frames
from pluvia.plans.report import score_report
from pluvia.session import join_dimension

T = datetime(2024, 1, 1)


def at(minutes, seconds=0):
    return T + timedelta(minutes=minutes, seconds=seconds)


# --- alignment ---------------------------------------------------------------


def times_df(spark, col, values):
    return spark.createDataFrame([(v,) for v in values], f"{col} timestamp_ntz")


@pytest.mark.parametrize("slot", [1, 10, 60])
@pytest.mark.parametrize("tolerance", [None, 25])
def test_match_times_brute_force(spark, slot, tolerance):
    rng = np.random.default_rng(slot)
    targets = sorted({at(int(m)) for m in rng.integers(0, 3000, 60)})
    sources = sorted({at(int(m), int(s)) for m, s in rng.integers(0, 59, (40, 2)) * [50, 1]})
    got = align.match_times(
        times_df(spark, "t", targets), times_df(spark, "s", sources), "t", "s",
        offset_minutes=5, tolerance_minutes=tolerance, slot_minutes=slot,
    ).collect()
    want = {}
    for t in targets:
        due = t + timedelta(minutes=5)
        ok = [s for s in sources if s <= due]
        if tolerance is not None:
            ok = [s for s in ok if s >= due - timedelta(minutes=tolerance)]
        want[t] = max(ok, default=None)
    assert {r.t: r.s for r in got} == want


def test_match_times_equality_counts(spark):
    got = align.match_times(
        times_df(spark, "t", [at(0)]), times_df(spark, "s", [at(5)]), "t", "s", offset_minutes=5
    ).first()
    assert got.s == at(5)


def test_first_scan_in_minutes(spark):
    t = times_df(spark, "target_ts", [at(10), at(20), at(30)])
    s = times_df(spark, "scan_ts", [at(6, 59), at(15, 30), at(29, 5), at(29, 50), at(30, 40)])
    got = {r.target_ts: r.scan_ts for r in align.first_scan_in_minutes(t, s).collect()}
    assert got == {at(10): at(6, 59), at(20): None, at(30): at(30, 40)}


def test_time_rank(spark):
    marks = [at(10 * k) for k in (0, 3, 7, 8, 200, 500)]
    df = times_df(spark, "ts", marks)
    up = {r.ts: r["rank"] for r in ordering.time_rank(df, "ts").collect()}
    assert up == {m: k for k, m in enumerate(marks)}
    down = {r.ts: r["rank"] for r in ordering.time_rank(df, "ts", ascending=False).collect()}
    assert down == {m: 5 - k for k, m in enumerate(marks)}


def test_keep_last_50(spark):
    df = spark.createDataFrame([(f"f{k:03d}",) for k in list(range(60)) * 2], "path string")
    got = [r.path for r in ordering.keep_last(df, "path").collect()]
    assert got == [f"f{k:03d}" for k in range(10, 60)]


def test_nth_last_of_short_axis_is_empty(spark):
    df = times_df(spark, "ts", [at(0), at(10)])
    assert ordering.nth_last(df, "ts", 3).count() == 0
    assert ordering.nth_last(df, "ts", 2).first().ts == at(0)


# --- state -------------------------------------------------------------------


def test_high_water(spark):
    batch = spark.createDataFrame(
        [("a", at(0)), ("a", at(0, 1)), ("b", at(0)), (None, at(9))], "id string, ts timestamp_ntz"
    )
    marks = spark.createDataFrame([("a", at(0)), ("z", at(5))], "id string, last_update timestamp_ntz")
    got = sorted((r.id, r.ts) for r in state.newer_rows(batch, marks, "id", "ts").collect())
    assert got == [("a", at(0, 1)), ("b", at(0))]
    moved = {r.id: r.last_update for r in state.advance_marks(batch, marks, "id", "ts").collect()}
    assert moved == {"a": at(0, 1), "b": at(0), "z": at(5)}


def test_new_rows_null_keys_match(spark):
    batch = spark.createDataFrame([("a", 1), (None, 2), ("c", None)], "k string, n int")
    known = spark.createDataFrame([(None,), ("c",)], "k string")
    got = state.new_rows(batch, known, ["k", "n"]).collect()
    assert sorted((r.k or "", r.n or 0) for r in got) == [("", 2), ("a", 1)]
    assert state.updated_state(batch, known, ["k", "n"]).count() == 4


def test_freshness_true_when_missing(spark):
    some = spark.createDataFrame([(at(0),)], "date timestamp_ntz")
    none = some.limit(0)
    assert state.is_fresher(some, none).first()[0] is True
    assert state.is_fresher(none, some).first()[0] is True
    assert state.is_fresher(some, some).first()[0] is False


# --- quality -----------------------------------------------------------------


def test_bounding_box_is_exclusive(spark):
    df = spark.createDataFrame([(-26.0, -43.0), (-19.0, -43.0), (-20.0, -43.0)], "lat double, lon double")
    assert [r.lat for r in quality.bounding_box(df).collect()] == [-20.0]


def test_drop_invalid(spark):
    vals = [(float("inf"),), (float("nan"),), (float("-inf"),), (None,), (1.0,)]
    df = spark.createDataFrame(vals, "v double")
    assert [r.v for r in quality.drop_invalid(df, ["v"]).collect()] == [1.0]


def test_rescale_constant_column(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r.v for r in quality.rescale_column(df, "v").collect()] == [None, None]


# --- samples -----------------------------------------------------------------


def test_valid_keys_cases(spark):
    def valid(missing):
        present = [at(10 * k) for k in range(-9, 7) if k not in missing]
        keys = samples.valid_keys(times_df(spark, "frame_ts", present), 10, 6).collect()
        return at(0) in [r.frame_ts for r in keys]

    assert valid({-9, -5, -1})
    assert not valid({-9, -5, -2, -1})
    assert not valid({3})


def test_sample_channels_are_newest_first(spark):
    f = spark.createDataFrame(
        [(at(10 * k), [float(k)]) for k in range(4)], "frame_ts timestamp_ntz, values array<double>"
    )
    out = samples.multi_source_samples([samples.Source(f, 3, 1, channels=1)])
    x = {r.channel: r["values"] for r in out.where("kind = 'x'").collect() if r.key_ts == at(20)}
    assert x == {0: [2.0], 1: [1.0], 2: [0.0]}


def test_missing_prediction_is_an_error(spark):
    keys = times_df(spark, "key_ts", [at(0)])
    preds = spark.createDataFrame(
        [(at(0), at(10), [1.0])],
        "issue_ts timestamp_ntz, valid_ts timestamp_ntz, values array<double>",
    )
    assert samples.with_predictions(keys, preds, 1).count() == 1
    with pytest.raises(Exception, match="no prediction"):
        samples.with_predictions(keys, preds, 2).collect()


def test_rolling_weights_brute_force(spark):
    w = np.random.default_rng(1).random(12)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(w)], "idx long, weight double")
    got = {r.idx: (r.sum_weight, r.weight) for r in samples.rolling_weights(df, 4, 3, min_sum=0.5).collect()}
    ext = np.append(w, w.min())
    sums = []
    for i in range(12):
        pos = np.arange(i - 3, i + 4)
        pos[(pos < 0) | (pos >= 12)] = 12
        sums.append(ext[pos].sum())
    shifted = np.array(sums) + 0.5
    for i in range(12):
        assert got[i] == pytest.approx((sums[i], shifted[i] / shifted.sum()))


def test_pack_unpack_round_trip(spark):
    f = spark.createDataFrame([(k, [float(k * 6 + c) for c in range(6)]) for k in range(3)], "k int, values array<double>")
    cells = grid.unpack_frames(f, 3, ["k"])
    back = {r.k: r["values"] for r in grid.pack_frames(cells, 2, 3, ["k"]).collect()}
    assert back == {r.k: r["values"] for r in f.collect()}
    holes = cells.where("not (i = 1 and j = 1)")
    sparse = grid.pack_frames(holes, 2, 3, ["k"], sparse=True).where("k = 0").first()["values"]
    assert sparse == [0.0, 1.0, 2.0, 3.0, None, 5.0]


def test_join_dimension_salted_equals_broadcast(spark):
    big = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    dim = spark.createDataFrame([(k, f"n{k}") for k in range(3)], "k long, name string")
    rows = lambda df: sorted(map(tuple, df.select("k", "id", "name").collect()))
    assert rows(join_dimension(big, dim, ["k"])) == rows(
        join_dimension(big, dim, ["k"], spread="id", salts=5, max_bytes=1)
    )


# --- verification ------------------------------------------------------------


def scored(spark, p, t, metrics):
    preds = spark.createDataFrame(
        [("m", 1, at(10), p)], "model string, lag int, valid_ts timestamp_ntz, values array<double>"
    )
    truth = spark.createDataFrame([(at(10), t)], "frame_ts timestamp_ntz, values array<double>")
    pairs = verify.paired_cells(verify.match_forecasts(preds, truth, "inner"), ["model", "lag"])
    return verify.score(pairs, ["model", "lag"], metrics).first()


def test_csi_cases(spark):
    assert scored(spark, [0.0, 0.0], [0.0, 0.0], ["CSI2"])["CSI2"] is None
    assert scored(spark, [2.0, 3.0], [2.0, 3.0], ["CSI2"])["CSI2"] == 1.0
    # +inf is cleaned to 0 before it can count as an event
    assert scored(spark, [float("inf"), 3.0], [0.0, 3.0], ["CSI2"])["CSI2"] == 1.0


def test_ets_by_hand(spark):
    p, t = [3.0, 3.0, 0.0, 0.0], [3.0, 0.0, 3.0, 0.0]
    r = 2 * 2 / 4
    assert scored(spark, p, t, ["ETS1"])["ETS1"] == pytest.approx((1 - r) / (3 - r))


def test_user_metric(spark):
    got = scored(spark, [1.0, 4.0], [0.0, 0.0], {"bias": lambda p, t: F.avg(p - t)})
    assert got["bias"] == 2.5


def test_best_worst_ties_and_missing(spark):
    df = spark.createDataFrame(
        [("b", 1, 0.5, None), ("a", 1, 0.5, None), ("c", 1, 0.9, None)],
        "model string, lag int, MAE double, CSI1 double",
    )
    out = {r.model: r for r in verify.best_worst(df, ["lag"], "model", ["MAE", "CSI1"], ["b", "a", "c"]).collect()}
    assert [out[m].best_MAE for m in "bac"] == [True, False, False]
    assert [out[m].worst_MAE for m in "bac"] == [False, False, True]
    assert all(out[m].best_CSI1 is None for m in "bac")


def test_report_has_null_for_model_without_forecast(spark):
    preds = spark.createDataFrame(
        [("m", 1, at(10), [1.0])], "model string, lag int, valid_ts timestamp_ntz, values array<double>"
    )
    truth = spark.createDataFrame([(at(10), [1.0])], "frame_ts timestamp_ntz, values array<double>")
    out = {r.model: r for r in score_report(preds, truth, ["m", "gone"], ["MAE"]).collect()}
    assert out["gone"].MAE is None and out["m"].best_MAE and not out["gone"].best_MAE


# --- radar -------------------------------------------------------------------


def test_circular_runs_case_and_rotation(spark):
    def runs(idx, n=360):
        df = spark.createDataFrame([(1, int(k)) for k in idx], "s int, k int")
        return {r.k: (r.run_start, r.run_length, r.run_pos) for r in R.circular_runs(df, ["s"], "k", n).collect()}

    got = runs([0, 1, 5, 358, 359])
    assert got == {358: (358, 4, 0), 359: (358, 4, 1), 0: (358, 4, 2), 1: (358, 4, 3), 5: (5, 1, 0)}
    base = runs([2, 3, 7], 10)
    turned = runs([(k + 8) % 10 for k in (2, 3, 7)], 10)
    assert {(k + 8) % 10: ((s + 8) % 10, n, p) for k, (s, n, p) in base.items()} == turned
    assert set(runs(range(4), 4).values()) == {(0, 4, p) for p in range(4)}


@pytest.mark.parametrize("weights,want", [("distance", (1.0, 2.0)), ("reference", (2.0, 1.0))])
def test_gap_fill_weights(spark, weights, want):
    df = spark.createDataFrame([(1, 10, [0.0]), (1, 13, [3.0])], "s int, ray_bin int, values array<double>")
    out = {r.ray_bin: r["values"][0] for r in R.fill_gaps(df, ["s"], weights=weights).collect()}
    assert (out[11], out[12]) == pytest.approx(want)
    assert len(out) == 360


def test_merge_repeats_median(spark):
    rows = [(1, 0, 5, [1.0, 8.0]), (1, 1, 6, [2.0, 2.0]), (1, 2, 6, [0.0, 0.0]), (1, 3, 6, [6.0, 4.0]), (1, 4, 9, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "s int, ray_idx int, ray_bin int, values array<double>")
    out = {r.ray_bin: r["values"] for r in R.merge_repeats(df, ["s"]).collect()}
    # the zero ray is left out; the rays of sectors 5 and 9 join the median
    assert out == {5: [1.0, 8.0], 6: [np.median([2, 6, 1, 9]), np.median([2, 4, 8, 9])], 9: [9.0, 9.0]}


def test_composite_tie_takes_first_elevation(spark):
    df = spark.createDataFrame([(1, 2, 5.0), (1, 0, 5.0), (1, 1, 3.0)], "c int, elev_idx int, raw double")
    row = R.composite(df, ["c"]).first()
    assert (row.value, row.elev_idx) == (5.0, 0)


def test_ragged_round_trip(spark):
    df = spark.createDataFrame(
        [(1, 0, [1, 2]), (1, 1, []), (1, 2, [3])], "s int, k int, l array<int>"
    )
    flat = R.flatten_ragged(df, ["s"], ["k"], "l")
    assert flat.first()["flat"] == [1, 2, 3] and flat.first()["lengths"] == [2, 0, 1]
    back = {r.pos: r["items"] for r in R.rebuild_ragged(flat, ["s"]).collect()}
    assert back == {0: [1, 2], 1: [], 2: [3]}


# --- objects -----------------------------------------------------------------


def brute_labels(a, threshold):
    nr, nb = a.shape
    label = {}
    for r in range(nr):
        for b in range(nb):
            if a[r, b] < threshold or (r, b) in label:
                continue
            stack, seen = [(r, b)], {(r, b)}
            while stack:
                x, y = stack.pop()
                for dx in (-1, 0, 1):
                    for dy in (-1, 0, 1):
                        c = ((x + dx) % nr, y + dy)
                        if 0 <= c[1] < nb and a[c] >= threshold and c not in seen:
                            seen.add(c)
                            stack.append(c)
            low = min(x * nb + y for x, y in seen)
            label.update(dict.fromkeys(seen, low))
    return label


def rays_of(spark, arrays):
    rows = [(s, r, a[r].tolist()) for s, a in enumerate(arrays) for r in range(a.shape[0])]
    return spark.createDataFrame(rows, "scan_id long, ray int, values array<double>")


@pytest.mark.parametrize("density", [0.2, 0.4, 0.6])
def test_labels_three_ways(spark, density):
    rng = np.random.default_rng(int(density * 10))
    a = (rng.random((12, 9)) < density) * 5.0
    cells = objects.echo_cells(rays_of(spark, [a]), 1.0)
    want = brute_labels(a, 1.0)
    for fn in (objects.label_objects, objects.label_by_propagation):
        got = {(r.ray, r.bin): r.label for r in fn(cells, 9, 12).collect()}
        assert got == want


def test_propagation_of_repeated_cells_and_long_objects(spark, monkeypatch):
    rounds = []
    keep = objects.stored
    monkeypatch.setattr(objects, "stored", lambda df: rounds.append(1) or keep(df))
    a = np.zeros((12, 9))
    a[::2] = 5.0  # a snake from ray 0 to ray 10
    a[1, 8] = a[3, 0] = a[5, 8] = a[7, 0] = a[9, 8] = 5.0
    cells = objects.echo_cells(rays_of(spark, [a, a]), 1.0)
    want = {(s, *c): (label, 2) for s in (0, 1) for c, label in brute_labels(a, 1.0).items()}
    got = objects.label_by_propagation(cells.unionAll(cells), 9, 12).groupBy("scan", "ray", "bin").agg(
        F.max("label").alias("label"), F.count("*").alias("n")
    )
    assert {(r.scan, r.ray, r.bin): (r.label, r.n) for r in got.collect()} == want
    assert len(rounds) <= 2 * 9


def test_seam_object_is_one(spark):
    a = np.zeros((360, 4))
    a[359, 1] = a[0, 2] = 5.0
    got = objects.label_objects(objects.echo_cells(rays_of(spark, [a]), 1.0), 4).collect()
    assert len({r.label for r in got}) == 1


def test_object_stats_brute_force(spark):
    rng = np.random.default_rng(5)
    a = np.where(rng.random((10, 8)) < 0.4, rng.random((10, 8)) * 9 + 1, 0.0)
    labels = brute_labels(a, 1.0)
    pad = np.pad(np.where(a >= 1, a, 0), 1)
    want = {}
    for lab in set(labels.values()):
        cells = [c for c, v in labels.items() if v == lab]
        border = sum(
            1
            for r, b in cells
            for dr, db in ((0, 1), (0, -1), (1, 0), (-1, 0))
            if 0 <= r + dr < 10 and 0 <= b + db < 8 and labels.get((r + dr, b + db)) != lab
        )
        var = [
            abs(a[c] - (pad[r, b + 1] + pad[r + 2, b + 1] + pad[r + 1, b] + pad[r + 1, b + 2]) / 4) / a[c]
            for c in cells
            for r, b in [c]
        ]
        want[lab] = (len(cells), len(cells) / border, sum(var) / len(cells))
    lab = objects.label_objects(objects.echo_cells(rays_of(spark, [a]), 1.0), 8, 10)
    stats = objects.object_stats(lab, 1.0, 8, 10).collect()
    for r in stats:
        assert (r["size"], r.ratio, r.variation) == pytest.approx(want[r.label])


def test_despeckle_time_smoothing_and_neighbours(spark):
    a = np.zeros((6, 6)); a[1, 1] = a[1, 2] = 5.0
    b = np.zeros((6, 6)); b[1, 2] = 5.0; b[4, 4] = 5.0
    rays = rays_of(spark, [a, b])
    scans = spark.createDataFrame([(0, 0), (1, 1)], "scan_id long, seq long")
    got = {(r.scan, r.ray, r.bin) for r in objects.despeckle_time(rays, scans, 6, 6, threshold=1.0).collect()}
    assert got == {(0, 1, 1), (0, 1, 2), (1, 1, 2)}


# --- motion ------------------------------------------------------------------


def moved(spark, a, du, dv, **kw):
    ni, nj = a.shape
    df = spark.createDataFrame(
        [(1, a.ravel().tolist(), [float(du)] * a.size, [float(dv)] * a.size)],
        "k int, values array<double>, du array<double>, dv array<double>",
    )
    out = np.zeros(a.shape)
    for r in grid.warp(df, ni, nj, ["k"], **kw).collect():
        out[r.i, r.j] = r.value
    return out


def test_warp_cases(spark):
    a = np.arange(12.0).reshape(3, 4) + 1
    assert np.array_equal(moved(spark, a, 0, 0), a)
    assert np.array_equal(moved(spark, a, 1, 0, mode="nearest")[:, :3], a[:, 1:])
    assert np.array_equal(moved(spark, a, 1, 0)[:, 3], np.zeros(3))
    assert np.array_equal(moved(spark, a, 1, 0, padding="border")[:, 3], a[:, 3])
    half = moved(spark, a, 0.5, 0.5)
    assert half[0, 0] == pytest.approx(a[:2, :2].mean())


def test_block_motion_finds_shift(spark):
    rng = np.random.default_rng(3)
    prev = rng.random((8, 8))
    cur = np.roll(prev, 1, axis=1)
    cur[:, 0] = prev[:, 0]
    df = spark.createDataFrame(
        [(1, cur.ravel().tolist(), prev.ravel().tolist())], "k int, cur array<double>, prev array<double>"
    )
    got = grid.block_motion(df, 8, 8, 4, 1, key="k").collect()
    assert {(r.di, r.dj) for r in got} == {(0, 1)}


# --- interpolation -----------------------------------------------------------


def test_interpolation_of_a_plane_is_exact(spark):
    rng = np.random.default_rng(0)
    pts = [(1, r, c, -22 - 0.1 * r + 0.02 * rng.random(), -43 + 0.1 * c + 0.02 * rng.random()) for r in range(6) for c in range(6)]
    pts = [(*p, 2 + 3 * p[3] - 5 * p[4]) for p in pts]
    points = spark.createDataFrame(pts, "s int, row int, col int, lat double, lon double, value double")
    tg = [(k, -22.05 - 0.04 * (k // 10), -42.95 + 0.04 * (k % 10)) for k in range(100)] + [(100, -30.0, -43.0)]
    targets = spark.createDataFrame(tg, "target long, lat double, lon double")
    got = {r.target: r.value for r in interpolate.interpolate(points, targets, ["s"], tile=0.07, n_targets=101).collect()}
    assert got[100] is None and len(got) == 101
    for k, la, lo in tg[:100]:
        assert got[k] == pytest.approx(2 + 3 * la - 5 * lo)
    big = interpolate.locate(interpolate.triangles(points, ["s"], ["value"]), targets, ["s"], [], 0.07, max_bytes=1)
    small = interpolate.locate(interpolate.triangles(points, ["s"], ["value"]), targets, ["s"], [], 0.07)
    assert sorted(r.target for r in big.collect()) == sorted(r.target for r in small.collect())


def test_missing_corner_keeps_one_triangle(spark):
    pts = [(1, r, c, float(r), float(c), 1.0) for r in range(2) for c in range(2) if (r, c) != (0, 0)]
    points = spark.createDataFrame(pts, "s int, row int, col int, lat double, lon double, value double")
    assert interpolate.triangles(points, ["s"], ["value"]).count() == 1


def test_parallax_pipeline_on_flat_heights(spark):
    pix = [(at(0), r, c, -22 - 0.1 * r, -43 + 0.1 * c, float(r + c)) for r in range(5) for c in range(5)]
    rain = spark.createDataFrame(pix, "creation timestamp_ntz, row int, col int, lat double, lon double, value double")
    zero = rain.withColumnRenamed("value", "height").withColumn("height", F.lit(0.0))
    same = correct_parallax(rain, zero)
    a = {(r.row, r.col): (r.lat, r.lon) for r in same.collect()}
    assert len(a) == 25 and all(a[r, c] == pytest.approx((la, lo)) for _, r, c, la, lo, _ in pix)
    late = zero.withColumn("creation", F.lit(at(1)).cast("timestamp_ntz"))
    assert correct_parallax(rain, late).count() == 0
    assert correct_parallax(rain, late, unknown="keep").count() == 25
    marks = times_df(spark, "frame_ts", [at(0), at(10)])
    g = spark.createDataFrame([(0, -22.15, -42.85)], "target long, lat double, lon double")
    out = satellite_frames(rain, marks, [g, g], zero).collect()
    assert len(out) == 4 and all(r.value == pytest.approx(3.0) for r in out)


# --- scoring -----------------------------------------------------------------


def test_model_scoring(spark):
    f = spark.createDataFrame(
        [(at(10 * k), [float(k), -1.0]) for k in range(5)], "frame_ts timestamp_ntz, values array<double>"
    )
    past = samples.past_frames(f.select(F.col("frame_ts").alias("key_ts")), f, 2)
    out = score_frames(stack_inputs(past, 1, 2), lambda x: x.mean(axis=1, keepdims=True), "m", 2, 1, 1, 2, batch=2)
    got = {r.issue_ts: r["values"] for r in out.collect()}
    assert got[at(40)] == [3.5, 0.0] and got[at(0)] == [0.0, 0.0]
    assert out.first().valid_ts - out.first().issue_ts == timedelta(minutes=10)
    assert isinstance(pd.DataFrame(got), pd.DataFrame)
