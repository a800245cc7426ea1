"""Several locations and sites, tables stored as folders, long axes, incomplete frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pluvia.operators import grid, objects, ordering, samples, scoring, state, verify
from pluvia.plans.samples import sample_table
from pluvia.streaming import state as stream_state

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def at(n):
    return T0 + dt.timedelta(minutes=10 * n)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The stream tables as folders of several files."""
    root = tmp_path_factory.mktemp("sf")
    for name in ("events", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(4).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize(
    "name", ["stream_first_sightings", "stream_high_water_state", "stream_last_files", "stream_latest_height"]
)
def test_streams_read_folders_like_files(spark, folders, name):
    run = entry.queries()[name]
    got, want = run(spark, folders), run(spark, SF)
    rows = sorted(map(str, want.collect()))
    assert rows and sorted(map(str, got.collect())) == rows


def test_streams_fail_without_a_table(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        entry.queries()["stream_first_sightings"](spark, str(tmp_path))


def test_last_files_keep_two_versions(spark, tmp_path):
    path = str(tmp_path / "state")
    run = stream_state.last_files_batches(path, n=2)
    for n, names in enumerate([["a", "c"], ["b"], ["d"], []]):
        run(spark.createDataFrame([(x,) for x in names], "path string"), n)
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["version=2", "version=3"]
    assert [r.path for r in stream_state.latest_state(spark, path, "path string").orderBy("path").collect()] == ["c", "d"]


def test_marks_move_without_a_join(spark):
    old = spark.createDataFrame([("a", at(3)), ("b", at(9))], "k string, last_update timestamp_ntz")
    batch = spark.createDataFrame(
        [("a", at(2)), ("a", at(5)), ("b", at(1)), ("c", at(0)), ("d", None), (None, at(1)), ("e", dt.datetime(1800, 1, 1))],
        "k string, ts timestamp_ntz",
    )
    new = state.advance_marks(batch, old, "k", "ts")
    assert {r.k: r.last_update for r in new.collect()} == {"a": at(5), "b": at(9), "c": at(0)}
    assert "Join" not in new._jdf.queryExecution().optimizedPlan().toString()


def test_datasets_of_any_length(spark):
    sizes = spark.createDataFrame([("a", 3_000_000_000), ("b", 0), ("c", 5)], "dataset string, n long")
    index = spark.createDataFrame([(0,), (2_999_999_999,), (3_000_000_000,), (3_000_000_004,), (3_000_000_005,)], "idx long")
    offsets = ordering.dataset_offsets(sizes, "dataset", "n")
    got = {r.idx: (r.dataset, r.local) for r in ordering.dataset_of(index, offsets, "dataset").collect()}
    assert got == {
        0: ("a", 0), 2_999_999_999: ("a", 2_999_999_999), 3_000_000_000: ("c", 0), 3_000_000_004: ("c", 4)
    }


def test_incomplete_frames_are_an_error(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 0, 3.0), (1, 1, 1, 4.0)], "t int, i int, j int, value double")
    with pytest.raises(Exception, match="does not have the cells"):
        grid.pack_frames(cells, 2, 2, ["t"]).collect()
    assert grid.pack_frames(cells, 2, 2, ["t"], sparse=True).first()["values"] == [1.0, None, 3.0, 4.0]
    wide = cells.union(spark.createDataFrame([(1, 2, 0, 9.0)], cells.schema))
    with pytest.raises(Exception, match="does not have the cells"):
        grid.pack_frames(wide, 2, 2, ["t"]).collect()


def test_sites_are_compared_apart(spark):
    # Two radars at the same times; each has one echo that lasts, at different places.
    rows = []
    for site, ray in (("a", 1), ("b", 5)):
        for seq in (0, 1):
            for r in range(8):
                rows.append((f"{site}{seq}", site, seq, r, [20.0 if r in (ray, ray + 1) else 0.0] * 4))
    rays = spark.createDataFrame(rows, "scan_id string, site string, seq int, ray int, values array<double>")
    scans = rays.select("scan_id", "site", "seq").distinct()
    out = objects.despeckle_time(rays.drop("site", "seq"), scans, 4, 8, [-1, 1], by=["site"]).collect()
    assert {(r.scan, r.ray) for r in out} == {(f"{s}{n}", k + d) for s, k in (("a", 1), ("b", 5)) for n in (0, 1) for d in (0, 1)}
    # A change of geometry is a change of site.
    other = scans.withColumn("site", F.col("scan_id"))
    assert objects.despeckle_time(rays.drop("site", "seq"), other, 4, 8, [-1, 1], by=["site"]).count() == 0


@pytest.fixture
def two_places(spark):
    rows = [(p, at(n), [float(10 * k + n)]) for k, p in enumerate("xy") for n in range(4)]
    return spark.createDataFrame(rows, "location string, frame_ts timestamp_ntz, values array<double>")


def test_samples_stay_in_their_location(spark, two_places):
    keys = two_places.select("location", F.col("frame_ts").alias("key_ts"))
    pairs = samples.lead_pairs(keys, two_places, 2, on=["location"])
    got = {(r.location, r.key_ts, r.lead): (r.previous, r.target) for r in pairs.collect()}
    assert len(got) == 16
    assert got["y", at(0), 2] == ([11.0], [12.0])
    assert got["x", at(2), 2] == (None, None)
    x = scoring.stack_inputs(samples.past_frames(keys, two_places, 2, on=["location"]), 1, 1, by=["location"])
    scored = scoring.score_frames(x, lambda s: s[:, :1], "last", 2, 1, 1, 1, by=["location"])
    got = {(r.location, r.issue_ts): r["values"] for r in scored.collect()}
    assert got["y", at(3)] == [13.0] and got["x", at(3)] == [3.0]
    wanted = spark.createDataFrame([("x", at(1)), ("z", at(1))], "location string, frame_ts timestamp_ntz")
    assert [r.location for r in samples.requested_keys(wanted, two_places, by=["location"]).collect()] == ["x"]
    only = two_places.where("location = 'x' OR values[0] < 12")
    assert samples.common_keys([two_places, only], by=["location"]).count() == 6
    matched = verify.match_forecasts(
        two_places.withColumnRenamed("frame_ts", "valid_ts"), two_places, "inner", by=["location"]
    )
    assert matched.where("forecast <> truth").count() == 0 and matched.count() == 8


def test_chosen_locations_and_leads(spark, two_places):
    both = sample_table(two_places, 1, 2, locations=["x", "y"])
    one = sample_table(two_places, 1, 2, locations=["y"])
    assert both.count() == 2 * one.count() == 24
    assert {r.location for r in one.collect()} == {"y"}
    led = sample_table(two_places, 1, 2, locations=["y"], lead_conditioned=True)
    rows = [r for r in led.collect() if r.key_ts == at(1)]
    assert sorted((r.lead, r.kind, r.lag, r["values"][0]) for r in rows) == [
        (1, "x", 0, 11.0), (1, "y", 1, 12.0), (2, "x", 0, 11.0), (2, "y", 2, 13.0)
    ]


def test_one_issue_reads_one_date(spark, tmp_path, two_places):
    predictions = two_places.select(
        F.col("frame_ts").alias("issue_ts"), "values", F.to_date("frame_ts").alias("issue_date")
    )
    predictions.write.partitionBy("issue_date").parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    for shown in (verify.forecast_table(stored, two_places), verify.hindcast_table(stored, two_places, back=1)):
        plan = shown._jdf.queryExecution().executedPlan().toString()
        filters = [x for x in plan.split("PartitionFilters: ")[1:]]
        assert filters and "issue_date" in filters[0].split("]")[0]
    assert verify.forecast_table(stored, two_places).count() == 2


def test_means_with_missing_members(spark):
    cells = spark.createDataFrame(
        [(1, 2.0), (1, 4.0), (2, 2.0), (2, None), (3, float("nan")), (3, 1.0)], "k int, value double"
    )
    mean = lambda **a: {r.k: r.value for r in grid.ensemble_mean(cells, ["k"], **a).collect()}
    assert mean() == {1: 3.0, 2: 2.0, 3: 1.0}
    assert mean(skip_missing=False) == {1: 3.0, 2: None, 3: None}


def test_frames_without_motion_have_missing_forecasts(spark):
    frames = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "frame_ts int, values array<double>")
    motion = spark.createDataFrame([(2, 0, 0, 0, 1), (2, 0, 1, 0, 1)], "frame_ts int, bi int, bj int, di int, dj int")
    out = grid.extrapolate(frames, motion, 1, 2, 1, 1)
    assert {r.frame_ts: r["values"] for r in out.collect()} == {1: None, 2: [3.0, 3.0]}
    assert grid.extrapolate(frames, motion, 1, 2, 1, 1, keep_missing=False).count() == 1
