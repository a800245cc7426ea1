"""Shape of the physical plans: pruning, broadcasts and number of shuffles."""

import re

import pytest
from pyspark.sql import functions as F

from pluvia.operators import grid, samples, verify
from pluvia.operators.objects import echo_cells, label_objects, object_stats
from pluvia.plans import views as V
from pluvia.plans.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def static_plans(spark):
    """Plans without adaptive wrappers, and without broadcasts of small inputs."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def shuffles(df):
    return len(re.findall(r"(?<!Reused)Exchange hashpartitioning|Exchange SinglePartition", plan(df)))


def stored(spark, tmp_path, df, name):
    df.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def test_scoring_shuffles_frames_once_and_groups_once(spark, tmp_path, static_plans):
    f = stored(spark, tmp_path, V.frames(spark, SF), "f")
    p = stored(spark, tmp_path, V.predictions(spark, SF, 2), "p")
    pairs = verify.paired_cells(verify.match_forecasts(p, f, "inner"), ["model", "lag"])
    out = verify.score(pairs, ["model", "lag"], ["MAE", "CSI1"])
    # two sides of the frame join, and one row per (model, lag) and task
    assert shuffles(out) == 3
    text = plan(out)
    assert "partial_sum" in text and "partial_avg" in text
    assert "ReadSchema: struct<model:string,valid_ts:timestamp_ntz,lag:int,values:array<double>>" in text


def test_past_join_moves_each_frame_once(spark, tmp_path, static_plans):
    f = stored(spark, tmp_path, V.frames(spark, SF), "f")
    keys = f.select(F.col("frame_ts").alias("key_ts"))
    assert shuffles(samples.past_frames(keys, f, 10)) == 2


def test_static_enrichment_is_a_broadcast(spark, tmp_path, static_plans):
    cells = spark.range(100).selectExpr("id % 4 AS i", "id % 5 AS j", "id AS value")
    dim = spark.range(20).selectExpr("id % 4 AS i", "id % 5 AS j", "id AS elevation")
    assert "BroadcastHashJoin" in plan(samples.with_static(cells, dim, ["i", "j"]))


def test_object_windows_share_one_partitioning(spark, tmp_path, static_plans):
    rays = stored(spark, tmp_path, V.composites(spark, SF), "r")
    stats = object_stats(label_objects(echo_cells(rays, 4.0), 64, 50), 4.0, 64, 50)
    # one shuffle to label a scan, one to place its labelled cells
    assert shuffles(stats) == 2


def test_packing_merges_repeats_before_they_move(spark, tmp_path, static_plans):
    f = stored(spark, tmp_path, V.frames(spark, SF).select("vec_id", "values"), "f")
    cells = grid.unpack_frames(f, 8, ["vec_id"])
    packed = grid.pack_frames(cells, 8, 8, ["vec_id"])
    # by frame and cell with a partial maximum, then one row per cell by frame
    assert shuffles(packed) == 2 and "partial_max" in plan(packed)
    members = f.withColumn("member", F.explode(F.array(F.lit(0), F.lit(1))))
    assert shuffles(grid.ensemble_mean_packed(members, ["vec_id"], 8)) == 1


def test_ensemble_mean_groups_frames_not_cells(spark):
    rows = [(1, [1.0, None, 4.0]), (1, [3.0, float("nan"), 6.0]), (1, [5.0]), (2, []), (3, None), (None, [2.0, 7.0])]
    members = spark.createDataFrame(rows, "k long, values array<double>")
    out = grid.ensemble_mean_packed(members, ["k"], 2)
    assert "collect_list" in plan(out) and "avg(" not in plan(out)
    got = {(r.k, r.i, r.j): r.value for r in out.collect()}
    assert got == {(1, 0, 0): 3.0, (1, 0, 1): None, (1, 1, 0): 5.0, (None, 0, 0): 2.0, (None, 0, 1): 7.0}


def test_evolve_skips_missing_frames_and_never_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(grid, "FOLLOWED_CELLS", 4)
    frames = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)] + [(9, None)], "issue_ts long, values array<double>")
    motion = spark.range(10).selectExpr(
        "id AS issue_ts", "explode(array(1, 2)) AS lead", "array(1D, 0D) AS du", "array(0D, 0D) AS dv", "array(0.5D, 0D) AS intensity"
    )
    out = grid.evolve(frames, motion, 1, 2, 2)
    assert "Broadcast" not in plan(out)
    got = {(r.issue_ts, r.lead): r["values"] for r in out.collect()}
    assert got == {(k, lead): v for k in range(5) for lead, v in ((1, [2.5, 2.0]), (2, [2.5, 2.0]))}


def test_scans_read_only_needed_columns(spark):
    text = plan(QUERIES["latest_per_key"](spark, SF))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in text
    text = plan(QUERIES["time_range_scan"](spark, SF))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text


def test_no_row_at_a_time_python(spark):
    for name in ("score_report", "gap_fill", "interp_grid", "object_stats", "warp_bilinear"):
        assert "BatchEvalPython" not in plan(QUERIES[name](spark, SF))
