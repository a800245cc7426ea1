"""Streams run over small files and compared with the batch operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pluvia.operators import state as ST
from pluvia.streaming import state as SS
from pluvia.streaming import windows as W

T = datetime(2024, 1, 1)
FAR = T + timedelta(days=40)


def at(minutes):
    return T + timedelta(minutes=minutes)


def feed(spark, path, batches, schema):
    """One parquet file per batch, read one per trigger, oldest first."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drain(df, spark, tmp_path, name):
    out = str(tmp_path / name)
    q = W.scheduled(
        df.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", str(tmp_path / (name + "-cp"))).option("path", out)
    ).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.schema(df.schema).parquet(out)


def drive(df, tmp_path, name, fn):
    q = W.scheduled(
        df.writeStream.foreachBatch(fn).option("checkpointLocation", str(tmp_path / (name + "-cp")))
    ).start()
    q.awaitTermination(240)
    assert q.exception() is None


READING = "station string, ts timestamp, value double"


def readings():
    rows = [("a" if k % 3 else "b", at(k * 4), float(k)) for k in range(60)]
    return [rows[:25], [rows[k] for k in (30, 26, 25, 29, 28, 27)] + rows[31:], [("end", FAR, 0.0)]]


def test_tumbling_frames_equal_batch(spark, tmp_path):
    batches = readings()
    stream = feed(spark, tmp_path / "in", batches, READING)
    got = drain(
        W.tumbling_frames(W.event_time(stream, "ts"), "ts", ["station"], "value"),
        spark, tmp_path, "tumble",
    ).where("station <> 'end'")
    flat = spark.createDataFrame([r for b in batches[:2] for r in b], READING)
    want = W.tumbling_frames(flat, "ts", ["station"], "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rolling_hours_equal_batch(spark, tmp_path):
    batches = readings()
    stream = feed(spark, tmp_path / "in", batches, READING)
    got = drain(
        W.rolling_hours(W.event_time(stream, "ts"), "ts", ["station"], "value"),
        spark, tmp_path, "roll",
    ).where("station <> 'end'")
    flat = spark.createDataFrame([r for b in batches[:2] for r in b], READING)
    want = W.rolling_hours(flat, "ts", ["station"], "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_first_sightings(spark, tmp_path):
    batches = [[("a", at(0), 1.0), ("a", at(0), 1.0)], [("a", at(0), 1.0), ("b", at(1), 1.0)]]
    stream = W.event_time(feed(spark, tmp_path / "in", batches, READING), "ts")
    got = drain(W.first_sightings(stream, ["station", "ts"], "ts"), spark, tmp_path, "dedupe")
    assert sorted(r.station for r in got.collect()) == ["a", "b"]


def high_water_input():
    return [
        [("a", at(0), 1.0), ("b", at(5), 2.0)],
        [("a", at(0), 3.0), ("a", at(2), 4.0), ("a", at(1), 5.0), ("b", at(4), 6.0)],
        [("a", at(2), 7.0), ("a", at(3), 8.0), ("c", at(0), 9.0)],
    ]


def expected_high_water(spark):
    marks, kept = spark.createDataFrame([], "station string, last_update timestamp"), []
    for rows in high_water_input():
        batch = spark.createDataFrame(rows, READING)
        kept += [r.value for r in ST.newer_rows(batch, marks, "station", "ts").collect()]
        moved = ST.advance_marks(batch, marks, "station", "ts").collect()
        marks = spark.createDataFrame(moved, "station string, last_update timestamp")
    return sorted(kept)


def test_high_water_batches_equal_batch_operator(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", high_water_input(), READING)
    fn = SS.high_water_batches(
        str(tmp_path / "marks"), str(tmp_path / "out"), "station", "ts", "string"
    )
    drive(stream, tmp_path, "hw", fn)
    got = sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == expected_high_water(spark) == [1.0, 2.0, 4.0, 5.0, 8.0, 9.0]
    # a batch that runs again changes nothing
    fn(spark.createDataFrame(high_water_input()[2], READING), 2)
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()) == got


def test_high_water_state_equal_batch_operator(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", high_water_input(), READING)
    got = drain(SS.high_water_stream(stream, "station", "ts"), spark, tmp_path, "hws")
    assert sorted(r.value for r in got.collect()) == expected_high_water(spark)


def test_last_files(spark, tmp_path):
    names = [f"f{k:03d}" for k in range(70)]
    stream = feed(spark, tmp_path / "in", [[(n,) for n in names[35:]], [(n,) for n in names[:40]]], "path string")
    drive(stream, tmp_path, "files", SS.last_files_batches(str(tmp_path / "state")))
    got = spark.read.parquet(str(tmp_path / "state" / "version=1"))
    assert sorted(r.path for r in got.collect()) == names[-50:]


def test_latest_height(spark, tmp_path):
    rain = feed(spark, tmp_path / "r", [[(at(10),), (at(30),)], [(FAR,)], [(FAR,)]], "ts timestamp")
    height = feed(
        spark, tmp_path / "h", [[(at(0),), (at(8),), (at(30),), (at(31),)], [(FAR,)], [(FAR,)]],
        "height_ts timestamp",
    )
    out = W.latest_height(
        W.event_time(rain, "ts", "rain"), W.event_time(height, "height_ts", "height")
    )
    got = {r.ts: r.height_ts for r in drain(out, spark, tmp_path, "lh").collect() if r.ts < FAR}
    assert got == {at(10): at(8), at(30): at(30)}


def test_latest_height_looks_up_and_does_not_pair(spark, tmp_path):
    rain = feed(spark, tmp_path / "r", [[(at(10),), (at(10),), (at(125),), (at(400),)], [(FAR,)], [(FAR,)]], "ts timestamp")
    height = feed(spark, tmp_path / "h", [[(at(5),), (at(5),), (at(130),)], [(FAR,)], [(FAR,)]], "height_ts timestamp")
    out = W.latest_height(W.event_time(rain, "ts", "rain"), W.event_time(height, "height_ts", "height"))
    assert "Join" not in out._jdf.queryExecution().analyzed().toString()
    got = sorted((r.ts, r.height_ts) for r in drain(out, spark, tmp_path, "lh").collect() if r.ts < FAR)
    assert got == [(at(10), at(5)), (at(125), at(5)), (at(400), None)]


def test_trailing_frames(spark, tmp_path):
    schema = "source string, frame_ts timestamp, values array<double>"
    frames = [("s", at(10 * k), [float(k)]) for k in (0, 1, 3, 4)]
    batches = [frames[:1] + frames[2:3], [frames[1]], [frames[3]], [("s", FAR, [0.0])], [("s", FAR, [0.0])]]
    stream = feed(spark, tmp_path / "in", batches, schema)
    got = drain(SS.trailing_frames(stream, 3), spark, tmp_path, "tf").collect()
    seen = {r.key_ts: [(f.lag, f["values"][0]) for f in r.frames] for r in got if r.key_ts < FAR}
    assert seen == {
        at(0): [(0, 0.0)], at(10): [(0, 1.0), (1, 0.0)], at(30): [(0, 3.0), (2, 1.0)],
        at(40): [(0, 4.0), (1, 3.0)],
    }


def test_scores_as_observed(spark, tmp_path):
    p_schema = "model string, issue_ts timestamp, valid_ts timestamp, values array<double>"
    preds = [("m", at(0), at(10), [3.0, 0.0]), ("m", at(0), at(20), [3.0, 3.0])]
    f_schema = "frame_ts timestamp, observed array<double>"
    p = feed(spark, tmp_path / "p", [preds, [("m", FAR, FAR, [0.0])]], p_schema)
    f = feed(spark, tmp_path / "f", [[(at(10), [3.0, 1.0])], [(at(20), [0.0, 5.0])]], f_schema)
    matched = W.matched_forecasts(W.event_time(p, "issue_ts"), W.event_time(f, "frame_ts"))
    got = drain(W.frame_scores(matched, [2.0]), spark, tmp_path, "sc").collect()
    rows = {r.valid_ts: (r.cells, r.abs_error, r["tp_2.0"], r["den_2.0"]) for r in got}
    assert rows == {at(10): (2, 1.0, 1, 1), at(20): (2, 5.0, 1, 2)}


def test_live_trigger(spark):
    stream = spark.readStream.format("rate").load()
    writer = W.scheduled(stream.writeStream.format("noop"), live=True)
    assert writer is not None


def test_first_sightings_needs_the_watermark_column(spark):
    with pytest.raises(ValueError):
        W.first_sightings(spark.range(1), ["id"], "ts")


def test_event_time_is_zoned(spark):
    df = spark.range(1).select(F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"))
    assert dict(W.event_time(df, "ts").dtypes)["ts"] == "timestamp"
