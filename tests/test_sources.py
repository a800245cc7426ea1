"""Files, archives, tables, settings and writers over temporary folders."""

import gzip
import io
import json
import zipfile
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pluvia.operators.radar import composite
from pluvia.sources import files, models, sinks, tables

T = datetime(2024, 1, 1, 6, 30)


def test_satellite_file_scan(spark, tmp_path):
    def decode_npz(path, content):
        """Test decoder: one compressed numpy file holds one scan."""
        with np.load(io.BytesIO(content)) as z:
            lat, lon, value = z["lat"], z["lon"], z["value"]
        rows, cols = np.indices(value.shape)
        yield pd.DataFrame(
            {
                "path": path, "row": rows.ravel().astype("int32"), "col": cols.ravel().astype("int32"),
                "lat": lat.ravel(), "lon": lon.ravel(), "value": value.ravel(),
            }
        )

    for k in range(3):
        lat, lon = np.meshgrid([-27.0, -22.0, -19.0], [-43.0, -39.0], indexing="ij")
        value = np.full(lat.shape, float(k))
        value[1, 0] = np.inf if k == 2 else value[1, 0]
        np.savez_compressed(tmp_path / f"s{k}.npz", lat=lat, lon=lon, value=value)
    schema = "path string, row int, col int, lat double, lon double, value double"
    raw = files.decode_files(spark, str(tmp_path), decode_npz, schema, "*.npz")
    assert raw.count() == 18
    kept = files.pixel_rows(raw, (-26, -19), (-47, -40), ["value"])
    assert sorted(r.value for r in kept.collect()) == [0.0, 1.0]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.txt", b"1")
        z.writestr("two.txt", b"22")
    with gzip.open(tmp_path / "b.txt.gz", "wb") as g:
        g.write(b"333")
    got = {r.member: bytes(r.bytes) for r in files.read_archives(spark, str(tmp_path)).collect()}
    assert got == {"x/one.txt": b"1", "two.txt": b"22", "b.txt": b"333"}


def test_members_go_together(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MEMBERS_AT_ONCE", 3)
    monkeypatch.setattr(files, "MEMBER_BYTES", 100)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in range(7):
            z.writestr(f"{k}.txt", b"x")
        z.writestr("long.txt", b"y" * 200)
        z.writestr("last.txt", b"")
    parts = list(files.archive_members("a.zip", (tmp_path / "a.zip").read_bytes()))
    assert [len(p) for p in parts] == [3, 3, 1, 1, 1]
    assert [m for p in parts for m in p["member"]] == [*(f"{k}.txt" for k in range(7)), "long.txt", "last.txt"]
    assert [len(b) for p in parts for b in p["bytes"]] == [1] * 7 + [200, 0]


def test_listing_and_directories(spark, tmp_path):
    (tmp_path / "p" / "q").mkdir(parents=True)
    for n in ("b.h5", "a.h5", "c.txt"):
        (tmp_path / "p" / "q" / n).write_bytes(b"x")
    got = files.list_files(spark, str(tmp_path), "*.h5")
    assert [r.path.rsplit("/", 1)[1] for r in got.collect()] == ["a.h5", "b.h5"]
    df = spark.createDataFrame([("a/b/c.txt",), ("a/d.txt",), ("e.txt",)], "path string")
    assert [r.directory for r in files.directories(df).collect()] == ["a/", "a/b/"]


def test_unknown_product_is_an_error(spark):
    df = spark.createDataFrame([("ABI-L2-ACHAF",), ("NOPE",)], "product string")
    assert files.with_bands(df.limit(1)).first().bands == ["HT"]
    with pytest.raises(Exception, match="unsupported product"):
        files.with_bands(df).collect()
    assert files.product_catalogue(spark).count() == 4


def test_partitioned_write_is_idempotent_per_day(spark, tmp_path):
    path = str(tmp_path / "t")
    day = lambda d, v: (datetime(2024, 1, d, 5), v)
    df = spark.createDataFrame([day(1, 1.0), day(2, 2.0)], "datetime timestamp_ntz, v double")
    sinks.write_partitioned(df, path, "datetime", mode="overwrite")
    again = spark.createDataFrame([day(2, 9.0)], "datetime timestamp_ntz, v double")
    sinks.write_partitioned(again, path, "datetime", mode="overwrite", files_per_day=2)
    back = tables.time_range(spark.read.parquet(path), "2024-01-01", "2024-01-03")
    assert sorted(r.v for r in back.collect()) == [1.0, 9.0] and back.columns == ["datetime", "v"]


def test_time_range_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(240).select(
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("datetime")
    )
    sinks.write_partitioned(df, path, "datetime")
    out = tables.time_range(spark.read.parquet(path), "2024-01-03 12:00:00", "2024-01-04 06:00:00")
    assert out.count() == 18
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(data_particao" in plan and "GreaterThanOrEqual(datetime" in plan


def test_frame_store_refuses_unless_overwrite(spark, tmp_path):
    f = spark.createDataFrame(
        [("sat", "rio", T, [1.0, 2.0])],
        "source string, location string, frame_ts timestamp_ntz, values array<double>",
    )
    stats = spark.createDataFrame([(1.5, 0.5, 0.8, 0.2)], "train_mean double, train_std double, train_log_mean double, train_log_std double")
    meta = sinks.dataset_meta(f, "RRQPE", "-", 1, 2, 10, stats, f.select("frame_ts"))
    path = str(tmp_path / "store")
    sinks.write_frames(f, meta, path)
    with pytest.raises(Exception):
        sinks.write_frames(f, meta, path)
    sinks.write_frames(f, meta, path, overwrite=True)
    got = spark.read.parquet(path + "/frames")
    assert dict(got.dtypes)["values"] == "array<float>" and got.count() == 1
    assert spark.read.parquet(path + "/meta").first().datetime_keys == [T]


def test_prediction_rows_and_store(spark, tmp_path):
    df = spark.createDataFrame(
        [("m", T, [[1.0], [2.0]])], "model string, issue_ts timestamp_ntz, horizon array<array<double>>"
    )
    sinks.write_predictions(sinks.prediction_rows(df), str(tmp_path / "p"))
    got = spark.read.parquet(str(tmp_path / "p")).orderBy("valid_ts").collect()
    assert [(r.valid_ts.minute, r["values"]) for r in got] == [(40, [1.0]), (50, [2.0])]


def test_metrics_csv_spells_nan(spark, tmp_path):
    df = spark.createDataFrame([("m", None)], "model string, csi double")
    sinks.write_metrics(df, str(tmp_path / "m"))
    text = "".join(p.read_text() for p in (tmp_path / "m").glob("*.csv"))
    assert "m,nan" in text.splitlines()


def test_csv_folder_to_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, 3.5)], "a int, b double")
    sinks.write_format(df.repartition(2), str(tmp_path / "c.csv"), "csv")
    back = tables.read_csv_folder(spark, str(tmp_path / "c.csv"), "a int, b double")
    assert sorted(map(tuple, back.collect())) == [(1, 2.5), (2, 3.5)]
    assert tables.read_by_extension(spark, str(tmp_path / "c.csv"), "a int, b double").count() == 2
    sinks.load_table(back, str(tmp_path / "t"))
    sinks.load_table(back, str(tmp_path / "t"))
    assert tables.read_by_extension(spark, str(tmp_path / "t")).count() == 4
    sinks.load_table(back, str(tmp_path / "t2"), "overwrite")
    assert spark.read.parquet(str(tmp_path / "t2")).count() == 2


def test_state_versions(spark, tmp_path):
    schema = "k string, v long"
    path = str(tmp_path / "state")
    assert tables.read_state(spark, path, schema).count() == 0
    one = spark.createDataFrame([("a", 1), ("b", 2)], schema)
    v1 = sinks.upsert_state(spark, one, path, ["k"], schema, "1")
    assert v1.count() == 2


def test_manifest_omits_failures(spark, tmp_path):
    done = spark.createDataFrame([("a", True), ("b", False)], "path string, ok boolean")
    sinks.append_manifest(done, str(tmp_path / "m"))
    listed = spark.createDataFrame([("a",), ("b",)], "path string")
    todo = files.not_yet_seen(listed, spark.read.parquet(str(tmp_path / "m")))
    assert [r.path for r in todo.collect()] == ["b"]


def test_registry_and_settings(spark, tmp_path):
    reg = {"models": {"U": {"model_file": "u.ckpt"}, "N": {"args": {"overwrite": "no"}, "plot": False}}}
    (tmp_path / "r.json").write_text(json.dumps(reg, indent=2))
    r = models.read_registry(spark, str(tmp_path / "r.json"))
    params = spark.createDataFrame([("U", {"accelerator": "gpu"})], "model string, params map<string,string>")
    got = {x.model: x.settings for x in models.model_settings(r, {"n_before": "10"}, params).collect()}
    assert got["U"] == {**models.DEFAULT_SETTINGS, "n_before": "10", "accelerator": "gpu"}
    assert got["N"] == {"overwrite": "no", "n_before": "10"}


def test_state_json_table(spark):
    rows = spark.createDataFrame([('{"a":1,"b":"x"}',)], "s string")
    assert tuple(tables.state_from_json(rows, "s", "a int, b string").first()) == (1, "x")


def test_local_suffix():
    assert sinks.local_suffix(datetime.fromisoformat("2024-01-01T02:30:00+00:00")) == "202312312330"


def test_radar_volume_scan(spark, tmp_path):
    def decode(path, content):
        for line in content.decode().splitlines():
            variable, elev, ray, values = line.split(";")
            raw = [float(v) for v in values.split(",")]
            yield pd.DataFrame(
                {
                    "scan": path.rsplit("/", 1)[-1], "variable": variable, "elev_idx": int(elev),
                    "ray": int(ray), "bin": np.arange(len(raw), dtype="int32"), "raw": raw,
                }
            )

    (tmp_path / "v1.vol").write_text("data2;0;0;1,5\ndata2;1;0;4,2\ndata1;0;0;9,9")
    schema = "scan string, variable string, elev_idx int, ray int, bin int, raw double"
    cells = files.decode_files(spark, str(tmp_path), decode, schema, "*.vol")
    dbzh = files.select_variable(cells, "DBZH")
    top = {r.bin: (r.value, r.elev_idx) for r in composite(dbzh, ["scan", "ray", "bin"]).collect()}
    assert top == {0: (4.0, 1), 1: (5.0, 0)}
    with pytest.raises(ValueError):
        files.select_variable(cells, "NOPE")


def test_composite_store_keeps_lists(spark, tmp_path):
    df = spark.createDataFrame(
        [("CMAX", "DBZH", T, 0, 0, 1.0, [0, 2])],
        "process_type string, feature string, scan_ts timestamp_ntz, ray int, bin int, "
        "value double, elevs array<int>",
    )
    sinks.write_composites(df, str(tmp_path / "c"))
    back = tables.read_composites(spark.read.parquet(str(tmp_path / "c"))).first()
    assert back.elevs == [0, 2] and (back.rscale, back.rstart, back.compressed) == (250.0, 0.0, True)
