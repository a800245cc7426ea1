"""Writers: partitioned tables, frame and prediction stores, state, manifests."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia.functions.times import LOCAL_ZONE, minutes
from pluvia.operators.state import upsert
from pluvia.sources.tables import PARTITION_COLUMNS, read_state

#: CSV files have a header and keep microseconds.
CSV = {
    "header": "true", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}
#: Folder below a loaded table whose files list the folders of each version.
VERSIONS = "_versions"


def with_partitions(df: DataFrame, ts: str) -> DataFrame:
    """Year, month and date partition columns taken from one timestamp."""
    year, month, date = PARTITION_COLUMNS
    return df.withColumns(
        {year: F.year(ts), month: F.month(ts), date: F.to_date(ts)}
    )


def local_suffix(now: datetime | None = None) -> str:
    """Default file suffix: local time to the minute."""
    moment = now or datetime.now(ZoneInfo("UTC"))
    return moment.astimezone(ZoneInfo(LOCAL_ZONE)).strftime("%Y%m%d%H%M")


def write_partitioned(
    df: DataFrame,
    path: str,
    ts: str,
    fmt: str = "parquet",
    mode: str = "append",
    files_per_day: int | None = None,
) -> None:
    """Write by year, month and date of ``ts``.

    ``mode='overwrite'`` replaces only the dates present in ``df``, so running a day
    again is idempotent. ``files_per_day`` gathers each date into that many files by
    a spread hash, so a heavy date is still written by several tasks.
    """
    out = with_partitions(df, ts)
    if files_per_day:
        out = out.withColumn(
            "_f", F.pmod(F.xxhash64(*df.columns), F.lit(files_per_day)).cast("int")
        ).repartition(PARTITION_COLUMNS[2], "_f").drop("_f")
    writer = out.write.partitionBy(*PARTITION_COLUMNS).mode(mode).option(
        "partitionOverwriteMode", "dynamic"
    )
    if fmt == "csv":
        writer = writer.options(**CSV)
    writer.format(fmt).save(path)


def write_format(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """CSV with a header, or parquet."""
    if fmt not in ("csv", "parquet"):
        raise ValueError("fmt must be 'csv' or 'parquet'")
    writer = df.write.mode(mode)
    (writer.options(**CSV).csv if fmt == "csv" else writer.parquet)(path)


def load_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """Plain staging load: add rows (creating the table) or replace the table.

    Replacing deletes the old files first; where readers or failures must not see that, use
    :func:`publish_table`.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be 'append' or 'overwrite'")
    df.write.mode(mode).option("partitionOverwriteMode", "static").parquet(path)


def publish_table(
    df: DataFrame, path: str, mode: str = "append", check: Callable[[DataFrame], bool] | None = None
) -> None:
    """Staging load that readers see as a whole or not at all.

    The rows go to a folder of their own; once they are whole, and ``check`` (if given) accepts the
    table as it would be, a new version that lists the folders is published. Readers of
    :func:`published` see the old table or the new one, and a failed load leaves the old rows. Of
    two loads at once the second fails, as its version exists.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be 'append' or 'overwrite'")
    spark = df.sparkSession
    version, folders = _versions(spark, path)
    new = f"load-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/{new}")
    kept = [*(folders if mode == "append" else []), new]
    if check is not None and not check(_folders(spark, path, kept, df.schema)):
        raise ValueError("the loaded table was not accepted")
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{VERSIONS}/{version + 1:012d}")
    # Created only if there is none of this number.
    out = pointer.getFileSystem(spark._jsc.hadoopConfiguration()).create(pointer, False)
    try:
        out.write(bytearray("\n".join(kept), "utf-8"))
    finally:
        out.close()


def published(
    spark: SparkSession, path: str, schema: T.StructType | str, version: int | None = None
) -> DataFrame:
    """The last published version of a loaded table, or an earlier one; empty before the first load."""
    last, folders = _versions(spark, path, version)
    if last < 0:
        return spark.createDataFrame([], schema)
    return _folders(spark, path, folders, schema)


def _folders(spark: SparkSession, path: str, folders: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/{f}" for f in folders])


def _versions(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[str]]:
    """Number and folders of a version, the last one by default; -1 where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{VERSIONS}")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = [int(f.getPath().getName()) for f in store.listStatus(folder)] if store.exists(folder) else []
    if version is None:
        version = max(numbers, default=-1)
    elif version not in numbers:
        raise ValueError(f"no version {version}")
    if version < 0:
        return -1, []
    file = store.open(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{version:012d}"))
    try:
        return version, bytes(file.readAllBytes()).decode().split("\n")
    finally:
        file.close()


def write_frames(
    frames: DataFrame,
    meta: DataFrame,
    path: str,
    overwrite: bool = False,
    ts: str = "frame_ts",
) -> None:
    """Packed float frames by source, location and date, with one row per dataset beside them.

    Refuses to touch an existing store unless ``overwrite``.
    """
    mode = "overwrite" if overwrite else "errorifexists"
    out = frames.withColumn("values", F.col("values").cast("array<float>"))
    out.withColumn("date", F.to_date(ts)).write.mode(mode).option(
        "partitionOverwriteMode", "static"
    ).partitionBy("source", "location", "date").parquet(f"{path}/frames")
    meta.write.mode(mode).parquet(f"{path}/meta")


def write_frame_buckets(
    frames: DataFrame,
    name: str,
    path: str,
    n_before: int,
    n_after: int,
    step: int = 10,
    slot_minutes: int = 1440,
    buckets: int = 64,
    ts: str = "frame_ts",
) -> None:
    """Packed frames as a catalogue table in buckets by source, location and time slot.

    Beside its own slot (``own``) a frame stands in the slots of other keys that need it: with a day as
    slot and three hours as horizon about one frame in eight has a copy. So a key finds its whole sample in
    its own bucket, and :func:`pluvia.operators.samples.bucketed_samples` joins without a shuffle.
    """
    slot = lambda shift: F.floor(
        F.unix_micros((F.col(ts) + minutes(shift)).cast("timestamp")) / F.lit(slot_minutes * 60_000_000)
    ).cast("long")
    reach = F.sequence(slot(-n_after * step), slot((n_before - 1) * step))
    spread = frames.withColumn("slot", F.explode(reach)).withColumn("own", F.col("slot") == slot(0))
    keys = ["source", "location", "slot"]
    # One file per bucket: rows of a bucket come together first.
    spread.repartition(buckets, *keys).write.mode("errorifexists").option("path", path).bucketBy(
        buckets, *keys
    ).sortBy(*keys, ts).saveAsTable(name)


def dataset_meta(
    frames: DataFrame, feature: str, process_type: str, ni: int, nj: int, step: int,
    stats: DataFrame, key_times: DataFrame, ts: str = "frame_ts",
) -> DataFrame:
    """One row of dataset attributes with its training statistics and issue times.

    ``key_times`` holds the few times to forecast from.
    """
    keys = key_times.agg(F.sort_array(F.collect_list(ts), asc=False)).scalar()
    return stats.select(
        F.lit(feature).alias("feature"), F.lit(process_type).alias("process_type"),
        F.lit(ni).alias("ni"), F.lit(nj).alias("nj"), F.lit(step).alias("timestep"),
        "train_mean", "train_std", "train_log_mean", "train_log_std",
        keys.alias("datetime_keys"),
    )


def write_composites(composites: DataFrame, path: str, mode: str = "append") -> None:
    """Radar composites by process, variable and date; list columns are stored as they are."""
    composites.withColumn("date", F.to_date("scan_ts")).write.mode(mode).option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("process_type", "feature", "date").parquet(path)


def prediction_rows(forecasts: DataFrame, step: int = 10) -> DataFrame:
    """One row per issue and valid time from a row with the whole horizon.

    ``forecasts``: ``model, issue_ts, horizon`` (array of packed frames).
    """
    rows = forecasts.select("model", "issue_ts", F.posexplode("horizon").alias("_p", "values"))
    return rows.select(
        "model", "issue_ts", (F.col("issue_ts") + minutes((F.col("_p") + 1) * step)).alias("valid_ts"),
        "values",
    )


def write_predictions(predictions: DataFrame, path: str, mode: str = "append") -> None:
    predictions.withColumn("issue_date", F.to_date("issue_ts")).write.mode(mode).option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("model", "issue_date").parquet(path)


def write_metrics(scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Score table as CSV, missing scores spelled ``nan``."""
    scores.write.mode(mode).option("header", True).option("nullValue", "nan").csv(path)


def append_manifest(done: DataFrame, path: str, ok: str = "ok") -> None:
    """Add the files that were processed successfully."""
    done.where(F.col(ok)).select("path").write.mode("append").parquet(path)


def upsert_state(
    spark: SparkSession,
    changes: DataFrame,
    path: str,
    key: list[str],
    schema: T.StructType | str,
    version: str,
) -> DataFrame:
    """New version of a state table with the changed keys replaced.

    The result goes to its own ``version`` folder, so the previous state stays
    readable while it is rewritten and a failed run changes nothing.
    """
    previous = read_state(spark, path, schema)
    target = f"{path.rstrip('/')}__{version}"
    upsert(previous, changes.select(*previous.columns), key).write.mode("errorifexists").parquet(
        target
    )
    return spark.read.parquet(target)
