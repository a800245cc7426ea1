"""Session settings and the few helpers that touch the session itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# A dimension whose size statistics exceed this is never broadcast by hint; the caller
# takes the shuffled path instead.
BROADCAST_MAX_BYTES = 32 << 20
# Bytes of one Arrow batch, as packed rows may be of any size.
BATCH_BYTES = 16 << 20


def get_session(master: str | None = None, app: str = "pluvia", **conf: str) -> SparkSession:
    """Session with the settings the operators rely on.

    UTC keeps naive and zoned timestamps interchangeable, adaptive execution
    sizes shuffles and splits skewed join partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
        # Recording the call site of every column expression makes long plans slow to build.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; fall back to a temporary one in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="pluvia-checkpoint-")
    sc.setCheckpointDir(folder)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """Path of a new folder below the shared one."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Lineage ends here, the table is computed once however often it is used, and its size is known.
    """
    path = shared_folder(df.sparkSession, "tables")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fits_broadcast(dim: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether a dimension is small enough to copy to every executor.

    Decided by the optimizer's size statistics, which run no job; where they know no
    better they are too large, and the shuffled path is taken.
    """
    stats = dim._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes())) <= max_bytes


def extended(df: DataFrame, ddl: str) -> StructType:
    """Schema of ``df`` with more columns behind."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Share a table stored in too few files among all cores before heavy work.

    A table that already has a partition per core is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key over all shuffle partitions, for groups whose work outweighs their bytes.

    Adaptive execution merges small partitions by their size alone; these stay as they are.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def join_dimension(
    big: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "inner",
    spread: str | None = None,
    salts: int = 32,
    max_bytes: int = BROADCAST_MAX_BYTES,
) -> DataFrame:
    """Join a large table with a dimension whose key has few distinct values.

    A dimension of checked size is broadcast. A larger one is shuffled; with
    ``spread`` (a column of ``big``) each key is split over ``salts`` partitions
    so that one key holding most of the rows does not land in one task.
    """
    if fits_broadcast(dim, max_bytes):
        return big.join(F.broadcast(dim), on, how)
    if spread is None:
        return big.join(dim, on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, on + ["_salt"], how).drop("_salt")
