"""Table readers: time-range scans, frame and composite tables, state tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia.functions.names import file_extension
from pluvia.functions.radar import RSCALE, RSTART

# Partition columns and bookkeeping columns of the warehouse tables.
PARTITION_COLUMNS = ["ano_particao", "mes_particao", "data_particao"]
BOOKKEEPING = ["update_time", "model_version", *PARTITION_COLUMNS]


def time_range(
    table: DataFrame,
    start: str,
    end: str,
    ts: str = "datetime",
    partition: str | None = "data_particao",
) -> DataFrame:
    """Rows with ``start <= ts < end``, without the bookkeeping columns.

    The dates of the bounds also filter the partition column, so only the folders
    of those days are read.
    """
    kind = table.schema[ts].dataType
    bound = lambda s: F.lit(s).cast(kind)
    out = table.where((F.col(ts) >= bound(start)) & (F.col(ts) < bound(end)))
    if partition is not None and partition in table.columns:
        days = [F.lit(s[:10]).cast("date") for s in (start, end)]
        out = out.where(F.col(partition).between(*days))
    return out.drop(*BOOKKEEPING)


def query(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    """Result of a SQL text over the given views."""
    return spark.sql(text, **views)


def read_by_extension(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """CSV (with header) or parquet, chosen by the file name."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.rstrip("/").endswith(".csv"):
        return reader.option("header", True).csv(path)
    return reader.parquet(path)


def read_csv_folder(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """All CSV files of a folder as one table; the schema is given, not inferred."""
    return (
        spark.read.schema(schema).option("header", True).option("pathGlobFilter", "*.csv").csv(folder)
    )


def read_composites(composites: DataFrame) -> DataFrame:
    """Composite rows with the usual geometry where an attribute is absent."""
    defaults = {"rscale": F.lit(RSCALE), "rstart": F.lit(RSTART), "compressed": F.lit(True)}
    return composites.withColumns(
        {
            c: F.coalesce(F.col(c), d) if c in composites.columns else d
            for c, d in defaults.items()
        }
    )


def read_state(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """State table, or an empty one of the same schema if it was never written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def decode_text(col: str):
    """Byte string to text."""
    return F.decode(F.col(col), "UTF-8")


def state_from_json(rows: DataFrame, col: str, schema: str) -> DataFrame:
    """State rows stored as JSON objects, one per row."""
    return rows.select(F.from_json(F.col(col), schema).alias("_s")).select("_s.*")


def with_extension(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumn("extension", file_extension(F.col(path)))
