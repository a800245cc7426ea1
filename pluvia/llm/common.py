"""What the corpus operators share: reading tables, storing results, word columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.session import ensure_checkpoint_dir

#: The characters that separate words: space, tab, newline, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query of this subpackage, with its SQL text where SQL can express it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: With this setting Spark deletes the shuffle files of a finished query at once.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: For columns that are compressed already: no second compression, no search for values that repeat.
PACKED = {"compression": "none", "parquet.enable.dictionary": "false"}


def stored(df: DataFrame, clear: bool = False, packed: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    The files are columnar and compressed, every executor can read them, and a lost
    executor costs only its unfinished tasks. They stay until ``forget``, or until the folder
    that ``spark.checkpoint.dir`` names is cleared. With ``clear`` the shuffle files of the write,
    which nothing else uses, go with its end. ``packed`` says that the columns are compressed already.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/llm/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    if clear:
        spark.conf.set(CLEAN, "true")
    try:
        df.write.options(**(PACKED if packed else {})).parquet(path)
    finally:
        if clear and before is None:
            spark.conf.unset(CLEAN)
        elif clear:
            spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(old: DataFrame) -> None:
    """Delete the files of a table that ``stored`` wrote, once nothing reads them any more."""
    spark = old.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in old.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def words(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " ")
    return F.array_remove(parts, "")


def remainder(doc_id: Column, modulus: int) -> Column:
    """CRC-32 of the id as text, modulo ``modulus``; null ids give null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)
