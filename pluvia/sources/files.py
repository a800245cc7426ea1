"""Raw files: listings, manifests, archives and decoding file bytes into rows."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions.names import dataset_prefix, file_extension, radar_file_time
from pluvia.functions.radar import VARIABLES
from pluvia.functions.times import listing_parts
from pluvia.operators.quality import bounding_box, drop_invalid

# Bands read from each satellite product, and whether its rows carry
# the dataset name.
PRODUCTS = {
    "ABI-L2-MCMIPF": (["CMI_C08", "CMI_C09", "CMI_C10", "CMI_C11"], False),
    "ABI-L2-RRQPEF": (["RRQPE"], False),
    "ABI-L2-DMWF": (["wind_direction", "wind_speed", "temperature", "pressure"], True),
    "ABI-L2-ACHAF": (["HT"], False),
}

# Members of an archive, and their bytes, that go to Spark together.
MEMBERS_AT_ONCE = 10_000
MEMBER_BYTES = 8 << 20

# (path, bytes) -> frames of rows.
Decoder = Callable[[str, bytes], Iterable[pd.DataFrame]]


def product_catalogue(spark: SparkSession) -> DataFrame:
    rows = [(p, bands, named) for p, (bands, named) in PRODUCTS.items()]
    return spark.createDataFrame(rows, "product string, bands array<string>, named boolean")


def with_bands(files: DataFrame, product: str = "product") -> DataFrame:
    """Files with their product's bands; an unknown product is an error."""
    table = F.create_map(
        *[
            x
            for p, (bands, named) in PRODUCTS.items()
            for x in (
                F.lit(p),
                F.struct(F.array(*[F.lit(b) for b in bands]).alias("bands"),
                         F.lit(named).alias("named")),
            )
        ]
    )
    entry = F.element_at(table, F.col(product))
    unknown = F.raise_error(F.concat_ws(" ", F.lit("unsupported product"), F.col(product)))
    checked = F.when(F.col(product).isin(list(PRODUCTS)), entry["bands"]).otherwise(
        unknown.cast("array<string>")
    )
    return files.withColumns({"bands": checked, "named": entry["named"]})


def list_files(
    spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True
) -> DataFrame:
    """Path, size and time of the files below a folder, by path. Contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    files = reader.option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", "length", "modificationTime").orderBy("path")


def by_name(
    files: DataFrame, prefix: str = "", suffix: str = "", path: str = "path"
) -> DataFrame:
    p = F.col(path)
    return files.where(p.startswith(prefix) & p.endswith(suffix)).orderBy(path)


def directories(files: DataFrame, path: str = "path") -> DataFrame:
    """Every folder that is a prefix of some file path, with a trailing slash."""
    parts = F.split(F.col(path), "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")),
    )
    nested = files.where(F.instr(F.col(path), "/") > 0)
    return nested.select(F.explode(prefixes).alias("directory")).distinct().where(
        F.col("directory") != "/"
    ).orderBy("directory")


def hours_needed(times: DataFrame, ts: str = "ts") -> DataFrame:
    """Distinct archive hours of the given times, newest first."""
    cols = [c.alias(n) for n, c in listing_parts(F.col(ts)).items()]
    return times.select(*cols).distinct().orderBy(F.desc("year"), F.desc("doy"), F.desc("hour"))


def files_of_hours(files: DataFrame, hours: DataFrame) -> DataFrame:
    """Files of the listed archive hours (partition columns ``year, doy, hour``)."""
    return files.join(hours, ["year", "doy", "hour"], "left_semi")


def files_of_day(files: DataFrame, products: list[str], year: int, doy: int) -> DataFrame:
    return files.where(
        F.col("product").isin(products) & (F.col("year") == year) & (F.col("doy") == doy)
    )


def not_yet_seen(files: DataFrame, manifest: DataFrame, path: str = "path") -> DataFrame:
    """Files that the manifest does not list."""
    return files.join(manifest.select(path).distinct(), path, "left_anti")


def radar_files(files: DataFrame, first: str, last: str, path: str = "path") -> DataFrame:
    """Raw radar files by the time in their name, both ends included.

    The range is compared as text, like the names sort. ``is_archive`` marks the
    compressed files, the only ones that are fetched.
    """
    stamped = files.withColumn("scan_time", radar_file_time(F.col(path)))
    return stamped.where(F.col("scan_time").between(first, last)).withColumn(
        "is_archive", file_extension(F.col(path)) == "gz"
    )


def union_files(parts: list[DataFrame]) -> DataFrame:
    """Distinct union of file sets."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def decode_files(
    spark: SparkSession,
    folder: str,
    decoder: Decoder,
    schema: str,
    pattern: str = "*",
) -> DataFrame:
    """Rows of every matching file. One file is decoded at a time inside a task.

    ``decoder`` turns one file's bytes into frames of rows with ``schema``; any file
    format fits, since the rest of the library only sees the rows.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "content")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                yield from decoder(path, bytes(content))

    return raw.mapInPandas(run, schema)


def archive_members(path: str, content: bytes) -> Iterator[pd.DataFrame]:
    """Members of one ``.zip`` or ``.gz`` file, some at a time; other files are errors."""
    names: list[str] = []
    held: list[bytes] = []

    def rows() -> pd.DataFrame:
        return pd.DataFrame({"archive": [path] * len(names), "member": names, "bytes": held})

    if path.endswith(".zip"):
        size = 0
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                if info.is_dir():
                    continue
                # A member that outgrows the bound goes alone.
                if names and (len(names) >= MEMBERS_AT_ONCE or size + info.file_size > MEMBER_BYTES):
                    yield rows()
                    names, held, size = [], [], 0
                names.append(info.filename)
                held.append(z.read(info))
                size += info.file_size
        if names:
            yield rows()
    elif path.endswith(".gz"):
        name = path.rsplit("/", 1)[-1][: -len(".gz")]
        yield pd.DataFrame(
            {"archive": [path], "member": [name], "bytes": [gzip.decompress(content)]}
        )
    else:
        raise ValueError(f"not an archive: {path}")


def read_archives(spark: SparkSession, folder: str, pattern: str = "*.{zip,gz}") -> DataFrame:
    return decode_files(
        spark, folder, archive_members, "archive string, member string, bytes binary", pattern
    )


def select_variable(cells: DataFrame, feature: str) -> DataFrame:
    """Cells of one radar variable of decoded volumes (``variable`` holds its dataset name)."""
    if feature not in VARIABLES:
        raise ValueError(f"unknown radar variable {feature}")
    chosen = cells.where(F.col("variable") == VARIABLES[feature])
    return chosen.drop("variable").withColumn("feature", F.lit(feature))


def pixel_rows(
    pixels: DataFrame,
    lat_bounds: tuple[float, float] | None,
    lon_bounds: tuple[float, float] | None,
    values: list[str],
    dataset_name: Column | None = None,
) -> DataFrame:
    """Cleaning of decoded satellite pixels: valid values inside the map bounds."""
    out = bounding_box(drop_invalid(pixels, ["lat", "lon", *values]), lat_bounds, lon_bounds)
    return out if dataset_name is None else out.withColumn("name", dataset_prefix(dataset_name))
