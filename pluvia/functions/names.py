"""State keys, file names and JSON state as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def state_key(
    dataset: Column, table: Column, name: Column | None = None, dev: bool = False
) -> Column:
    """``[dev.]dataset.table[.name]``; a NULL or empty name is left out."""
    parts = [F.lit("dev")] if dev else []
    parts += [dataset, table]
    if name is not None:
        parts.append(F.nullif(name, F.lit("")))
    return F.concat_ws(".", *parts)


def dataset_prefix(name: Column) -> Column:
    """First two ``_`` separated tokens of a dataset name."""
    return F.substring_index(name, "_", 2)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """Base name up to its first dot."""
    return F.substring_index(base_name(path), ".", 1)


def file_extension(path: Column) -> Column:
    """Text after the last dot of the base name, or empty."""
    return F.regexp_extract(base_name(path), r"\.([^.]*)$", 1)


def composite_name(process: Column, feature: Column, ts: Column) -> Column:
    """File name of a radar composite: ``MDN-<process>-<feature>-<date>-<time>``."""
    return F.concat_ws(
        "-",
        F.lit("MDN"),
        process,
        feature,
        F.date_format(ts, "yyyyMMdd"),
        F.date_format(ts, "HHmmss"),
    )


def parse_composite_name(name: Column) -> dict[str, Column]:
    """Fields of a composite file name; empty text where the name does not match."""
    pattern = r"^MDN-([^-]+)-([^-]+)-(\d{8})-(\d{4,6})"
    fields = ["process", "feature", "date", "time"]
    return {f: F.regexp_extract(name, pattern, k + 1) for k, f in enumerate(fields)}


def radar_file_time(name: Column) -> Column:
    """Scan time inside a raw radar file name (``...MDN.<time>.PVOL...``)."""
    return F.regexp_extract(name, r"MDN\.([^ ]*)\.PVOL", 1)


def encode_state(*cols: Column | str) -> Column:
    return F.to_json(F.struct(*cols))


def decode_state(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)
