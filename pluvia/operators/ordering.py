"""Positions along a long time axis without one global sort task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvia.functions.times import floor_minutes


# Width of a time slot; the distinct times of one slot are ordered in one task.
SLOT_MINUTES = 60
# Indices per stretch of the axis that datasets are looked up by.
STRETCH = 1 << 20


def time_rank(
    df: DataFrame,
    ts: str,
    by: list[str] | None = None,
    out: str = "rank",
    ascending: bool = True,
    slot_minutes: int = SLOT_MINUTES,
) -> DataFrame:
    """0-based position of every row in time order within ``by``.

    ``ts`` must be non-NULL and distinct within ``by`` (frame times are). Rows are
    ranked inside their time slot; slots are offset by a running count over the
    much smaller table of slots, so neither step sorts the whole axis in one task.
    """
    by = by or []
    order = (lambda c: F.col(c).asc()) if ascending else (lambda c: F.col(c).desc())
    slots = df.withColumn("_slot", floor_minutes(F.col(ts), slot_minutes))
    counts = slots.groupBy(*by, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy(order("_slot")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *by, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    within = F.row_number().over(Window.partitionBy(*by, "_slot").orderBy(order(ts)))
    ranked = slots.withColumn("_r", within).join(offsets, [*by, "_slot"], "inner")
    return ranked.select(
        *df.columns, (F.col("_before") + F.col("_r") - 1).cast("long").alias(out)
    )


def nth_last(df: DataFrame, ts: str, n: int = 1) -> DataFrame:
    """The ``n``-th distinct time from the end, as one row (empty if there are fewer).

    A distributed top-k of ``n`` rows, then the smallest of them.
    """
    top = df.select(F.col(ts)).distinct().orderBy(F.col(ts).desc()).limit(n)
    return top.agg(
        F.when(F.count(F.lit(1)) == n, F.min(ts)).alias(ts)
    ).where(F.col(ts).isNotNull())


def keep_last(df: DataFrame, col: str, n: int = 50) -> DataFrame:
    """The ``n`` greatest distinct values, ascending."""
    top = df.select(col).where(F.col(col).isNotNull()).distinct()
    return top.orderBy(F.col(col).desc()).limit(n).orderBy(col)


def dataset_offsets(sizes: DataFrame, dataset: str, n: str) -> DataFrame:
    """Start and end position of every dataset when the datasets are laid end to end.

    One row per dataset; the dataset list is configuration, so it stays small.
    """
    w = Window.orderBy(dataset).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(n).over(w)
    return sizes.select(dataset, (end - F.col(n)).alias("first"), end.alias("end"))


def dataset_of(index: DataFrame, offsets: DataFrame, dataset: str, idx: str = "idx") -> DataFrame:
    """Which dataset each running index falls in, and its position inside it.

    The axis is cut into stretches of ``STRETCH`` indices and every dataset is listed
    under the stretches it touches, so the lookup is an equality join and a comparison.
    """
    stretch = lambda c: F.floor(c / F.lit(STRETCH))
    listed = offsets.where(F.col("end") > F.col("first")).select(
        dataset, "first", "end",
        F.explode(F.sequence(stretch(F.col("first")), stretch(F.col("end") - 1))).alias("_at"),
    )
    hit = index.withColumn("_at", stretch(F.col(idx))).join(listed, "_at", "inner")
    hit = hit.where((F.col(idx) >= F.col("first")) & (F.col(idx) < F.col("end")))
    return hit.select(
        *index.columns, dataset, (F.col(idx) - F.col("first")).alias("local")
    )
