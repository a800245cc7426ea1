"""Incremental state: new rows, high-water marks, latest values, key differences."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.session import join_dimension

# Fixed value: last update assumed for a key that has none.
NEVER = datetime(1900, 1, 1)


def never(df: DataFrame, col: str):
    """The "never updated" time in the type of column ``col``."""
    return F.lit(NEVER).cast(df.schema[col].dataType)


def _typed_state(batch: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    """State reduced to ``columns`` in the batch's types; an absent column is NULL."""
    cols = []
    for c in columns:
        source = F.col(c) if c in state.columns else F.lit(None)
        cols.append(source.cast(batch.schema[c].dataType).alias(c))
    return state.select(*cols)


def new_rows(batch: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    """Batch rows whose ``columns`` are not in the state yet; NULL equals NULL."""
    known = _typed_state(batch, state, columns).distinct().alias("s")
    b = batch.alias("b")
    cond = [F.col(f"b.{c}").eqNullSafe(F.col(f"s.{c}")) for c in columns]
    return b.join(known, cond, "left_anti")


def updated_state(batch: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    """State after the batch: what was there plus the new rows' columns."""
    base = _typed_state(batch, state, columns)
    return base.unionByName(new_rows(batch, state, columns).select(*columns))


def newer_rows(
    batch: DataFrame, state: DataFrame, key: str, ts: str, last: str = "last_update"
) -> DataFrame:
    """Rows strictly newer than their key's high-water mark.

    A key without a mark counts as never updated; rows without a key are dropped.
    There is one mark per key: a list of checked size is copied to the rows, which
    then do not move at all; a longer one is joined with each key spread by time.
    """
    marks = state.groupBy(key).agg(F.max(last).alias(last))
    known = batch.where(F.col(key).isNotNull())
    joined = join_dimension(known, marks, [key], "left", spread=ts)
    mark = F.coalesce(F.col(last), never(batch, ts))
    return joined.withColumn(last, mark).where(F.col(ts) > F.col(last))


def latest_per_key(df: DataFrame, key: str, ts: str, out: str | None = None) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(ts).alias(out or ts))


def advance_marks(
    batch: DataFrame, state: DataFrame, key: str, ts: str, last: str = "last_update"
) -> DataFrame:
    """State after the batch: accepted rows move their key's mark forward.

    A row that is not accepted is no newer than the mark, so the greatest of both is the
    mark after the batch and no join is needed.
    """
    moved = latest_per_key(batch.where(F.col(ts) > never(batch, ts)), key, ts, last)
    moved = moved.select(key, F.col(last).cast(state.schema[last].dataType).alias(last))
    return state.select(key, last).unionByName(moved).groupBy(key).agg(F.max(last).alias(last))


def key_difference(batch: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only, with the side that has them."""
    b = batch.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(True))
    s = state.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_s", F.lit(True))
    both = b.join(s, key, "full_outer")
    side = F.when(F.col("_s").isNull(), "batch_only").when(F.col("_b").isNull(), "state_only")
    return both.select(key, side.alias("side")).where(F.col("side").isNotNull())


def is_fresher(first: DataFrame, second: DataFrame, ts: str = "date") -> DataFrame:
    """One row: whether the second table's date is later; true if either has none."""
    both = first.agg(F.max(ts).alias("_d"), F.lit(1).alias("_n")).unionByName(
        second.agg(F.max(ts).alias("_d"), F.lit(2).alias("_n"))
    )
    d1, d2 = (F.max(F.when(F.col("_n") == n, F.col("_d"))) for n in (1, 2))
    return both.agg(F.coalesce(d1 < d2, F.lit(True)).alias("is_fresher"))


def upsert(state: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """State with changed keys replaced and new keys added."""
    keys = changes.select(*key).distinct()
    cond = [state[k].eqNullSafe(keys[k]) for k in key]
    return state.join(keys, cond, "left_anti").unionByName(changes)
