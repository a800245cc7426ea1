"""As-of alignment on distinct times.

Only the distinct times of both sides are matched; the wide cell tables then
join by plain equality on the matched time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.functions.times import floor_minutes, minutes
from pluvia.operators.ordering import SLOT_MINUTES


def match_times(
    targets: DataFrame,
    sources: DataFrame,
    target_ts: str = "target_ts",
    source_ts: str = "source_ts",
    by: list[str] | None = None,
    offset_minutes: int = 0,
    tolerance_minutes: int | None = None,
    slot_minutes: int = SLOT_MINUTES,
) -> DataFrame:
    """Latest source time at or before ``target + offset``, one row per target time.

    ``by`` columns must match exactly. ``tolerance_minutes`` limits how old the
    match may be; without it any earlier source time is accepted. Targets with
    no match keep a NULL.

    The time axis is cut into slots. Inside a slot the match is a window over its
    distinct times; the carry-in from earlier slots is a window over one row per slot.
    """
    by = by or []
    shifted = F.col(target_ts) + minutes(offset_minutes) if offset_minutes else F.col(target_ts)
    t = targets.select(*by, target_ts).distinct().withColumn("_at", shifted)
    s = sources.select(*by, source_ts).where(F.col(source_ts).isNotNull()).distinct()

    # Side 0 sorts before side 1 at equal times, so an equal time is a match.
    axis = t.select(*by, target_ts, "_at", F.lit(1).alias("_side")).unionByName(
        s.select(*by, F.col(source_ts).alias("_at"), F.lit(0).alias("_side")),
        allowMissingColumns=True,
    )
    axis = axis.withColumn("_slot", floor_minutes(F.col("_at"), slot_minutes))
    seen = F.when(F.col("_side") == 0, F.col("_at"))
    inside = Window.partitionBy(*by, "_slot").orderBy("_at", "_side").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = axis.withColumn("_hit", F.last(seen, ignorenulls=True).over(inside)).where(
        F.col("_side") == 1
    )
    slots = axis.groupBy(*by, "_slot").agg(F.max(seen).alias("_top"))
    earlier = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carry = slots.select(*by, "_slot", F.max("_top").over(earlier).alias("_carry"))

    joined = local.join(carry, [*by, "_slot"], "left")
    hit: Column = F.coalesce("_hit", "_carry")
    if tolerance_minutes is not None:
        hit = F.when(hit >= F.col("_at") - minutes(tolerance_minutes), hit)
    return joined.select(*by, target_ts, hit.alias(source_ts))


def attach_latest(
    targets: DataFrame,
    sources: DataFrame,
    target_ts: str,
    source_ts: str,
    by: list[str] | None = None,
    offset_minutes: int = 0,
    tolerance_minutes: int | None = None,
) -> DataFrame:
    """Every target row with the time of its latest source (NULL if there is none)."""
    by = by or []
    matched = match_times(
        targets, sources, target_ts, source_ts, by, offset_minutes, tolerance_minutes
    )
    return targets.join(matched, [*by, target_ts], "left")


def first_scan_in_minutes(
    targets: DataFrame,
    scans: DataFrame,
    target_ts: str = "target_ts",
    scan_ts: str = "scan_ts",
    by: list[str] | None = None,
    back: int = 4,
) -> DataFrame:
    """First scan of the target's own minute, else of 1..``back`` minutes earlier.

    Minutes are matched by equality on the ``back + 1`` candidate minutes; the
    nearest minute wins, and the earliest scan inside that minute.
    """
    by = by or []
    t = targets.select(*by, target_ts).distinct()
    wanted = t.select(
        *by, target_ts, F.explode(F.sequence(F.lit(0), F.lit(back))).alias("_back")
    ).withColumn("_minute", F.date_trunc("minute", F.col(target_ts) - minutes(F.col("_back"))))
    per_minute = scans.withColumn("_minute", F.date_trunc("minute", scan_ts)).groupBy(
        *by, "_minute"
    ).agg(F.min(scan_ts).alias(scan_ts))
    found = wanted.join(per_minute, [*by, "_minute"], "inner")
    best = found.groupBy(*by, target_ts).agg(F.min_by(scan_ts, "_back").alias(scan_ts))
    return t.join(best, [*by, target_ts], "left")
