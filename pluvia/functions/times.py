"""Time keys, rounding and lag/lead lists as Column expressions.

All functions keep the input's timestamp type (with or without zone).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key and text formats used by the stored frames and predictions.
KEY_FORMAT = "yyyyMMdd/HHmm"
PREDICTION_KEY_FORMAT = "yyyyMMdd-HHmm"
TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"
LOCAL_ZONE = "America/Sao_Paulo"


def minutes(n: Column | int) -> Column:
    """Day-time interval of ``n`` minutes."""
    n = F.lit(n) if isinstance(n, int) else n.cast("int")
    return F.make_dt_interval(mins=n)


def parse_datetime(text: Column | None = None) -> Column:
    """``YYYY-mm-dd HH:MM:SS`` in UTC, or the current time. A bad text is an error."""
    return F.current_timestamp() if text is None else F.to_timestamp(text, TEXT_FORMAT)


def parse_scan_time(text: Column) -> Column:
    """ISO scan time with fraction and ``Z``."""
    return F.to_timestamp(text)


def floor_minutes(ts: Column, step: int = 10) -> Column:
    """Round down to a multiple of ``step`` minutes within the hour."""
    excess = F.make_dt_interval(
        mins=F.pmod(F.minute(ts), F.lit(step)),
        secs=F.date_part(F.lit("SECOND"), ts).cast("decimal(18,6)"),
    )
    return ts - excess


def floor_hour(ts: Column) -> Column:
    return floor_minutes(ts, 60)


def hour_bounds(end: Column, hours: int) -> dict[str, Column]:
    """Start and end of the last ``hours`` full hours, and the end in local time, as text."""
    stop = floor_hour(end)
    start = stop - minutes(60 * hours)
    local = F.from_utc_timestamp(stop.cast("timestamp"), LOCAL_ZONE)
    return {
        "start": F.date_format(start, TEXT_FORMAT),
        "end": F.date_format(stop, TEXT_FORMAT),
        "end_local": F.date_format(local, TEXT_FORMAT),
    }


def listing_parts(ts: Column) -> dict[str, Column]:
    """Year, day of year and hour: the folder levels of the satellite archive."""
    return {"year": F.year(ts), "doy": F.dayofyear(ts), "hour": F.hour(ts)}


def time_key(ts: Column, fmt: str = KEY_FORMAT) -> Column:
    return F.date_format(ts, fmt)


def parse_time_key(key: Column, fmt: str = KEY_FORMAT) -> Column:
    return F.to_timestamp(key, fmt)


def date_features(ts: Column) -> dict[str, Column]:
    """Month, day, hour and minute as fractions of 12, 31, 24 and 60."""
    return {
        "month_f": F.month(ts) / F.lit(12.0),
        "day_f": F.dayofmonth(ts) / F.lit(31.0),
        "hour_f": F.hour(ts) / F.lit(24.0),
        "minute_f": F.minute(ts) / F.lit(60.0),
    }


def caption_time(ts: Column, shift_hours: int = -3) -> Column:
    """Clock text for captions at a fixed offset from UTC."""
    return F.date_format(ts + minutes(60 * shift_hours), "HH:mm")


def past_times(ts: Column, n: int, step: int = 10) -> Column:
    """``ts, ts-step, ...``: ``n`` times, newest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: ts - minutes(k * step))


def past_times_oldest_first(ts: Column, n: int, step: int = 10) -> Column:
    return F.reverse(past_times(ts, n, step))


def future_times(ts: Column, n: int, step: int = 10, include_first: bool = False) -> Column:
    """``n`` times after ``ts``; ``include_first`` starts the list at ``ts`` itself."""
    first = 0 if include_first else 1
    return F.transform(
        F.sequence(F.lit(first), F.lit(first + n - 1)), lambda k: ts + minutes(k * step)
    )


def prediction_keys(ts: Column, n: int, step: int = 10) -> Column:
    """Stored key ``issue/valid`` of each of the ``n`` forecasts issued at ``ts``."""
    return F.transform(
        future_times(ts, n, step),
        lambda valid: F.concat_ws("/", time_key(ts), time_key(valid, PREDICTION_KEY_FORMAT)),
    )


def target_times(now: Column, hours: int = 6, extra_hours: int = 2, step: int = 10) -> Column:
    """Marks of the last ``hours + extra_hours``, newest first."""
    return past_times(floor_minutes(now, step), 60 * (hours + extra_hours) // step, step)
