"""Calendar parts, labels and time features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cabline.schema import (
    HOUR_LABEL_FORMAT,
    ISO_SECONDS_PATTERN,
    MESSAGE_TIME_PATTERN,
    MONTH_LABEL_PATTERN,
    WEEKDAY_NAME_PATTERN,
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_calendar(df: DataFrame, ts: str = "tpep_pickup_datetime") -> DataFrame:
    """Year, month, day, hour of a timestamp (session time zone)."""
    t = F.col(ts)
    return df.withColumns(
        {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t)}
    )


def hour_label(hour) -> Column:
    """``HH:00``."""
    return F.format_string(HOUR_LABEL_FORMAT, _c(hour))


def weekday_name(ts) -> Column:
    """Full weekday name."""
    return F.date_format(_c(ts), WEEKDAY_NAME_PATTERN)


def month_label(ts) -> Column:
    """``MM/yyyy`` of a timestamp."""
    return F.date_format(_c(ts), MONTH_LABEL_PATTERN)


def month_label_from_parts(year, month) -> Column:
    """``MM/yyyy`` from integer parts, month zero padded."""
    return F.format_string("%02d/%d", _c(month), _c(year))


def hour_start(ts) -> Column:
    """Truncate to the hour."""
    return F.date_trunc("hour", _c(ts))


def time_features(ts) -> dict[str, Column]:
    """P10 (shared by training and serving, trap 2): hour, day_of_week with
    Sunday = 1, is_weekend for Saturday and Sunday."""
    t = _c(ts)
    return {
        "hour": F.hour(t),
        "day_of_week": F.dayofweek(t),
        "is_weekend": F.dayofweek(t).isin(1, 7).cast("int"),
    }


def serving_features_reference(ts) -> dict[str, Column]:
    """P11 as the upstream live job computes it: ISO weekday (Monday = 1).

    Kept for comparison only; ``time_features`` is used on both sides.
    """
    t = _c(ts)
    iso = F.weekday(t) + 1
    return {"hour": F.hour(t), "day_of_week": iso, "is_weekend": (iso >= 6).cast("int")}


def iso_text(ts) -> Column:
    """ISO-8601 text to the second."""
    return F.date_format(_c(ts), ISO_SECONDS_PATTERN)


def message_time(ts) -> Column:
    """Message time text."""
    return F.date_format(_c(ts), MESSAGE_TIME_PATTERN)


def plus_hours(ts, hours: int = 1) -> Column:
    return _c(ts) + F.make_dt_interval(F.lit(0), F.lit(hours))


def plus_minutes(ts, minutes: int) -> Column:
    return _c(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))


def plus_seconds(ts, seconds) -> Column:
    """``ts`` plus a per-row whole number of seconds, in long microseconds."""
    return F.timestamp_micros(F.unix_micros(_c(ts)) + _c(seconds).cast("long") * F.lit(1_000_000))


def month_picker(text) -> dict[str, Column]:
    """P20: ``yyyy-MM`` text to integer year and month."""
    parts = F.split(_c(text), "-")
    return {"year": parts[0].cast("int"), "month": parts[1].cast("int")}
