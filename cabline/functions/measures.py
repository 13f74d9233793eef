"""Derived trip measures (distance, duration, speed) and rounding.

All are built-in column expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cabline.schema import MILES_TO_KM


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c, places: int = 2) -> Column:
    """Round half up (away from zero) on the value fixed to 8 decimals.

    One rule for any magnitude: below 1e10 the decimal fits a long, which is
    fast in generated code; beyond, the wide decimal gives the same digits;
    from 1e30 on, where that ends, a double has no decimals left to round.
    A value clear of a tie needs no decimal: a thousandth of a unit is far more
    than what the 8 decimals and the double's own error move, and the whole
    number over a power of ten is the double that the decimal gives.
    It does not make a sum of doubles exact; ``exact_sum`` does."""
    v = _c(c)
    long, wide = (F.round(v.try_cast(t), places).cast("double") for t in ("decimal(18,8)", "decimal(38,8)"))
    x, unit = v.cast("double"), F.lit(float(10**places))
    up = F.abs(x) * unit + F.lit(0.5)
    whole = F.floor(up)
    clear = (F.abs(x) < F.lit(1e9)) & (up - whole).between(0.001, 0.999)
    near = F.when(x < 0, -whole).otherwise(whole).cast("double") / unit
    return F.when(clear, near).otherwise(F.coalesce(long, wide, x))


def bind(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose values are computed once a row. A projection's
    columns are put into every filter and column that uses them, so a chain of
    measures is computed many times over; what a generator gives isn't."""
    new = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, new)


def exact_sum(c) -> Column:
    """Sum of the values fixed to 8 decimals: the same in any row order."""
    return F.sum(_c(c).cast("decimal(28,8)"))


def miles_to_km(c, places: int = 2) -> Column:
    return round_half_up(_c(c) * F.lit(MILES_TO_KM), places)


def duration_minutes(start, end, places: int = 2) -> Column:
    """Whole-second difference in minutes, rounded."""
    secs = F.unix_timestamp(_c(end)) - F.unix_timestamp(_c(start))
    return round_half_up(secs / F.lit(60), places)


def speed_kph(distance_km, duration_min, places: int = 2) -> Column:
    """Speed from the already rounded distance and duration.

    ``try_divide`` gives null on zero duration instead of failing under ANSI.
    """
    return round_half_up(F.try_divide(_c(distance_km), _c(duration_min) / F.lit(60)), places)
