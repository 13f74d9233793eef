"""Column cleaning: defaults, tolerant parsing, non-finite values, codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from cabline.schema import PAYMENT_TYPE_NAMES, PAYMENT_TYPE_OTHER, TRIP_DEFAULTS


def fill_defaults(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Fill nulls of the listed columns (only those present)."""
    d = {k: v for k, v in (defaults or TRIP_DEFAULTS).items() if k in df.columns}
    return df.fillna(d) if d else df


def parse_ts(df: DataFrame, column: str, fmt: str | None = None, drop_null: bool = True) -> DataFrame:
    """Tolerant timestamp parse; rows whose value does not parse are dropped."""
    c = F.col(column)
    parsed = F.try_to_timestamp(c.cast("string"), F.lit(fmt)) if fmt else F.try_to_timestamp(c.cast("string"))
    out = df.withColumn(column, parsed)
    return out.dropna(subset=[column]) if drop_null else out


def null_non_finite(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN, +Inf and -Inf become null in floating columns."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    targets = [c for c in (columns or df.columns) if c in floating]
    if not targets:
        return df
    inf = F.lit(float("inf"))
    return df.withColumns(
        {c: F.when(F.isnan(c) | (F.abs(F.col(c)) == inf), F.lit(None)).otherwise(F.col(c)) for c in targets}
    )


def decode_code(c, mapping: dict, default: str) -> Column:
    """Code -> name through a chain of ``when``; unmatched and null give ``default``."""
    col = F.col(c) if isinstance(c, str) else c
    expr = None
    for code, name in mapping.items():
        expr = F.when(col == F.lit(code), F.lit(name)) if expr is None else expr.when(col == F.lit(code), F.lit(name))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def payment_type_name(c="payment_type") -> Column:
    return decode_code(c, PAYMENT_TYPE_NAMES, PAYMENT_TYPE_OTHER)
