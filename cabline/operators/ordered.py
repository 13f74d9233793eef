"""Order-dependent operators (previous / next row, running sums) without a
single-partition window.

A global ``Window.orderBy`` moves every row to one task. Here the ordered
scan is done in two levels instead:

1. rows are partitioned by the caller's keys plus a time bucket (e.g. the
   hour or month of the order column) and the window runs inside each
   bucket, in parallel;
2. a per-bucket summary (one row per bucket: first / last row, or total)
   carries the value across bucket borders. Only the summary, whose size is
   the number of buckets and not the number of rows, is ordered as a whole
   within the caller's keys.

Results equal those of the plain window over the caller's keys, null keys,
times and values included (nulls sort first, as Spark sorts them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a bucket that one task takes; a bucket with more is cut into seconds.
HOT_ROWS = 1_000_000


def _cols(names) -> list[str]:
    return [names] if isinstance(names, str) else list(names or [])


def join_buckets(df: DataFrame, summary: DataFrame, keys: list[str], bucket: str = "_bk", small: bool = False) -> DataFrame:
    """Left join of a per-bucket summary; a null key or bucket matches a null
    one. A ``small`` summary goes to the rows, which then aren't shuffled."""
    on = [*keys, bucket]
    s = summary.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in summary.columns if c not in on])
    cond = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return df.join(F.broadcast(s) if small else s, cond, "left").drop(*[f"_on_{c}" for c in on])


def _bucket(ts: str, unit: str) -> Column:
    return F.date_trunc(unit, F.col(ts))


def with_buckets(df: DataFrame, ts: str, keys: list[str], unit: str, hot_rows: int | None = None,
                 fine_unit: str = "second") -> DataFrame:
    """Adds ``_bk``, the time bucket of each row.

    Rows are first counted per (keys, bucket) (partial
    aggregation, one row per bucket); a bucket holding more rows is cut into
    ``fine_unit`` buckets. Bucket keys stay monotone in time, so the order and
    the results do not change; only a hot bucket's window work is spread. The hot
    buckets are broadcast: there is at most one per ``hot_rows`` rows. With
    ``hot_rows=None``, for series known to be small, nothing is counted."""
    coarse = _bucket(ts, unit)
    if not hot_rows:
        return df.withColumn("_bk", coarse)
    x = df.withColumn("_coarse", coarse)
    hot = (
        x.groupBy(*keys, "_coarse").agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows).select(*keys, "_coarse", F.lit(True).alias("_hot"))
    )
    x = join_buckets(x, hot, keys, "_coarse", small=True)
    bk = F.when(F.col("_hot"), _bucket(ts, fine_unit)).otherwise(F.col("_coarse"))
    return x.withColumn("_bk", bk).drop("_coarse", "_hot")


def previous_value(
    df: DataFrame,
    ts: str,
    value: str,
    out: str,
    partition_by=None,
    tiebreak=None,
    bucket_unit: str = "hour",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """``lag(value)`` over (partition_by) ordered by (ts, *tiebreak)."""
    keys = _cols(partition_by)
    order = [ts] + _cols(tiebreak)
    x = with_buckets(df, ts, keys, bucket_unit, hot_rows)
    w = Window.partitionBy(*keys, "_bk").orderBy(*order)
    x = x.withColumn("_lag", F.lag(value).over(w)).withColumn("_pos", F.row_number().over(w))
    # last row of every bucket, then the previous non-empty bucket's last row
    last = x.groupBy(*keys, "_bk").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order))["v"].alias("_last"))
    wb = Window.partitionBy(*keys).orderBy("_bk")
    carry = last.withColumn("_carry", F.lag("_last").over(wb)).select(*keys, "_bk", "_carry")
    x = join_buckets(x, carry, keys)
    res = F.when(F.col("_pos") == 1, F.col("_carry")).otherwise(F.col("_lag"))
    return x.withColumn(out, res).drop("_bk", "_lag", "_pos", "_carry")


def next_value(
    df: DataFrame,
    ts: str,
    value: str,
    out: str,
    partition_by=None,
    tiebreak=None,
    bucket_unit: str = "month",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """``lead(value)`` over (partition_by) ordered by (ts, *tiebreak)."""
    keys = _cols(partition_by)
    order = [ts] + _cols(tiebreak)
    x = with_buckets(df, ts, keys, bucket_unit, hot_rows)
    w = Window.partitionBy(*keys, "_bk").orderBy(*order)
    wd = Window.partitionBy(*keys, "_bk").orderBy(*[F.col(c).desc() for c in order])
    x = x.withColumn("_lead", F.lead(value).over(w)).withColumn("_rpos", F.row_number().over(wd))
    first = x.groupBy(*keys, "_bk").agg(F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order))["v"].alias("_first"))
    wb = Window.partitionBy(*keys).orderBy("_bk")
    carry = first.withColumn("_carry", F.lead("_first").over(wb)).select(*keys, "_bk", "_carry")
    x = join_buckets(x, carry, keys)
    res = F.when(F.col("_rpos") == 1, F.col("_carry")).otherwise(F.col("_lead"))
    return x.withColumn(out, res).drop("_bk", "_lead", "_rpos", "_carry")


def running_sum(
    df: DataFrame,
    ts: str,
    value: str,
    out: str,
    partition_by=None,
    tiebreak=None,
    bucket_unit: str = "hour",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Cumulative ``sum(value)`` over (partition_by) ordered by (ts, *tiebreak),
    rows from the first to the current one."""
    keys = _cols(partition_by)
    order = [ts] + _cols(tiebreak)
    x = with_buckets(df, ts, keys, bucket_unit, hot_rows)
    w = Window.partitionBy(*keys, "_bk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("_local", F.sum(value).over(w))
    totals = x.groupBy(*keys, "_bk").agg(F.sum(value).alias("_tot"), F.count(value).alias("_cnt"))
    wb = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumns({
        "_off": F.coalesce(F.sum("_tot").over(wb), F.lit(0)), "_any": F.coalesce(F.sum("_cnt").over(wb), F.lit(0)) > 0
    }).select(*keys, "_bk", "_off", "_any")
    x = join_buckets(x, offsets, keys)
    # like a plain window, null until the first value that is not null
    total = F.when(F.col("_any") | F.col("_local").isNotNull(), F.col("_off") + F.coalesce("_local", F.lit(0)))
    return x.withColumn(out, total).drop("_any","_bk", "_local", "_off")
