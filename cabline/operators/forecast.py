"""Next-hour demand forecast: hourly series, label, features, model.

Training and serving share ``time_features`` (Sunday = 1 on both sides) and
the same meaning of ``trip_count`` (trips in the hour), which fixes the two
train/serve mismatches of the upstream jobs.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cabline.functions.timeparts import message_time, plus_hours, time_features
from cabline.operators.analytics import hourly_counts
from cabline.operators.timeline import micro_batches
from cabline.schema import FORECAST_FEATURES


def hourly_series(processed: DataFrame, ts: str = "tpep_pickup_datetime") -> DataFrame:
    """A3 + P9 + P10: ``pickup_hour, trip_count, hour, day_of_week, is_weekend``."""
    return hourly_counts(processed, ts).withColumns(time_features("pickup_hour"))


def add_label(series: DataFrame, gap: str = "skip") -> DataFrame:
    """W1 + F5: ``future_trip_count``.

    ``gap="skip"``: the count of the next hour that has trips (``lead`` over
    the present hours; the upstream definition). ``gap="grid"``: the count
    of the clock hour right after, so an hour followed by an empty hour gets
    no label. Rows without a label are dropped (F5)."""
    if gap == "skip":
        # one row per hour, 87,000 in ten years: a window over all of it is small at any data size
        out = series.withColumn("future_trip_count", F.lead("trip_count").over(Window.orderBy("pickup_hour")))
    elif gap == "grid":
        nxt = series.select(
            plus_hours("pickup_hour", -1).alias("pickup_hour"), F.col("trip_count").alias("future_trip_count")
        )
        out = series.join(nxt, on="pickup_hour", how="left")
    else:
        raise ValueError(f"unknown gap policy {gap!r}")
    return out.dropna(subset=["future_trip_count"])


def forecast_pipeline(seed: int = 42, num_trees: int = 20, max_depth: int = 5) -> Pipeline:
    """M1 + M2: feature vector and random-forest regression (upstream
    defaults: 20 trees, depth 5), with a fixed seed."""
    assembler = VectorAssembler(inputCols=list(FORECAST_FEATURES), outputCol="features")
    forest = RandomForestRegressor(
        featuresCol="features", labelCol="future_trip_count", seed=seed, numTrees=num_trees, maxDepth=max_depth
    )
    return Pipeline(stages=[assembler, forest])


def fit_forecast(train: DataFrame, **kw) -> PipelineModel:
    """M3: fit on the whole labelled history.

    The estimator passes over its input several times; the labelled series
    (one row per hour, small at any scale) is persisted for the fit so the
    raw trips are aggregated once, not once per pass."""
    data = train.withColumn("future_trip_count", F.col("future_trip_count").cast("double")).persist()
    try:
        return forecast_pipeline(**kw).fit(data)
    finally:
        data.unpersist()


def serving_features(stats: DataFrame, ts: str = "max_pickup_time", count: str = "hour_trip_count") -> DataFrame:
    """One feature row per batch at ``ts + 1 hour``, computed as
    columns (no driver round trip)."""
    nxt = plus_hours(ts, 1)
    return stats.withColumn("_next", nxt).withColumns(time_features("_next")).withColumn(
        "trip_count", F.col(count)
    ).drop("_next")


def score_next_hour(model: PipelineModel | None, features: DataFrame, total_col: str = "trip_count_total",
                    ts: str = "max_pickup_time", keep: tuple[str, ...] = ()) -> DataFrame:
    """M4 + P16 + P17: the real-time message columns, after those in ``keep``.
    The prediction is truncated to a whole count and added to the running
    total; without a model there is none."""
    scored = model.transform(features) if model else features.withColumn("prediction", F.lit(None).cast("double"))
    return scored.select(
        *keep,
        message_time(ts).alias("timestamp"),
        F.col(total_col).cast("bigint").alias("trip_count"),
        message_time(plus_hours(ts, 1)).alias("predicted_timestamp"),
        (F.col("prediction").cast("bigint") + F.col(total_col)).cast("bigint").alias("predicted_trip_count"),
    )


def batch_features(events: DataFrame, ts: str, seconds: int = 900) -> DataFrame:
    """P11 for every event-time batch: ``seq``, the latest time and the
    features one hour later. ``trip_count`` is what the hour has so far, as
    in training and in the live sink. Batches divide the hour, so an hour's
    window has a handful of rows."""
    if 3600 % seconds:
        raise ValueError("seconds must divide an hour")
    b = micro_batches(events, ts, seconds)
    so_far = Window.partitionBy(F.floor(F.col("seq") / 3600)).orderBy("seq")
    b = b.withColumn("hour_trip_count", F.sum("batch_trip_count").over(so_far))
    return serving_features(b).select("seq", "max_pickup_time", *FORECAST_FEATURES)
