"""The monthly batch plan: valid trips -> zones -> derived measures ->
outlier bounds -> monthly and route aggregates -> repeatable writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cabline.functions.cleaning import payment_type_name
from cabline.functions.measures import bind, duration_minutes, miles_to_km, speed_kph
from cabline.functions.timeparts import hour_label, month_label, weekday_name
from cabline.operators.analytics import monthly_analytics, route_analytics
from cabline.operators.joins import enrich_zones
from cabline.operators.rules import within_bounds

PICKUP, DROPOFF = "tpep_pickup_datetime", "tpep_dropoff_datetime"


def derive_measures(df: DataFrame) -> DataFrame:
    """P1, P3-P8 on enriched trips: projections, no shuffle. The measures, on
    which the bounds and one another rest, are computed once a row."""
    t = F.col(PICKUP)
    df = df.withColumns({"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t)})
    df = df.withColumns(
        {
            "hour_label": hour_label("hour"),
            "payment_type_name": payment_type_name("payment_type"),
        }
    )
    df = bind(df, {"trip_distance_km": miles_to_km("trip_distance"), "trip_duration_minutes": duration_minutes(PICKUP, DROPOFF)})
    df = bind(df, {"trip_speed_kph": speed_kph("trip_distance_km", "trip_duration_minutes")})
    return df.withColumns(
        {
            "day_of_week": weekday_name(PICKUP),
            "month_label": month_label(PICKUP),
        }
    )


def enrich(valid: DataFrame, zones: DataFrame) -> DataFrame:
    """J1, J2 then derived measures (all columns, before outlier bounds)."""
    return derive_measures(enrich_zones(valid, zones))


def process(valid: DataFrame, zones: DataFrame) -> DataFrame:
    """Processed trips: enriched and within the outlier bounds."""
    return within_bounds(enrich(valid, zones))


def aggregates(processed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return monthly_analytics(processed), route_analytics(processed)
