"""The ingest plan shared by batch and streaming: decode -> calendar parts ->
defaults -> (valid, error). Pure projections and filters: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cabline.functions.cleaning import fill_defaults, null_non_finite
from cabline.functions.timeparts import with_calendar
from cabline.operators.rules import split_valid

PICKUP = "tpep_pickup_datetime"


def prepare(df: DataFrame) -> DataFrame:
    """P15 + P1 + P2: values that aren't finite are null, as at the source, so the rules see them."""
    return fill_defaults(with_calendar(null_non_finite(df), PICKUP))


def split(df: DataFrame, null_policy: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """prepare, then F1/F2."""
    return split_valid(prepare(df), null_policy=null_policy)
