"""Temporal splits at exact quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.functions.quantile import exact_quantiles
from coterie.sources.adapters import TIME

TRAIN_FRACTION = 0.80
EMBARGO_SECONDS = 7 * 24 * 3600


def with_cutoff(df: DataFrame, fraction: float) -> DataFrame:
    """``_cut``: the exact quantile of time on every row, from a one-row frame."""
    cut = exact_quantiles(df, TIME, [fraction]).select(F.round(F.col("q")[0], 6).alias("_cut"), F.lit(1).alias("_one"))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(cut), "_one").drop("_one")  # one row


def temporal_split(df: DataFrame, fraction: float = TRAIN_FRACTION, embargo: int = EMBARGO_SECONDS) -> DataFrame:
    """Adds ``split``: train, test, or null for the gap between them."""
    part = F.when(F.col(TIME) <= F.col("_cut") - embargo, "train").when(F.col(TIME) > F.col("_cut"), "test")
    return with_cutoff(df, fraction).withColumn("split", part).drop("_cut")


def valid_split(train: DataFrame, fraction: float = 0.2) -> DataFrame:
    """Adds ``is_valid``: the last part of the training time."""
    return with_cutoff(train, 1 - fraction).withColumn("is_valid", F.col(TIME) > F.col("_cut")).drop("_cut")


def train_test(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    out = temporal_split(df, **options)
    return out.where("split = 'train'").drop("split"), out.where("split = 'test'").drop("split")


def first_by_time(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(TIME, "TransactionID").limit(n)
