"""Time parts and client keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.sources.adapters import TIME

#: Columns of the client fingerprint, in order; those a frame lacks are left out.
CLIENT_KEYS = ("card1", "card2", "card3", "card5", "addr1", "addr2")


def add_time_features(df: DataFrame) -> DataFrame:
    """Day, hour and weekday of whole seconds; floors, also before the epoch."""
    day, hour = F.floor(F.col(TIME) / 86400), F.floor(F.col(TIME) / 3600)
    return df.withColumns({"_day": day.cast("int"), "_hour": F.pmod(hour, F.lit(24)).cast("byte"), "_dow": F.pmod(day, F.lit(7)).cast("byte")})


def add_card_anchor(df: DataFrame) -> DataFrame:
    """The day a card began: the row's day less D1; null where D1 is."""
    if "D1" not in df.columns:
        return df.withColumn("_card_anchor", F.lit(None).cast("long"))
    return df.withColumn("_card_anchor", (F.floor(F.col(TIME) / 86400) - F.col("D1")).cast("long"))


def build_client_id(df: DataFrame) -> DataFrame:
    """The client key: fingerprint columns and anchor, joined; null is ``na``."""
    parts = [c for c in CLIENT_KEYS if c in df.columns] + ["_card_anchor"]
    return df.withColumn("client_id", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("na")) for c in parts]))


def resolve(df: DataFrame) -> DataFrame:
    return df.transform(add_card_anchor).transform(build_client_id)
