"""Exact quantiles without a task that holds all distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions.storage import materialize


def ranged(df: DataFrame, order: Column) -> DataFrame:
    """The rows dealt by ranges of ``order``, with the range's number, written so that the numbers stay."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, order).withColumn("_range", F.spark_partition_id()))


def exact_quantiles(df: DataFrame, column: str, fractions: list[float]) -> DataFrame:
    """One row, ``q``: the interpolated quantiles of a number column in the order given; null if it has no values.

    Distinct values with their counts are dealt by range; the ranges' totals are one row each and give the
    rank each value begins at, so that only the values at the ranks asked for leave their range.
    """
    per = ranged(df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")), F.asc("v"))
    up, every = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    totals = per.groupBy("_range").agg(F.sum("n").alias("s")).select(
        "_range", F.coalesce(F.sum("s").over(up), F.lit(0)).alias("before"), F.sum("s").over(every).alias("total")
    )
    inside = Window.partitionBy("_range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranks = per.join(F.broadcast(totals), "_range").withColumn("end", F.col("before") + F.sum("n").over(inside))  # one row per range
    places = [(i, F.lit(float(f)) * (F.col("total") - 1)) for i, f in enumerate(fractions)]
    asked = F.array(*[F.struct(F.lit(i).alias("i"), p.alias("at"), side(p).cast("long").alias("k")) for i, p in places for side in (F.floor, F.ceil)])
    begin = F.col("end") - F.col("n")
    hits = ranks.select("v", F.explode(F.filter(asked, lambda x: (x["k"] >= begin) & (x["k"] < F.col("end")))).alias("x")).select("v", "x.*")
    low, high = F.min_by("v", "k"), F.max_by("v", "k")
    one = hits.groupBy("i").agg(low.alias("low"), high.alias("high"), (F.max("at") - F.min("k")).alias("part"), (F.max("k") == F.min("k")).alias("met"))
    # As quantile_cont weighs them, to the last bit: one product is not rounded before the sum.  Rows equal to a
    # threshold fall on its other side otherwise.  (reflect gives a string that holds every bit.)
    mix = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), F.col("low"), 1 - F.col("part"), F.col("high") * F.col("part")).cast("double")
    one = one.select("i", F.when(F.col("met"), F.col("low")).otherwise(mix).alias("q"))
    done = one.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q"))  # one entry per fraction
    return done.select(F.when(F.size("q") > 0, F.col("q")).alias("q"))
