"""What the corpus operators share: tables, words, Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.functions.ship import ship_package

#: ASCII white space; a word is a run of anything else.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Whole texts go to Python in Arrow batches; keep a batch of long ones within a worker's memory."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def words_of(text: Column) -> Column:
    """Array of the text's words; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` mentions it."""
    return F.transform(F.array(value), body)[0]


def hash32(value: Column) -> Column:
    """An evenly spread 32-bit number that other engines can compute too."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
