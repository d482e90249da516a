"""A training corpus from raw documents, in stages that each write what they keep.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.  Each
stage's result is written as Parquet and read again as the next one's documents.  All but the last
keep the columns of documents.

A stage begins by deleting what the stage before it left in the scratch folder: by then that stage's
result is written, so nothing reads it any more.  The disk needed is that of the largest stage, not of
all.  (A result that has not been written yet cannot be read after another stage was called.)

Null or empty texts fail the quality rules; a null id is the last of its group and stays a row; a null
source is a source; repeated rows are near copies of each other; texts of any length are taken whole;
an empty table gives empty results; further columns travel along, whatever their names.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.functions.storage import drop_path, free_shuffles, materialize, release, scratch_paths
from coterie.llm import mixing, near_dup, packing, quality_rules, suffix_dedup


_LEFT: set[str] = set()


def stage(f):
    """A stage that starts from a scratch folder without the former stage's files."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for path in _LEFT & scratch_paths():
            drop_path(spark, path)
        free_shuffles(spark)
        before = scratch_paths()
        out = f(spark, docs, sf_dir)
        _LEFT.clear()
        _LEFT.update(scratch_paths() - before)
        return out

    return run


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their host's verdict let pass."""
    return quality_rules.keep_good(docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return near_dup.keep_one_of_each(docs)


@stage
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of strings of 200 bytes; n_chars follows the text."""
    out = suffix_dedup.remove_repeats(docs)
    if "n_chars" not in out.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mix(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack_digest(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_copies),
    ("suffix_array_dedup", repeated_strings),
    ("mix_sources", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, f) in enumerate(STAGES[:-1]):
        after = materialize(f(spark, docs, sf_dir))
        if i:
            release(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)


#: Suffix order, connected components and a tokenizer's merges are beyond SQL; tests/llm has brute-force versions.
ORACLE_SQL = None
