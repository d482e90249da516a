"""The queries of the corpus operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from coterie.llm import html_text, licenses, mixing, near_dup, packing, quality_model, quality_rules, suffix_dedup, token_counts, vector_search

MODULES = (token_counts, quality_model, near_dup, vector_search, html_text, licenses, mixing, packing, suffix_dedup, quality_rules)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.QUERY: m.query for m in MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.QUERY: m.SQL for m in MODULES if getattr(m, "SQL", None)}
