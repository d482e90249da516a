"""Null-safe arithmetic.  Spark raises on division by zero, and greatest() skips nulls; these do neither."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a, b, empty=0.0) -> Column:
    """a / b; ``empty`` where b is zero or either is null."""
    return F.coalesce(col(a) / F.nullif(col(b), F.lit(0)), F.lit(empty))


def at_least(c, low) -> Column:
    """Lower clamp that keeps null."""
    return F.when(col(c).isNotNull(), F.greatest(col(c), F.lit(low)))


def money(c) -> Column:
    """Exact to the cent, so that sums do not depend on their order."""
    return col(c).cast("decimal(18,2)")


def rounded(c, digits: int) -> Column:
    """A double rounded as SQL engines do, on the scaled binary number; Spark's round takes the shortest decimal instead."""
    return F.round(col(c) * 10.0**digits, 0) / 10.0**digits


def logit(p) -> Column:
    x = F.least(F.greatest(col(p), F.lit(1e-7)), F.lit(1 - 1e-7))
    return F.ln(x / (1 - x))
