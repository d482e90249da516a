"""What a transaction's ring had done before it: past-only windows by ring.

All windows share one partitioning and order (ring; time, id), so Spark sorts each ring once.  Running
distinct counts flag the first row of each (ring, key) and sum the flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions.numeric import at_least, ratio
from coterie.sources.adapters import AMOUNT, ID, LABEL, TIME

LABEL_LAG_DAYS = 30
FEATURES = (
    "ring_prior_tx ring_prior_amt_sum ring_prior_amt_mean ring_prior_amt_cv ring_prior_clients client_is_new_to_ring "
    "ring_prior_addrs ring_age_days ring_secs_since_prev ring_prior_velocity ring_cards_per_addr_prior "
    "ring_known_prior_frauds ring_known_fraud_rate"
).split()


def ring_window(ring: str = "ring_id"):
    return Window.partitionBy(ring).orderBy(TIME, ID)


def prior(ring: str = "ring_id"):
    return ring_window(ring).rowsBetween(Window.unboundedPreceding, -1)


def inclusive(ring: str = "ring_id"):
    return ring_window(ring).rowsBetween(Window.unboundedPreceding, 0)


def first_of(group: list[str], key: str) -> Column:
    """1 on the first row of each (group, key); a null key is a key."""
    return (F.row_number().over(Window.partitionBy(*group, key).orderBy(TIME, ID)) == 1).cast("int")


def known_frauds(lag_seconds: int, ring: str = "ring_id", strict: bool = False) -> Column:
    """Frauds of the ring reported by now: an as-of lookup written as a range frame.

    With lag 0 the row itself counts; ``strict`` leaves it out.
    """
    frame = Window.partitionBy(ring).orderBy(TIME).rangeBetween(Window.unboundedPreceding, -lag_seconds)
    total = F.coalesce(F.sum(LABEL).over(frame), F.lit(0))
    return total - F.coalesce(F.col(LABEL), F.lit(0)) if strict and lag_seconds == 0 else total


def add_ring_history(df: DataFrame, label_lag_days: float = LABEL_LAG_DAYS, labels: bool = True, ring: str = "ring_id",
                     compat_global_diff: bool = False) -> DataFrame:
    """The history features of ``FEATURES``, and ``ring_first_seen``, which is never one.

    ``compat_global_diff`` takes a client as new when the ring-wise running count rose against the
    previous row of any ring, over one global order; by default newness is by ring.
    """
    if ring not in df.columns:
        raise ValueError(f"no column {ring}: assign rings first")
    amt = F.col(AMOUNT).cast("double")
    d = df.withColumn("_new", first_of([ring], "client_id"))
    if "addr1" in df.columns:
        d = d.withColumn("_new_addr", first_of([ring], "addr1"))
    n = F.row_number().over(ring_window(ring)) - 1
    d = d.withColumns({
        "ring_prior_tx": n,
        "ring_prior_amt_sum": F.coalesce(F.sum(AMOUNT).over(prior(ring)), F.lit(0.0)),
        "_sq": F.coalesce(F.sum(amt * amt).over(prior(ring)), F.lit(0.0)),
        "_cum": F.sum("_new").over(inclusive(ring)),
        "ring_first_seen": F.min(TIME).over(Window.partitionBy(ring)),
        "ring_secs_since_prev": F.col(TIME) - F.lag(TIME).over(ring_window(ring)),
        **({"ring_prior_addrs": F.sum("_new_addr").over(inclusive(ring))} if "addr1" in df.columns else {}),
        **({"ring_known_prior_frauds": known_frauds(int(label_lag_days * 86400), ring)} if labels and LABEL in df.columns else {}),
    })
    if compat_global_diff:
        before = F.lag("_cum").over(Window.orderBy(TIME, ID))
        d = d.withColumn("_new", F.coalesce(F.col("_cum") - before == 1, F.lit(True)).cast("int"))
    d = d.withColumns({
        "client_is_new_to_ring": F.col("_new"),
        "ring_prior_clients": F.col("_cum") - F.col("_new"),
        "ring_prior_amt_mean": ratio("ring_prior_amt_sum", "ring_prior_tx"),
        "ring_age_days": (F.col(TIME) - F.col("ring_first_seen")) / 86400.0,
    })
    addrs = F.col("ring_prior_addrs") if "addr1" in df.columns else F.lit(1)
    spread = F.greatest(ratio("_sq", "ring_prior_tx") - F.col("ring_prior_amt_mean") * F.col("ring_prior_amt_mean"), F.lit(0.0))
    d = d.withColumns({
        "ring_prior_velocity": F.col("ring_prior_tx") / at_least("ring_age_days", 1.0 / 24),
        "ring_cards_per_addr_prior": F.col("ring_prior_clients") / at_least(addrs, 1),
        "ring_prior_amt_cv": F.sqrt(spread) / at_least("ring_prior_amt_mean", 0.01),
        **({"ring_known_fraud_rate": ratio("ring_known_prior_frauds", "ring_prior_tx")} if "ring_known_prior_frauds" in d.columns else {}),
    })
    return d.drop("_new", "_new_addr", "_sq", "_cum")
