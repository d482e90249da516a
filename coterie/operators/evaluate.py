"""Evaluation in money and in review capacity; every metric is one pass and running sums over distinct scores.

Running sums go by ranges of scores: sums within each range, and the sums of the ranges before it, which
are one row per shuffle partition.  No task sees more than its range.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions.numeric import ratio, rounded
from coterie.functions.quantile import exact_quantiles, ranged
from coterie.functions.storage import materialize


@dataclass(frozen=True)
class CostModel:
    """What each cell of the confusion matrix costs, in rupees."""

    chargeback_fee_inr: float = 1500.0
    fraud_loss_rate: float = 1.0
    gross_margin_rate: float = 0.25
    churn_multiplier: float = 2.0
    usd_inr: float = 88.0
    review_cost_inr: float = 0.0

    def to_inr(self, usd: Column) -> Column:
        return usd * self.usd_inr

    def missed(self, inr: Column) -> Column:
        return inr * self.fraud_loss_rate + self.chargeback_fee_inr

    def blocked(self, inr: Column) -> Column:
        return inr * self.gross_margin_rate * self.churn_multiplier

    def to_dict(self) -> dict[str, float]:
        return asdict(self)


def _by_score(df: DataFrame) -> DataFrame:
    """Per distinct score, descending: its positives and rows, both so far, and both in all."""
    g = ranged(df.groupBy("score").agg(F.sum("y").alias("dp"), F.count(F.lit(1)).alias("dn")), F.desc("score"))
    sums = g.groupBy("_range").agg(F.sum("dp").alias("p"), F.sum("dn").alias("n"))  # one row per range from here on
    up = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    offsets = sums.select(
        "_range", F.coalesce(F.sum("p").over(up), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(up), F.lit(0)).alias("n0"),
        F.sum("p").over(every).alias("p_all"), F.sum("n").over(every).alias("n_all"),
    )
    down = Window.partitionBy("_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    out = g.join(F.broadcast(offsets), "_range")
    return out.withColumns({"tp": F.col("p0") + F.sum("dp").over(down), "n": F.col("n0") + F.sum("dn").over(down)}).drop("_range", "p0", "n0")


def headline(df: DataFrame) -> DataFrame:
    """One row of n, prevalence, pr_auc (step-wise average precision), its lift, roc_auc; columns y and score in."""
    s = _by_score(df)
    below = (F.col("p_all") - F.col("tp")) * (F.col("dn") - F.col("dp")) + 0.5 * F.col("dp") * (F.col("dn") - F.col("dp"))
    out = s.agg(
        F.max("n_all").alias("n"), F.max("p_all").alias("p"),
        F.sum(F.col("dp") / F.nullif("p_all", F.lit(0)) * F.col("tp") / F.col("n")).alias("pr_auc"), F.sum(below).alias("bad"),
    )
    neg = F.col("n") - F.col("p")
    return out.select(
        "n", (F.col("p") / F.col("n")).alias("prevalence"), "pr_auc", (F.col("pr_auc") * F.col("n") / F.nullif("p", F.lit(0))).alias("pr_auc_lift_over_baseline"),
        (1 - F.col("bad") / F.nullif(F.col("p") * neg, F.lit(0))).alias("roc_auc"),
    )


def precision_at_k(df: DataFrame, ks=(100, 500, 1000, 5000), id_col: str = "id") -> DataFrame:
    """Hits among the k highest scores (ties by id); k is cut to the number of rows."""
    ks = sorted(ks)
    top = df.orderBy(F.desc("score"), id_col).limit(ks[-1])
    ranked = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))
    total = df.agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    hits = ranked.agg(*[F.sum(F.when(F.col("r") <= k, F.col("y"))).alias(f"h{k}") for k in ks])
    one = hits.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")  # one row each
    rows = F.array(*[F.struct(F.least(F.lit(k), F.col("n")).cast("long").alias("k"), F.col(f"h{k}").alias("frauds_caught")) for k in ks])
    return one.select("pos", F.explode(rows).alias("x")).select(
        "x.k", ratio("x.frauds_caught", "x.k").alias("precision_at_k"), (F.col("x.frauds_caught") / F.nullif("pos", F.lit(0))).alias("recall_at_k"), "x.frauds_caught"
    )


def recall_at_fp_budget(df: DataFrame, budgets=(0.001, 0.005, 0.01, 0.05)) -> DataFrame:
    """For each share of negatives one may flag: the score of the negative at that rank, and what it catches."""
    s = _by_score(df).drop("p_all", "n_all").withColumn("fp", F.col("n") - F.col("tp"))
    total = df.agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    want = total.select("pos", "neg", F.explode(F.array(*[F.lit(float(b)) for b in budgets])).alias("fp_budget"))
    want = want.withColumn("k", F.greatest(F.floor(F.col("fp_budget") * F.col("neg")), F.lit(1)))
    # The threshold is the highest score at which k negatives are flagged: four rows against distinct scores.
    hit = s.join(F.broadcast(want), F.col("fp") >= F.col("k")).groupBy("fp_budget", "pos").agg(F.max(F.struct("score", "tp", "fp")).alias("x"))
    return hit.select(
        "fp_budget", F.col("x.score").alias("threshold"), (F.col("x.tp") / F.nullif("pos", F.lit(0))).alias("recall"),
        ratio("x.tp", F.col("x.tp") + F.col("x.fp")).alias("precision"), F.col("x.fp").alias("false_positives"),
    )


def cost_curve(df: DataFrame, cost: CostModel = CostModel(), n_thresholds: int = 200) -> DataFrame:
    """Every operating point priced: rows go to the greatest threshold at or below their score, then sums from above.

    Work grows with the rows, not with rows times thresholds.  ``df``: y, score, amt (dollars).
    """
    at = exact_quantiles(df, "score", [i / (n_thresholds - 1) for i in range(n_thresholds)])
    cuts = at.select(F.array_sort(F.array_distinct("q")).alias("cuts"), F.lit(1).alias("_one"))
    inr = cost.to_inr(F.col("amt"))
    rows = df.withColumn("_one", F.lit(1)).join(F.broadcast(cuts), "_one")  # one row of thresholds
    below = F.size(F.filter("cuts", lambda t: t <= F.col("score")))
    rows = rows.withColumn("b", below)
    cents = lambda c: F.sum(c.cast("decimal(20,4)"))
    per = rows.groupBy("b").agg(
        F.sum("y").alias("tp"), F.sum(1 - F.col("y")).alias("fp"), cents(F.when(F.col("y") == 1, cost.missed(inr)).otherwise(F.lit(0.0))).alias("caught"),
        cents(F.when(F.col("y") == 0, cost.blocked(inr)).otherwise(F.lit(0.0))).alias("friction"),
    )
    # Sums from the highest threshold down, over one row per threshold.
    down = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(1))
    grid = cuts.select(F.posexplode("cuts").alias("i", "threshold")).select((F.col("i") + 1).alias("b"), "threshold")
    full = grid.join(per, "b", "full").na.fill(0, ["tp", "fp"])
    for c in ("caught", "friction"):
        full = full.withColumn(c, F.coalesce(c, F.lit(0).cast("decimal(20,4)")))
    full = full.withColumns({c + "_all": F.sum(c).over(every) for c in ("tp", "fp", "caught")})
    full = full.withColumns({c: F.sum(c).over(down) for c in ("tp", "fp", "caught", "friction")}).where("threshold is not null")
    n = F.col("tp_all") + F.col("fp_all")
    missed, review = (F.col("caught_all") - F.col("caught")).cast("double"), cost.review_cost_inr * (F.col("tp") + F.col("fp"))
    loss = missed + F.col("friction").cast("double") + review
    return full.select(
        "threshold", ((F.col("tp") + F.col("fp")) / n).alias("flag_rate"), "tp", "fp", (F.col("tp_all") - F.col("tp")).alias("fn"),
        (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"), (F.col("tp") / F.nullif("tp_all", F.lit(0))).alias("recall"),
        F.col("caught").cast("double").alias("loss_avoided_inr"), missed.alias("fraud_loss_inr"), F.col("friction").cast("double").alias("fp_friction_inr"),
        review.alias("review_cost_inr"), loss.alias("total_loss_inr"), (F.col("caught_all").cast("double") - loss).alias("net_saving_inr"),
        F.col("caught_all").cast("double").alias("baseline_loss_inr"),
    )


def optimal_operating_point(curve: DataFrame) -> DataFrame:
    return curve.orderBy(F.desc("net_saving_inr"), "threshold").limit(1)


def thin_curve(curve: DataFrame, keep_below: float = 0.25, every: int = 4) -> DataFrame:
    """The curve for a chart: all points of low flag rate, and every fourth of the rest, rounded."""
    i = F.row_number().over(Window.orderBy("threshold")) - 1
    thin = curve.withColumn("_i", i).where((F.col("flag_rate") <= keep_below) | (F.col("_i") % every == 0)).drop("_i")
    return thin.select(*[rounded(c, 6).alias(c) if t == "double" else F.col(c) for c, t in thin.dtypes])


def summary_report(df: DataFrame, cost: CostModel = CostModel()) -> dict[str, DataFrame | dict]:
    curve = materialize(cost_curve(df, cost))  # a row per threshold, read by several
    return {"headline": headline(df), "precision_at_k": precision_at_k(df), "recall_at_fp_budget": recall_at_fp_budget(df),
            "cost_curve": curve, "optimal": optimal_operating_point(curve), "cost_model": cost.to_dict()}
