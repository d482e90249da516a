"""Raw transactions to features, split, model and report: the whole path in one place."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from coterie.functions.storage import materialize
from coterie.operators import rings
from coterie.operators.entity import add_time_features, resolve
from coterie.operators.evaluate import CostModel, summary_report
from coterie.operators.history import LABEL_LAG_DAYS, add_ring_history
from coterie.operators.model import VBlockReducer, feature_names
from coterie.operators.split import train_test
from coterie.sources.adapters import ID


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    names: list[str] = field(default_factory=list)
    assigned: DataFrame | None = None
    rows: DataFrame | None = None  # all of them, those between the splits too


def prepare(df: DataFrame, attrs=rings.LINK_ATTRS, max_shared: int = rings.MAX_SHARED, max_ring: int = rings.MAX_RING,
            label_lag_days: float = LABEL_LAG_DAYS, labels: bool = True, leaky_whole_frame: bool = False) -> Prepared:
    """Features first, split after: features only look back, so a test row may use the test period's past.

    ``leaky_whole_frame`` takes aggregates of whole rings instead, to measure how much that flatters.
    """
    df = add_time_features(df)
    if "client_id" not in df.columns:
        df = resolve(df)
    assigned = rings.assign_rings_causally(df, attrs, max_shared, max_ring)
    df = df.drop("ring_id").join(assigned.select(ID, "ring_id"), ID, "left")
    if leaky_whole_frame:
        df = rings.leaky_labels(df.join(rings.ring_features(df), "ring_id", "left"))
    else:
        df = add_ring_history(df, label_lag_days, labels)
    train, test = train_test(df)
    return Prepared(train, test, feature_names(train), assigned, df)


def save(prepared: Prepared, path: str, info: dict | None = None) -> None:
    """Parquet by split, with the columns that travel along, the choice of V columns, and a JSON line of metadata.

    The choice is made on the training rows.  Metadata: feature names, rows per split, ring diagnostics, ``info``.
    """
    carried = [c for c in ("isFraud", "TransactionDT", "TransactionAmt", "ring_id", "client_id", ID) if c in prepared.train.columns]
    keep = [*prepared.names, *[c for c in carried if c not in prepared.names]]
    prepared.train.select(*keep).write.mode("overwrite").parquet(path + "/train")
    prepared.test.select(*keep).write.mode("overwrite").parquet(path + "/test")
    spark = prepared.train.sparkSession
    train, test = (spark.read.parquet(f"{path}/{s}") for s in ("train", "test"))
    VBlockReducer().fit(train).save(spark, path + "/columns")
    rows = [] if prepared.assigned is None else rings.causal_diagnostics(prepared.assigned).collect()  # one row per attribute
    meta = {"feature_names": prepared.names, "n_train": train.count(), "n_test": test.count(), "diagnostics": [r.asDict() for r in rows], **(info or {})}
    write_json(spark, meta, path + "/meta")


def write_json(spark, value, path: str) -> None:
    """A small value as one JSON line."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark, path: str):
    return json.loads(spark.read.text(path).first()["value"])


def write_report(scored: DataFrame, path: str, cost: CostModel = CostModel(), info: dict | None = None) -> None:
    """Metric tables as JSON lines and the cost curve as CSV, each in its folder; ``scored``: id, y, score, amt."""
    spark = scored.sparkSession
    parts = summary_report(materialize(scored), cost)  # every table reads it; rows are scored once
    write_json(spark, {"cost_model": parts.pop("cost_model"), **(info or {})}, path + "/info")
    for name, table in parts.items():
        table.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")
    parts["cost_curve"].coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/cost_curve_csv")


def read_report(spark, path: str, name: str) -> DataFrame | None:
    """One table of a report, or None if it is not there."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.json(f"{path}/{name}")
    except AnalysisException:
        return None


def read_curve(spark, path: str) -> DataFrame:
    """The cost curve of a report from its CSV; the columns are declared, not inferred."""
    whole = ("tp", "fp", "fn")
    names = ("threshold flag_rate tp fp fn precision recall loss_avoided_inr fraud_loss_inr fp_friction_inr review_cost_inr "
             "total_loss_inr net_saving_inr baseline_loss_inr").split()
    schema = ", ".join(f"{n} {'bigint' if n in whole else 'double'}" for n in names)
    return spark.read.schema(schema).option("header", True).csv(f"{path}/cost_curve_csv")


def load_scored(spark, path: str, model, names: list[str]) -> DataFrame:
    """The test split with scores; only the columns needed are read."""
    extra = [c for c in ("isFraud", "TransactionDT", "TransactionAmt", "ring_id", "client_id", ID) if c not in names]
    return model.predict(spark.read.parquet(path + "/test").select(*names, *extra))


def ablation(df: DataFrame, run, lags=(LABEL_LAG_DAYS, 0)) -> list[dict]:
    """``run(prepared) -> dict`` for each label lag and for the whole-frame variant."""
    out = [{"variant": f"lag_{lag}", **run(prepare(df, label_lag_days=lag))} for lag in lags]
    return [*out, {"variant": "whole_frame", **run(prepare(df, leaky_whole_frame=True))}]
