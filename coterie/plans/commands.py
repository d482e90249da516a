"""The command line: ``python -m coterie COMMAND ...``, or the same under spark-submit.

Everything of one run lies below ``OUT/TAG``: ``prepared`` (train, test, columns, meta), ``model``,
``report``, ``rings``, ``agent``.  Paths are Spark's, so a shared file system of any kind will do.

    prepare  raw CSV files (--transactions, --identity) or the driver's tables (--data) to features
    train    fit, score the test split, price it, write model and report (--data-tag: another run's features)
    ablate   the honest run, one without label lag, one on whole rings; finished ones are reused
    rings    ring sizes, a client counted once
    agent    facts of the top rings and triage of two sample disputes; no text is generated here
    site     one JSON document out of the reports of all runs (--mirror: a second copy)
    status   what is there
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.operators import disputes, evaluate, rings
from coterie.operators.history import LABEL_LAG_DAYS
from coterie.operators.model import TrainedModel, VBlockReducer, train, without_ring_features
from coterie.operators.split import first_by_time
from coterie.plans.prepare import load_scored, prepare, read_curve, read_json, read_report, save, write_json, write_report
from coterie.sources.adapters import AMOUNT, ID, LABEL, TIME, load_raw, present, tx_events

#: Variants of the ablation: suffix of the tag, and what differs from the honest run.
VARIANTS = {"": {}, "_lag0": {"label_lag_days": 0.0}, "_whole_frame": {"leaky": True}}


def _input(spark: SparkSession, a) -> tuple[DataFrame, tuple[str, ...]]:
    """The transactions and the attributes that link them."""
    if a.data:
        df, attrs = tx_events(spark, a.data), ("k_day",)
    elif a.transactions and a.identity:
        df, attrs = load_raw(spark, a.transactions, a.identity), rings.LINK_ATTRS
    else:
        raise SystemExit("give --data, or --transactions and --identity")
    return (first_by_time(df, a.sample) if a.sample else df), attrs


def run_prepare(spark: SparkSession, a, home: str, **changes) -> None:
    b = argparse.Namespace(**{**vars(a), **changes})
    df, attrs = _input(spark, b)
    done = prepare(df, attrs, b.max_shared_clients, b.max_ring_clients, b.label_lag_days, leaky_whole_frame=b.leaky)
    if a.data:  # a link made of a number and a day is no feature
        done.names = [n for n in done.names if n not in attrs]
    save(done, home + "/prepared", {"args": {k: v for k, v in vars(b).items() if k != "command"}})


def run_train(spark: SparkSession, a, home: str, source: str | None = None) -> None:
    """Model and report of one run; ``source``: the run whose features it takes, its own by default."""
    began, data = time.time(), (source or home) + "/prepared"
    meta = read_json(spark, data + "/meta")
    dropped = set() if a.keep_all_v else set(VBlockReducer.load(spark, data + "/columns").dropped)
    names = [n for n in meta["feature_names"] if n not in dropped]
    if a.no_ring_features:
        names = without_ring_features(names)
    model = train(spark.read.parquet(data + "/train"), names, max_iter=a.rounds)
    model.save(home + "/model")
    write_json(spark, {"names": names, "data": data}, home + "/model/names")
    scored = load_scored(spark, data, model, names)
    rows = scored.select(F.col(ID).alias("id"), F.col(LABEL).alias("y"), "score", F.col(AMOUNT).alias("amt"))
    top = model.importance()
    info = {
        "tag": a.tag, "n_train": meta["n_train"], "n_test": meta["n_test"], "ring_diagnostics": meta["diagnostics"],
        "ring_feature_gain_pct": 100 * sum(g for _, g, _, ring in top[:50] if ring),
        "top_features": [{"feature": n, "gain_pct": 100 * g, "splits": s, "is_ring_feature": r} for n, g, s, r in top[:30]],
        "rounds": model.trees.stages[-1].getNumTrees, "no_ring_features": a.no_ring_features,
    }
    write_report(rows, home + "/report", info=info | {"runtime_seconds": round(time.time() - began, 1)})


def run_ablate(spark: SparkSession, a, out: str) -> DataFrame:
    """One row per variant; a variant with a report is not run again unless forced."""
    rows = []
    for suffix, changes in VARIANTS.items():
        home = f"{out}/{a.tag}{suffix}"
        if a.force or not present(spark, home + "/report/headline"):
            run_prepare(spark, a, home, **changes)
            run_train(spark, a, home)
        head = read_report(spark, home + "/report", "headline")
        rows.append(head.withColumn("variant", F.lit(suffix.strip("_") or "honest")))
    table = rows[0]
    for r in rows[1:]:
        table = table.unionByName(r)
    table.coalesce(1).write.mode("overwrite").json(f"{out}/{a.tag}/ablation")
    return spark.read.json(f"{out}/{a.tag}/ablation")


def run_rings(spark: SparkSession, a, home: str) -> None:
    df, attrs = _input(spark, a)
    done = prepare(df, attrs, a.max_shared_clients, a.max_ring_clients, a.label_lag_days).rows
    # A client counts once, in the ring of its last transaction.
    last = done.groupBy("client_id").agg(F.max_by("ring_id", F.struct(TIME, ID)).alias("ring_id"))
    rings.ring_sizes(last).write.mode("overwrite").json(home + "/rings")


def run_agent(spark: SparkSession, a, home: str, call=None) -> None:
    """Case files of the top rings and triage of two disputes; ``call(system, user, schema)`` writes the texts, if given."""
    made = read_json(spark, home + "/model/names")
    scored = load_scored(spark, made["data"], TrainedModel.load(home + "/model", made["names"]), made["names"])
    have = lambda c, kind: F.col(c) if c in scored.columns else F.lit(None).cast(kind)
    rows = scored.withColumns({"addr1": have("addr1", "double"), "known": F.coalesce(have("ring_known_prior_frauds", "bigint"), F.lit(0))})
    top = rings.top_rings(rows, a.rings)
    attrs = [c for c in ("addr1", "P_emaildomain", "DeviceInfo", "card1") if c in rows.columns]
    shared = rings.shared_map(rings.shared_attributes(rows.join(top.select("ring_id"), "ring_id", "left_semi"), attrs))
    facts = top.join(shared, "ring_id", "left")
    facts = disputes.case_text(facts.withColumn("shared_attributes", F.coalesce("shared_attributes", F.create_map().cast("map<string,array<string>>"))))
    cases = [disputes.write_case_file(r, call) for r in facts.orderBy(F.desc("max_fraud_score"), "ring_id").collect()]  # --rings of them
    write_json(spark, cases, home + "/agent/case_files")
    disputes.triage(disputes.sample_disputes(scored)).write.mode("overwrite").json(home + "/agent/disputes")


def _runs(spark: SparkSession, out: str) -> list[str]:
    """Names of the runs below ``out``."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(top) if s.isDirectory()) if files.exists(top) else []


def run_site(spark: SparkSession, out: str, mirror: str | None = None) -> dict:
    """Metrics, best point and thinned curve of every run that has a report, as one JSON document."""
    page = {}
    for tag in _runs(spark, out):
        report = f"{out}/{tag}/report"
        if present(spark, report + "/headline"):
            tables = {t: read_report(spark, report, t) for t in ("headline", "precision_at_k", "recall_at_fp_budget", "optimal")}
            tables["cost_curve"] = evaluate.thin_curve(read_curve(spark, report)).orderBy("threshold")
            # Tables of a report: one row per metric, budget or threshold.
            page[tag] = {t: [r.asDict() for r in d.collect()] for t, d in tables.items()} | {"info": read_json(spark, report + "/info")}
            if present(spark, f"{out}/{tag}/agent/case_files"):
                page[tag]["case_files"] = read_json(spark, f"{out}/{tag}/agent/case_files")
    for path in [out + "/site", *([mirror] if mirror else [])]:
        write_json(spark, page, path)
    return page


def run_status(spark: SparkSession, out: str) -> dict[str, list[str]]:
    """Which parts each run has; printed as well."""
    parts = ("prepared/train", "prepared/test", "prepared/columns", "model/trees", "report/headline", "rings", "agent/case_files", "ablation")
    have = {tag: [p for p in parts if present(spark, f"{out}/{tag}/{p}")] for tag in _runs(spark, out) if tag != "site"}
    for tag, found in have.items():
        print(tag, *[("+" if p in found else "-") + p for p in parts])
    return have


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="coterie")
    p.add_argument("command", choices=["prepare", "train", "ablate", "rings", "agent", "site", "status"])
    p.add_argument("--out", required=True, help="folder of all runs")
    p.add_argument("--tag", default="main", help="name of the run")
    p.add_argument("--data-tag", help="train: the run whose features are taken")
    p.add_argument("--data", help="folder of the driver's tables")
    p.add_argument("--transactions", help="raw transactions, CSV with a header")
    p.add_argument("--identity", help="raw identities, CSV with a header")
    p.add_argument("--sample", type=int, default=0, help="only the first rows by time, to try things out")
    p.add_argument("--max-shared-clients", type=int, default=rings.MAX_SHARED)
    p.add_argument("--max-ring-clients", type=int, default=rings.MAX_RING)
    p.add_argument("--label-lag-days", type=float, default=LABEL_LAG_DAYS)
    p.add_argument("--leaky", action="store_true", help="aggregates of whole rings, to measure the harm")
    p.add_argument("--rounds", type=int, default=40, help="most boosting rounds")
    p.add_argument("--no-ring-features", action="store_true")
    p.add_argument("--keep-all-v", action="store_true")
    p.add_argument("--force", action="store_true", help="ablate: run finished variants again")
    p.add_argument("--rings", type=int, default=2, help="agent: how many rings")
    p.add_argument("--mirror", help="site: a second folder for the document")
    return p


def cli(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("coterie").getOrCreate()
    out = a.out.rstrip("/")
    home = f"{out}/{a.tag}"
    if a.command == "prepare":
        run_prepare(spark, a, home)
    elif a.command == "train":
        run_train(spark, a, home, f"{out}/{a.data_tag}" if a.data_tag else None)
    elif a.command == "ablate":
        run_ablate(spark, a, out).show(truncate=False)
    elif a.command == "rings":
        run_rings(spark, a, home)
    elif a.command == "agent":
        run_agent(spark, a, home)
    elif a.command == "site":
        run_site(spark, out, a.mirror)
    else:
        run_status(spark, out)
    return 0
