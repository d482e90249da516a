"""The command line from raw CSV files to the document of all runs."""

import pytest
from pyspark.sql import functions as F

from coterie.plans.commands import cli, parser, run_agent, run_site, run_status
from coterie.plans.prepare import read_json
from coterie.sources.adapters import declared, load_raw


@pytest.fixture(scope="module")
def raw(planted, tmp_path_factory):
    """The planted rows as two CSV files; a third of them have no identity row."""
    top = "file://" + str(tmp_path_factory.mktemp("raw"))
    v = planted.withColumns({"V1": F.col("TransactionAmt"), "V2": F.col("TransactionAmt") * 2, "V3": F.hash("TransactionID") % 97})
    v.drop("DeviceInfo", "_ring_truth").coalesce(1).write.option("header", True).csv(top + "/transactions")
    side = planted.where("TransactionID % 3 > 0").select("TransactionID", F.lit(-5.0).alias("id-01"), "DeviceInfo")
    side.coalesce(1).write.option("header", True).csv(top + "/identity")
    return top


def test_raw_schema_by_rule_and_left_join(spark, planted, raw):
    assert dict((f.name, f.dataType.simpleString()) for f in declared(spark, raw + "/identity")) == {"TransactionID": "bigint", "id-01": "double", "DeviceInfo": "string"}
    d = load_raw(spark, raw + "/transactions", raw + "/identity")
    kinds = dict(d.dtypes)
    assert kinds["TransactionDT"] == "bigint" and kinds["addr1"] == "double" and kinds["P_emaildomain"] == "string" and "id_01" in kinds
    assert d.count() == planted.count() and d.where("id_01 is null").count() == planted.where("TransactionID % 3 = 0").count()
    with pytest.raises(FileNotFoundError, match="nowhere"):
        load_raw(spark, raw + "/transactions", raw + "/nowhere")


def test_commands_end_to_end(spark, raw):
    out = raw + "/out"
    common = ["--out", out, "--transactions", raw + "/transactions", "--identity", raw + "/identity", "--rounds", "3"]
    assert cli(["prepare", *common]) == 0
    meta = read_json(spark, out + "/main/prepared/meta")
    assert meta["n_train"] > meta["n_test"] > 0 and not {"isFraud", "ring_id", "TransactionDT"} & set(meta["feature_names"])
    assert {r["attr"] for r in meta["diagnostics"]} <= {"card1", "addr1", "P_emaildomain", "R_emaildomain", "DeviceInfo"} and meta["diagnostics"]
    assert cli(["train", *common]) == 0
    made = read_json(spark, out + "/main/model/names")["names"]
    assert "V3" in made and len({"V1", "V2"} & set(made)) == 1  # one of two that say the same
    info = read_json(spark, out + "/main/report/info")
    assert info["ring_feature_gain_pct"] > 0 and any(f["splits"] > 0 for f in info["top_features"])
    assert cli(["train", *common, "--tag", "bare", "--data-tag", "main", "--no-ring-features", "--keep-all-v"]) == 0
    assert not any(n.startswith("ring_") for n in read_json(spark, out + "/bare/model/names")["names"])
    assert read_json(spark, out + "/bare/report/info")["ring_feature_gain_pct"] == 0

    assert cli(["agent", "--out", out, "--rings", "2"]) == 0
    cases = read_json(spark, out + "/main/agent/case_files")
    assert len(cases) == 2 and all(c["facts"].startswith("Ring ") for c in cases)
    assert {r["recommendation"] for r in spark.read.json(out + "/main/agent/disputes").collect()} <= {"contest", "accept", "escalate_to_human"}
    answer = {"headline": "h", "summary": "s", "evidence": "e", "recommended_action": "hold", "confidence": "low", "confidence_rationale": "r", "ring_id": "x"}
    run_agent(spark, parser().parse_args(["agent", "--out", out, "--rings", "1"]), out + "/main", lambda system, user, schema: answer)
    assert read_json(spark, out + "/main/agent/case_files") == [answer]

    page = run_site(spark, out, out + "/mirror")
    assert set(page) == {"main", "bare"} and read_json(spark, out + "/site") == read_json(spark, out + "/mirror")
    assert page["main"]["headline"][0]["n"] == meta["n_test"] and page["main"]["case_files"] == [answer]
    have = run_status(spark, out)
    assert "agent/case_files" in have["main"] and "model/trees" in have["bare"] and "prepared/train" not in have["bare"]


def test_rings_count_a_client_once(spark, tmp_path, monkeypatch):
    from coterie.plans import commands
    from coterie.plans.prepare import Prepared

    rows = spark.createDataFrame([(1, 1, "a", "r"), (2, 2, "a", "r"), (3, 3, "b", "r"), (4, 4, "c", "s"), (5, 5, "c", "q")], "TransactionID bigint, TransactionDT bigint, client_id string, ring_id string")
    monkeypatch.setattr(commands, "_input", lambda spark, a: (rows, ()))
    monkeypatch.setattr(commands, "prepare", lambda *a: Prepared(rows, rows, rows=rows))
    assert cli(["rings", "--out", f"file://{tmp_path}"]) == 0
    want = sorted(map(tuple, commands.rings.ring_sizes(spark.createDataFrame([("a", "r"), ("b", "r"), ("c", "q")], "client_id string, ring_id string")).collect()), key=str)
    got = spark.read.json(f"file://{tmp_path}/main/rings")
    assert sorted(map(tuple, got.select(*commands.rings.ring_sizes(rows.select("client_id", "ring_id")).columns).collect()), key=str) == want


def test_ablation_runs_each_variant_once(spark, tmp_path, monkeypatch):
    from coterie.plans import commands

    asked = []
    monkeypatch.setattr(commands, "run_prepare", lambda spark, a, home, **changes: asked.append((home.rsplit("/", 1)[1], changes)))
    monkeypatch.setattr(commands, "run_train", lambda spark, a, home: spark.createDataFrame([(0.5,)], "pr_auc double").write.mode("overwrite").json(home + "/report/headline"))
    args = ["ablate", "--out", f"file://{tmp_path}", "--data", "unused"]
    assert cli(args) == 0
    want = [("main", {}), ("main_lag0", {"label_lag_days": 0.0}), ("main_whole_frame", {"leaky": True})]
    assert asked == want and {r["variant"] for r in spark.read.json(f"file://{tmp_path}/main/ablation").collect()} == {"honest", "lag0", "whole_frame"}
    assert cli(args) == 0 and asked == want  # what is there is not run again
    assert cli([*args, "--force"]) == 0 and asked == want + want


def test_input_has_to_be_named():
    with pytest.raises(SystemExit, match="--data"):
        cli(["prepare", "--out", "/tmp/x"])
