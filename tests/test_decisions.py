"""Evaluation properties, calibration, triage rules and the draft's safety."""

import random

import pytest
from pyspark.sql import functions as F

from coterie.operators import disputes, evaluate, model
from coterie.operators.split import temporal_split


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(0)
    rows = []
    for i in range(4000):
        y = int(rng.random() < 0.05)
        rows.append((i, y, min(1.0, max(0.0, rng.gauss(0.2, 0.15) + y * rng.gauss(0.45, 0.2))), rng.lognormvariate(4.2, 1)))
    return spark.createDataFrame(rows, "id bigint, y int, score double, amt double").cache()


def test_metrics_order(scored):
    h = evaluate.headline(scored).collect()[0]
    assert h["roc_auc"] > h["pr_auc"] > h["prevalence"]
    p = [r["frauds_caught"] for r in evaluate.precision_at_k(scored).orderBy("k").collect()]
    assert p == sorted(p)
    r = [x["recall"] for x in evaluate.recall_at_fp_budget(scored).orderBy("fp_budget").collect()]
    assert r == sorted(r)


def test_optimum_is_inside_and_dearer_blocks_flag_fewer(scored):
    best = [evaluate.optimal_operating_point(evaluate.cost_curve(scored, evaluate.CostModel(churn_multiplier=m))).collect()[0] for m in (2.0, 25.0)]
    assert 0 < best[0]["flag_rate"] < 1 and best[1]["flag_rate"] <= best[0]["flag_rate"]
    assert best[0]["net_saving_inr"] > 0


def test_report_round_trip(spark, scored, tmp_path):
    from coterie.plans.prepare import read_report, write_report

    write_report(scored, f"file://{tmp_path}/r", info={"variant": "x"})
    assert read_report(spark, f"file://{tmp_path}/r", "headline").count() == 1
    assert read_report(spark, f"file://{tmp_path}/r", "precision_at_k").count() == 4
    assert read_report(spark, f"file://{tmp_path}/r", "missing") is None
    from coterie.plans.prepare import read_curve

    back = read_curve(spark, f"file://{tmp_path}/r").orderBy("threshold").collect()
    assert back == evaluate.cost_curve(scored).orderBy("threshold").collect()


def test_average_precision_by_hand(spark):
    d = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.7), (1, 0.1)], "y int, score double")
    h = evaluate.headline(d).collect()[0]
    assert h["pr_auc"] == pytest.approx((1 + 2 / 4 + 3 / 5) / 3)
    # Positives .9, .7, .1 against negatives .8, .7: 2 + .5 + 0 + 0 wins and one tie at .7.
    assert h["roc_auc"] == pytest.approx((2 + 0.5) / 6)


def test_embargo(spark):
    d = spark.range(0, 100).select(F.col("id").alias("TransactionID"), (F.col("id") * 86400).alias("TransactionDT"))
    s = {r["split"]: (r["a"], r["b"]) for r in temporal_split(d).groupBy("split").agg(F.min("TransactionID").alias("a"), F.max("TransactionID").alias("b")).collect()}
    assert s["train"][1] + 7 < s["test"][0]


def test_platt_refuses_inverted(spark):
    rng = random.Random(1)
    rows = [(int(rng.random() < 0.2),) for _ in range(500)]
    d = spark.createDataFrame([(y, 1 - (0.6 * y + 0.3 * rng.random())) for y, in rows], "isFraud int, raw_score double")
    with pytest.raises(ValueError):
        model.fit_platt(d)


def test_v_reducer_drops_correlated_and_constant(spark, tmp_path):
    rows = [(i, i, float(i), float(2 * i + 1), float(i * 7 % 11), 1.0) for i in range(60)]
    d = spark.createDataFrame(rows, "TransactionID bigint, TransactionDT bigint, V1 double, V2 double, V3 double, V4 double")
    r = model.VBlockReducer().fit(d)
    r.save(spark, f"file://{tmp_path}/v")
    r = model.VBlockReducer.load(spark, f"file://{tmp_path}/v")
    assert r.kept == ["V1", "V3"] and set(r.transform(d).columns) == {"TransactionID", "TransactionDT", "V1", "V3"}


EVIDENCE = "array<struct<document_id:string,slot:string,description:string,strength:string>>"
STRONG = [("d1", "shipping_proof", "", "strong"), ("d2", "customer_communication", "", "strong")]


def decide(spark, **change):
    base = dict(id=1, amount_inr=40000.0, reason_code="4855", respond_by_days=7, fraud_score=0.1, ring_known_frauds=None, customer_prior_disputes=0, evidence=STRONG) | change
    schema = f"id bigint, amount_inr double, reason_code string, respond_by_days int, fraud_score double, ring_known_frauds int, customer_prior_disputes int, evidence {EVIDENCE}"
    return disputes.triage(spark.createDataFrame([tuple(base.values())], schema)).collect()[0]


def test_triage_rules(spark):
    assert decide(spark)["recommendation"] == "contest"
    assert decide(spark, fraud_score=0.9)["recommendation"] == "accept"
    assert decide(spark, evidence=[])["recommendation"] == "accept"
    assert decide(spark, evidence=None)["recommendation"] == "accept"
    assert decide(spark, evidence=[("x", "no_such_slot", "", "strong")])["recommendation"] == "accept"
    assert decide(spark, respond_by_days=1)["recommendation"] == "escalate_to_human"
    assert decide(spark, amount_inr=300.0)["recommendation"] == "accept"
    assert decide(spark, ring_known_frauds=2)["p_win"] < decide(spark)["p_win"] < decide(spark, customer_prior_disputes=3)["p_win"]
    assert all(0 <= decide(spark, fraud_score=s)["p_win"] <= 0.62 for s in (0.0, 0.5, 1.0))
    assert decide(spark)["rationale"] and decide(spark)["evidence_missing"] == ["billing_proof"]


def test_draft_keeps_only_documents_on_file(spark):
    row = decide(spark)
    body, note = disputes.draft_contest(row, lambda r: ("s" * 2000, [("shipping_proof", ["d1", "d1", "ghost"]), ("bad", ["d2"])], "n"))
    assert body["action"] == "draft" and body["shipping_proof"] == ["d1"] and len(body["summary"]) == 1000 and "ghost" in note and "d2" in note
    body, _ = disputes.draft_contest(decide(spark, fraud_score=0.9), None)
    assert body["summary"] == ""


def test_case_files_and_answers():
    facts = {"ring_id": "r", "case_text": "Ring r"}
    assert disputes.write_case_file(facts) == {"ring_id": "r", "facts": "Ring r"}
    good = dict.fromkeys(disputes.CASE_FIELDS, "x") | {"recommended_action": "hold", "confidence": "low"}
    assert disputes.write_case_file(facts, lambda *a: good) == good
    for bad in (5, "[1]", {}, good | {"recommended_action": "burn"}):
        with pytest.raises(ValueError):
            disputes.write_case_file(facts, lambda *a: bad)


def test_sample_disputes_and_prompts(spark):
    d = spark.createDataFrame([(i, float(i), (i * 7 % 100) / 100) for i in range(1, 101)], "TransactionID bigint, TransactionAmt double, score double")
    got = {r["reason_code"]: r for r in disputes.triage(disputes.sample_disputes(d)).collect()}
    assert {c: r["id"] for c, r in got.items()} == {"4855": "disp_100", "4837": "disp_99"}
    text = disputes.dispute_text(got["4855"].asDict()) + disputes.inventory_text(got["4855"]["evidence"])
    assert "disp_100" in text and "sample-terms" in text and disputes.inventory_text([]) == "no documents on file"


def test_text_of_many_levels_trains(spark):
    rng = random.Random(2)
    rows = [(i, i * 1000, f"d{rng.randrange(200)}", float(i % 7)) for i in range(600)]
    d = spark.createDataFrame([(*r, int(r[2] < "d15")) for r in rows], "TransactionID bigint, TransactionDT bigint, DeviceInfo string, x double, isFraud int")
    m = model.train(d, ["DeviceInfo", "x"], calibrate=False, max_iter=2)
    new = spark.createDataFrame([(1, 1, "never seen", 1.0)], "TransactionID bigint, TransactionDT bigint, DeviceInfo string, x double")
    assert m.predict(new).count() == 1


def test_rank_mismatches(spark):
    d = spark.createDataFrame([(float(i), float(i if i != 50 else 10)) for i in range(100)], "raw_score double, score double")
    assert model.rank_mismatches(d).collect()[0][0] == 1


def test_strict_schema():
    s = disputes.strict_schema({"type": "object", "properties": {"a": {"type": "object", "properties": {"b": {"type": "string", "default": ""}}}}})
    assert s["required"] == ["a"] and s["properties"]["a"]["additionalProperties"] is False and s["properties"]["a"]["required"] == ["b"]


def test_end_to_end_model(spark, planted):
    from coterie.plans.prepare import prepare

    p = prepare(planted, ("addr1", "P_emaildomain"))
    names = [n for n in p.names if n in ("TransactionAmt", "ring_prior_clients", "ring_prior_velocity", "ring_known_prior_frauds", "P_emaildomain")]
    assert not {"isFraud", "TransactionDT", "ring_id", "client_id", "ring_first_seen"} & set(p.names)
    d = p.train.unionByName(p.test)
    m = model.train(d, names, calibrate=False, max_iter=5)
    s = m.predict(d).select(F.col("isFraud").alias("y"), "score")
    h = evaluate.headline(s).collect()[0]
    assert h["pr_auc"] > h["prevalence"] and any(r for _, g, n, r in m.importance() if g > 0 and n > 0)


def test_exact_quantiles_equal_percentile(spark):
    import random

    from coterie.functions.quantile import exact_quantiles

    rng, fractions = random.Random(5), [0.0, 0.001, 0.25, 0.5, 0.803, 0.999, 1.0, 0.5]
    many = [(rng.choice([1.0, 2.0, 2.0, rng.random() * 5]),) for _ in range(4001)] + [(None,)] * 50
    for rows in (many, [(3.0,)], [(1.0,), (2.0,)], [(7.0,)] * 900):
        d = spark.createDataFrame(rows, "x double")
        want = d.agg(F.percentile("x", F.array(*[F.lit(f) for f in fractions])).alias("q")).collect()[0]["q"]
        got = exact_quantiles(d, "x", fractions).collect()[0]["q"]
        assert len(got) == len(want) and all(abs(a - b) < 1e-9 for a, b in zip(got, want))
    assert exact_quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]).collect()[0]["q"] is None


def test_exact_quantiles_equal_the_sql_bit_for_bit(spark):
    import duckdb

    from coterie.functions.quantile import exact_quantiles

    at = [i / 199 for i in range(200)]
    listed = ", ".join(f"{f!r}::DOUBLE" for f in at)
    for n, m in ((1000, 10007), (4444, 97)):
        got = exact_quantiles(spark.range(n).select((F.pmod(F.col("id") * 7919, F.lit(m)) / F.lit(float(m))).alias("x")), "x", at).collect()[0]["q"]
        assert got == duckdb.sql(f"SELECT quantile_cont(range * 7919 % {m} / {m}.0::DOUBLE, [{listed}]) FROM range({n})").fetchall()[0][0]


def test_halves_round_as_in_the_sql(spark):
    import duckdb

    from coterie.functions.numeric import rounded

    got = [r[0] for r in spark.range(1, 40_000, 2).select(rounded((F.col("id") * 3) / F.lit(6e6), 6)).collect()]
    assert got == [r[0] for r in duckdb.sql("SELECT round(range * 3 / 6e6::DOUBLE, 6) FROM range(1, 40000, 2)").fetchall()]


def test_thinned_curve_rounds_halves_as_the_sql_does(spark):
    import duckdb

    curve = spark.range(1, 40_000, 2).select(F.col("id").alias("threshold"), ((F.col("id") * 3) / F.lit(6e6)).alias("flag_rate"))
    got = [r[0] for r in evaluate.thin_curve(curve).orderBy("threshold").select("flag_rate").collect()]
    assert got == [r[0] for r in duckdb.sql("SELECT round(range * 3 / 6e6::DOUBLE, 6) FROM range(1, 40000, 2)").fetchall()]
