"""Named queries over the driver's tables, each with the SQL that gives the same rows.

The SQL is written in another form than the Spark plan wherever there is one: DISTINCT windows for
flag sums, correlated counts for range frames, recursion for the components, joins for bucketed sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.functions.numeric import rounded
from coterie.functions.storage import scratch_path
from coterie.operators import disputes, entity, evaluate, history, model, rings, split
from coterie.operators.history import add_ring_history
from coterie.sources import adapters
from coterie.sources.adapters import AMOUNT, EVENTS_SQL, ID, LABEL, ORDERS_SQL, TIME, tx_events, tx_orders

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return register


def _r(*names: str, digits: int = 6):
    return [F.round(n, digits).alias(n) for n in names]


W = "WINDOW r AS (PARTITION BY ring ORDER BY t, id), p AS (PARTITION BY ring ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
LINKS_SQL = "lk AS (SELECT id, t, client, 'P_emaildomain' AS attr, event_type AS value FROM tx UNION ALL SELECT id, t, client, 'addr1', CAST(addr1 AS VARCHAR) FROM tx UNION ALL SELECT id, t, client, 'k_day', k_day FROM tx)"
EVENT_ATTRS = ("addr1", "P_emaildomain", "k_day")


# ---- scalar, entity, joins

@query(f"WITH {EVENTS_SQL} SELECT id, CAST(floor(t / 86400.0) AS INT) AS day, CAST(floor(t / 3600.0) AS BIGINT) % 24 AS hour, CAST(floor(t / 86400.0) AS BIGINT) % 7 AS dow FROM tx")
def tx_time_parts(spark, sf):
    d = entity.add_time_features(tx_events(spark, sf))
    return d.select(F.col(ID).alias("id"), F.col("_day").alias("day"), F.col("_hour").cast("long").alias("hour"), F.col("_dow").cast("long").alias("dow"))


@query(f"WITH {ORDERS_SQL} SELECT id, CAST(floor(t / 86400.0) AS BIGINT) - d1 AS anchor, coalesce(CAST(card1 AS VARCHAR), 'na') || '|' || coalesce(CAST(addr1 AS VARCHAR), 'na') || '|' || coalesce(CAST(CAST(floor(t / 86400.0) AS BIGINT) - d1 AS VARCHAR), 'na') AS client_id FROM o")
def tx_client_id(spark, sf):
    d = entity.resolve(tx_orders(spark, sf))
    return d.select(F.col(ID).alias("id"), F.col("_card_anchor").alias("anchor"), "client_id")


@query(f"WITH {ORDERS_SQL} SELECT id, t, y, card1, addr1, part FROM o")
def tx_identity_left_join(spark, sf):
    return tx_orders(spark, sf).select(F.col(ID).alias("id"), F.col(TIME).alias("t"), F.col(LABEL).alias("y"), "card1", "addr1", "part")


@query(f"WITH {EVENTS_SQL} SELECT id, t, amt, y, client FROM tx")
def csv_round_trip(spark, sf):
    """CSV sink and declared-schema CSV source."""
    path = scratch_path(spark)
    tx_events(spark, sf).select(ID, TIME, AMOUNT, LABEL, "client_id").write.option("header", True).csv(path)
    d = adapters.read_csv(spark, path, f"{ID} bigint, {TIME} bigint, {AMOUNT} double, {LABEL} int, client_id string")
    return d.select(F.col(ID).alias("id"), F.col(TIME).alias("t"), F.col(AMOUNT).alias("amt"), F.col(LABEL).alias("y"), F.col("client_id").alias("client"))


@query(f"WITH {EVENTS_SQL} SELECT event_type, count(*) AS n FROM tx GROUP BY 1")
def json_round_trip(spark, sf):
    """JSON sink and source of a report."""
    path = scratch_path(spark)
    tx_events(spark, sf).groupBy(F.col("P_emaildomain").alias("event_type")).agg(F.count(F.lit(1)).alias("n")).write.json(path)
    return spark.read.schema("event_type string, n bigint").json(path)


@query(f"WITH {EVENTS_SQL} SELECT id, t FROM tx ORDER BY t, id LIMIT 500")
def first_rows_by_time(spark, sf):
    return split.first_by_time(tx_events(spark, sf), 500).select(F.col(ID).alias("id"), F.col(TIME).alias("t"))


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT round(quantile_cont(t, 0.8), 6) AS c FROM tx)
SELECT CASE WHEN t <= c - 604800 THEN 'train' WHEN t > c THEN 'test' ELSE 'embargo' END AS split, count(*) AS n, sum(y)::BIGINT AS frauds, min(t) AS t_min, max(t) AS t_max FROM tx, c GROUP BY 1""")
def temporal_split_counts(spark, sf):
    d = split.temporal_split(tx_events(spark, sf)).withColumn("split", F.coalesce("split", F.lit("embargo")))
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(LABEL).alias("frauds"), F.min(TIME).alias("t_min"), F.max(TIME).alias("t_max"))


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT round(quantile_cont(t, 0.8), 6) AS c FROM tx), tr AS (SELECT tx.* FROM tx, c WHERE t <= c - 604800), v AS (SELECT round(quantile_cont(t, 0.8), 6) AS v FROM tr)
SELECT t > v AS is_valid, count(*) AS n, min(t) AS t_min FROM tr, v GROUP BY 1""")
def time_valid_split(spark, sf):
    train, _ = split.train_test(tx_events(spark, sf))
    return split.valid_split(train).groupBy("is_valid").agg(F.count(F.lit(1)).alias("n"), F.min(TIME).alias("t_min"))


# ---- ring history

@query(f"WITH {EVENTS_SQL} SELECT id, ring, row_number() OVER r - 1 AS prior_tx FROM tx {W}")
def ring_prior_counts(spark, sf):
    d = add_ring_history(tx_events(spark, sf))
    return d.select(F.col(ID).alias("id"), F.col("ring_id").alias("ring"), F.col("ring_prior_tx").cast("long").alias("prior_tx"))


@query(f"WITH {EVENTS_SQL} SELECT id, round(coalesce(sum(amt) OVER p, 0) + 1e-7, 4) AS amt_sum, round(coalesce(avg(amt) OVER p, 0) + 1e-7, 4) AS amt_mean FROM tx {W}")
def ring_prior_amounts(spark, sf):
    d = add_ring_history(tx_events(spark, sf))
    return d.select(F.col(ID).alias("id"), F.round(F.col("ring_prior_amt_sum") + 1e-7, 4).alias("amt_sum"), F.round(F.col("ring_prior_amt_mean") + 1e-7, 4).alias("amt_mean"))


@query(f"""WITH {EVENTS_SQL}, b AS (SELECT id, t, row_number() OVER r - 1 AS n, min(t) OVER (PARTITION BY ring) AS f, t - lag(t) OVER r AS prev FROM tx {W})
SELECT id, round((t - f) / 86400.0::DOUBLE + 1e-9, 6) AS age_days, prev AS secs_since_prev, round(n / greatest((t - f) / 86400.0::DOUBLE, 1 / 24.0::DOUBLE) + 1e-9, 6) AS velocity FROM b""")
def ring_timing(spark, sf):
    d = add_ring_history(tx_events(spark, sf))
    return d.select(F.col(ID).alias("id"), F.round(F.col("ring_age_days") + 1e-9, 6).alias("age_days"), F.col("ring_secs_since_prev").alias("secs_since_prev"), F.round(F.col("ring_prior_velocity") + 1e-9, 6).alias("velocity"))


@query(f"""WITH {EVENTS_SQL}, b AS (SELECT id, avg(amt) OVER p AS m, avg(amt * amt) OVER p AS q FROM tx {W})
SELECT id, round(coalesce(sqrt(greatest(q - m * m, 0)) / greatest(m, 0.01), 0), 4) AS amt_cv FROM b""")
def ring_amount_cv(spark, sf):
    return add_ring_history(tx_events(spark, sf)).select(F.col(ID).alias("id"), F.round("ring_prior_amt_cv", 4).alias("amt_cv"))


@query(f"""WITH {EVENTS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY ring, client ORDER BY t, id) = 1 AS is_new FROM tx)
SELECT id, is_new::INT AS client_is_new, coalesce(count(DISTINCT client) OVER p, 0) AS prior_clients, count(DISTINCT addr1) OVER r AS prior_addrs,
round(coalesce(count(DISTINCT client) OVER p, 0) / greatest(count(DISTINCT addr1) OVER r, 1)::DOUBLE, 6) AS cards_per_addr FROM f {W}""")
def ring_prior_distinct(spark, sf):
    d = add_ring_history(tx_events(spark, sf))
    return d.select(F.col(ID).alias("id"), F.col("client_is_new_to_ring").alias("client_is_new"), F.col("ring_prior_clients").alias("prior_clients"),
                    F.col("ring_prior_addrs").alias("prior_addrs"), F.round("ring_cards_per_addr_prior", 6).alias("cards_per_addr"))


@query(f"WITH {ORDERS_SQL} SELECT id, count(DISTINCT coalesce(addr1, -1)) OVER (PARTITION BY part ORDER BY t, id) AS prior_addrs FROM o WHERE part IS NOT NULL")
def ring_prior_addrs(spark, sf):
    d = tx_orders(spark, sf).where("part is not null").withColumn("ring_id", F.col("part")).withColumn("client_id", F.col("card1").cast("string"))
    return add_ring_history(d).select(F.col(ID).alias("id"), F.col("ring_prior_addrs").alias("prior_addrs"))


def _lagged(days):
    return f"""WITH {EVENTS_SQL}, n AS (SELECT id, row_number() OVER r - 1 AS n FROM tx {W}),
e AS (SELECT ring, t, sum(sum(y)) OVER (PARTITION BY ring ORDER BY t) AS cum FROM tx GROUP BY ring, t),
a AS (SELECT tx.id, coalesce(e.cum, 0) AS known FROM tx ASOF LEFT JOIN e ON tx.ring = e.ring AND tx.t - {days * 86400} >= e.t)
SELECT id, known::BIGINT AS known_frauds, CASE WHEN n > 0 THEN round(known / n::DOUBLE, 6) ELSE 0 END AS known_rate FROM a JOIN n USING (id)"""


def _known(d):
    return d.select(F.col(ID).alias("id"), F.col("ring_known_prior_frauds").alias("known_frauds"), F.round("ring_known_fraud_rate", 6).alias("known_rate"))


@query(_lagged(5))
def ring_lagged_frauds(spark, sf):
    return _known(add_ring_history(tx_events(spark, sf), 5))


@query(_lagged(0))
def ring_lag0_frauds(spark, sf):
    return _known(add_ring_history(tx_events(spark, sf), 0))


# ---- links and rings

@query(f"""WITH {EVENTS_SQL}, {LINKS_SQL} SELECT id, attr, value, count(DISTINCT client) OVER w AS seen, count(DISTINCT client) OVER w <= 20 AS eligible FROM lk WINDOW w AS (PARTITION BY attr, value ORDER BY t, id)""")
def hub_gate_edges(spark, sf):
    return rings.gated(tx_events(spark, sf), EVENT_ATTRS).select(F.col(ID).alias("id"), "attr", "value", "seen", "eligible")


@query(f"""WITH {EVENTS_SQL}, {LINKS_SQL}, s AS (SELECT attr, value, count(DISTINCT client) AS n FROM lk GROUP BY 1, 2)
SELECT attr, count(*) AS distinct_values, count(*) FILTER (n > 20) AS hubs, count(*) FILTER (n BETWEEN 2 AND 20) AS linking_values, coalesce(sum(n) FILTER (n BETWEEN 2 AND 20), 0)::BIGINT AS edges FROM s GROUP BY 1""")
def hub_demotions(spark, sf):
    return rings.hub_demotions(tx_events(spark, sf), EVENT_ATTRS)


@query(f"WITH {EVENTS_SQL}, {LINKS_SQL} SELECT attr, value, count(DISTINCT client) AS n_clients FROM lk GROUP BY 1, 2")
def attribute_selectivity(spark, sf):
    return rings.selectivity(tx_events(spark, sf), EVENT_ATTRS)


def _ring_frame(spark, sf):
    return tx_orders(spark, sf).withColumn("client_id", F.col("card1").cast("string"))


def _rings_sql(cap: int, tail: str) -> str:
    return f"""WITH RECURSIVE {ORDERS_SQL}, pr AS (SELECT DISTINCT part, CAST(card1 AS VARCHAR) AS client FROM o WHERE part IS NOT NULL),
kp AS (SELECT part FROM pr GROUP BY 1 HAVING count(*) BETWEEN 2 AND {cap}), e AS (SELECT DISTINCT a.client AS u, b.client AS v FROM pr a JOIN pr b USING (part) JOIN kp USING (part) WHERE a.client <> b.client),
cl AS (SELECT DISTINCT CAST(card1 AS VARCHAR) AS client FROM o),
w(client, ring) AS (SELECT client, client FROM cl UNION SELECT e.v, w.ring FROM w JOIN e ON w.client = e.u WHERE w.ring < e.v),
lb AS (SELECT client, min(ring) AS ring FROM w GROUP BY 1) {tail}"""


PART_ATTRS = ("part",)


def _ring_labels(spark, sf, cap=3):
    return rings.client_rings(_ring_frame(spark, sf), PART_ATTRS, cap)


@query(_rings_sql(3, "SELECT client AS client_id, ring AS ring_id FROM lb"))
def whole_frame_rings(spark, sf):
    return _ring_labels(spark, sf)


SIZES = """sz AS (SELECT ring, count(*) AS n FROM lb GROUP BY 1) SELECT sum(n)::BIGINT AS n_clients, count(*) AS n_rings, count(*) FILTER (n > 1) AS multi_client_rings,
coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS clients_linked, max(n) AS largest_ring FROM sz"""


@query(_rings_sql(3, ", " + SIZES))
def ring_size_stats(spark, sf):
    return rings.ring_sizes(_ring_labels(spark, sf))


@query(" UNION ALL ".join(
    f"SELECT * FROM ({_rings_sql(c, ', ' + SIZES.replace('SELECT sum(n)::BIGINT AS n_clients', f'SELECT {c} AS cap', 1).replace('max(n) AS largest_ring', 'round(100.0 * coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 6) AS pct_clients_linked, max(n) AS largest_ring, round(100.0 * max(n) / sum(n), 6) AS pct_in_largest'))})"
    for c in (2, 3)))
def selectivity_sweep(spark, sf):
    d = rings.sweep_selectivity(_ring_frame(spark, sf), (2, 3), PART_ATTRS)
    return d.select("cap", "n_rings", "multi_client_rings", "clients_linked", *_r("pct_clients_linked"), "largest_ring", *_r("pct_in_largest"))


@query(f"""WITH {EVENTS_SQL}, g AS (SELECT ring AS ring_id, count(*) AS ring_n_tx, count(DISTINCT client) AS ring_n_clients, round(sum(CAST(amt AS DECIMAL(18,2)))::DOUBLE, 2) AS ring_total_amt,
sum(CAST(amt AS DECIMAL(18,2)))::DOUBLE / count(amt) AS m, coalesce(stddev_samp(amt), 0) AS s, count(DISTINCT addr1) AS ring_n_addr, count(DISTINCT event_type) AS ring_n_pemail, (max(t) - min(t)) / 86400.0::DOUBLE AS sp FROM tx GROUP BY 1)
SELECT ring_id, ring_n_tx, ring_n_clients, ring_total_amt, round(m + 1e-7, 4) AS ring_mean_amt, round(s + 1e-7, 4) AS ring_std_amt, ring_n_addr, ring_n_pemail, round(sp, 4) AS ring_span_days,
round(ring_n_tx / greatest(sp, 1), 4) AS ring_velocity, round(ring_n_clients / greatest(ring_n_addr, 1)::DOUBLE, 4) AS ring_cards_per_addr, round(s / greatest(m, 0.01), 4) AS ring_amt_cv FROM g""")
def whole_frame_ring_features(spark, sf):
    d = rings.ring_features(tx_events(spark, sf))
    return d.select("ring_id", "ring_n_tx", "ring_n_clients", "ring_total_amt", *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("ring_mean_amt", "ring_std_amt")], "ring_n_addr", "ring_n_pemail",
                    *_r("ring_span_days", "ring_velocity", "ring_cards_per_addr", "ring_amt_cv", digits=4))


@query(f"WITH {EVENTS_SQL} SELECT id, sum(y) OVER (PARTITION BY ring)::BIGINT AS known_frauds, round(avg(y) OVER (PARTITION BY ring), 6) AS known_rate FROM tx")
def leaky_label_transform(spark, sf):
    return _known(rings.leaky_labels(tx_events(spark, sf)))


@query()
def causal_rings(spark, sf):
    """Order-dependent capped merges; tested against one plain replay of all rows."""
    return rings.assign_rings_causally(tx_events(spark, sf).drop("ring_id"), EVENT_ATTRS).select(ID, "ring_id", F.size("made").alias("made"), F.size("refused").alias("refused"))


@query()
def causal_ring_diagnostics(spark, sf):
    return rings.causal_diagnostics(rings.assign_rings_causally(tx_events(spark, sf).drop("ring_id"), EVENT_ATTRS), EVENT_ATTRS)


@query()
def causal_ring_features(spark, sf):
    from coterie.plans.prepare import prepare

    p = prepare(tx_events(spark, sf), ("k_day",))
    return p.rows.select(ID, "ring_id", *history.FEATURES)


# ---- evaluation: a pseudo-score that any engine computes alike

SCORED_SQL = "s AS (SELECT event_id AS id, CAST(event_type = 'error' AS INT) AS y, ((event_id * 7919) % 10007) / 10007.0::DOUBLE AS score, value AS amt FROM events)"


def scored(spark, sf):
    return tx_events(spark, sf).select(F.col(ID).alias("id"), F.col(LABEL).alias("y"), (F.pmod(F.col(ID) * 7919, F.lit(10007)) / F.lit(10007.0)).alias("score"), F.col(AMOUNT).alias("amt"))


@query(f"""WITH {SCORED_SQL}, d AS (SELECT score, sum(y) AS dp, count(*) AS dn FROM s GROUP BY 1), c AS (SELECT *, sum(dp) OVER (ORDER BY score DESC) AS tp, sum(dn) OVER (ORDER BY score DESC) AS n, sum(dp) OVER () AS pos FROM d)
SELECT (SELECT count(*) FROM s) AS n, round((SELECT avg(y) FROM s), 6) AS prevalence, round(sum(dp / pos::DOUBLE * tp / n), 6) AS pr_auc, round(sum(dp / pos::DOUBLE * tp / n) / (SELECT avg(y) FROM s), 6) AS lift FROM c""")
def average_precision(spark, sf):
    d = evaluate.headline(scored(spark, sf))
    return d.select("n", *_r("prevalence", "pr_auc"), F.round("pr_auc_lift_over_baseline", 6).alias("lift"))


@query(f"""WITH {SCORED_SQL}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM s)
SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))::DOUBLE, 6) AS roc_auc FROM r""")
def roc_auc(spark, sf):
    return evaluate.headline(scored(spark, sf)).select(*_r("roc_auc"))


@query(f"""WITH {SCORED_SQL}, r AS (SELECT y, row_number() OVER (ORDER BY score DESC, id) AS r FROM s), k AS (SELECT k AS k0, least(k, (SELECT count(*) FROM s))::BIGINT AS k FROM (VALUES (100), (500), (1000), (5000)) t(k))
SELECT k, round(sum(y) FILTER (r <= k) / k::DOUBLE, 6) AS precision_at_k, round(sum(y) FILTER (r <= k) / sum(y)::DOUBLE, 6) AS recall_at_k, sum(y) FILTER (r <= k)::BIGINT AS frauds_caught FROM k, r GROUP BY k0, k""")
def precision_at_k(spark, sf):
    d = evaluate.precision_at_k(scored(spark, sf))
    return d.select("k", *_r("precision_at_k", "recall_at_k"), "frauds_caught")


@query(f"""WITH {SCORED_SQL}, ng AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS r FROM s WHERE y = 0), b AS (SELECT b::DOUBLE AS b, greatest(floor(b::DOUBLE * (SELECT count(*) FROM ng)), 1) AS k FROM (VALUES (0.001), (0.005), (0.01), (0.05)) t(b)),
th AS (SELECT b, score AS thr FROM b JOIN ng ON r = k)
SELECT b AS fp_budget, round(thr, 9) AS threshold, round(sum(y) FILTER (score >= thr) / sum(y)::DOUBLE, 6) AS recall, round(sum(y) FILTER (score >= thr) / count(*) FILTER (score >= thr)::DOUBLE, 6) AS precision,
count(*) FILTER (score >= thr AND y = 0) AS false_positives FROM th, s GROUP BY b, thr""")
def recall_at_fp_budget(spark, sf):
    d = evaluate.recall_at_fp_budget(scored(spark, sf))
    return d.select("fp_budget", F.round("threshold", 9).alias("threshold"), *_r("recall", "precision"), "false_positives")


CURVE_SQL = f"""{SCORED_SQL}, q AS (SELECT DISTINCT unnest(quantile_cont(score, [{', '.join(f'{i / 199!r}::DOUBLE' for i in range(200))}])) AS thr FROM s),
m AS (SELECT *, CAST(amt * 88.0 * 1.0 + 1500.0 AS DECIMAL(20,4)) AS miss, CAST(amt * 88.0 * 0.25 * 2.0 AS DECIMAL(20,4)) AS blk FROM s),
cv AS (SELECT thr, count(*) FILTER (score >= thr) AS fl, count(*) AS n, count(*) FILTER (score >= thr AND y = 1) AS tp, count(*) FILTER (score >= thr AND y = 0) AS fp, count(*) FILTER (score < thr AND y = 1) AS fn,
coalesce(sum(miss) FILTER (score >= thr AND y = 1), 0)::DOUBLE AS caught, coalesce(sum(miss) FILTER (score < thr AND y = 1), 0)::DOUBLE AS missed, coalesce(sum(blk) FILTER (score >= thr AND y = 0), 0)::DOUBLE AS friction,
sum(miss) FILTER (y = 1)::DOUBLE AS base FROM q, m GROUP BY thr)"""
CURVE_OUT = """round(thr, 6) AS threshold, round(fl / n::DOUBLE, 6) AS flag_rate, tp, fp, fn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(caught, 2) AS loss_avoided_inr,
round(missed, 2) AS fraud_loss_inr, round(friction, 2) AS fp_friction_inr, round(missed + friction, 2) AS total_loss_inr, round(base - missed - friction, 2) AS net_saving_inr"""


def _curve_out(d):
    r = lambda *names, digits=6: [rounded(n, digits).alias(n) for n in names]
    return d.select(*r("threshold", "flag_rate"), "tp", "fp", "fn", *r("precision", "recall"), *r("loss_avoided_inr", "fraud_loss_inr", "fp_friction_inr", "total_loss_inr", "net_saving_inr", digits=2))


@query(f"WITH {CURVE_SQL} SELECT {CURVE_OUT} FROM cv")
def cost_curve(spark, sf):
    return _curve_out(evaluate.cost_curve(scored(spark, sf)))


@query(f"WITH {CURVE_SQL} SELECT {CURVE_OUT} FROM cv ORDER BY base - missed - friction DESC, thr LIMIT 1")
def optimal_point(spark, sf):
    return _curve_out(evaluate.optimal_operating_point(evaluate.cost_curve(scored(spark, sf))))


@query(f"WITH {CURVE_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY thr) - 1 AS i FROM cv) SELECT {CURVE_OUT} FROM n WHERE fl / n::DOUBLE <= 0.25 OR i % 4 = 0")
def cost_curve_thinned(spark, sf):
    return _curve_out(evaluate.thin_curve(evaluate.cost_curve(scored(spark, sf))))


# ---- rings ranked

def _scored_rings(spark, sf):
    d = tx_events(spark, sf)
    return d.withColumn("score", F.pmod(F.col(ID) * 7919, F.lit(10007)) / F.lit(10007.0)).withColumn("known", history.known_frauds(5 * 86400))


@query(f"""WITH {EVENTS_SQL}, k AS (SELECT a.*, ((a.id * 7919) % 10007) / 10007.0::DOUBLE AS score, (SELECT count(*) FROM tx b WHERE b.ring = a.ring AND b.y = 1 AND b.t <= a.t - 432000) AS known FROM tx a)
SELECT ring AS ring_id, count(DISTINCT client) AS n_clients, count(*) AS n_transactions, count(DISTINCT addr1) AS n_addresses, round(sum(CAST(amt AS DECIMAL(18,2)))::DOUBLE * 88.0, 2) AS total_amount_inr, round((max(t) - min(t)) / 86400.0::DOUBLE, 4) AS span_days,
max(known)::BIGINT AS known_prior_frauds, round(max(score), 6) AS max_fraud_score, round(count(*) / greatest((max(t) - min(t)) / 86400.0::DOUBLE, 1 / 24.0), 4) AS velocity_per_day FROM k GROUP BY 1 HAVING count(DISTINCT client) > 1 ORDER BY max(score) DESC, ring LIMIT 10""")
def top_rings(spark, sf):
    d = rings.top_rings(_scored_rings(spark, sf))
    return d.select("ring_id", "n_clients", "n_transactions", "n_addresses", *_r("total_amount_inr", digits=2), *_r("span_days", digits=4), "known_prior_frauds", *_r("max_fraud_score"), *_r("velocity_per_day", digits=4))


@query(f"""WITH {EVENTS_SQL}, u AS (SELECT ring, client, 'k_day' AS attr, k_day AS value FROM tx UNION ALL SELECT ring, client, 'P_emaildomain', event_type FROM tx),
c AS (SELECT ring, attr, value, count(DISTINCT client) AS n FROM u GROUP BY 1, 2, 3 HAVING count(DISTINCT client) > 1), r AS (SELECT *, row_number() OVER (PARTITION BY ring, attr ORDER BY n DESC, value) AS rk FROM c)
SELECT ring AS ring_id, attr, value || ' (' || n || ' cards)' AS label, rk AS rank FROM r WHERE rk <= 3""")
def ring_shared_attributes(spark, sf):
    d = rings.shared_attributes(tx_events(spark, sf), ("k_day", "P_emaildomain"))
    return d.select("ring_id", "attr", "label", F.col("rank").cast("long").alias("rank"))


@query()
def ring_case_files(spark, sf):
    d = _scored_rings(spark, sf)
    top = rings.top_rings(d)
    shared = rings.shared_map(rings.shared_attributes(d.join(top.select("ring_id"), "ring_id", "left_semi"), ("k_day", "P_emaildomain")))
    facts = top.join(shared, "ring_id", "left").withColumn("shared_attributes", F.coalesce("shared_attributes", F.create_map().cast("map<string,array<string>>")))
    return disputes.case_text(facts).select("ring_id", "case_text")


# ---- V columns

def _v(spark, sf):
    c = adapters.table(spark, sf, "lineitem")
    row = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return c.select(row.alias(ID), F.unix_timestamp("l_shipdate").alias(TIME), F.col("l_quantity").alias("V1"), F.col("l_extendedprice").alias("V2"),
                    F.when(F.col("l_linenumber") > 1, F.col("l_discount")).alias("V3"), F.when(F.col("l_linenumber") > 1, F.col("l_tax")).alias("V10"))


V_SQL = "v AS (SELECT l_quantity AS V1, l_extendedprice AS V2, CASE WHEN l_linenumber > 1 THEN l_discount END AS V3, CASE WHEN l_linenumber > 1 THEN l_tax END AS V10 FROM lineitem)"


@query(f"WITH {V_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, (count(*) - count({c}))::BIGINT AS nulls, count(DISTINCT {c}) AS n_distinct FROM v" for c in ("V1", "V2", "V3", "V10")))
def v_block_nulls(spark, sf):
    return model.column_profile(_v(spark, sf), ["V1", "V2", "V3", "V10"])


@query(f"WITH {V_SQL} SELECT round(abs(corr(V1, V2)), 6) AS c12, round(abs(corr(V3, V10)), 6) AS c310 FROM v")
def v_block_corr(spark, sf):
    pair = lambda a, b: F.round(F.abs(model.pair_correlation(a, b)), 6)
    return _v(spark, sf).agg(pair("V1", "V2").alias("c12"), pair("V3", "V10").alias("c310"))


@query(f"""WITH {V_SQL}, p AS (SELECT (count(*) FILTER (V1 IS NULL)) = (count(*) FILTER (V2 IS NULL)) AS same12, (count(*) FILTER (V3 IS NULL)) = (count(*) FILTER (V10 IS NULL)) AS same310,
abs(corr(V1, V2)) < 0.75 AS free12, abs(corr(V3, V10)) < 0.75 AS free310, count(DISTINCT V1) >= count(DISTINCT V2) AS first1, count(DISTINCT V3) >= count(DISTINCT V10) AS first3 FROM v)
SELECT 'V1' AS column_name, NOT same12 OR first1 OR coalesce(free12, false) AS kept FROM p UNION ALL SELECT 'V2', NOT same12 OR NOT first1 OR coalesce(free12, false) FROM p
UNION ALL SELECT 'V3', NOT same310 OR first3 OR coalesce(free310, false) FROM p UNION ALL SELECT 'V10', NOT same310 OR NOT first3 OR coalesce(free310, false) FROM p""")
def v_block_reducer(spark, sf):
    r = model.VBlockReducer(sample_rows=None).fit(_v(spark, sf))
    return spark.createDataFrame([(c, c in r.kept) for c in r.kept + r.dropped], "column_name string, kept boolean")


# ---- disputes: built from orders by arithmetic

def dispute_rows(spark, sf):
    o = adapters.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    k = F.col("o_orderkey")
    slots = F.array(*[F.lit(s) for s in (*disputes.SLOTS, "unknown_slot")])
    strength = F.array(F.lit("strong"), F.lit("moderate"), F.lit("weak"))
    doc = lambda j: F.struct(
        F.concat_ws("-", F.lit("doc"), k, F.lit(j)).alias("document_id"), F.get(slots, ((k * (j + 3)) % 11).cast("int")).alias("slot"),
        F.lit("on file").alias("description"), F.get(strength, ((k + j) % 3).cast("int")).alias("strength"))
    return o.select(
        k.alias("id"), F.concat(F.lit("pay_"), k).alias("payment_id"), (F.floor("o_totalprice") / 10).alias("amount_inr"),
        F.get(F.array(*[F.lit(r) for r in ("4855", "13.1", "4837", "10.4", "4853", "other")]), (k % 6).cast("int")).alias("reason_code"),
        (k % 9).cast("int").alias("respond_by_days"), (F.pmod(k * 7919, F.lit(1009)) / F.lit(1009.0)).alias("fraud_score"),
        (k % 5 == 0).cast("int").alias("ring_known_frauds"), (k % 4).cast("int").alias("customer_prior_disputes"),
        F.when(k % 3 == 0, F.array(doc(0)).cast("array<struct<document_id:string,slot:string,description:string,strength:string>>")).when(k % 3 == 1, F.array(doc(0), doc(1), doc(2))).otherwise(F.array().cast("array<struct<document_id:string,slot:string,description:string,strength:string>>")).alias("evidence"),
    )


_SLOTS = "[" + ", ".join(f"'{s}'" for s in (*disputes.SLOTS, "unknown_slot")) + "]"
_CASE = lambda col, values: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " ELSE 0 END"
DISPUTES_SQL = f"""d AS (SELECT o_orderkey AS id, floor(o_totalprice) / 10 AS amt, ['4855', '13.1', '4837', '10.4', '4853', 'other'][o_orderkey % 6 + 1] AS rc, (o_orderkey % 9)::INT AS days, ((o_orderkey * 7919) % 1009) / 1009.0::DOUBLE AS s,
o_orderkey % 5 = 0 AS ring, o_orderkey % 4 AS pd FROM orders),
ev AS (SELECT id, {_SLOTS}[(id * (j + 3)) % 11 + 1] AS slot, ['strong', 'moderate', 'weak'][(id + j) % 3 + 1] AS st, j FROM d, (VALUES (0), (1), (2)) t(j) WHERE (id % 3 = 0 AND j = 0) OR id % 3 = 1),
bs AS (SELECT id, slot, max(({_CASE('slot', disputes.WEIGHTS)})::DOUBLE * ({_CASE('st', disputes.STRENGTHS)})::DOUBLE) AS w FROM ev GROUP BY 1, 2),
lf AS (SELECT id, sum(w) AS w FROM bs GROUP BY 1)"""


@query(f"WITH {DISPUTES_SQL} SELECT d.id, round(coalesce(w, 0), 6) AS evidence_lift FROM d LEFT JOIN lf USING (id)")
def dispute_evidence_lift(spark, sf):
    return dispute_rows(spark, sf).select("id", F.round(disputes.evidence_lift(F.col("evidence")), 6).alias("evidence_lift"))


@query(f"""WITH {DISPUTES_SQL},
a AS (SELECT d.*, coalesce(w, 0) AS w0, greatest(0, coalesce(w, 0) + ({_CASE('rc', disputes.REASONS)})::DOUBLE + CASE WHEN pd >= 2 THEN 0.08 ELSE 0 END - CASE WHEN ring THEN 0.2 ELSE 0 END)::DOUBLE AS l,
CASE WHEN s >= 0.7 THEN 0.02 WHEN s <= 0.3 THEN 0.1 ELSE 0.1 + (s - 0.3) / 0.4 * -0.08 END::DOUBLE AS b, CASE WHEN s >= 0.7 THEN 0.15 WHEN s <= 0.3 THEN 0.62 ELSE 0.62 + (s - 0.3) / 0.4 * -0.47 END::DOUBLE AS c FROM d LEFT JOIN lf USING (id)),
p AS (SELECT *, greatest(0, least(c, b + (c - b) * l / (l + 0.5))) AS p FROM a)
SELECT id, round_even(p, 4) AS p_win, s <= 0.3 AS friendly, CASE WHEN days <= 2 THEN 'escalate_to_human' WHEN w0 = 0 THEN 'accept' WHEN s >= 0.7 THEN 'accept' WHEN p * (amt + 250) > 650 THEN 'contest' ELSE 'accept' END AS recommendation FROM p""")
def dispute_triage(spark, sf):
    d = disputes.triage(dispute_rows(spark, sf))
    return d.select("id", "p_win", F.col("likely_friendly_fraud").alias("friendly"), "recommendation")


@query(f"""WITH {SCORED_SQL}, q AS (SELECT round(quantile_cont(amt, 0.95), 6) AS q FROM s), p AS (SELECT s.* FROM s, q WHERE amt > q),
r AS (SELECT *, row_number() OVER (ORDER BY score, id) AS lo, row_number() OVER (ORDER BY score DESC, id) AS hi FROM p)
SELECT 'disp_' || id AS id, 'pay_' || id AS payment_id, round(amt * 88.0, 2) AS amount_inr, CASE WHEN lo = 1 THEN '4855' ELSE '4837' END AS reason_code, round(score, 9) AS fraud_score FROM r WHERE lo = 1
UNION ALL SELECT 'disp_' || id, 'pay_' || id, round(amt * 88.0, 2), '4837', round(score, 9) FROM r WHERE hi = 1""")
def dispute_samples(spark, sf):
    """A dispute on the least and one on the most suspect of the large payments."""
    d = disputes.sample_disputes(scored(spark, sf).withColumnsRenamed({"id": ID, "amt": AMOUNT}))
    return d.select("id", "payment_id", F.round("amount_inr", 2).alias("amount_inr"), "reason_code", F.round("fraud_score", 9).alias("fraud_score"))


def assignments(spark, sf):
    """What a drafter might propose: documents on file, twice, and one that is not."""
    d = dispute_rows(spark, sf).where("size(evidence) > 0")
    own = d.select(F.col("id").alias("dispute_id"), F.posexplode("evidence").alias("pos", "e")).select("dispute_id", "pos", "e.slot", "e.document_id")
    again = own.where("pos = 0").withColumn("pos", F.lit(8))
    made_up = d.select(F.col("id").alias("dispute_id"), F.lit(9).alias("pos"), F.lit("shipping_proof").alias("slot"), F.concat(F.lit("ghost-"), "id").alias("document_id"))
    return own.unionByName(again).unionByName(made_up), own.select("dispute_id", "document_id", "slot")


@query(f"""WITH {DISPUTES_SQL}, pr AS (SELECT id, j AS pos, slot, 'doc-' || id || '-' || j AS doc FROM ev UNION ALL SELECT id, 8, slot, 'doc-' || id || '-0' FROM ev WHERE j = 0 UNION ALL SELECT DISTINCT id, 9, 'shipping_proof', 'ghost-' || id FROM ev)
SELECT id AS dispute_id, pos, slot, doc AS document_id, (doc NOT LIKE 'ghost%' AND slot <> 'unknown_slot') AS accepted, row_number() OVER (PARTITION BY id, slot, doc ORDER BY pos) = 1 AS first FROM pr""")
def evidence_provenance(spark, sf):
    return disputes.validate_provenance(*assignments(spark, sf)).select("dispute_id", "pos", "slot", "document_id", "accepted", "first")


@query(f"""WITH {DISPUTES_SQL},
a AS (SELECT d.*, coalesce(w, 0) AS w0, greatest(0, coalesce(w, 0) + ({_CASE('rc', disputes.REASONS)})::DOUBLE + CASE WHEN pd >= 2 THEN 0.08 ELSE 0 END - CASE WHEN ring THEN 0.2 ELSE 0 END)::DOUBLE AS l,
CASE WHEN s >= 0.7 THEN 0.02 WHEN s <= 0.3 THEN 0.1 ELSE 0.1 + (s - 0.3) / 0.4 * -0.08 END::DOUBLE AS b, CASE WHEN s >= 0.7 THEN 0.15 WHEN s <= 0.3 THEN 0.62 ELSE 0.62 + (s - 0.3) / 0.4 * -0.47 END::DOUBLE AS c FROM d LEFT JOIN lf USING (id)),
p AS (SELECT *, greatest(0, least(c, b + (c - b) * l / (l + 0.5))) AS p FROM a),
r AS (SELECT id, amt, CASE WHEN days <= 2 THEN 'escalate_to_human' WHEN w0 = 0 THEN 'accept' WHEN s >= 0.7 THEN 'accept' WHEN p * (amt + 250) > 650 THEN 'contest' ELSE 'accept' END AS recommendation FROM p),
doc AS (SELECT id, {', '.join(f"string_agg('doc-' || id || '-' || j, ',' ORDER BY j) FILTER (slot = '{s}') AS {s}" for s in disputes.SLOTS)},
string_agg('doc-' || id || '-' || j, ',' ORDER BY 'doc-' || id || '-' || j) FILTER (slot = 'unknown_slot') AS bad FROM ev GROUP BY 1)
SELECT r.id, round_even(amt * 100, 0)::BIGINT AS amount, 'draft' AS action, '' AS summary, {', '.join(f"CASE WHEN recommendation = 'contest' THEN coalesce({s}, '') ELSE '' END AS {s}" for s in disputes.SLOTS)},
CASE WHEN doc.id IS NULL THEN '' ELSE concat_ws(',', bad, 'ghost-' || doc.id) END AS rejected, recommendation FROM r LEFT JOIN doc ON r.id = doc.id""")
def contest_payloads(spark, sf):
    """Payloads with their lists of documents written out."""
    d = disputes.contest_payloads(disputes.triage(dispute_rows(spark, sf)), disputes.validate_provenance(*assignments(spark, sf)))
    return d.withColumns({c: F.array_join(c, ",") for c in (*disputes.SLOTS, "rejected")})


# ---- learning

def _model_frame(spark, sf):
    d = add_ring_history(tx_events(spark, sf), 5)
    # A label that amounts explain, but for one row in seventeen.
    d = d.withColumn(LABEL, ((F.col(AMOUNT) > 60) != (F.col(ID) % 17 == 0)).cast("int"))
    return d, [AMOUNT, *history.FEATURES]


@query()
def gbt_scores(spark, sf):
    d, names = _model_frame(spark, sf)
    train, test = split.train_test(d)
    return model.train(train, names).predict(test).select(F.col(ID).alias("id"), F.col(LABEL).alias("y"), "raw_score", "score")


@query("SELECT 0::BIGINT AS mismatches")
def platt_rank_check(spark, sf):
    d, names = _model_frame(spark, sf)
    train, test = split.train_test(d)
    return model.rank_mismatches(model.train(train, names).predict(test))


@query()
def feature_importance(spark, sf):
    d, names = _model_frame(spark, sf)
    return spark.createDataFrame(model.train(split.train_test(d)[0], names, calibrate=False).importance(), "feature string, gain double, splits int, is_ring_feature boolean")


# ---- streaming

@query()
def stream_hub_gate(spark, sf):
    """The hub gate on a stream of files, drained to a table; tests hold it against the batch window."""
    from coterie.streaming.plane import gate_stream, stream_files

    src, out, ck = (scratch_path(spark) for _ in range(3))
    rings.links(tx_events(spark, sf), ("k_day",)).select(ID, TIME, "client_id", "attr", "value").repartitionByRange(4, TIME).write.parquet(src)
    links = stream_files(spark, src, f"{ID} bigint, {TIME} bigint, client_id string, attr string, value string", 10)
    q = gate_stream(links).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
