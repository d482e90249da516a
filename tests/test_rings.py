"""Rings and their history: planted rings, prefixes, permutations, one plain replay."""

from pyspark.sql import functions as F

from coterie.operators import rings
from coterie.operators.entity import resolve
from coterie.operators.history import FEATURES, add_ring_history
from coterie.sources.adapters import ID, TIME


def frame(planted):
    return planted.withColumn("client_id", F.col("card1").cast("string"))


def test_planted_rings_found_unmerged_and_hubs_do_not_collapse(planted):
    d = frame(planted)
    got = rings.client_rings(d, ("addr1", "P_emaildomain"))
    truth = d.where("_ring_truth >= 0").select("client_id", "_ring_truth").distinct()
    per = got.join(truth, "client_id").groupBy("_ring_truth").agg(F.countDistinct("ring_id").alias("n"), F.count("*").alias("c")).collect()
    assert [(r["n"], r["c"]) for r in per] == [(1, 6)] * 4
    s = rings.ring_sizes(got).collect()[0]
    assert s["largest_ring"] < 0.25 * s["n_clients"]


def test_looser_cap_links_no_fewer(planted):
    rows = rings.sweep_selectivity(frame(planted), (2, 6, 20), ("addr1",)).orderBy("cap").collect()
    linked = [r["clients_linked"] for r in rows]
    assert linked == sorted(linked)


def plain_replay(rows, max_shared, max_ring):
    """(id, client, [values by attribute]) in order, over everything at once; rings are lists of nodes, searched.

    By id: the ring, the attributes of edges first seen and taken, those of edges refused.
    """
    seen, groups, out = {}, [], {}  # groups: [name, nodes]

    def of(node):
        for g in groups:
            if node in g[1]:
                return g
        groups.append([node, [node]])
        return groups[-1]

    n_clients = lambda g: sum(x.startswith("c:") for x in g[1])
    for i, client, values in rows:
        c = "c:" + client
        of(c)
        made, refused = [], []
        for a, v in enumerate(values):
            if v is None:
                continue
            s = seen.setdefault((a, v), set())
            new = client not in s
            s.add(client)
            if len(s) <= max_shared:
                one, two = of(c), of(f"{a}={v}")
                if one is not two and n_clients(one) + n_clients(two) > max_ring:
                    refused.append(a)
                    continue
                made += [a] * new
                if one is not two:
                    name = one[0] if len(one[1]) >= len(two[1]) else two[0]
                    groups[:] = [g for g in groups if g is not one and g is not two] + [[name, one[1] + two[1]]]
        out[i] = of(c)[0], made, refused
    return out


def test_causal_rings_equal_one_plain_replay(planted):
    d = frame(planted)
    attrs = ("addr1", "P_emaildomain", "DeviceInfo")
    for cap, limit in ((20, 50), (4, 5), (60, 12)):
        got = {r[ID]: (r["ring_id"], r["made"], r["refused"]) for r in rings.assign_rings_causally(d, attrs, cap, limit).collect()}
        rows = d.select(ID, TIME, "client_id", *[F.col(a).cast("string").alias(a) for a in attrs]).orderBy(TIME, ID).collect()
        assert got == plain_replay([(r[0], r[2], r[3:]) for r in rows], cap, limit)


def test_first_rows_of_hubs_are_ranked_before_the_exchange(planted):
    plan = rings.edges_before_demotion(frame(planted), ("addr1", "P_emaildomain"), 4)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2
    got = {(r["ai"], r["value"], r["client_id"], r["at"]["id"]) for r in plan.collect()}
    rows = rings.gated(frame(planted), ("addr1", "P_emaildomain"), 4).where("eligible and was_new = 1").collect()
    assert got == {(r["ai"], r["value"], r["client_id"], r[ID]) for r in rows}


def test_prefix_keeps_its_rings(planted):
    d = frame(planted)
    cut = d.select(F.percentile(TIME, F.lit(0.5))).collect()[0][0]
    whole = {r[ID]: r["ring_id"] for r in rings.assign_rings_causally(d, ("addr1",)).collect()}
    part = {r[ID]: r["ring_id"] for r in rings.assign_rings_causally(d.where(F.col(TIME) <= cut), ("addr1",)).collect()}
    assert part and all(whole[k] == v for k, v in part.items())


def test_membership_refuses_beyond_the_limit():
    m = rings.Membership(2)
    a, b, c = (m.enter(x, 1) for x in "abc")
    assert m.merge(a, b) and not m.merge(m.ring["b"], c) and m.merge(m.ring["a"], m.ring["b"]) and m.ring["a"] == m.ring["b"] == "a" != m.ring["c"]


def history(planted, where="true"):
    d = frame(planted).withColumn("ring_id", F.col("addr1").cast("string")).where(where)
    return {r[ID]: tuple(r[f] for f in FEATURES) for r in add_ring_history(d).collect()}


def test_future_and_other_rings_change_nothing(planted):
    cut = planted.select(F.percentile(TIME, F.lit(0.6))).collect()[0][0]
    whole, past, alone = history(planted), history(planted, f"{TIME} <= {cut}"), history(planted, "addr1 = 901")
    assert all(whole[k] == v for k, v in past.items()) and all(whole[k] == v for k, v in alone.items())


def test_first_row_has_no_history(planted):
    d = frame(planted).withColumn("ring_id", F.col("addr1").cast("string"))
    r = add_ring_history(d).where("ring_prior_tx = 0").agg(*[F.max(c).alias(c) for c in ("ring_prior_amt_sum", "ring_prior_clients", "ring_age_days")], F.min("client_is_new_to_ring").alias("new")).collect()[0]
    assert (r["ring_prior_amt_sum"], r["ring_prior_clients"], r["ring_age_days"], r["new"]) == (0, 0, 0, 1)


def test_client_key_writes_na(spark):
    d = spark.createDataFrame([(0, 86401, 1, None, 2.0), (1, -1, 2, None, None)], "TransactionID bigint, TransactionDT bigint, card1 bigint, addr1 string, D1 double")
    assert [r["client_id"] for r in resolve(d).orderBy("TransactionID").collect()] == ["1|na|-1", "2|na|na"]
