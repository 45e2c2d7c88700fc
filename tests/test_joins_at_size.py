"""Tables that grow are not broadcast, whatever their estimated size, and shared steps shuffle lines as seldom as they can."""

from pyspark.sql import functions as F

from evigraph.operators import assign as A
from evigraph.operators import graph as G
from evigraph.operators import ledger as E
from evigraph.operators import order as R
from evigraph.plans import star_queries as S
from evigraph.sources.fixtures import Star


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_single_assignment_broadcasts_nothing(spark):
    groups = spark.createDataFrame([("g1", 1, "a", 0.9), ("g2", 2, "b", 0.9), ("g3", 3, "c", 0.6)], "group_id string, ord long, canonical string, confidence double")
    members = spark.createDataFrame([("g1", "a", "merge"), ("g1", "b", "keep_separate"), ("g2", "b", "merge"), ("g2", "d", "merge"), ("g3", "c", "merge"), ("g3", "a", "merge"), ("g9", "e", "merge")], "group_id string, member_id string, action string")
    got = A.assign(groups, members)
    assert "Broadcast" not in plan(got)
    assert sorted((r["member_id"], r["group_id"], r["kind"]) for r in got.collect()) == [
        ("a", "g1", "merged"), ("b", "g1", "fallback"), ("c", "g3", "fallback"), ("d", None, "fallback"), ("e", None, "fallback")
    ]


def test_star_steps_broadcast_nations_only(spark, sf):
    s = Star(spark, sf)
    for rows, shuffles in ((s.claim_drafts(), 6), (s.entity_evidence(), 4), (s.evidence(), 2), (S.node_evidence(s), 0), (S.edge_evidence(s), 0)):
        shown = plan(rows).split("Initial Plan")[-1]
        assert shown.count("BroadcastExchange") <= 1 and shown.count("Exchange hashpartitioning") <= shuffles


def shuffles(df):
    return plan(df).split("Initial Plan")[-1].count("Exchange hashpartitioning")


def test_claims_shuffle_lines_twice_and_keep_their_block(spark, sf):
    claims = E.claim_ledger(Star(spark, sf).claim_drafts())
    assert shuffles(claims) <= 6 and "block_key" not in claims.columns  # lines by part and by order, parts, customers, and orders by customer and by key


def test_support_meets_evidence_without_a_shuffle_of_its_own(spark, sf):
    s = Star(spark, sf)
    rows = S.support_rows(s)
    live = s.evidence().select("o_orderkey")
    assert shuffles(rows.join(live.hint("merge"), "o_orderkey", "left_semi")) == shuffles(rows) + shuffles(live) + 1  # the evidence by order, none of the support


def test_places_are_numbered_as_the_rows_lie(spark):
    rows = spark.createDataFrame([("p", i) for i in range(300)] + [("q", i) for i in range(7)], "g string, i int").repartition(5)
    got = R.numbered(rows, ["g"], F.desc("i"), total="all")
    assert "Window" not in plan(got)
    assert {(r["g"], r["i"], r["place"], r["all"]) for r in got.collect()} == {("p", i, 300 - i, 300) for i in range(300)} | {("q", i, 7 - i, 7) for i in range(7)}


def test_touching_takes_each_edge_once(spark):
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "a", "a"), ("e3", "c", "d"), ("e4", "d", "b")], "edge_id string, source_id string, target_id string")
    near = G.touching(edges, spark.createDataFrame([("a",), ("b",), ("a",)], "id string"))
    assert sorted(r["edge_id"] for r in near.collect()) == ["e1", "e2", "e4"] and "Union" not in plan(near)
