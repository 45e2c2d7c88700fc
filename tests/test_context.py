"""Context of an answer: unknown seeds, limits, evidence of edges, table order."""

from evigraph.operators import graph as G


def context(spark, questions, **limits):
    t = spark.createDataFrame
    nodes = t([("a", 3), ("b", 2), ("c", 1), ("bare", 0)], "node_id string, ord long")
    edges = t([("ab", 0, 0.5, "a", "b"), ("ac", 1, 0.9, "a", "c"), ("a-bare", 2, 0.7, "a", "bare"), ("dull", 3, 0.8, "a", "b")], "edge_id string, ord long, confidence double, source_id string, target_id string")
    evidence = t([("e1", 5), ("e2", 4), ("e3", 1), ("e4", 0)], "evidence_id string, ord long")
    of_nodes = t([("a", "e1"), ("b", "e2"), ("c", "e3"), ("a", "gone")], "node_id string, evidence_id string")
    of_edges = t([("ab", "e2"), ("ac", "e4"), ("a-bare", "e1")], "edge_id string, evidence_id string")
    asked = t(questions, "question string, node_id string, ord long")
    got = G.retrieve_context(asked, nodes, edges, evidence, of_nodes, of_edges, **limits).collect()
    return sorted((r["question"], r["kind"], r["id"]) for r in got)


def test_edges_bring_their_evidence_and_go_without_it(spark):
    got = context(spark, [("q", "a", 0), ("q", "a", 1), ("q", "unheard", 0), ("r", "unheard", 0)])
    assert got == [("q", "edge", "ab"), ("q", "edge", "ac"), *[("q", "evidence", f"e{i}") for i in (1, 2, 3, 4)], ("q", "node", "a"), ("q", "node", "b"), ("q", "node", "c")]


def test_limits_follow_confidence_and_table_order(spark):
    assert context(spark, [("q", "a", 0)], n_edges=1, n_evidence=2) == [("q", "evidence", "e3"), ("q", "evidence", "e4"), ("q", "node", "c")]  # a's own evidence is cut off, and its edge with it
    assert [x for x in context(spark, [("q", "a", 0)], n_nodes=2) if x[1] == "node"] == [("q", "node", "a")]  # the first end in the table is bare


def test_no_questions(spark):
    assert context(spark, []) == []
