"""Cascades: bound to their projects, nulls, repeated rows, foreign columns, tables left out, nothing to remove."""

from evigraph.operators import cascades as C


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def space(spark):
    t = spark.createDataFrame
    return {
        "documents": t([("p", "d1"), ("p", "d2"), ("q", "d3")], "project_id string, document_id string"),
        "blocks": t([("d1", "b1"), ("d2", "b2"), ("d3", "b3")], "document_id string, block_id string"),
        "evidence": t([("d1", "e1", 1), ("d2", "e2", 2), ("d3", "e3", 3)], "document_id string, evidence_id string, status int"),
        "nodes": t([("p", "p:n1", "x"), ("p", "p:n2", "x"), ("p", "p:n3", "x"), ("q", "q:n", "x"), ("q", "q:bare", "x")], "project_id string, node_id string, `a.b` string"),
        "edges": t([("p", "p:e12", "p:n1", "p:n2"), ("p", "p:e23", "p:n2", "p:n3"), ("p", "p:e33", "p:n3", "p:n3")], "project_id string, edge_id string, source_id string, target_id string"),
        "node_evidence": t([("p:n1", "e1"), ("p:n2", "e1"), ("p:n2", "e2"), ("p:n3", "e2"), ("q:n", "e1"), ("p:n1", None)], "node_id string, evidence_id string"),
        "edge_evidence": t([("p:e12", "e2"), ("p:e23", "e2"), ("p:e33", "e1"), ("p:e23", "e1")], "edge_id string, evidence_id string"),
        "candidates": t([("p", "c1"), ("p", "c2"), ("q", "c3")], "project_id string, candidate_id string"),
        "candidate_blocks": t([("c1", "b1"), ("c2", "b1"), ("c2", "b2"), ("c3", "b1")], "candidate_id string, block_id string"),
        "registry": t([("p", "r1", "active"), ("p", "r2", "active"), ("q", "r3", "active")], "project_id string, registry_id string, status string"),
        "registry_blocks": t([("r1", "b1"), ("r2", "b1"), ("r2", "b2"), ("r3", "b1")], "registry_id string, block_id string"),
        "registry_members": t([("r1", "c1"), ("r2", "c2"), ("r2", "unheard"), ("r3", "c3"), ("r3", "unheard")], "registry_id string, candidate_id string"),
        "claims": t([("p", "k1", "b1"), ("p", "k2", "b2"), ("p", "k0", None), ("p", "k2", "b2")], "project_id string, claim_id string, block_id string"),
        "proposals": t([("p", "o1", "pending"), ("p", "o2", "accepted"), ("q", "o3", "pending")], "project_id string, proposal_id string, status string"),
        "proposal_documents": t([("o1", "d1"), ("o2", "d1"), ("o3", "d1")], "proposal_id string, document_id string"),
    }


def test_documents_go_with_what_rests_on_them_in_their_project(spark):
    left = C.remove_documents(space(spark), spark.createDataFrame([("p", "d1")], "project_id string, document_id string"))
    assert rows(left["evidence"], "evidence_id", "status") == [("e2", 2), ("e3", 3)]
    assert rows(left["nodes"], "node_id") == [("p:n2",), ("p:n3",), ("q:bare",), ("q:n",)]  # of q none is touched
    assert left["nodes"].columns == ["project_id", "node_id", "a.b"]
    assert rows(left["node_evidence"], "node_id", "evidence_id") == [("p:n2", "e2"), ("p:n3", "e2"), ("q:n", "e1")]
    assert rows(left["edges"], "edge_id") == [("p:e23",)]  # the others lack an end or evidence
    assert rows(left["edge_evidence"], "edge_id", "evidence_id") == [("p:e23", "e2")]
    assert rows(left["candidates"], "candidate_id") == [("c2",), ("c3",)]
    assert rows(left["candidate_blocks"], "candidate_id", "block_id") == [("c2", "b2"), ("c3", "b1")]
    assert rows(left["registry"], "registry_id", "status") == [("r1", "orphaned"), ("r2", "active"), ("r3", "active")]
    assert rows(left["registry_members"], "registry_id", "candidate_id") == [("r2", "c2"), ("r3", "c3"), ("r3", "unheard")]
    assert rows(left["claims"], "claim_id") == [("k0",), ("k2",), ("k2",)]
    assert rows(left["proposals"], "proposal_id", "status") == [("o1", "superseded"), ("o2", "accepted"), ("o3", "pending")]
    assert rows(left["proposal_documents"], "proposal_id", "document_id") == [("o2", "d1"), ("o3", "d1")]


def test_nothing_to_remove_changes_nothing(spark):
    tables = space(spark)
    left = C.remove_documents(tables, spark.createDataFrame([], "project_id string, document_id string"))
    for name, table in tables.items():
        assert rows(left[name], *[f"`{c}`" for c in table.columns]) == rows(table, *[f"`{c}`" for c in table.columns]), name


def test_cleared_graphs_leave_cited_evidence_and_the_registry(spark):
    left = C.clear_project_graph(space(spark), spark.createDataFrame([("p",)], "project_id string"))
    assert rows(left["nodes"], "node_id") == [("q:bare",), ("q:n",)] and left["edges"].isEmpty()
    assert rows(left["evidence"], "evidence_id") == [("e1",), ("e3",)]
    assert rows(left["candidate_blocks"], "candidate_id") == [("c3",)] and left["registry"].count() == 3 and left["blocks"].count() == 3


def test_deleted_projects_take_all_their_rows(spark):
    left = C.delete_projects(space(spark), spark.createDataFrame([("p",), ("p",), (None,)], "project_id string"))
    assert {name: t.count() for name, t in left.items()} == {
        "documents": 1, "blocks": 1, "evidence": 1, "nodes": 2, "edges": 0, "node_evidence": 1, "edge_evidence": 0, "candidates": 1, "candidate_blocks": 1,
        "registry": 1, "registry_blocks": 1, "registry_members": 2, "claims": 0, "proposals": 1, "proposal_documents": 1,
    }


def test_tables_left_out_are_not_asked_for(spark):
    tables = space(spark)
    few = {name: tables[name] for name in ("documents", "blocks", "claims")}
    assert rows(C.remove_documents(few, tables["documents"].filter("document_id = 'd2'"))["claims"], "claim_id") == [("k0",), ("k1",)]
    assert C.delete_projects(few, tables["documents"].select("project_id").distinct())["blocks"].isEmpty()


def test_links_with_their_project_are_treated_alike(spark):
    plain = space(spark)
    owner = {"node_evidence": ("nodes", "node_id"), "edge_evidence": ("edges", "edge_id"), "candidate_blocks": ("candidates", "candidate_id"), "registry_blocks": ("registry", "registry_id")}
    told = plain | {link: plain[link].join(plain[name].select(key, "project_id"), key) for link, (name, key) in owner.items()}
    gone = spark.createDataFrame([("p", "d1")], "project_id string, document_id string")
    left, same = C.remove_documents(plain, gone), C.remove_documents(told, gone)
    cleared, alike = C.clear_project_graph(plain, gone), C.clear_project_graph(told, gone)
    for name in plain:
        columns = [f"`{c}`" for c in plain[name].columns]
        assert rows(left[name], *columns) == rows(same[name], *columns) and rows(cleared[name], *columns) == rows(alike[name], *columns)
