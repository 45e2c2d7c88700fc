"""First-wins and last-wins rules, ties, nulls and empty input of the core operators, on literals."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from evigraph.functions import text as X
from evigraph.operators import analysis, assign, blocks, candidates, classify, graph, ledger, ontology


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,want", [("a  　﻿ b\n", "a b"), ("", ""), (None, None), ("\t", "")])
def test_normalise_ws(spark, text, want):
    assert one(spark, text, X.normalise_ws) == want


def test_entity_key(spark):
    names = ["C++", "C#  lib", ".NET_core", "Ａ–Ｂ", "x (y) z", "定律 一", None]
    df = X.nfkc(spark.createDataFrame([(n,) for n in names], "n string"), "n", "k")
    assert [r["y"] for r in df.select(X.entity_key(F.col("k")).alias("y")).collect()] == ["c++", "c# lib", ".net core", "a b", "x y z", "定律 一", None]


@pytest.mark.parametrize("word,want", [("", 0.0), (" High ", 0.9), ("高", 0.9), ("一般", 0.6), ("low", 0.3), ("1.7", 1.0), ("-2", 0.0), ("NaN", 0.5), ("maybe", 0.5), (None, None)])
def test_coerce_score(spark, word, want):
    assert one(spark, word, X.coerce_score) == want


def test_numbers(spark):
    # floor(x * 1e4 + .5) is the rule, also where the product falls just below a half
    assert one(spark, 0.61235, X.round4, "double") == math.floor(0.61235 * 10000 + 0.5) / 10000 and one(spark, 0.61236, X.round4, "double") == 0.6124 and one(spark, None, X.clamp01, "double") is None and one(spark, 9.0, X.clamp01, "double") == 1.0


def test_props_folds(spark):
    df = spark.createDataFrame([("g", 2, {"a": "2", "b": "2"}), ("g", 1, {"a": "1"}), ("g", 3, {"b": None}), ("h", 1, None)], "k string, o int, p map<string,string>")
    first = X.props_fold(df, ["k"], "p", [F.col("o")], last=False)
    last = X.props_fold(df, ["k"], "p", [F.col("o")], last=True)
    assert first.first()["p"] == {"a": "1", "b": "2"} and last.first()["p"] == {"a": "2", "b": None} and first.count() == 1


def slow_chunks(text, most, overlap):
    out, start = [], 0
    while True:
        end = min(len(text), start + most)
        if end < len(text):
            low = start + int(0.65 * most)
            tokens = [m.end() for m in re.finditer(r"[。！？；]|[.!?;] ", text[:end]) if m.start() >= low]
            spaces = [i + 1 for i in range(low, end) if text[i] == " "]
            end = tokens[-1] if tokens else spaces[-1] if spaces else end
        out.append((start, end))
        if end == len(text):
            return out
        start = max(start + 1, end - overlap)


def test_chunks(spark):
    text = ("One sentence that ends here. 另一句。And more; " * 40 + "x" * 130 + " tail").strip()
    for most, overlap in ((60, 10), (100, 99), (1200, 160)):
        assert blocks.cut_points(text, most, overlap) == slow_chunks(text, most, overlap)
    df = spark.createDataFrame([(1, text), (2, None), (3, "  "), (4, "short  one")], "doc_id long, text string")
    got = blocks.chunk_blocks(df, 60, 10).collect()
    assert {r["doc_id"] for r in got} == {1, 4} and [r["text"] for r in got if r["doc_id"] == 4] == ["short one"]
    assert all(0 < len(r["text"]) <= 60 for r in got) and [r["text"] for r in got if r["doc_id"] == 1][-1].endswith("tail")
    assert blocks.chunk_blocks(df.limit(0)).count() == 0


def slow_batches(lengths, chars, items):
    batch, n, total, out = -1, items, 0, []
    for x in lengths:
        x = max(1, x)
        if n >= items or (n and total + x > chars):
            batch, n, total = batch + 1, 0, 0
        n, total = n + 1, total + x
        out.append(batch)
    return out


def test_packing(spark):
    for count, length, chars, items, batches in ((686, 334, 20_000, 48, 15), (686, 334, 18_000, 28, 25), (30, 1600, 18_000, 28, 3), (3, 99_999, 100, 5, 3)):
        df = spark.createDataFrame([("p", i, length) for i in range(count)], "k string, o int, n int")
        got = blocks.pack_text_budget(df, ["k"], "o", "n", chars, items).orderBy("o").collect()
        assert [r["batch"] for r in got] == slow_batches([length] * count, chars, items) and got[-1]["batch"] + 1 == batches


def test_relevance_keeps_the_undecided(spark):
    b = spark.createDataFrame([(i,) for i in range(5)], "k int")
    d = spark.createDataFrame([(0, True, 0.41), (1, True, 0.42), (2, False, 0.9), (3, False, 0.9), (3, True, 0.9), (9, True, 1.0)], "k int, keep boolean, score double")
    assert values(blocks.relevance_filter(b, d, "k"), "k") == [(1,), (3,), (4,)]


DRAFT = "project_id string, block_id string, disposition string, kind string, statement string, suggested_name string, suggested_type string, importance double, confidence double, brand string, size long"


def test_claims(spark):
    rows = [("p", "b", "candidate", "fact", "s", "n", "t", 0.1, 0.2, "x", 1), ("p", "b", "attach", "fact", "r", " ", "t", 0.1, 0.2, "x", 1), ("p", "b", "ignore", "fact", "q", None, "t", None, None, None, None)]
    got = ledger.claim_ledger(spark.createDataFrame(rows, DRAFT))
    again = ledger.claim_ledger(spark.createDataFrame(rows[::-1], DRAFT))
    assert values(got, "claim_id", "disposition", "reason") == values(again, "claim_id", "disposition", "reason")
    assert {(r["statement"], r["disposition"], r["occurrence"]) for r in got.collect()} == {("q", "ignore", 0), ("r", "ignore", 1), ("s", "candidate", 2)}
    bad = ledger.rejected(ledger.validate_claim_drafts(spark.createDataFrame([("p", "b", "maybe", "k", "", "n", "t", 2.0, None, "x", 1)], DRAFT)))
    assert set(bad.first()["errors"]) == {"disposition", "statement", "importance"}


def test_coverage(spark):
    b = spark.createDataFrame([("a",), ("b",), ("c",)], "block_id string")
    d = spark.createDataFrame([("a", "unresolved", 2), ("a", "claimed", 1), ("b", "claimed", 1)], "block_id string, status string, ord int")
    c = spark.createDataFrame([("a", "attach"), ("b", "ignore")], "block_id string, disposition string")
    assert values(ledger.coverage_ledger(b, d, c), "block_id", "status", "n_claims") == [("a", "claimed", 1), ("b", "unresolved", 1), ("c", "unresolved", 0)]


def test_longest_summary_first_on_ties(spark):
    e = spark.createDataFrame([("p", 1, "k", "A", "t", "abc", 0.0, True, None), ("p", 0, "k", "B", "t", "xyz", 0.0, False, "z"), ("p", 2, "k", "C", "t", "", 0.0, False, "a")], "project_id string, ord int, key string, name string, type string, summary string, importance double, has_props boolean, alias string")
    r = candidates.merge_candidate_entities(e).first()
    assert (r["name"], r["importance"], r["aliases"], r["has_props"]) == ("B", None, "a,z", True)


def test_decision_reason_order(spark):
    rows = [(0, 0.9, 0.9), (1, 0.58, 0.5), (1, 0.9, 0.4), (1, 0.34, 0.6), (1, 0.2, 0.6)]
    df = spark.createDataFrame([("p", str(i), "n", "t", n, 1, 0.0, 0.0, ind, 0.0, tot) for i, (n, tot, ind) in enumerate(rows)], "project_id string, key string, name string, type string, evidence_blocks long, documents long, relevance double, evidence double, independence double, completeness double, total double")
    assert [r[1:] for r in values(candidates.candidate_decision(df), "key", "decision", "reason")] == [("ignore", "too little evidence"), ("publish", "above the publish threshold"), ("review", "no independent meaning"), ("review", "above the review threshold"), ("ignore", "below the thresholds")]


def test_last_node_wins_a_name_and_gate(spark):
    nodes = spark.createDataFrame([("p", "n1", 1, "A", ["x", "y"]), ("p", "n2", 2, "B", ["z", "x", ""])], "project_id string, node_id string, ord int, type string, names array<string>")
    names = graph.name_index(nodes)
    assert values(names, "key", "node_id") == [("x", "n2"), ("y", "n1"), ("z", "n2")]
    rel = "project_id string, source_key string, target_key string, relation_type string, status string, confidence double, n_missing int, n_valid int, conditions string"
    rows = [("y", "z", "r", "reported", 0.9, 0, 1, None), ("q", "z", "r", "reported", 0.9, 0, 1, None), ("x", "z", "r", "reported", 0.9, 0, 1, None), ("y", "z", "r", "reported", 0.9, 1, 1, None), ("y", "z", "r", "reported", 0.9, 0, 0, None), ("y", "z", "u", "reported", 0.9, 0, 1, None), ("z", "y", "r", "reported", 0.9, 0, 1, None), ("y", "z", "r", "inferred", 0.9, 0, 1, None), ("y", "z", "c", "reported", 0.9, 0, 1, ""), ("y", "z", "r", "reported", 0.1, 0, 1, None), ("y", "z", "r", "reported", None, 0, 1, None)]
    rules = spark.createDataFrame([("r", False, False, False, ["A"], []), ("c", True, True, True, [], [])], "label string, symmetric boolean, requires_conditions boolean, allow_inferred boolean, sources array<string>, targets array<string>")
    df = spark.createDataFrame([("p", *r) for r in rows], rel).withColumn("i", F.monotonically_increasing_id())
    got = [r["reject"] for r in graph.relation_gate(graph.resolve_endpoints(df, names), rules, 0.5).orderBy("i").collect()]
    assert got == [None, "source unresolved", "same node", "missing evidence", "no evidence", "unknown relation type", "source type", "inferred", "conditions", "confidence", None]


def slow_assign(groups, members):
    """The sequential rule: groups in order; accepted only if the canonical member is still free."""
    taken, out = set(), {}
    for g, _, canonical, confidence in sorted(groups, key=lambda x: x[1]):
        mine = [(m, a) for x, m, a in members if x == g and m not in taken]
        if canonical not in [m for m, _ in mine]:
            continue
        for m, a in mine:
            taken.add(m)
            out[m] = (g, "merged" if confidence >= 0.72 and (a == "merge" or m == canonical) else "fallback")
    return out | {m: (None, "fallback") for _, m, _ in members if m not in taken}


def test_single_assignment_equals_the_sequential_rule(spark):
    import random

    rng = random.Random(3)
    for _ in range(4):
        groups, members = [], []
        for g in range(30):
            mine = rng.sample(range(40), rng.randint(1, 5))
            groups.append((f"g{g}", f"{g:03}", f"m{rng.choice(mine + [99] * (rng.random() < 0.1))}", rng.choice((0.6, 0.9))))
            members += [(f"g{g}", f"m{m}", rng.choice(("merge", "keep_separate"))) for m in mine]
        got = assign.assign(spark.createDataFrame(groups, "group_id string, ord string, canonical string, confidence double"), spark.createDataFrame(members, "group_id string, member_id string, action string"))
        assert {r["member_id"]: (r["group_id"], r["kind"]) for r in got.collect()} == slow_assign(groups, members)


def test_entity_keys_are_order_dependent(spark):
    rows = [("p", 0, ["a"]), ("p", 1, ["b"]), ("p", 2, ["c", "b", "a"]), ("p", 3, ["c"]), ("p", 4, ["z"]), ("q", 0, ["a"]), ("q", 5, [])]
    got = assign.entity_keys(spark.createDataFrame(rows, "project_id string, ord long, names array<string>"))
    assert values(got, "project_id", "ord", "key") == [("p", 0, "a"), ("p", 1, "b"), ("p", 2, "a"), ("p", 3, "c"), ("p", 4, "z"), ("q", 0, "a")]


def test_roles_use_ascii_boundaries(spark):
    df = spark.createDataFrame([(n,) for n in ("Ohm's law", "élaw", "lawful", "牛顿定律", "a Model of theory", None)], "name string")
    assert [r["role"] for r in df.select(classify.name_role(F.col("name")).alias("role")).collect()] == ["law", "law", None, "law", "theory", None]


def test_merge_nodes_and_registry(spark):
    node = "node_id string, name string, type string, summary string, confidence double, reason string, evidence_ids array<string>"
    old = spark.createDataFrame([("a", "old", "t", "", 0.5, "ro", ["e2"]), ("b", "b", "t", "s", 0.1, "r", [])], node)
    new = spark.createDataFrame([("a", "new", "t", "sn", 0.5, "rn", ["e1"]), ("c", "c", "t", None, 0.2, "r", None)], node)
    got = {r["node_id"]: r for r in candidates.merge_nodes(old, new).collect()}
    assert (got["a"]["name"], got["a"]["summary"], got["a"]["reason"], got["a"]["evidence_ids"]) == ("old", "sn", "ro", ["e1", "e2"]) and set(got) == {"a", "b", "c"}


def test_suffix_must_be_unique(spark):
    nodes = spark.createDataFrame([("p:node:ab", "1"), ("q:node:ab", "2"), ("p:node:cd", "3"), ("p:concept:ef", "4")], "node_id string, name string")
    asked = spark.createDataFrame([("x:node:ab",), ("x:node:cd",), ("p:concept:ef",), ("x:concept:ef",), ("q:node:ab",)], "asked string")
    assert values(analysis.resolve_node_suffix(asked, nodes), "asked", "name") == [("p:concept:ef", "4"), ("q:node:ab", "2"), ("x:node:cd", "3")]


def test_extension_and_supersede(spark):
    base = spark.createDataFrame([("p", "model", "Model", "model"), ("p", "o", "Else", "other")], "project_id string, id string, label string, role string")
    new = spark.createDataFrame([("p", "m2", "M2", "model"), ("p", "x", "else", "other"), ("p", "ELSE", "y", "other"), ("p", "z", "Z", "other")], base.schema)
    assert values(ontology.ontology_extension(base, new), "id") == [("z",)]
    p = spark.createDataFrame([("1", "pending", ["a"]), ("2", "pending", ["a", "b"]), ("3", "accepted", ["a"])], "proposal_id string, status string, document_ids array<string>")
    gone = spark.createDataFrame([("a",)], "document_id string")
    assert values(ontology.supersede_proposals(p, gone), "proposal_id", "status") == [("1", "superseded"), ("2", "pending"), ("3", "accepted")]


def test_numbered_over_ranges(spark):
    from evigraph.operators import order

    rows = spark.createDataFrame([("hot" if i % 3 else "cold", (i * 7919) % 1000) for i in range(1000)], "g string, x int")
    for by in (["g"], []):
        got = order.numbered(rows.repartition(7), by, F.desc("x")).collect()
        assert len(got) == 1000
        for g in {r["g"] for r in got} if by else {None}:
            mine = sorted((r for r in got if g is None or r["g"] == g), key=lambda r: -r["x"])
            assert [r["place"] for r in mine] == list(range(1, len(mine) + 1))
    assert order.numbered(rows.limit(0), [], F.col("x")).count() == 0


def test_long_chains_of_rivals_are_decided(spark):
    groups = [(f"g{i:03}", f"{i:03}", f"m{i}", 0.9) for i in range(140)]
    members = [(f"g{i:03}", f"m{j}", "merge") for i in range(140) for j in (i, i + 1)]
    got = assign.assign(spark.createDataFrame(groups, "group_id string, ord string, canonical string, confidence double"), spark.createDataFrame(members, "group_id string, member_id string, action string"))
    assert {r["member_id"]: (r["group_id"], r["kind"]) for r in got.collect()} == slow_assign(groups, members)


def slow_keys(rows):
    created, out = {}, {}
    for project, ord_, names in sorted(rows, key=lambda r: (r[0], r[1])):
        known = [n for n in names if (project, n) in created]
        key = min(known, key=lambda n: created[project, n]) if known else names[0]
        created.setdefault((project, key), ord_)
        out[project, ord_] = key
    return out


def test_entity_keys_equal_the_sequential_rule(spark):
    rng = random.Random(11)
    rows = [(f"p{k % 3}", k, [f"n{rng.randrange(60)}" for _ in range(rng.choice([1, 1, 2, 3]))]) for k in range(400)]
    got = assign.entity_keys(spark.createDataFrame(rows, "project_id string, ord long, names array<string>"))
    assert {(r["project_id"], r["ord"]): r["key"] for r in got.collect()} == slow_keys(rows)


def test_a_giant_component_of_entities_is_no_group(spark, monkeypatch):
    """Chains of 100,000 entities, each with its neighbour's name as an alias: in order, and in random order."""
    n, rounds = 100_000, []
    plain = assign._contracted
    monkeypatch.setattr(assign, "_contracted", lambda state: rounds.append(1) or plain(state))
    order = list(range(n))
    for shuffled in (False, True):
        rounds.clear()
        if shuffled:
            random.Random(2).shuffle(order)
        rows = [("p", order[k], [f"n{k}", f"n{k - 1}"] if k else ["n0"]) for k in range(n)]
        df = spark.createDataFrame(rows, "project_id string, ord long, names array<string>")
        assert {("p", r["ord"]): r["key"] for r in assign.entity_keys(df).collect()} == slow_keys(rows)
        assert len(rounds) <= 12


def test_a_chain_of_groups_takes_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    plain = assign.staged
    monkeypatch.setattr(assign, "staged", lambda df, name: rounds.append(name) or plain(df, name))
    groups = [(f"{k:05d}", f"{k:05d}", f"m{k}", 0.9) for k in range(n)]
    members = [(f"{k:05d}", f"m{j}", "merge") for k in range(n) for j in (k, k + 1)]
    got = assign.assign(spark.createDataFrame(groups, "group_id string, ord string, canonical string, confidence double"), spark.createDataFrame(members, "group_id string, member_id string, action string"))
    assert {r["member_id"]: (r["group_id"], r["kind"]) for r in got.collect()} == slow_assign(groups, members)
    assert rounds.count("come-state") < 40
