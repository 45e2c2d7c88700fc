"""Consolidation equals going through the groups one after another."""

import random

from evigraph.operators import consolidation as M

CANDIDATE = "project_id string, candidate_id string, ord int, decision string, name string, canonical_name string, canonical_key string, type string, aliases array<string>, summary string, properties map<string,string>, evidence_ids array<string>, claim_ids array<string>, importance double"
GROUP = "project_id string, group_id string, ord int, canonical string, registry_id string, name string, type string, summary string, confidence double, reason string"
MEMBER = "group_id string, member_id string, place int, action string, reason string"
ENTRY = "project_id string, registry_id string, name string, type string, summary string, aliases array<string>, member_ids array<string>, claim_ids array<string>, evidence_ids array<string>, confidence double, status string"
ACTIONS = ["same_as", "alias_of", "facet_of", "keep_separate", "uncertain"]


def slow(candidates, groups, members):
    """Sets of members of each concept, with their source, and the name that each form has last."""
    able = {c[1]: c for c in candidates if c[3] != "ignore"}
    done, concepts = set(), []
    for _, g, _, canonical, _, name, _, _, confidence, _ in groups:
        mine = [m for m in members if m[0] == g and m[1] in able and m[1] not in done]
        if canonical not in {m[1] for m in mine}:
            continue
        merging = [m[1] for m in mine if confidence >= 0.72 and (m[1] == canonical or m[3] not in ("keep_separate", "uncertain"))]
        if merging:
            concepts.append((tuple(merging), "ai", name))
        concepts += [((m[1],), "fallback", able[m[1]][5] or able[m[1]][4]) for m in mine if m[1] not in merging]
        done |= {m[1] for m in mine}
    concepts += [((c,), "fallback", able[c][5] or able[c][4]) for c in able if c not in done]
    names = {}
    for ids, _, name in concepts:
        for i in ids:
            for form in [able[i][4], able[i][5], *(able[i][8] or [])]:
                if form:
                    names[form.lower()] = name
    return {(frozenset(ids), source, name) for ids, source, name in concepts}, names


def run(spark, candidates, groups, members, registry=()):
    tables = [spark.createDataFrame(list(rows), schema) for rows, schema in ((candidates, CANDIDATE), (groups, GROUP), (members, MEMBER), (registry, ENTRY), ([("p", 1, "T"), ("p", 2, "U")], "project_id string, ord int, label string"))]
    return M.consolidate(*tables, revision=1)


def test_random_groups(spark):
    r = random.Random(5)
    candidates = [("p", f"c{i:03}", i, "ignore" if i % 9 == 8 else None, f"n{r.randrange(40)}", r.choice([None, f"k{r.randrange(40)}"]), f"key{i}", "T", r.choice([None, [f"a{r.randrange(20)}"]]), None, None, None, None, None) for i in range(80)]
    groups, members = [], []
    for g in range(30):
        ids = r.sample(range(80), r.randrange(1, 7))
        groups.append(("p", f"g{g:02}", g, f"c{r.choice(ids):03}" if g % 5 else "c999", None, f"group {g}", "U", None, r.choice([0.6, 0.72, 0.9]), "why"))
        members += [(f"g{g:02}", f"c{i:03}", n, r.choice(ACTIONS), "as") for n, i in enumerate(ids)]
    out = run(spark, candidates, groups, members)
    want, names = slow(candidates, groups, members)
    assert {(frozenset(m["candidate_id"] for m in x["members"]), x["source"], x["name"]) for x in out.resolutions.collect()} == want
    assert {x["form"]: x["name"] for x in out.names.collect()} == names
    assert out.registry.count() == out.entities.count() == len(want)


def test_registry_goes_on(spark):
    one = lambda i, **c: ("p", i, 0, "review", c.get("name", i), c.get("own"), f"key {i}", c.get("type"), c.get("aliases"), c.get("summary"), c.get("props"), c.get("proof"), c.get("claims"), c.get("importance"))
    candidates = [one("a", props={"x": "1"}, proof=["e2"], claims=["m1"], importance=0.2, own="Alpha", aliases=["OLD NAME", "al"]), one("b", props={"x": "2", "y": "3"}, proof=["e1", "e2"], importance=0.7, type="U"), one("c", type="U", summary="s"), one("z", type="nothing")]
    groups = [("p", "g", 0, "b", "r1", "proposed", "T", "", 0.8, "why"), ("p", "h", 1, "c", "r2", "C group", "other", None, 0.9, "h")]
    members = [("g", "a", 0, "alias_of", "as a"), ("g", "b", 1, "keep_separate", "as b"), ("h", "c", 0, "same_as", "as c"), ("g", "gone", 2, "same_as", "x")]
    registry = [("p", "r1", "Old name", "Old type", "old", ["older"], ["y", "a"], ["m0"], ["e9"], 0.95, "active"), ("p", "r2", "Orphan", "T", "o", [], [], [], [], 1.0, "orphaned"), ("q", "r1", "Foreign", "T", "o", [], [], [], [], 1.0, "active")]
    out = run(spark, candidates, groups, members, registry)
    kept = out.registry.filter("entry = 'g|g'").first()
    assert (kept["registry_id"], kept["name"], kept["type"], kept["summary"], kept["confidence"], kept["status"]) == ("r1", "Old name", "Old type", "old", 0.95, "needs_review")
    assert (kept["aliases"], kept["member_ids"], kept["claim_ids"], kept["evidence_ids"]) == (["older", "a", "Alpha", "al", "b"], ["y", "a", "b"], ["m0", "m1"], ["e1", "e2", "e9"])
    concept = {x["entry"]: x for x in out.entities.collect()}
    assert (concept["g|g"]["properties"], concept["g|g"]["importance"], concept["g|h"]["type"], concept["g|h"]["summary"], concept["g|h"]["name"]) == ({"x": "2", "y": "3"}, 0.7, "U", "s", "C group")
    assert (concept["c|z"]["type"], concept["c|z"]["summary"], concept["c|z"]["confidence"], concept["c|z"]["properties"]) == ("T", "z", 1.0, {})
    assert concept["g|h"]["registry_id"].startswith("p:concept:")
    single = out.resolutions.filter("canonical = 'z'").first()
    assert (single["status"], single["source"], single["reason"], [tuple(m) for m in single["members"]]) == ("accepted", "fallback", M.SINGLE, [("z", "z", "keep_separate", M.UNCOVERED)])
    nothing = run(spark, [], [], [])
    assert (nothing.resolutions.count(), nothing.registry.count(), nothing.names.count()) == (0, 0, 0)
