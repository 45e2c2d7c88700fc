"""Whole plans: what is declared comes first, limits, proposed categories, projects without profiles, languages."""

import pytest
from pyspark.sql import functions as F

from evigraph.operators import planning as P
from evigraph.operators.classify import ensure_categories

LISTS = "project_id string, origin string, kind string, ord int, label string"


def frames(spark, lists, categories=(), fields=(), rules=()):
    t = spark.createDataFrame
    plans = t([("p", "en", "auto", "given"), ("q", "zh", None, ""), ("bare", "en", "survey", None)], "project_id string, language string, preset string, unit string")
    profiles = t([("p", "textbook", "own", "precision_first"), ("q", "auto", None, "unheard")], "project_id string, preset string, unit string, quality string")
    return (
        plans, profiles, t(list(lists), LISTS), t(list(categories), "project_id string, ord int, id string, label string, role string, definition string"),
        t(list(fields), "project_id string, id string, label string, priority string"), t(list(rules), "project_id string, id string, label string, symmetric boolean, allow_inferred boolean"),
    )


def labels(df, project, column="label"):
    return [r[column] for r in df.filter(F.col("project_id") == project).orderBy("place").collect()]


@pytest.fixture(scope="module")
def made(spark):
    lists = [("p", "plan", "required_knowledge", 0, "late"), ("p", "profile", "important_fields", 5, " early "), ("p", "profile", "important_fields", 6, None), ("p", "plan", "required_knowledge", 1, "early"), ("p", "plan", "required_knowledge", 2, " ")]
    lists += [("p", "profile", "entity_types", i, label) for i, label in enumerate(["Rule", "law ", "Law", "Ships"])] + [("q", "plan", "relation_types", i, f"r{i:02d}") for i in range(40)]
    categories = [("p", 0, "model", "Model", "model", "d"), *[("q", i, f"c{i:02d}", f"C{i}", "other", None) for i in range(20)]]
    return P.normalize_plan(*frames(spark, lists, categories, rules=[("q", "own", " R01", True, True)]))


def test_settings_take_the_profile_first(made):
    rows = {r["project_id"]: r for r in made["settings"].collect()}
    assert [rows["p"][c] for c in ("preset", "unit", "analysis_unit", "relevance", "review")] == ["textbook", "own", "own", 0.6, 0.42]
    assert [rows["q"][c] for c in ("preset", "unit", "analysis_unit", "publish")] == ["auto", "", P.UNIT["zh"], 0.58]
    assert [rows["bare"][c] for c in ("preset", "unit", "generic_relations")] == ["survey", "", 0.1]


def test_declared_types_replace_proposed_categories(made):
    assert labels(made["categories"], "p") == ["Rule", "law", "Law", "Ships"]
    assert labels(made["categories"], "p", "id") == ["law", "law-2", "law-3", "other"]
    assert labels(made["categories"], "q", "id") == [f"c{i:02d}" for i in range(16)]
    assert labels(made["categories"], "bare") == ["Concept"]


def test_lists_are_distinct_in_order_and_cut(made):
    assert labels(made["required_knowledge"], "p") == labels(made["claim_kinds"], "p") == ["early", "late"]
    assert labels(made["relation_types"], "q") == [f"r{i:02d}" for i in range(24)]
    assert labels(made["exclusion_rules"], "q") == [P.EXCLUSION["zh"]]
    fields = {r["label"]: r["priority"] for r in made["field_rules"].filter("project_id = 'p'").collect()}
    assert fields == {"early": "critical", "late": "critical"}  # two important labels, one of them null


def test_own_relation_rules_stay_and_others_are_strict(made):
    rules = {r["label"]: (r["id"], r["symmetric"], r["allow_inferred"]) for r in made["relation_rules"].collect()}
    assert len(rules) == 24 and rules[" R01"] == ("own", True, True) and rules["r00"] == ("relation-2", False, False) and rules["r02"] == ("relation-3", False, False)


def test_fallback_has_general_relations_and_counts_documents(spark):
    profiles = spark.createDataFrame([("p", None, None, None, "zh"), ("q", "auto", "", None, None)], "project_id string, preset string, unit string, quality string, language string")
    blocks = spark.createDataFrame([("p", "d", "b1"), ("p", "d", "b2"), ("x", "d2", "b3")], "project_id string, document_id string, block_id string")
    made = P.fallback_plan(profiles, spark.createDataFrame([("q", "profile", "preferred_relations", 0, "binds"), ("p", "profile", "preferred_relations", 0, " ")], LISTS), blocks)
    assert labels(made["relation_types"], "p") == P.RELATIONS["zh"] and labels(made["relation_types"], "q") == ["binds"]
    assert [tuple(r) for r in made["documents"].collect()] == [("p", "d")]
    assert labels(made["categories"], "p") == ["概念"] and {r["summary"] for r in made["settings"].collect()} == set(P.SUMMARY.values())


def test_no_plans(spark):
    none = [df.limit(0) for df in frames(spark, [])]
    assert all(df.isEmpty() for df in P.normalize_plan(*none).values())


def test_new_categories_speak_the_plans_language_and_frozen_plans_stay(spark):
    t = spark.createDataFrame
    categories = t([(p, i, label, "other" if i else "concept") for p in ("en", "zh", "ice", "none") for i, label in enumerate(["Idea", "Rest"])], "project_id string, ord long, label string, role string")
    entities = t([(p, i, name, None, "") for p in ("en", "zh", "ice", "none") for i, name in enumerate(["Ohm's law", "string theory", "Hooke's law"])], "project_id string, ord long, name string, type string, content string")
    plans = t([("en", "en", None), ("zh", "zh", False), ("ice", "zh", True)], "project_id string, language string, frozen boolean")
    got = {}
    for r in ensure_categories(categories, entities, 3, plans).orderBy("place").collect():
        got.setdefault(r["project_id"], []).append(r["label"])
    assert got == {"en": ["Idea", "Law", "Theory"], "zh": ["Idea", "定律", "理论"], "ice": ["Idea", "Rest"], "none": ["Idea", "Law", "Theory"]}  # the rest made room
    assert {r["label"] for r in ensure_categories(categories, entities).collect()} == {"Idea", "Rest", "Law", "Theory"}
