"""Every limit of every contract has a row that breaks it, and one that just keeps it."""

import pytest
from pyspark.sql import functions as F

from evigraph.operators import contracts as C
from evigraph.operators import synthesis

ACTIONS = ("same_as", "keep_separate")


def kind(rule):
    if isinstance(rule, C.Record):
        return "struct<" + ",".join(f"{n}:{kind(r)}" for n, r in rule.fields.items()) + ">"
    if isinstance(rule, C.Many):
        return f"array<{kind(rule.item)}>"
    if isinstance(rule, C.Mapping):
        return "map<string,string>"
    if isinstance(rule, C.Positive) or isinstance(rule, C.Score) and not rule.lenient:
        return "double"
    return "string"


def good(rule):
    if isinstance(rule, C.Record):
        return {n: good(r) for n, r in rule.fields.items()}
    if isinstance(rule, C.Many):
        return [good(rule.item)]
    if isinstance(rule, C.OneOf):
        return rule.values[-1]
    if isinstance(rule, C.Score):
        return "high" if rule.lenient else 1.0
    return {"a": "b"} if isinstance(rule, C.Mapping) else 3.0 if isinstance(rule, C.Positive) else "x"


def variants(rule, path):
    """(value, its faults)."""
    if isinstance(rule, C.Record):
        for n, r in rule.fields.items():
            for v, f in variants(r, f"{path}.{n}" if path else n):
                yield {**good(rule), n: v}, f
        if path:
            yield None, [f"{path}: missing"]
    elif isinstance(rule, C.Many):
        one = good(rule.item)
        yield None, [] if rule.default else [f"{path}: missing"]
        yield [], [f"{path}: fewer than {rule.least}"] if rule.least else []
        if rule.most is not None:
            yield [one] * rule.most, []
            yield [one] * (rule.most + 1), [f"{path}: more than {rule.most}"]
        for v, f in variants(rule.item, f"{path}[1]"):
            yield [one, v], f
    elif isinstance(rule, C.Text):
        yield None, [] if rule.optional else [f"{path}: missing"]
        yield "", [f"{path}: shorter than {rule.least}"] if rule.least else []
        yield " 　\n", [f"{path}: shorter than {rule.least}"] if rule.least and rule.trim else []
        if rule.most is not None:
            yield "é" * rule.most, []
            yield "é" * (rule.most + 1), [f"{path}: longer than {rule.most}"]
            yield "é" * rule.most + " ", [] if rule.trim else [f"{path}: longer than {rule.most}"]
    elif isinstance(rule, C.OneOf):
        yield None, [f"{path}: missing"]
        yield "other thing", [f"{path}: not one of {', '.join(rule.values)}"]
        yield from ((v, []) for v in rule.values)
    elif isinstance(rule, C.Score):
        yield None, [f"{path}: missing"]
        yield from ((v, []) for v in (("nonsense", "7", "0.2") if rule.lenient else (0.0, 0.5)))
        if not rule.lenient:
            yield from ((v, [f"{path}: outside 0 to 1"]) for v in (-0.1, 1.1, float("nan")))
    elif isinstance(rule, C.Positive):
        yield None, [f"{path}: missing"]
        yield from ((v, [f"{path}: not a positive whole number"]) for v in (0.0, -1.0, 1.5))
    elif isinstance(rule, C.Mapping):
        yield None, []


@pytest.mark.parametrize("name,rule", [("slice", C.SLICE), ("answer", C.ANSWER), ("groups", C.resolution_groups(ACTIONS)), ("catalog", C.catalog_groups(ACTIONS))])
def test_every_limit(spark, name, rule):
    rows = [(good(rule), [])] + list(variants(rule, ""))
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(rows)], f"i int, draft {kind(rule)}")
    got = {r["i"]: r for r in C.validated(df, "draft", rule).collect()}
    for i, (value, want) in enumerate(rows):
        assert got[i]["faults"] == want, value
        assert (got[i]["draft"] is None) == bool(want)


# Limits that a contract must have, written out once more.
def test_limits():
    most = lambda rule, *path: rule.most if not path else most(rule.item.fields[path[0]] if isinstance(rule, C.Many) else rule.fields[path[0]], *path[1:])
    for want, rule, *path in (
        (2500, C.SLICE, "summary"), (32, C.SLICE, "themes"), (160, C.SLICE, "entities"), (320, C.SLICE, "knowledge_points"), (80, C.SLICE, "suggested_topics"), (80, C.SLICE, "concept_links"), (None, C.SLICE, "coverage"),
        (20, C.SLICE, "entities", "aliases"), (1500, C.SLICE, "knowledge_points", "statement"), (8000, C.ANSWER, "answer"), (8, C.ANSWER, "claims"), (12, C.ANSWER, "claims", "evidence_ids"), (40, C.ANSWER, "citations"), (5, C.ANSWER, "limitations"),
        (240, C.resolution_groups(ACTIONS), "groups"), (80, C.resolution_groups(ACTIONS), "groups", "members"), (360, C.catalog_groups(ACTIONS), "groups"), (120, C.catalog_groups(ACTIONS), "groups", "members"),
    ):
        assert most(rule, *path) == want, path


def test_read_as_the_contract_says(spark):
    draft = good(C.SLICE)
    draft["knowledge_points"] = [{**good(C.POINT), "title": "  t ", "importance": "0.25", "confidence": "low", "conditions": None}]
    draft["themes"] = None
    df = spark.createDataFrame([(draft,)], f"draft {kind(C.SLICE)}")
    got = C.validated(df, "draft", C.SLICE).first()["draft"]
    point = got["knowledge_points"][0]
    assert (point["title"], point["importance"], point["confidence"], point["conditions"], got["themes"]) == ("t", 0.25, 0.3, {}, [])
    assert C.validated(df.select(F.lit(None).cast(kind(C.SLICE)).alias("draft")), "draft", C.SLICE).first()["draft"] is None


def slice_draft(**changes):
    return {**{n: [] for n in C.SLICE.fields}, "summary": "s", "relevance": "partial", "relevance_reason": "r", "source_boundary": "b"} | changes


def entity(name, *ids, aliases=()):
    return {"name": name, "type": " ", "aliases": list(aliases), "evidence_block_ids": list(ids)}


def test_document_analysis(spark):
    documents = spark.createDataFrame([("d", "p", "en"), ("e", "p", "zh"), ("f", None, None)], "document_id string, project_id string, output_language string")
    blocks = spark.createDataFrame([("d", "b1"), ("d", "b2"), ("d", "b3"), ("e", "c1")], "document_id string, block_id string")
    point = lambda kind, title, *ids: {"kind": kind, "title": title, "statement": "S", "status": "observed", "scope": None, "conditions": {}, "importance": "9", "confidence": "low", "evidence_block_ids": list(ids)}
    cover = lambda b, s: {"block_id": b, "status": s, "reason": "r"}
    slices = [
        ("d", 0, slice_draft(entities=[entity("Ａlpha", "b1", "b1", "c1"), entity("none", "c1")], knowledge_points=[point("finding", "T", "b2"), point("concept", "t", "b2"), point("finding", " t ", "b1")],
                             themes=["x", "y", "x"], coverage=[cover("b1", "analyzed"), cover("b2", "analyzed")])),
        ("d", 1, slice_draft(relevance="direct", entities=[entity("alpha", "b2"), entity("Beta", "b2")], coverage=[cover("b2", "unresolved"), cover("c1", "analyzed")],
                             concept_links=[{"registry_entry_id": r, "reason": "r", "evidence_block_ids": ["b1"]} for r in ("r1", "r9", "r1")])),
        ("d", 2, slice_draft(relevance="unheard of", entities=[entity("Gamma", "b3")])),
    ]
    df = spark.createDataFrame(slices, f"document_id string, slice long, draft {kind(C.SLICE)}")
    synthesis = spark.createDataFrame([("d", slice_draft(summary=" whole ", relevance="contextual", themes=["z", "y"], entities=[entity("beta", "b3", "b2", aliases=["B", "B"]), entity("Delta", "b3")]))], f"document_id string, draft {kind(C.SYNTHESIS)}")
    registry = spark.createDataFrame([("p", "r1"), ("q", "r9")], "project_id string, registry_entry_id string")
    checked = C.validated(df, "draft", C.SLICE)
    out, coverage = synthesis_of(documents, blocks, checked, registry, C.validated(synthesis, "draft", C.SYNTHESIS))
    d = out["d"]
    assert (d["summary"], d["relevance"], d["relevance_reason"], d["themes"]) == ("whole", "contextual", "r", ["z", "y", "x"])
    assert [(e["item"]["name"], e["evidence"], e["item"]["aliases"], e["item"]["type"]) for e in d["entities"]] == [("beta", ["b2"], ["B"], None), ("Ａlpha", ["b1"], [], None)]
    assert [(p["item"]["kind"], p["item"]["title"] if "title" in p["item"] else p["item"]["name"], p["item"]["importance"], p["item"]["confidence"]) for p in d["knowledge_points"]] == [("finding", "T", 1.0, 0.3), ("concept", "t", 1.0, 0.3)]
    assert len({p["id"] for p in d["knowledge_points"]}) == 2 and all(p["id"].startswith("d:analysis-point:") for p in d["knowledge_points"])
    assert [x["item"]["registry_entry_id"] for x in d["concept_links"]] == ["r1"]
    assert coverage == {("d", "b1"): "analysed", ("d", "b2"): "unresolved", ("d", "b3"): "unresolved", ("e", "c1"): "unresolved"}
    assert (out["e"]["summary"], out["f"]["summary"], out["e"]["relevance"], out["f"]["entities"]) == (synthesis_texts("zh"), synthesis_texts("en"), "out_of_scope", [])
    alone, _ = synthesis_of(documents, blocks, checked, registry, None)
    assert (alone["d"]["summary"], alone["d"]["relevance"]) == ("s s", "direct") and [e["item"]["name"] for e in alone["d"]["entities"]] == ["Ａlpha", "Beta"]
    empty, _ = synthesis_of(documents.limit(0), blocks.limit(0), checked.limit(0), registry.limit(0), None)
    assert empty == {}


def synthesis_of(documents, blocks, slices, registry, draft):
    out, coverage = synthesis.document_analysis(documents, blocks, slices, registry, draft)
    return {r["document_id"]: r for r in out.collect()}, {(r["document_id"], r["block_id"]): r["status"] for r in coverage.collect()}


def synthesis_texts(lang):
    return synthesis.NOTHING[lang]


def test_a_long_document_keeps_the_first_entities(spark):
    documents = spark.createDataFrame([("d", "p", "en")], "document_id string, project_id string, output_language string")
    blocks = spark.range(3000).select(F.lit("d").alias("document_id"), F.concat(F.lit("b"), "id").alias("block_id"))
    rows = [("d", i, slice_draft(entities=[entity(f"n{i % 700}", f"b{i}")])) for i in range(3000)]
    slices = C.validated(spark.createDataFrame(rows, f"document_id string, slice long, draft {kind(C.SLICE)}"), "draft", C.SLICE)
    out, _ = synthesis_of(documents, blocks, slices, spark.createDataFrame([], "project_id string, registry_entry_id string"), None)
    assert [(e["item"]["name"], e["evidence"]) for e in out["d"]["entities"]] == [(f"n{i}", [f"b{i}"]) for i in range(160)]
    assert out["d"]["summary"] == ("s " * 3000)[:2500]
