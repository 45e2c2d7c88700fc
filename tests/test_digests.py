"""Digests and compact analyses against sequential rules, with more items than their limits let through."""

import random

from evigraph.operators import analysis as N

ITEM = "document_id string, slice long, ord long, text string"


def world(seed):
    """slices and items of three documents; one has slices without items."""
    rng = random.Random(seed)
    slices = [(d, i, f"{d}{i}") for d in "abc" for i in range(40 if d == "a" else 6)]
    items = [(d, i, n, f"t{rng.randrange(60)}") for d, i, _ in slices for n in range(0 if (d, i % 2) == ("b", 0) else rng.randrange(9))]
    return slices, items


def test_rolling_digest_equals_sequential_rule(spark):
    slices, items = world(1)
    frame = spark.createDataFrame([*items, ("a", 3, 99, None), ("z", 0, 0, "no slice")], ITEM)
    got = {(r.document_id, r.slice): r[2:] for r in N.rolling_digest(spark.createDataFrame(slices, "document_id string, slice long, summary string"), frame, frame, frame).collect()}
    want = {}
    for d, i, _ in slices:
        seen = [x for x in items if x[0] == d and x[1] < i]
        texts = [x[3] for x in seen]
        before = [s for e, j, s in slices if e == d and j < i]
        lists = (before[-3:], list(dict.fromkeys(texts))[:24], texts[-60:], texts[-80:])
        want[d, i] = tuple(" / ".join(x) for x in lists) if i else (None,) * 4
    assert max(len(x[3]) for x in want.values() if x[3]) > 79 * 5
    assert got == want


def test_compact_analyses_equals_sequential_rule(spark):
    _, items = world(2)
    rows = [(d, 100 * i + n, t, (7 * i + n) % 10 / 10, "unresolved" if n % 3 else "analysed") for d, i, n, t in items]
    frame = spark.createDataFrame(rows, "document_id string, ord long, text string, importance double, status string")
    docs = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("none",)], "document_id string")
    got = {r.document_id: (r.themes, r.entities, r.points, r.topics, r.unresolved) for r in N.compact_analyses(docs, frame, frame, frame, frame, frame).collect()}
    want = {"none": (None, None, None, None, 0)}
    for d in "abc":
        mine = sorted((r for r in rows if r[0] == d), key=lambda r: r[1])
        texts = [r[2] for r in mine]
        best = [r[2] for r in sorted(mine, key=lambda r: -r[3])]
        want[d] = (*(" / ".join(x) for x in (list(dict.fromkeys(texts))[:32], texts[:30], best[:40], texts[:16])), sum(r[4] == "unresolved" for r in mine))
    assert got == want


def test_corpus_plan_keeps_themes_that_begin_alike(spark):
    many = [("p", i // 7, i % 7, f"a long common beginning {i % 30}", i % 10 / 10) for i in range(70)]
    frame = spark.createDataFrame(many, "project_id string, doc_id long, ord long, text string, importance double")
    summaries = spark.createDataFrame([("p", i, "s" * 300) for i in range(10)], "project_id string, doc_id long, summary string")
    row = N.corpus_plan_fallback(summaries, frame, frame, frame.filter("ord = 0")).collect()[0]
    assert row.corpus_summary == " ".join(["s" * 300] * 10)[:2000]
    assert row.themes.split(" / ") == list(dict.fromkeys(m[3] for m in many))[:24]
    order = sorted([(m[1], 0, m[2], m[3]) for m in many if m[4] >= 0.6] + [(m[1], 1, m[2], m[3]) for m in many if m[2] == 0])
    assert row.required.split(" / ") == list(dict.fromkeys(x[3] for x in order))[:24]


def test_digests_of_nothing(spark):
    none = spark.createDataFrame([], ITEM + ", summary string, importance double, status string, project_id string, doc_id long")
    assert N.rolling_digest(none, none, none, none).count() == N.compact_analyses(none, none, none, none, none, none).count() == N.corpus_plan_fallback(none, none, none, none).count() == 0
