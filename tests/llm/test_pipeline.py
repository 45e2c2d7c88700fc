"""The pipeline's stages against brute force on what each was given."""

import pytest

import corpus_pipeline
from evigraph.llm import decontam, langid
from evigraph.plans.scratch import staged

from .test_llm_operators import AWKWARD, rows, shares
from .test_near_dedup import slow_near

from .test_decontam import occurs

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, SF), f"test-{name}")
        if name != "shard":
            assert out.columns == columns
        seen.append((name, rows(docs), rows(out)))
        docs = out
    by = {name: (given, kept) for name, given, kept in seen}
    ids = lambda rs: sorted(r["doc_id"] for r in rs)

    given, kept = by["language"]
    model = langid.fit(spark.createDataFrame(given, docs.select(*columns).schema))
    judged = {r["doc_id"]: model.assess(r["text"]) for r in given}
    bars = {}
    for lang in model.langs:
        seen = sorted(round(e, 3) for x, _, e in judged.values() if x == lang)
        bars[lang] = (seen[(len(seen) - 1) // 2] + seen[len(seen) // 2]) / 4 if seen else 0
    assert ids(kept) == sorted(i for i, (lang, _, e) in judged.items() if e is not None and e >= bars[lang])
    given, kept = by["near_dedup"]
    assert ids(kept) == slow_near(given) and len(kept) < len(given)
    given, kept = by["decontaminate"]
    items = [decontam.normalise(r["text"]) for r in rows(spark.read.parquet(f"{SF}/benchmark.parquet"))]
    leaks = {r["doc_id"] for r in given if any(b in decontam.normalise(r["text"]) for b in items)}
    gone = [r for r in given if r["doc_id"] not in set(ids(kept))]
    assert leaks <= {r["doc_id"] for r in gone} and all(any(occurs(b, r["text"]) for b in items) for r in gone)
    given, kept = by["mix_sources"]
    size = lambda rs, s: sum(len(r["text"].split()) for r in rs if r["source"] == s)
    names = {r["source"] for r in given}
    for s, target in shares({s: size(given, s) for s in names}).items():
        assert abs(size(kept, s) - target) <= 150
    given, kept = by["shard"]
    assert ids(given) == ids(kept) and {r["shard"] for r in kept} == set(range(8))
    assert sorted(ids(corpus_pipeline.run(spark, SF).collect())) == ids(kept)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_awkward_rows_in_every_stage(spark, name, stage):
    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, size long, copies int, `a.b` string, place long"
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    more = [(5, "the river runs past the old stone bridge", "en"), (6, "the river runs past the old stone mill", "en"), (7, "the river runs past the old stone mill", None), (7, leak, "en"), (None, None, None), (8, "the " + "river stone bridge " * 9000, "en")]
    data = [(i, t, "en", s, None, "r", "k", 1, 2, "x", 3) for i, t, s in AWKWARD] + [(i, t, lang, "s", 1, None, "k", 1, 2, None, 3) for i, t, lang in more]
    given = spark.createDataFrame(data, kind)
    got = [staged(stage(spark, df, SF), f"awkward-{name}") for df in (given, given.repartition(5))]
    assert [c for c in got[0].columns if c not in ("shard", "slot")] == given.columns
    shown = [sorted((tuple(r[c] for c in got[0].columns) for r in df.collect()), key=repr) for df in got]
    assert shown[0] == shown[1] and shown[0]
    texts = [r["text"] for r in got[0].collect()]
    if name == "language":
        assert None not in texts and "" not in texts and texts.count("one two three four") == 3 and "the river runs past the old stone bridge" in texts
    if name == "near_dedup":
        assert sum(not (t or "").split() for t in texts) == 1 and texts.count("one two three four") == 1 and len(set(texts)) == len(texts)
    if name == "decontaminate":
        assert leak not in texts and len(texts) == len(data) - 1
    if name in ("mix_sources", "shard"):
        assert sum(t is None for t in texts) >= 1
    if name == "shard":
        assert len(texts) == len(data)
    assert stage(spark, given.limit(0), SF).count() == 0
