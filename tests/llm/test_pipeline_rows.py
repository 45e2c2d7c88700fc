"""Rows with null and repeated ids through the stages that told them apart by id."""

import corpus_pipeline

from .test_llm_operators import docs, rows

WORDS = "river stone lamp copper window garden ladder paper silver bridge harbour candle basket feather orchard meadow".split()


def test_null_and_repeated_ids_stay_apart(spark):
    unlike = [" ".join(f"{w}{k}" for w in WORDS) for k in range(8)]
    data = [(None, unlike[0], "s"), (None, unlike[1], "s"), (None, unlike[2], "s"), (7, unlike[3], "s"), (7, unlike[4], "s"), (7, unlike[4], "s"), (8, unlike[5], "s"), (None, unlike[5], "s")]
    want = sorted([("", unlike[0]), ("", unlike[1]), ("", unlike[2]), ("7", unlike[3]), ("7", unlike[4]), ("8", unlike[5])])
    shown = lambda df: sorted((str(r["doc_id"] or ""), r["text"]) for r in rows(df))
    for given in (docs(spark, data), docs(spark, data[::-1]).repartition(5)):
        kept = corpus_pipeline.near_dedup(spark, given, "")
        assert shown(kept) == want
    assert shown(corpus_pipeline.mix_sources(spark, kept, "")) == want  # a single source is taken whole
