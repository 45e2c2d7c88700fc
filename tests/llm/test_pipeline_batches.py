"""Stages that hand whole texts to Python do so in small batches."""

import corpus_pipeline as P


def test_texts_go_to_python_in_small_batches(spark, sf, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), []
    note = lambda docs: seen.append(int(spark.conf.get(name))) or docs
    monkeypatch.setattr(P.langid, "keep_known", note)
    monkeypatch.setattr(P.neardup, "keep_first", note)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    try:
        for stage in (P.language, P.near_dedup):
            spark.conf.set(name, before)
            stage(spark, docs, sf)
    finally:
        spark.conf.set(name, before)
    assert len(seen) == 2 and max(seen) <= 1000
