"""A training corpus from ``documents``: each stage takes (spark, docs, sf_dir) and works on all its predecessor kept.

Rows are documents, told apart by a hash of all their columns: a ``doc_id`` may be null or repeat. Rows equal in all columns count
as one from near-dedup on. A null text is an empty one: it has no language and goes in the first stage; the other stages
take it as a text without words. Extra columns pass through all stages under any name (but the last stage sets ``shard`` and ``slot``).
An empty table gives an empty result in every stage, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import decontam, langid, mixing, neardup, shards
from evigraph.plans.scratch import new_path, staged


#: Rows that Python gets at once: whole texts, of which Spark's 10,000 would stand several times over in an executor and its workers.
BATCH_ROWS = "500"


def _small_batches(spark: SparkSession) -> None:
    """For what is planned from now on, also what the stage returns."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go: those without a letter, and those whose words and n-grams their predicted
    language does not explain. Of equal documents all stay or all go."""
    _small_batches(spark)
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of 5-word shingles at least 0.8) the document with the smallest id stays, null ids being last and
    ties going to the smaller hash of the row. Texts without words are copies of each other."""
    _small_batches(spark)
    return neardup.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go. A null or empty text stays; ids and other columns aren't read."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one without words stays once. A null source is one of its own."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", "source", neardup.row_key(docs).alias("key"))
    return mixing.repeat(keyed, mixing.mix(keyed, id_col="key"), id_col="key").select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows shuffled into 8 shards, with their slots, written shard by shard and read back; equal rows are records of their own."""
    shuffled = shards.two_pass_shuffle(docs, size=F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return shards.write_shards(shuffled, new_path(spark, "shards"))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Language models, XXH64 majorities, banded alignment and Newton iterations are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{name}")
    return docs
