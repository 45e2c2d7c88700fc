"""New and changed documents as a stream: each micro-batch goes through the batch operators, and the tables end as if all had come at once.

A document may come again with a greater ``version`` (and other text); its blocks are replaced as a whole. Of equal versions the text with the greater hash holds, late lower
ones change nothing, and a version with the same text keeps the blocks it has. So the result depends on what has arrived, not on how it was cut into batches. Documents
without an id are left out.

Each batch reads the states of the batches before it and writes folders of its own number: a replayed batch overwrites its first try.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.blocks import build_blocks
from ..plans.scratch import new_path, staged

STATE = "document_id string, version long, hash string, at long, batch long"
BLOCKS = "document_id string, block_id string, ord long, chars int, batch long"


def blocks_of(documents: DataFrame) -> DataFrame:
    return build_blocks(documents.select("document_id", "text")).select("document_id", "block_id", "ord", F.length("text").alias("chars"))


def _latest(state: DataFrame) -> DataFrame:
    """document_id, version, hash, at: the state of each document."""
    return state.groupBy("document_id").agg(F.max(F.struct("version", "hash", "batch", "at")).alias("s")).select("document_id", "s.version", "s.hash", "s.at")


def apply(batch: DataFrame, number: int, target: str) -> None:
    """Bring a micro-batch (doc_id, text and, if it has one, version) into the tables below ``target``."""
    spark = batch.sparkSession
    version = F.coalesce(F.col("version").cast("long"), F.lit(0)) if "version" in batch.columns else F.lit(0).cast("long")
    rows = batch.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"), version.alias("version"), X.content_hash(F.coalesce("text", F.lit(""))).alias("hash"), "text").filter("document_id is not null")
    last = rows.groupBy("document_id").agg(F.max_by(F.struct("version", "hash", "text"), F.struct("version", "hash")).alias("d")).select("document_id", "d.*")
    before = _latest(spark.read.schema(STATE).parquet(f"{target}/state").filter(F.col("batch") < number))
    old = before.select("document_id", F.struct("version", "hash").alias("had"), F.col("at").alias("had_at"))
    met = last.join(old, "document_id", "left").filter(F.col("had").isNull() | (F.struct("version", "hash") > F.col("had")))
    same = F.coalesce(F.col("hash") == F.col("had.hash"), F.lit(False))
    news = staged(met.select("document_id", "version", "hash", "text", same.alias("same"), F.when(same, F.col("had_at")).otherwise(F.lit(number)).cast("long").alias("at")), "stream-news")
    blocks_of(news.filter("not same")).write.mode("overwrite").parquet(f"{target}/blocks/batch={number}")
    news.select("document_id", "version", "hash", "at").write.mode("overwrite").parquet(f"{target}/state/batch={number}")


def current(spark: SparkSession, target: str) -> DataFrame:
    """document_id, block_id, ord, chars of every document as it is now."""
    state = _latest(spark.read.schema(STATE).parquet(f"{target}/state")).select("document_id", F.col("at").alias("batch"))
    return spark.read.schema(BLOCKS).parquet(f"{target}/blocks").join(state, ["document_id", "batch"], "left_semi").select("document_id", "block_id", "ord", "chars")


def prepare(spark: SparkSession, target: str) -> None:
    """Empty tables, before the first batch; a restarted stream finds them and leaves them."""
    for name, schema in (("state", STATE), ("blocks", BLOCKS)):
        spark.createDataFrame([], schema).drop("batch").write.mode("ignore").parquet(f"{target}/{name}/batch=-1")


def start(spark: SparkSession, source: str, schema, target: str, checkpoint: str):
    """A query that brings all that arrives in ``source`` into the tables below ``target``."""
    prepare(spark, target)
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda batch, number: apply(batch, number, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def build_once(spark: SparkSession, source: str) -> DataFrame:
    """Run the stream over all that has arrived and return the blocks by id."""
    schema = spark.read.parquet(source).schema
    target, checkpoint = new_path(spark, "stream-blocks"), new_path(spark, "stream-checkpoint")
    pattern = f"{source[:-1]}[{source[-1]}]"  # a pattern may match one file; a stream's plain path must be a folder
    query = start(spark, pattern, schema, target, checkpoint)
    query.awaitTermination()
    return current(spark, target)
