"""Documents to blocks: scans, chunking, batching, relevance, deltas and manifests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .packing import batch_stats, pack_text_budget  # noqa: F401 (batches of blocks)

MAX_CHARS, OVERLAP, WINDOW_FROM = 1200, 160, 0.65
# Where a chunk may end.
SENTENCE_ENDS = ("。", "！", "？", ". ", "! ", "? ", "；", "; ")


def scan_sources(documents: DataFrame, project_id: str) -> DataFrame:
    return documents.filter(F.col("project_id") == project_id)


def load_with_defaults(spark: SparkSession, path: str, schema: str, defaults: dict) -> DataFrame:
    """Stored state under a declared schema; columns it lacks and nulls get their defaults."""
    return spark.read.schema(schema).parquet(path).fillna(defaults)


def markup_paragraphs(pages: DataFrame) -> DataFrame:
    """page_id, paragraph (number in the source, from 1), text of every non-empty <p>."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("i", "p"))
    rows = rows.select("page_id", (F.col("i") + 1).cast("long").alias("paragraph"), X.normalise_ws(X.decode_entities(F.col("p"))).alias("text"))
    return rows.filter("text <> ''")


def split_pages(docs: DataFrame) -> DataFrame:
    """Form-feed pages; blank ones go before the rest is numbered."""
    parts = F.filter(F.split("text", "\f"), lambda p: X.normalise_ws(p) != "")
    return docs.select("doc_id", F.posexplode(parts).alias("i", "text")).select("doc_id", (F.col("i") + 1).cast("long").alias("page"), "text")


def cut_points(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each chunk of a text whose white space is already collapsed."""
    out, start = [], 0
    while True:
        hard = min(len(text), start + most)
        end = hard
        if hard < len(text):
            low = start + int(WINDOW_FROM * most)
            ends = [i + len(t) for t in SENTENCE_ENDS if (i := text.rfind(t, low, hard)) >= 0]
            space = text.rfind(" ", low, hard)
            end = max(ends) if ends else space + 1 if space >= 0 else hard
        out.append((start, end))
        if end == len(text):
            return out
        start = max(start + 1, end - overlap)


def chunk_blocks(docs: DataFrame, most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk (from 0), start, text: overlapping chunks that prefer to end with a sentence.

    Short texts stay in Spark; only those longer than ``most`` pass through the Arrow function.
    """

    @F.pandas_udf("array<struct<start:int,text:string>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else [{"start": a, "text": t[a:b].strip()} for a, b in cut_points(t, most, overlap)] for t in texts])

    rows = docs.select("doc_id", X.normalise_ws(F.coalesce("text", F.lit(""))).alias("t")).filter("t <> ''")
    long = F.length("t") > most
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("t").alias("text")))
    rows = rows.withColumn("c", cut(F.when(long, F.col("t"))))
    return rows.select("doc_id", F.posexplode(F.coalesce("c", whole)).alias("chunk", "c")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "c.start", "c.text")


def build_blocks(documents: DataFrame) -> DataFrame:
    """document_id, block_id, ord, text, block_count."""
    chunks = chunk_blocks(documents.select(F.struct("document_id", X.content_hash(F.coalesce("text", F.lit(""))).alias("h")).alias("doc_id"), "text"))
    rows = chunks.select(
        F.col("doc_id.document_id").alias("document_id"), F.col("chunk").alias("ord"), "text",
        X.stable_block_id(F.col("doc_id.document_id"), F.col("doc_id.h"), F.lit(1), F.lit("paragraph"), F.col("chunk"), F.col("text")).alias("block_id"),
    )
    return rows.withColumn("block_count", F.count(F.lit(1)).over(Window.partitionBy("document_id")))


def relevance_filter(blocks: DataFrame, decisions: DataFrame, key: str, threshold: float = 0.42) -> DataFrame:
    """Blocks with a passing decision, and blocks without any."""
    judged = decisions.groupBy(key).agg(F.bool_or(F.col("keep") & (F.col("score") >= threshold)).alias("__pass"))
    return blocks.join(judged, key, "left").filter(F.coalesce("__pass", F.lit(True))).drop("__pass")


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def missing_coverage(blocks: DataFrame, coverage: DataFrame, keys: list[str]) -> DataFrame:
    return without(blocks, coverage, keys)


def delta_documents(sources: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """key, state: new, retry, kept or removed. ``processed`` has key and failed."""
    both = sources.select(key, F.lit(True).alias("s")).join(processed.select(key, "failed", F.lit(True).alias("p")), key, "full")
    state = F.when(F.col("s").isNull(), "removed").when(F.col("p").isNull(), "new").when(F.col("failed"), "retry").otherwise("kept")
    return both.select(key, state.alias("state"))


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return without(old, new, keys).unionByName(new)
