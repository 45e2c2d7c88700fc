"""Exact deduplication against a persistent digest index.

The index lives in one folder: ``digests`` (digest, keep_id), one row for each text ever seen, and ``counts`` (digest, copies, batch),
what each batch brought; both are bucketed and sorted by digest. A new batch is reduced to one candidate per digest, sort-merge
anti-joined with ``digests`` (whose side is read bucket by bucket, without a shuffle), and what is new is appended. A batch's
counts replace those of an earlier run under the same name, so that replaying a batch, also one that failed half-way, changes nothing.

Number of buckets, type of the ids and version are written beside the data and read back when the folder is opened again, in
this or another session; asking for other ones than the folder has is an error. ``compact`` rewrites the index as a new version with
one sorted file a bucket, and with as many buckets as are asked for.

Nulls: a null text counts as the empty text. A null id is smaller than any other. Repeated
rows are copies of each other. An empty batch appends nothing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import new_path, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with A-Z lower-cased."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256))


class DigestIndex:
    """A digest index in a folder that outlives the session; ``buckets`` and ``id_type`` default to what the folder has."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        try:
            has = spark.read.schema("version int, buckets int, id_type string").json(f"{self.path}/about").orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            has = None
        if has is None:
            self._open(1, buckets or 64, id_type or "bigint")
            self._note()
            return
        for name, asked in (("buckets", buckets), ("id_type", id_type and id_type.lower())):
            if asked not in (None, has[name]):
                raise ValueError(f"the index in {self.path} has {name} {has[name]}, not {asked}")
        self._open(has["version"], has["buckets"], has["id_type"], reopened=True)

    def _open(self, version: int, buckets: int, id_type: str, reopened: bool = False) -> None:
        self.version, self.buckets, self.id_type = version, buckets, id_type.lower()
        name = f"digest_index_{hashlib.sha256(self.path.encode()).hexdigest()[:24]}_v{version}"
        self.digests, self.counts = f"{name}_digests", f"{name}_counts"
        for table, columns, extra in ((self.digests, f"digest BINARY, keep_id {id_type}", ""), (self.counts, "digest BINARY, copies BIGINT, batch STRING", "PARTITIONED BY (batch) ")):
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet {extra}"
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.folder(table)}'"
            )
        if not reopened:
            return
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder(self.counts))
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)
        self.spark.sql(f"MSCK REPAIR TABLE {self.counts}")  # a catalog that is new to the folder doesn't know its batches

    def folder(self, table: str) -> str:
        return f"{self.path}/v{self.version}-{table.rsplit('_', 1)[-1]}"

    def _note(self) -> None:
        note = self.spark.createDataFrame([(self.version, self.buckets, self.id_type)], "version int, buckets int, id_type string")
        note.coalesce(1).write.mode("append").json(f"{self.path}/about")

    def table(self) -> DataFrame:
        return self.spark.table(self.digests)

    def files(self) -> DataFrame:
        """``table`` without the buckets."""
        return self.spark.read.schema(self.table().schema).parquet(self.folder(self.digests))

    def sizes(self) -> DataFrame:
        """digest -> group_size, the rows of all batches so far; summed bucket by bucket."""
        return self.spark.table(self.counts).groupBy("digest").agg(F.sum("copies").alias("group_size"))

    def unseen(self, candidates: DataFrame) -> DataFrame:
        """The candidates whose digest the index does not have."""
        return candidates.hint("merge").join(self.table(), "digest", "left_anti")

    def append(self, candidates: DataFrame, batch: str) -> None:
        """Add what is new of (digest, keep_id, copies), and the copies of all as the counts of ``batch``."""
        self._insert(f"INTO {self.digests}", self.unseen(candidates).select("digest", "keep_id"))
        self._insert(f"OVERWRITE {self.counts} PARTITION (batch = '{batch}')", candidates.select("digest", "copies"))

    def _insert(self, into: str, rows: DataFrame) -> None:
        dealt = rows.repartition(self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets)))  # as the table's buckets: one file for each, sorted by the writer
        self.spark.sql(f"INSERT {into} SELECT * FROM {{rows}}", rows=dealt)
        self.spark.catalog.refreshTable(into.split()[1])

    def compact(self, buckets: int | None = None) -> None:
        """Rewrite as the next version; the version before stays as it is until its folders are removed."""
        digests, counts = self.table(), self.spark.table(self.counts).groupBy("digest", "batch").agg(F.sum("copies").alias("copies"))
        self._open(self.version + 1, buckets or self.buckets, self.id_type)
        self._insert(f"OVERWRITE {self.digests}", digests)
        self._insert(f"OVERWRITE {self.counts}", counts.select("digest", "copies", "batch"))
        self._note()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest for each row; staged, so that whole texts are read once."""
    return staged(docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest")), "digests-of-batch")


def candidates(ids: DataFrame) -> DataFrame:
    """(doc_id, digest) -> one row per digest: the largest id stays."""
    return ids.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))


def judged(ids: DataFrame, index: DigestIndex) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept of (doc_id, digest) whose digests the index has."""
    # A text may fill a third of the rows: the index comes without its buckets, so that both sides are shuffled and adaptive execution can split its partition.
    known = index.files().join(index.sizes().hint("merge"), "digest")
    sizes = staged(ids.select("digest").distinct().hint("merge").join(known, "digest"), "digests-known")
    return ids.hint("merge").join(sizes, "digest").select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def dedup_batch(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Append the batch's new texts to the index and return a row per document:
    doc_id, digest, keep_id, group_size, kept.

    ``keep_id`` is the document that the index keeps for this text; a text that an earlier batch
    brought stays with that batch's document. ``group_size`` counts the rows with this text in this batch and all
    before it. ``kept`` marks the rows that stay; of repeated rows with the same id all carry the mark.
    """
    ids = digests(docs, id_col, text_col)
    index.append(candidates(ids), batch)
    return judged(ids, index)


def buckets_for(rows: int, bucket_rows: int = 4_000_000) -> int:
    """64 buckets, or as many as keep each near ``bucket_rows`` digests."""
    return max(64, math.ceil(rows / bucket_rows))


def fresh_index(spark: SparkSession, buckets: int = 64) -> DigestIndex:
    return DigestIndex(spark, new_path(spark, "digests"), buckets)
