"""One query for each operator, over its whole table, and the pipeline."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import new_path
from . import bpe, chat, decontam, exact_index, langid, merkle, mixing, quality, repeats, secrets, shards, simhash, urltrie

# The rules of the url query.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.span_list(base).cast("binary"), 256).alias("base_sha256"),
        secrets.span_list(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~held_out(F.col("doc_id"))))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), langid.predict_column(model, F.col("text"), spark).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score"
    )


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urltrie.judge(table(spark, sf_dir, "pages"), rules)


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf_dir, "labels").filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    known = docs.filter(~held_out(F.col("doc_id"))).join(labels.hint("merge"), "doc_id")
    machine = quality.fit(known, meta_cols=("n_chars",))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality.score_column(machine, spark, F.col("text"), F.col("n_chars")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger half of the ids comes as the first batch, since of equal texts the largest id stays; the rest is held against it."""
    ids = exact_index.digests(table(spark, sf_dir, "documents"))
    shape = ids.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("doc_id", 0.5).alias("half")).first()
    index = exact_index.fresh_index(spark, exact_index.buckets_for(shape["n"]))
    first = F.coalesce(F.col("doc_id") > F.lit(shape["half"]), F.lit(False))
    for batch, rows in (("first", ids.filter(first)), ("second", ids.filter(~first))):
        index.append(exact_index.candidates(rows), batch)
    found = exact_index.judged(ids, index)
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are shuffled and written; sizes and checksums are those of the texts read back from the shards."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents")
    shuffled = shards.two_pass_shuffle(docs, size=F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    written = shards.write_shards(shuffled, new_path(spark, "shards"))
    return written.select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one document in ten the words from a place on are made periodic first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))
    docs = docs.withColumn("h", h).withColumn("words", F.when(h % 10 == 0, repeats.words(F.col("text"))))
    g, n = F.floor(F.col("h") / 10), F.size("words").cast("long")
    docs = docs.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    word = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    planted = docs.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(F.transform("words", word), " ")).alias("text"))
    found = repeats.find_runs(planted)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coder = bpe.Coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(table(spark, sf_dir, "documents"), coder)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves with 7 | crc32 of their id are tampered with and then held against the proofs of the originals."""
    docs = table(spark, sf_dir, "documents")
    leaf = lambda n: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(tampered, leaf(F.col("n_chars") + 1)).alias("other"))
    found = merkle.prove(leaves, "lang", "doc_id", "leaf", "other")
    found = found.withColumn("folded", merkle.folded(F.coalesce("other", "leaf"), F.col("siblings"), F.col("lefts")))
    return found.select(
        "doc_id", merkle.hexed(F.col("leaf")).alias("leaf"), merkle.hexed(F.col("subroot")).alias("subroot"), merkle.hexed(F.col("root")).alias("root"),
        merkle.hexed(merkle.proof_digest(F.col("siblings"))).alias("proof_sha256"), merkle.hexed(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_secrets, op3_langid, op4_urls, op5_decontam, op6_simhash, op7_quality, op8_exact_dedup, op9_shards, op10_chat, op11_runs, op12_bpe, op13_merkle, pipeline)
}
