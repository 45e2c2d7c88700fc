"""Hash trees equal a plain tree; a version of tables is seen as a whole or not at all."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from evigraph.operators import fingerprint, publishing


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(leaves, fanout):
    while True:
        leaves = [digest(",".join(leaves[i : i + fanout])) for i in range(0, len(leaves), fanout)]
        if len(leaves) == 1:
            return leaves[0]


@pytest.mark.parametrize("fanout", [2, 3, 10])
def test_tree(spark, fanout):
    sizes = {"a": 1, "b": fanout, "c": fanout + 1, None: fanout**2 + 1, "d": 40}
    rows = [(k, i, digest(f"{k}{i}") if i != 3 else None) for k, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    got = fingerprint.hash_tree(spark.createDataFrame(rows, "k string, o int, h string"), ["k"], ["o"], "h", fanout=fanout).collect()
    want = {k: (plain([digest(f"{k}{i}") if i != 3 else "" for i in range(n)], fanout), n) for k, n in sizes.items()}
    assert {r["k"]: (r["fingerprint"], r["leaves"]) for r in got} == want


def test_one_large_group_and_none(spark):
    df = spark.range(70_000).select(F.lit("p").alias("project_id"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("fingerprint"))
    want = digest("v|" + plain(sorted(digest(str(i)) for i in range(70_000)), 256))
    assert fingerprint.input_fingerprint(df, "v").first()["fingerprint"] == want
    assert fingerprint.input_fingerprint(df.limit(0), "v").collect() == []


def test_what_counts_of_a_block(spark):
    rows = [("d", 0, 1, "x"), ("d", 1, 1, "y"), ("e", 0, 1, "x"), ("e", 1, 2, "y")]
    df = spark.createDataFrame(rows, "document_id string, ord int, page int, text string")
    of = lambda *f: {r["document_id"]: r["fingerprint"] for r in fingerprint.manifest_documents(df, f or ("ord", "text")).collect()}
    assert of()["d"] == of()["e"] and of("page", "ord", "text")["d"] != of("page", "ord", "text")["e"]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "store")
    one, two = spark.range(5).withColumn("p", F.col("id") % 2), spark.range(3)
    with pytest.raises(LookupError):
        publishing.read(spark, root, "a")
    assert publishing.publish(spark, root, {"a": one, "b": two}, "p") == 1
    old = publishing.read(spark, root, "a")
    broken = two.select(F.assert_true(F.col("id") < 0).alias("x"))
    with pytest.raises(Exception, match="is not true"):
        publishing.publish(spark, root, {"a": one.limit(1), "b": broken})
    assert publishing.versions(spark, root) == [1] and publishing.read(spark, root, "a").count() == 5
    assert publishing.publish(spark, root, {"a": one.union(one), "b": two}, "p") == 2
    assert (publishing.read(spark, root, "a").count(), old.count(), publishing.read(spark, root, "a", 1).count()) == (10, 5, 5)
    assert publishing.read(spark, root, "a").schema["id"].dataType == one.schema["id"].dataType
    with pytest.raises(LookupError):
        publishing.read(spark, root, "missing")


def test_two_builds_at_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    publishing.publish(spark, root, {"a": spark.range(1)})
    monkeypatch.setattr(publishing, "versions", lambda *_: [])  # what a build saw that began earlier
    with pytest.raises(Exception, match="exist"):
        publishing.publish(spark, root, {"a": spark.range(2)})
    monkeypatch.undo()
    assert publishing.versions(spark, root) == [1] and publishing.read(spark, root, "a").count() == 1
