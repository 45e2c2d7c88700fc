"""The digest index over sessions, folders and batches."""

import random

import pytest
from pyspark.sql import functions as F

from evigraph.llm import exact_index
from evigraph.plans.scratch import new_path

from .test_llm_operators import docs, rows


def texts(spark, names, first_id=0):
    return docs(spark, [(first_id + i, f"text {n}", "s") for i, n in enumerate(names)])


def test_reopened_in_a_new_session(spark):
    path = new_path(spark, "index")
    exact_index.dedup_batch(texts(spark, range(500)), exact_index.DigestIndex(spark, path, 128), "a").count()
    other = spark.newSession()
    for name in [t.name for t in other.catalog.listTables() if t.name.startswith("digest_index")]:
        other.sql(f"DROP TABLE {name}")  # as in a session whose catalog never had it; the files stay
    index = exact_index.DigestIndex(other, path)
    assert (index.buckets, index.id_type) == (128, "bigint")
    known = exact_index.candidates(exact_index.digests(texts(other, range(500), 1000)))
    assert index.unseen(known).count() == 0
    got = rows(exact_index.dedup_batch(texts(other, range(250, 750), 1000), index, "b"))
    assert sum(r["kept"] for r in got) == 250 and {r["group_size"] for r in got if r["keep_id"] < 1000} == {2}
    for wrong in ({"buckets": 64}, {"id_type": "string"}):
        with pytest.raises(ValueError):
            exact_index.DigestIndex(other, path, **wrong)


def test_two_folders_with_one_name(spark):
    a, b = exact_index.DigestIndex(spark, new_path(spark, "a") + "/digests", 4), exact_index.DigestIndex(spark, new_path(spark, "b") + "/digests", 4)
    exact_index.dedup_batch(texts(spark, range(10)), a, "x").count()
    assert a.table().count() == 10 and b.table().count() == 0


def test_batches_against_a_plain_dictionary(spark):
    rng = random.Random(1)
    index, keep, copies = exact_index.fresh_index(spark, 4), {}, {}
    for k in range(4):
        if k == 2:
            index.compact(16)
            index = exact_index.DigestIndex(spark, index.path)
            assert (index.buckets, index.version) == (16, 2)
        given = [(rng.randrange(1000) + 1000 * k, f"Text {rng.randrange(30)}", "s") for _ in range(40)]
        got = rows(exact_index.dedup_batch(docs(spark, given), index, f"batch {k}").join(docs(spark, given).select("doc_id", F.col("text")).distinct(), "doc_id"))
        best = {}
        for i, t, _ in given:
            best[t], copies[t] = max(best.get(t, -1), i), copies.get(t, 0) + 1
        keep = best | keep
        assert all((r["keep_id"], r["group_size"]) == (keep[r["text"]], copies[r["text"]]) for r in got if sum(i == r["doc_id"] for i, _, _ in given) == 1)
        assert index.table().count() == len(keep)


def test_string_ids_and_a_third_of_all_rows(spark):
    index = exact_index.DigestIndex(spark, new_path(spark, "index"), 4, "string")
    given = spark.createDataFrame([(f"d{i}", "same" if i % 3 == 0 else f"t{i}") for i in range(300)] + [(None, None)], "doc_id string, text string")
    got = {r["doc_id"]: r for r in rows(exact_index.dedup_batch(given, index, "x"))}
    assert got["d3"]["group_size"] == 100 and got["d3"]["keep_id"] == "d99" and got[None]["kept"] and got[None]["group_size"] == 1
