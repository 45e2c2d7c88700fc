"""Proofs by pointer jumping against trees built in plain Python."""

import hashlib
import random
import zlib

import pytest
from evigraph.llm import merkle, queries
from pyspark.sql import functions as F


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row, more=0):
    values = [row[0], row[1], row[2], None if row[3] is None else row[3] + more, row[4]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, i):
    """(is it on the left, sibling or "") level by level."""
    got = []
    for row in levels[:-1]:
        j = i ^ 1
        got.append((j < i, row[j] if j < len(row) else ""))
        i //= 2
    return got


def expected(rows):
    """The query's rows for (doc_id, source, lang, n_chars, text)."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = levels_of([leaf_of(r) for r in groups[g]])
    top = levels_of([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = path(trees[g], i) + path(top, k)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            fold = leaf_of(r, int(tampered))
            for left, s in steps:
                fold = sha(s + fold if left else fold + s)
            out.append((r[0], leaf_of(r), trees[g][-1][0], top[-1][0], sha("".join(s for _, s in steps)), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def query_rows(spark, rows, tmp_path):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, Tree string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return sorted((tuple(r) for r in queries.op13_merkle(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [2], [1, 1, 1], [0], [5, 1, 2], [1100, 3, 1, 64, 33]])
def test_trees_of_any_size(spark, tmp_path, sizes):
    rng, rows = random.Random(sum(sizes)), []
    for k, n in enumerate(sizes):
        rows += [(len(rows) + i * 3, rng.choice(["a", None, "é"]), [None, "de", "en", "", "zz"][k], rng.choice([None, 3]), rng.choice([None, "", "text"])) for i in range(n)]
    assert query_rows(spark, rows, tmp_path) == expected(rows)


def test_null_and_repeated_rows(spark, tmp_path):
    rows = [(None, None, None, None, None)] * 3 + [(7, "s", "en", 1, "x")] * 5 + [(7, "s", "en", 1, "y"), (8, "s", "en", 2, "x")]
    assert query_rows(spark, rows, tmp_path) == expected(rows)


def test_a_stretch_that_ends_with_a_level(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "STEP", 2)
    rows = [(i, "s", "en" if i < 16 else "de", i, "x") for i in range(16 + 17)]
    assert query_rows(spark, rows, tmp_path) == expected(rows)


def test_any_column_names_and_group(spark):
    rows = spark.createDataFrame([(i, f"g{i % 3}", 1, 2) for i in range(20)], "key int, part string, idx int, Level int").withColumn("digest", merkle.leaf_digest(F.col("key"), F.col("idx")))
    got = merkle.prove(rows, "part", "key", "digest", "Level", "idx").withColumn("root2", merkle.folded(F.col("digest"), F.col("siblings"), F.col("lefts"))).collect()
    assert len(got) == 20 and all(r["root"] == r["root2"] for r in got) and {r["Level"] for r in got} == {2}


def test_query_on_the_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_merkle(spark, sf).collect()), key=str) == expected(rows)
