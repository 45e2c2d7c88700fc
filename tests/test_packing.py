"""Packing equals the sequential rule however the items are cut into stretches."""

import random

import pytest
from pyspark.sql import functions as F

from evigraph.operators import packing


def slow(lengths, chars, items):
    out, batch, n, used = [], -1, items, 0
    for x in (max(1, x or 1) for x in lengths):
        if n >= items or n and used + x > chars:
            batch, n, used = batch + 1, 0, 0
        n, used = n + 1, used + x
        out.append(batch)
    return out


@pytest.mark.parametrize("stretch", [7, 16, 4096])
def test_random_lengths(spark, stretch):
    r = random.Random(stretch)
    keys = {"a": 1, "b": 7, "c": 300, None: 60, "d": 14}
    lengths = {k: [r.choice([None, 0, 1, 5, 20, 99, 100, 101, 500]) for _ in range(n)] for k, n in keys.items()}
    df = spark.createDataFrame([(k, i, n) for k, ns in lengths.items() for i, n in enumerate(ns)], "k string, o int, n int")
    for chars, items in ((100, 7), (250, 3), (10**9, 5), (100, 1)):
        got = {}
        for x in packing.pack_text_budget(df, ["k"], "o", "n", chars, items, stretch).collect():
            got.setdefault(x["k"], {})[x["o"]] = x["batch"]
        assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: slow(ns, chars, items) for k, ns in lengths.items()}


def test_one_sequence_of_all_rows(spark):
    n = 200_000
    df = spark.range(n).select("id", (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).alias("n"))
    lengths = [x["n"] for x in df.orderBy("id").collect()]
    got = packing.pack_text_budget(df, [], "id", "n", 18_000, 28).orderBy("id").collect()
    assert [x["batch"] for x in got] == slow(lengths, 18_000, 28)
    assert got[0].asDict().keys() == {"id", "n", "batch"}


def test_equal_places_and_nothing(spark):
    df = spark.createDataFrame([("a", 1, 10)] * 5 + [("a", 1, 1000)], "k string, o int, n int")
    got = packing.pack_text_budget(df, ["k"], "o", "n", 30, 3)
    assert got.count() == 6 and got.select("batch").distinct().count() in (3, 4)
    assert packing.pack_text_budget(df.limit(0), ["k"], "o", "n", 30, 3).collect() == []
    assert packing.batch_stats(packing.pack_text_budget(df.limit(0).withColumn("d", F.lit(True)), ["k"], "o", "n", 30, 3), ["k"], "n", "d").collect() == []


def test_stats(spark):
    df = spark.createDataFrame([("a", 0, 10, True), ("a", 0, 10, None), ("a", 1, 0, True), (None, 0, 5, True)], "k string, batch long, n int, done boolean")
    got = {r["k"]: r[1:] for r in packing.batch_stats(df, ["k"], "n", "done").collect()}
    assert got == {"a": (2, 3, 21, 1, 0.5), None: (1, 1, 5, 1, 1.0)}
