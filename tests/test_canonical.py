"""Canonical JSON doesn't depend on the order of keys at any level."""

import json

from pyspark.sql import functions as F

from evigraph.functions import text as X


def test_order_of_keys(spark):
    kind = "a map<string,struct<z:int,b:array<map<string,string>>>>"
    one = {"y": {"z": 1, "b": [{"q": "1", "p": "é", "gone": None}, None]}, "x": {"z": None, "b": []}, "none": None}
    two = {k: one[k] for k in ("none", "x", "y")}
    two["y"] = {"b": [{"p": "é", "q": "1"}, None], "z": 1}
    got = [r["j"] for r in X.nested_json(spark.createDataFrame([(one,), (two,), (None,), ({},)], kind), "a", "j").collect()]
    want = json.dumps({"x": {"b": []}, "y": {"b": [{"p": "é", "q": "1"}, None], "z": 1}}, separators=(",", ":"), ensure_ascii=False)
    assert got == [want, want, None, "{}"]


def test_struct_fields_by_name(spark):
    df = spark.range(1).select(F.struct(F.lit(2).alias("b"), F.struct(F.lit(None).cast("int").alias("d"), F.lit("x").alias("c")).alias("a")).alias("v"))
    assert X.nested_json(df, "v", "j").first()["j"] == '{"a":{"c":"x"},"b":2}'
