"""Whole entries of analyses are dealt once, by document, and texts are searched for white space at their ends only if there is some."""

import re

from pyspark.sql import functions as F

from evigraph.functions import text as X
from evigraph.plans.contract_queries import document_analysis


def test_entries_are_dealt_once_by_document(spark, sf):
    shown = document_analysis(spark, sf)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    dealt = re.findall(r"Exchange hashpartitioning\((.*), \d+\)", shown)
    assert dealt and not any(c in by for by in dealt for c in ("sort#", "key#", "registry_entry_id"))


def test_ends_are_searched_only_where_white_space_is(spark):
    texts = [None, "", " ", "a", " a", "a b", "　a b\n", "﻿a﻿", "a\u0085", "\U0001f600 a", " \U0001f600", "a​"]
    plain = F.regexp_replace("t", r"(?U)^[\s﻿]+|[\s﻿]+\z", "")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.normalise_ends(F.col("t")).alias("x"), plain.alias("y"))
    assert all(r["x"] == r["y"] for r in got.collect())
    assert "CASE WHEN" in got._jdf.queryExecution().optimizedPlan().toString()
