"""Ownership of secrets against copies."""

from pyspark.sql import functions as F

from evigraph.llm import secrets

from .test_llm_operators import docs, rows


def test_copies_do_not_overrule_ownership(spark):
    token = lambda x: "ghp_" + x * 20
    data = [(i, f"mine {token('a')}", "s") for i in range(1000)]  # one owner, one text
    data += [(2000 + i, f"{i} mine {token('b')}", "s") for i in range(40)]  # one owner, many texts
    data += [(3000 + i, f"ours {token('c')}", f"s{i % 2}") for i in range(40)]  # two owners, one text
    data += [(4000 + i, f"{i} ours {token('d')}", f"s{i % 2}") for i in range(40)]  # two owners, many texts
    data += [(5000 + i, f"all {token('e')}", f"s{i}") for i in range(3)]  # three owners
    got = rows(secrets.scan(docs(spark, data)).select("doc_id", F.size("spans").alias("n")))
    assert len(got) == len(data)
    assert all(r["n"] == (r["doc_id"] < 4000) for r in got)
