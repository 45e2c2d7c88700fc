"""Fingerprints of ordered rows as hash trees, so that no task holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import staged
from .order import numbered

FANOUT = 256


def hash_tree(rows: DataFrame, by: list[str], order: list[str], leaf: str, out: str = "fingerprint", fanout: int = FANOUT) -> DataFrame:
    """by + ``out`` and ``leaves``: the root over the digests in ``leaf``, in ``order`` within each group.

    Every ``fanout`` consecutive nodes (the last run may be shorter) are joined by commas and hashed, level by level until a group has one node; a single leaf is hashed once.
    Null groups are groups, and a null digest is an empty text. ``order`` must be total, or rows with equal order equal in ``leaf``.
    """
    names = [f"__o{i}" for i in range(len(order))]
    leaves = rows.select(F.struct(*by).alias("__k"), *[F.col(o).alias(n) for o, n in zip(order, names)], F.coalesce(leaf, F.lit("")).alias("h"))
    level = numbered(leaves, ["__k"], *[F.col(n) for n in names], name="at", total="leaves").select("__k", "leaves", (F.col("at") - 1).alias("at"), "h")
    done, most = None, 1
    while True:
        most *= fanout
        digests = F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"])  # fanout at most
        up = level.groupBy("__k", "leaves", F.floor(F.col("at") / fanout).alias("up")).agg(F.sha2(F.array_join(digests, ",").cast("binary"), 256).alias("h"))
        up = staged(up.withColumnRenamed("up", "at"), "hash-level")
        roots, level = up.filter(F.col("leaves") <= most), up.filter(F.col("leaves") > most)
        done = roots if done is None else done.unionByName(roots)
        if level.isEmpty():
            return done.select("__k.*", F.col("h").alias(out), "leaves")


def manifest_documents(blocks: DataFrame, fields: tuple[str, ...] = ("ord", "text"), order: str = "ord") -> DataFrame:
    """document_id, block_count, fingerprint of its blocks in order; ``fields`` are what counts of a block (page, section, type, location and text where it has them)."""
    cell = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("-")) for f in fields]).cast("binary"), 256)
    roots = hash_tree(blocks.withColumn("__cell", cell), ["document_id"], [order], "__cell")
    return roots.select("document_id", F.col("leaves").alias("block_count"), "fingerprint")


def input_fingerprint(manifest: DataFrame, versions: str) -> DataFrame:
    """project_id, fingerprint of its documents' fingerprints, free of ids and time."""
    roots = hash_tree(manifest, ["project_id"], ["fingerprint"], "fingerprint", out="root")
    return roots.select("project_id", F.sha2(F.concat_ws("|", F.lit(versions), "root").cast("binary"), 256).alias("fingerprint"))


def plan_fingerprint(plan: DataFrame) -> DataFrame:
    """project_id, fingerprint of (kind, label, value) rows, whatever their order."""
    cells = plan.select("project_id", F.sha2(F.concat_ws("|", "kind", "label", "value").cast("binary"), 256).alias("cell"))
    return hash_tree(cells, ["project_id"], ["cell"], "cell").drop("leaves")


def manifest_order(documents: DataFrame, content_hash: str, name: str) -> DataFrame:
    """``documents`` with their ``place`` (from 1) in the manifest of their project: by content, then by ``name``, which tells the documents of a project apart. Null projects are one."""
    keyed = documents.withColumn("__project", F.struct("project_id"))
    return numbered(keyed, ["__project"], F.col(content_hash), F.col(name)).drop("__project")
