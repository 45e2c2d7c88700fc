"""Candidates: merging by name, scores, decisions; upserts of candidates and registry entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Fixed values: (publish, review) thresholds by quality preference.
THRESHOLDS = {"precision": (0.68, 0.42), "balanced": (0.58, 0.34), "recall": (0.48, 0.28)}


def saturation(n: Column) -> Column:
    """0 for none, towards 1 for many."""
    return 1 - F.exp(-n.cast("double"))


def signal(evidence: Column, documents: Column, blocks: Column, mass: Column) -> Column:
    """Confidence from the numbers of distinct evidence, documents and blocks, and the mean share of a full text."""
    e, d, b = (saturation(c) for c in (evidence, documents, blocks))
    return X.clamp01(0.12 + 0.38 * e + 0.22 * d + 0.18 * mass + 0.10 * b)


# How the two scores are explained where none was given.
REASONS = {"confidence": "基于%s 条证据、%s 个来源文档、%s 个证据块及原文完整度计算。", "importance": "基于%s 条证据、%s 个来源文档、%s 个证据块、重复出现次数和结构化属性覆盖度计算。"}


def signal_reason(evidence: Column, documents: Column, blocks: Column, of: str) -> Column:
    return F.format_string(REASONS[of], *[c.cast("string") for c in (evidence, documents, blocks)])


def importance_signal(evidence: Column, documents: Column, blocks: Column, occurrences: Column, properties: Column) -> Column:
    e, d, b, o, p = (saturation(c) for c in (evidence, documents, blocks, occurrences, properties))
    return X.clamp01(0.08 + 0.27 * e + 0.24 * b + 0.18 * d + 0.13 * o + 0.10 * p)


def evidence_signal(item_evidence: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """keys + confidence, importance, from evidence, documents, blocks, text mass, occurrences and properties.

    ``item_evidence``: keys, evidence_id, document_id, block_id, text; one row for each bound evidence. ``items``: keys, occurrences, properties.
    """
    got = item_evidence.groupBy(*keys).agg(
        F.countDistinct("evidence_id").alias("e"), F.countDistinct("document_id").alias("d"), F.countDistinct("block_id").alias("b"),
        F.avg(F.least(F.length(F.trim("text")) / 600.0, F.lit(1.0))).alias("mass"),
    )
    return got.join(items.hint("merge"), keys).select(
        *keys, signal(F.col("e"), F.col("d"), F.col("b"), F.col("mass")).alias("confidence"),
        importance_signal(*[F.col(c) for c in ("e", "d", "b", "occurrences", "properties")]).alias("importance"),
    )


def merge_candidate_entities(entities: DataFrame) -> DataFrame:
    """One row for each project and normalised name: the longest summary represents (first on ties).

    ``entities``: project_id, ord, key, name, type, summary, importance, has_props, alias.
    """
    seen = F.struct(F.length("summary").alias("n"), (-F.col("ord")).alias("o"))
    return entities.groupBy("project_id", "key").agg(
        F.max_by(F.struct("name", "type", "summary", "ord"), seen).alias("r"), F.nullif(F.max("importance"), F.lit(0.0)).alias("importance"), F.bool_or("has_props").alias("has_props"),
        F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"), F.count(F.lit(1)).alias("members"),
    ).select("project_id", "key", "r.name", "r.type", "r.summary", F.col("r.ord").alias("ord"), "importance", "has_props", "aliases", "members")


def candidate_scores(candidates: DataFrame, support: DataFrame) -> DataFrame:
    """Sub-scores and the unrounded total. ``support``: project_id, key, block_id, document_id, text, distinct."""
    got = support.groupBy("project_id", "key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document_id").alias("d"), F.sum(F.length("text")).alias("mass"))
    joined = candidates.join(got, ["project_id", "key"], "left")
    n, d, mass = (F.coalesce(c, F.lit(0)).cast("double") for c in ("n", "d", "mass"))
    s = F.length(F.coalesce("summary", F.lit("")))
    one = F.lit(1.0)
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    props, alias = F.col("has_props"), F.col("aliases") != ""
    relevance = X.clamp01(F.coalesce("importance", F.lit(0.6)))
    evidence = X.clamp01(0.35 + 0.15 * F.least(F.lit(2.0), F.greatest(F.lit(0.0), n - 1)) + 0.2 * F.least(one, F.greatest(F.lit(0.0), d - 1)) + 0.3 * F.least(one, mass / 900))
    independence = X.clamp01(0.25 + F.when(s >= 40, 0.35).when(s >= 15, 0.2).otherwise(0.0) + flag(props, 0.2) + flag(n > 1, 0.1))
    completeness = X.clamp01(0.25 + flag(s > 0, 0.3) + flag(props, 0.25) + flag(F.coalesce("type", F.lit("")) != "", 0.1) + flag(alias, 0.1))
    out = joined.select("project_id", "key", "name", "type", n.cast("long").alias("evidence_blocks"), d.cast("long").alias("documents"), relevance.alias("relevance"), evidence.alias("evidence"), independence.alias("independence"), completeness.alias("completeness"))
    return out.withColumn("total", X.clamp01(0.45 * F.col("relevance") + 0.3 * F.col("evidence") + 0.15 * F.col("independence") + 0.1 * F.col("completeness")))


def candidate_decision(scored: DataFrame, preference: str = "balanced", minimum: int = 1) -> DataFrame:
    """+ decision and reason; totals decide unrounded and are stored with 4 digits."""
    publish, review = THRESHOLDS[preference]
    few, alone = F.col("evidence_blocks") < minimum, F.col("independence") < 0.5
    decision = F.when(few, "ignore").when((F.col("total") >= publish) & ~alone, "publish").when(F.col("total") >= review, "review").otherwise("ignore")
    reason = F.when(few, "too little evidence").when(alone, "no independent meaning").when(F.col("total") >= publish, "above the publish threshold").when(F.col("total") >= review, "above the review threshold").otherwise("below the thresholds")
    return scored.select(
        "project_id", "key", "name", "type", "evidence_blocks", "documents", *[X.round4(F.col(c)).alias(c) for c in ("relevance", "evidence", "independence", "completeness", "total")],
        decision.alias("decision"), reason.alias("reason"),
    )


def _merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    o = old.select(F.col(key), F.struct(*old.columns).alias("o"))
    n = new.select(F.col(key), F.struct(*new.columns).alias("n"))
    return o.join(n, key, "full")


def union_lists(a: Column, b: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)))


def merge_candidates(old: DataFrame, new: DataFrame, lists: tuple[str, ...]) -> DataFrame:
    """By candidate_id: incoming wins, created_at is kept, list columns are united."""
    pick = lambda c: F.when(F.col("n").isNotNull(), F.col("n")[c]).otherwise(F.col("o")[c])
    cols = []
    for c in old.columns:
        if c in lists:
            cols.append(union_lists(F.col("o")[c], F.col("n")[c]).alias(c))
        elif c == "created_at":
            cols.append(F.coalesce(F.col("o")[c], F.col("n")[c]).alias(c))
        else:
            cols.append(pick(c).alias(c))
    return _merged(old, new, "candidate_id").select(*cols)


def merge_registry(old: DataFrame, new: DataFrame, lists: tuple[str, ...]) -> DataFrame:
    """By registry_id: the higher confidence (incoming on ties) names the entry, lists are united, active if either is."""
    o, n = F.col("o"), F.col("n")
    stronger = F.when(o.isNull() | (n["confidence"] >= o["confidence"]), n).otherwise(o)
    cols = []
    for c in old.columns:
        if c in lists:
            cols.append(union_lists(o[c], n[c]).alias(c))
        elif c == "status":
            either = (F.coalesce(o[c], F.lit("")) == "active") | (F.coalesce(n[c], F.lit("")) == "active")
            cols.append(F.when(either, "active").otherwise(stronger[c]).alias(c))
        elif c == "created_at":
            cols.append(F.coalesce(o[c], n[c]).alias(c))
        elif c == "updated_at":
            cols.append(F.coalesce(n[c], o[c]).alias(c))
        else:
            cols.append(stronger[c].alias(c))
    return _merged(old, new, "registry_id").select(*cols)


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """By node_id: the old name and type stay, first non-empty summary, highest scores (a reason changes only with a higher one), evidence united."""
    o, n = F.col("o"), F.col("n")
    old_or_new = lambda c: F.when(o.isNotNull(), o[c]).otherwise(n[c]).alias(c)
    higher = o.isNull() | (n["confidence"] > o["confidence"])
    return _merged(old, new, "node_id").select(
        old_or_new("node_id"), old_or_new("name"), old_or_new("type"), F.coalesce(F.nullif(o["summary"], F.lit("")), n["summary"], o["summary"]).alias("summary"),
        F.greatest(o["confidence"], n["confidence"]).alias("confidence"), F.when(higher, n["reason"]).otherwise(o["reason"]).alias("reason"),
        union_lists(o["evidence_ids"], n["evidence_ids"]).alias("evidence_ids"),
    )


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """By edge_id: evidence united, highest confidence."""
    o, n = F.col("o"), F.col("n")
    return _merged(old, new, "edge_id").select(
        F.coalesce(o["edge_id"], n["edge_id"]).alias("edge_id"), F.greatest(o["confidence"], n["confidence"]).alias("confidence"), union_lists(o["evidence_ids"], n["evidence_ids"]).alias("evidence_ids")
    )


def stable_summaries(old: DataFrame, new: DataFrame, drafts: DataFrame, sets: tuple[str, ...] = ("evidence_ids", "claim_ids", "member_ids")) -> DataFrame:
    """registry_id, summary, changed: an entry whose ``sets`` are all as before keeps its summary; otherwise the draft or the current one."""
    empty = F.array().cast("array<string>")
    as_set = lambda side, c: F.array_sort(F.array_distinct(F.coalesce(F.col(side)[c], empty)))
    same = F.col("o").isNotNull()
    for c in sets:
        same = same & (as_set("o", c) == as_set("n", c))
    joined = _merged(old, new, "registry_id").filter(F.col("n").isNotNull()).join(drafts.select("registry_id", F.col("summary").alias("draft")), "registry_id", "left")
    return joined.select("registry_id", F.when(same, F.col("o")["summary"]).otherwise(F.coalesce(F.nullif("draft", F.lit("")), F.col("n")["summary"])).alias("summary"), (~same).alias("changed"))
