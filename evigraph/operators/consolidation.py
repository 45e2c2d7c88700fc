"""Concepts from candidates: proposed groups become resolutions, registry entries, entities and a map of names, each candidate once.

Inputs: candidates (project_id, candidate_id, ord, decision, name, canonical_name, canonical_key, type, aliases, summary, properties, evidence_ids, claim_ids, importance); groups (project_id,
group_id, ord, canonical, registry_id, name, type, summary, confidence, reason; ord is total over all groups); members (group_id, member_id, place, action, reason); registry (project_id,
registry_id, name, type, summary, aliases, member_ids, claim_ids, evidence_ids, confidence, status); categories (project_id, ord, label) of the plans.

Ignored candidates don't take part. A member that a group proposes twice has its first place and its last action. Which group has a candidate is ``assign``; one without a group, or that its group
keeps separate, is a concept of its own. A group may go on with a registry entry of its project that isn't orphaned: that entry's name and type hold. Absent arrays and maps are empty ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.scratch import staged
from .assign import assign

# Actions that don't merge, the confidence below which a concept is reviewed, and the reasons of single candidates.
APART = ("keep_separate", "uncertain")
REVIEW = 0.82
UNCOVERED = "The candidate was not safely covered by an AI consolidation group."
SINGLE = "Safe fallback preserved this evidence-backed candidate as a separate concept."


@dataclass
class Consolidation:
    resolutions: DataFrame  # project_id, resolution_id, registry_id, canonical, name, type, summary, members (candidate_id, name, action, reason), confidence, reason, status, source
    registry: DataFrame  # project_id, entry, registry_id, name, type, summary, aliases, member_ids, claim_ids, evidence_ids, confidence, status
    entities: DataFrame  # project_id, entry, registry_id, name, type, summary, aliases, properties, importance, confidence, evidence_ids
    names: DataFrame  # project_id, form, name


def _lists(c: Column | str) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _first(c: str) -> Column:
    return F.nullif(F.coalesce(c, F.lit("")), F.lit(""))


def _key(df: DataFrame, col: str, out: str) -> DataFrame:
    return X.nfkc(df, col, "__n").withColumn(out, X.entity_key(F.col("__n"))).drop("__n")


def consolidate(candidates: DataFrame, groups: DataFrame, members: DataFrame, registry: DataFrame, categories: DataFrame, revision: int) -> Consolidation:
    able = staged(candidates.filter("coalesce(decision, '') <> 'ignore'"), "concept-candidates")
    known = members.join(able.select(F.col("candidate_id").alias("member_id")).hint("merge"), "member_id", "left_semi")
    known = staged(known.groupBy("group_id", "member_id").agg(F.min("place").alias("place"), F.max_by("action", "place").alias("action"), F.max_by("reason", "place").alias("m_reason")), "concept-members")
    offered = known.select("group_id", "member_id", F.when(F.col("action").isin(*APART), "keep_separate").otherwise("merge").alias("action"))
    kinds = staged(assign(groups.select("group_id", "ord", "canonical", "confidence"), offered).filter("group_id is not null"), "concept-kinds")
    taken = kinds.join(known.hint("merge"), ["group_id", "member_id"]).join(groups.select("group_id", F.col("ord").alias("g_ord")).hint("merge"), "group_id")
    placed = able.join(taken.withColumnRenamed("member_id", "candidate_id").hint("merge"), "candidate_id", "left")
    merged = F.coalesce(F.col("kind") == "merged", F.lit(False))
    # Concepts in order: a group, then its single members by their places, at last the candidates of no group in theirs.
    at = F.struct(F.when(F.col("group_id").isNull(), 1).otherwise(0).alias("a"), F.col("g_ord").alias("b"), F.when(merged, 0).otherwise(1).alias("c"), F.when(~merged, F.col("place")).alias("d"), F.when(F.col("group_id").isNull(), F.col("ord")).alias("e"))
    rows = staged(placed.withColumns({
        "merged": merged, "entry": F.when(merged, F.concat(F.lit("g|"), "group_id")).otherwise(F.concat(F.lit("c|"), "candidate_id")), "at": at,
        "action": F.when(merged, F.col("action")).otherwise("keep_separate"), "m_reason": F.when(merged, F.col("m_reason")).otherwise(UNCOVERED), "own": F.coalesce("canonical_name", "name"),
    }), "concept-rows")

    lead = groups.select(F.concat(F.lit("g|"), "group_id").alias("entry"), "canonical", *[F.col(c).alias(f"g_{c}") for c in ("registry_id", "name", "type", "summary", "confidence", "reason")])
    each = F.struct("place", "candidate_id", F.col("own").alias("name"), "action", F.col("m_reason").alias("reason"))
    told = F.transform(F.array_sort(F.collect_list(each)), lambda m: F.struct(m["candidate_id"].alias("candidate_id"), m["name"].alias("name"), m["action"].alias("action"), m["reason"].alias("reason")))
    claimed = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "candidate_id", _lists("claim_ids").alias("l")))), lambda m: m["l"])))
    proof = F.array_distinct(F.flatten(F.collect_list(_lists("evidence_ids"))))
    heads = rows.groupBy("entry").agg(F.first("project_id").alias("project_id"), F.first("merged").alias("merged"), F.first("at").alias("at"), F.first("candidate_id").alias("single"), told.alias("members"), claimed.alias("own_claims"), proof.alias("own_evidence"), F.max("importance").alias("importance"))
    heads = heads.join(lead.hint("merge"), "entry", "left").withColumn("canonical", F.coalesce("canonical", "single"))
    lead_row = able.select(F.col("candidate_id").alias("canonical"), "canonical_key", F.coalesce("canonical_name", "name").alias("c_name"), F.col("type").alias("c_type"), F.col("summary").alias("c_summary"))
    heads = heads.join(lead_row.hint("merge"), "canonical")
    old = registry.filter("coalesce(status, '') <> 'orphaned'").select("project_id", F.col("registry_id").alias("g_registry_id"), F.lit(True).alias("kept"), *[F.col(c).alias(f"r_{c}") for c in ("name", "type", "summary", "aliases", "member_ids", "claim_ids", "evidence_ids", "confidence")])
    heads = heads.join(old.hint("merge"), ["project_id", "g_registry_id"], "left")
    plan = categories.groupBy("project_id").agg(F.min_by("label", "ord").alias("__first"), F.collect_set("label").alias("__all"))  # a plan's few labels
    heads = heads.join(plan.hint("merge"), "project_id", "left")
    safe = lambda c: F.when(F.array_contains("__all", F.col(c)), F.col(c))
    name = F.coalesce("r_name", "g_name", "c_name")
    heads = heads.withColumns({
        "registry_id": F.when(F.col("kept"), F.col("g_registry_id")).otherwise(X.scoped_id(F.col("project_id"), "concept", F.col("canonical_key"), 20)), "name": name, "type": F.coalesce("r_type", safe("g_type"), safe("c_type"), "__first"),
        "summary": F.coalesce(_first("g_summary"), _first("r_summary"), _first("c_summary"), name), "proposed": F.when(F.col("merged"), F.col("g_confidence")).otherwise(1.0),
    })
    both = lambda a, b: F.array_distinct(F.concat(_lists(a), _lists(b)))
    ids = F.transform("members", lambda m: m["candidate_id"])
    heads = heads.withColumns({
        "confidence": F.greatest(F.coalesce("r_confidence", F.lit(0.0)), "proposed"), "status": F.when(F.col("merged") & (F.col("proposed") < REVIEW), "needs_review").otherwise("active"), "source": F.when(F.col("merged"), "ai").otherwise("fallback"),
        "member_ids": both("r_member_ids", ids), "claim_ids": both("r_claim_ids", "own_claims"), "evidence_ids": F.array_sort(both("r_evidence_ids", "own_evidence")), "reason": F.when(F.col("merged"), F.col("g_reason")).otherwise(SINGLE),
    })
    heads = staged(_key(heads.drop("__first", "__all"), "name", "title"), "concept-heads")

    said = rows.select("project_id", "entry", "at", F.lit(1).alias("late"), "place", "candidate_id", F.posexplode(F.concat(F.array("name", "canonical_name"), _lists("aliases"))).alias("i", "alias"))
    before = heads.select("project_id", "entry", "at", F.lit(0).alias("late"), F.lit(None).cast(rows.schema["place"].dataType).alias("place"), F.lit(None).cast("string").alias("candidate_id"), F.posexplode(_lists("r_aliases")).alias("i", "alias"))
    said = _key(said.unionByName(before).filter("coalesce(alias, '') <> ''"), "alias", "form")
    said = staged(said.join(heads.select("entry", "title", F.col("name").alias("concept")).hint("merge"), "entry"), "concept-names")
    first = said.filter("form <> title").groupBy("entry", "alias").agg(F.min(F.struct("late", "place", "candidate_id", "i")).alias("p"))
    aliases = first.groupBy("entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "alias"))), lambda x: x["alias"]).alias("aliases"))
    values = rows.join(heads.select("entry", "canonical").hint("merge"), "entry").select("entry", F.struct((F.col("candidate_id") != F.col("canonical")).alias("a"), "place", "candidate_id").alias("o"), F.explode("properties").alias("p", "v"))
    values = values.groupBy("entry", "p").agg(F.min_by("v", "o").alias("v")).groupBy("entry").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "v")))).alias("properties"))
    whole = heads.join(aliases.hint("merge"), "entry", "left").withColumn("aliases", _lists("aliases"))
    whole = staged(whole.join(values.hint("merge"), "entry", "left").withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>"))), "concepts")

    mark = F.concat_ws("|", F.lit(str(revision)), "registry_id", F.array_join(F.array_sort(ids), "|"))
    resolutions = whole.select("project_id", X.scoped_id(F.col("project_id"), "resolution", mark, 20).alias("resolution_id"), "registry_id", "canonical", "name", "type", "summary", "members", F.col("proposed").alias("confidence"), "reason", F.when(F.col("status") == "active", "accepted").otherwise("needs_review").alias("status"), "source")
    entries = whole.select("project_id", "entry", "registry_id", "name", "type", "summary", "aliases", "member_ids", "claim_ids", "evidence_ids", "confidence", "status")
    entities = whole.select("project_id", "entry", "registry_id", "name", "type", "summary", "aliases", "properties", "importance", "confidence", "evidence_ids")
    names = said.filter("late = 1").groupBy("project_id", "form").agg(F.max_by("concept", F.struct("at", "place", "candidate_id", "i")).alias("name"))  # the last one holds
    return Consolidation(resolutions, entries, entities, names)
