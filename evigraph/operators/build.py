"""A knowledge graph from drafts: entities deduplicated, relations gated, edges merged; nothing without evidence.

Inputs, one row for each draft in the order of ``ord`` within its project:

* entities: project_id, ord, name, canonical_name, type, aliases, summary, properties (map), importance, importance_reason, confidence,
  confidence_reason, evidence_ids, registry_id, classification (struct with confidence), members (structs with candidate_id)
* relations: project_id, ord, source, target, relation_type, evidence_ids, confidence, confidence_reason, status, conditions (map), scope
* evidence: project_id, evidence_id, document_id, block_id, text

Drafts may cite blocks or evidence. Nulls: an absent array or map is an empty one; an absent score is computed from the evidence. Every step
is a grouping or an equi-join, so that one entity, edge or block with most of the rows is spread over tasks; what several outputs need is written once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.scratch import discard, few, staged
from . import graph as G
from .assign import entity_keys
from .candidates import importance_signal, signal, signal_reason

GROUP = ["project_id", "key"]


@dataclass
class Plan:
    """What a project has agreed on. categories: id, label, ord. rules: label, ord, symmetric, requires_conditions, allow_inferred, sources, targets (category ids).
    types: labels allowed without a rule."""

    categories: DataFrame
    rules: DataFrame
    types: DataFrame
    threshold: float = 0.0


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame
    rejected: DataFrame  # kind, project_id, name, reason, missing


def materialise(blocks: DataFrame) -> DataFrame:
    """project_id, document_id, block_id, page, text -> + evidence_id, status: one reported evidence for each block."""
    return blocks.withColumns({"evidence_id": X.scoped_id(F.col("project_id"), "evidence", F.concat("block_id", F.lit("|reported"))), "status": F.lit("reported")})


def cited(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """project_id, ord, j, evidence_id, known, document_id, block_id, text: what a draft cites, each once, in its order; blocks by their evidence."""
    by = lambda c: evidence.select("project_id", F.col(c).alias("cite"), F.lit(c == "block_id").alias("block"), F.struct("evidence_id", "document_id", "block_id", "text").alias("e"))
    names = by("block_id").unionByName(by("evidence_id")).groupBy("project_id", "cite").agg(F.max_by("e", "block").alias("e"))
    rows = drafts.select("project_id", "ord", F.posexplode("evidence_ids").alias("j", "cite")).filter("cite is not null")
    met = rows.join(names.hint("merge"), ["project_id", "cite"], "left")
    each = met.groupBy("project_id", "ord", F.coalesce("e.evidence_id", "cite").alias("evidence_id")).agg(F.min("j").alias("j"), F.first("e").alias("e"))
    return staged(each.select("project_id", "ord", "j", "evidence_id", F.col("e").isNotNull().alias("known"), "e.document_id", "e.block_id", "e.text"), "build-cited")


def _checked(cites: DataFrame) -> DataFrame:
    """project_id, ord, n_valid, n_missing, missing in order."""
    lost = F.when(~F.col("known"), F.struct("j", "evidence_id"))
    got = cites.groupBy("project_id", "ord").agg(F.count_if("known").alias("n_valid"), F.array_sort(F.collect_list(lost)).alias("lost"))
    return got.select("project_id", "ord", "n_valid", F.size("lost").cast("long").alias("n_missing"), F.transform("lost", lambda x: x["evidence_id"]).alias("missing"))


def _in_order(rows: DataFrame, value: str, *place: str) -> DataFrame:
    """GROUP + the distinct values as an array, in the order of their first places."""
    first = rows.groupBy(*GROUP, value).agg(F.min(F.struct(*place)).alias("place"))
    return first.groupBy(*GROUP).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", value))), lambda x: x[value]).alias(value))


def _names(entities: DataFrame) -> DataFrame:
    """project_id, ord, i, name, form: display name (0), canonical name (1) and aliases (from 2), with their comparison forms."""
    every = F.concat(F.array("name", F.coalesce("canonical_name", "name")), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = X.nfkc(entities.select("project_id", "ord", F.posexplode(every).alias("i", "name")).filter("name is not null"), "name", "normal")
    return staged(rows.select("project_id", "ord", "i", "name", X.entity_key(F.col("normal")).alias("form")), "build-names")


def _best(value: str, reason: str, signal_: str, signal_reason_: str) -> tuple[list[Column], Column]:
    """Aggregates of a score over a group, and from them and the group's signal the first highest (value, reason)."""
    given = X.clamp01(F.col(value))
    absent = F.when(F.col(value).isNull(), F.col("ord"))
    aggregates = [
        F.max_by(F.struct(given.alias("v"), "ord", F.col(reason).alias("r")), F.when(given.isNotNull(), F.struct(given.alias("v"), (-F.col("ord")).alias("o")))).alias(f"{value}_given"),
        F.min_by(F.struct("ord", F.col(reason).alias("r")), absent).alias(f"{value}_absent"),
    ]
    g, a = F.col(f"{value}_given"), F.col(f"{value}_absent")
    own = F.struct(F.col(signal_).alias("v"), F.coalesce(a["r"], F.col(signal_reason_)).alias("r"))
    told = F.struct(g["v"].alias("v"), F.coalesce(g["r"], F.col(signal_reason_)).alias("r"))
    first = g.isNull() | (a.isNotNull() & ((F.col(signal_) > g["v"]) | ((F.col(signal_) == g["v"]) & (a["ord"] < g["ord"]))))
    return aggregates, F.when(first, own).otherwise(told)


def _grouped(entities: DataFrame, cites: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the drafts that count, with their group's key; all names of theirs; the rejected drafts)."""
    names = _names(entities)
    own = names.filter("i = 1 and form <> ''").select("project_id", "ord", F.col("form").alias("own"))
    checked = entities.join(own.hint("merge"), ["project_id", "ord"]).join(_checked(cites).hint("merge"), ["project_id", "ord"], "left").fillna(0, ["n_valid", "n_missing"])
    checked = staged(checked, "build-checked")
    good = (F.col("n_missing") == 0) & (F.col("n_valid") > 0)
    label = F.coalesce("canonical_name", "name")
    lost = F.when(F.col("n_missing") > 0, F.col("missing")).otherwise(F.array(F.lit("evidence required")))
    rejected = checked.filter(~good).select(F.lit("entity").alias("kind"), "project_id", label.alias("name"), F.lit("evidence").alias("reason"), lost.alias("missing"))
    fine = checked.filter(good)
    free = fine.filter("registry_id is null").select("project_id", "ord").join(names.filter("i > 0 and form <> ''").hint("merge"), ["project_id", "ord"])
    free = free.groupBy("project_id", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "form"))), lambda x: x["form"]).alias("names"))
    keys = staged(entity_keys(staged(free, "build-forms")).unionByName(fine.filter("registry_id is not null").select("project_id", "ord", F.col("registry_id").alias("key"))), "build-keys")
    return staged(fine.drop("missing", "n_valid", "n_missing").join(keys.hint("merge"), ["project_id", "ord"]), "build-grouped"), names.join(keys.hint("merge"), ["project_id", "ord"]), rejected


def _folded(grouped: DataFrame, names: DataFrame, cites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, names of nodes): each group of drafts as a node; project_id, form, node_id, type, since of what names it."""
    mine = grouped.select("project_id", "ord", "key").hint("merge")
    aliases = _in_order(names.filter("form <> key").withColumnRenamed("name", "alias"), "alias", "ord", "i").withColumnRenamed("alias", "aliases")
    values = grouped.select(*GROUP, "ord", F.explode("properties").alias("p", "v")).groupBy(*GROUP, "p").agg(F.max_by("v", "ord").alias("v"))
    values = values.groupBy(*GROUP).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "v")))).alias("properties"))
    proof = cites.filter("known").join(mine, ["project_id", "ord"])
    each = proof.groupBy(*GROUP, "evidence_id").agg(
        F.min(F.struct("ord", "j")).alias("place"), F.first("document_id").alias("document_id"), F.first("block_id").alias("block_id"), F.first(F.least(F.length(F.trim("text")) / 600.0, F.lit(1.0))).alias("m")
    )
    proof = each.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("e"), F.countDistinct("document_id").alias("d"), F.countDistinct("block_id").alias("b"), F.avg("m").alias("m"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence_id"))), lambda x: x["evidence_id"]).alias("evidence_ids"),
    )
    members = grouped.select(*GROUP, "ord", F.posexplode("members").alias("i", "member")).groupBy(*GROUP, "member.candidate_id")
    members = members.agg(F.min(F.struct("ord", "i")).alias("place"), F.max_by("member", F.struct("ord", "i")).alias("member"))
    members = members.groupBy(*GROUP).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "member"))), lambda x: x["member"]).alias("members"))
    parts = {c: _best(c, f"{c}_reason", f"{c}_signal", f"{c}_basis") for c in ("importance", "confidence")}
    rank = F.when(F.col("classification").isNotNull(), F.struct(F.col("classification.confidence").alias("c"), (-F.col("ord")).alias("o")))
    folded = grouped.groupBy(*GROUP).agg(
        F.min("ord").alias("ord"), F.count(F.lit(1)).alias("occurrences"), F.min_by(F.struct("name", F.coalesce("canonical_name", "name").alias("canonical"), F.coalesce("type", F.lit("Concept")).alias("type")), "ord").alias("first"),
        F.coalesce(F.min_by("summary", F.when(F.col("summary") != "", F.col("ord"))), F.lit("")).alias("summary"), F.max_by("classification", rank).alias("classification"),
        F.min_by("registry_id", F.when(F.col("registry_id").isNotNull(), F.col("ord"))).alias("registry_id"), *[a for p in parts.values() for a in p[0]],
    )
    for side in (proof, values, aliases, members):
        folded = folded.join(side.hint("merge"), GROUP, "left")
    counts = [F.col(c) for c in "edb"]
    folded = folded.withColumns({
        "confidence_signal": signal(*counts, F.col("m")), "confidence_basis": signal_reason(*counts, "confidence"), "importance_basis": signal_reason(*counts, "importance"),
        "importance_signal": importance_signal(*counts, F.col("occurrences"), F.coalesce(F.size("properties"), F.lit(0))),
    }).withColumns({c: p[1] for c, p in parts.items()})
    empty = lambda c: F.coalesce(c, F.array().cast(folded.schema[c].dataType)).alias(c)
    nodes = folded.select(
        "project_id", F.coalesce("registry_id", X.scoped_id(F.col("project_id"), "node", F.col("key"))).alias("node_id"), "ord", "key", F.col("first.canonical").alias("canonical_name"), F.col("first.name").alias("display_name"),
        "first.type", empty("aliases"), "summary", F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"),
        *[x for c in parts for x in (F.col(f"{c}.v").alias(c), F.col(f"{c}.r").alias(f"{c}_reason"))], "evidence_ids", "classification", "registry_id", empty("members"),
    )
    nodes = staged(nodes, "build-nodes")
    light = nodes.select(*GROUP, "node_id", "type", F.col("ord").alias("since"))
    shown = names.join(light.hint("merge"), GROUP).filter((F.col("form") != F.col("key")) | ((F.col("ord") == F.col("since")) & (F.col("i") < 2)))
    return nodes, shown.select("project_id", "form", "node_id", "type", "since")


def dedup_entities(entities: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, rejected): drafts under their registry entry, else under the earliest created key among their names, else under their own name.

    Of a node the first draft names it, properties and members of later drafts replace those of earlier ones, the first summary stays, the highest
    score wins (the first on ties), and of classifications the surest one.
    """
    cites = cited(entities, evidence)
    grouped, names, rejected = _grouped(entities, cites)
    return _folded(grouped, names, cites)[0], rejected


def _rules(plan: Plan) -> DataFrame:
    """The plan's rules with category ids in comparison form; labels allowed without a rule come as rules that ask nothing."""
    ids = lambda c: F.transform(c, lambda x: F.lower(F.trim(x)))
    rules = plan.rules.select("label", "ord", "symmetric", "requires_conditions", "allow_inferred", ids(F.col("sources")).alias("sources"), ids(F.col("targets")).alias("targets"), F.lit(True).alias("named"))
    nothing = F.array().cast("array<string>")
    free = plan.types.select(F.col("label"), F.lit(-1).cast(rules.schema["ord"].dataType).alias("ord"), F.lit(False).alias("symmetric"), F.lit(False).alias("requires_conditions"), F.lit(True).alias("allow_inferred"), nothing.alias("sources"), nothing.alias("targets"), F.lit(False).alias("named"))
    return rules.unionByName(free)


def build_graph(entities: DataFrame, relations: DataFrame, blocks: DataFrame, plan: Plan | None = None) -> Graph:
    """Nodes, edges, evidence and rejected drafts. Without a plan any relation type is allowed.

    An edge is what accepted drafts have in common: both nodes and the relation type in comparison form, in any direction if the rule is symmetric.
    The first draft gives its ends, status, conditions and scope; evidence is united; the confidence is ``running_edge_confidence``.
    """
    evidence = staged(materialise(blocks), "build-evidence")
    entities = staged(entities, "build-entities")
    cites = cited(entities, evidence)
    grouped, names, lost_entities = _grouped(entities, cites)
    nodes, shown = _folded(grouped, names, cites)
    index = staged(shown.groupBy("project_id", F.col("form").alias("key")).agg(F.max_by(F.struct("node_id", "type"), "since").alias("n")).select("project_id", "key", "n.node_id", "n.type"), "build-index")

    lost_entities = staged(lost_entities, "build-lost")
    discard(cites, entities)
    relations = staged(relations, "build-relations")
    cites = cited(relations, evidence)
    rows = relations.join(_checked(cites).hint("merge"), ["project_id", "ord"], "left").fillna(0, ["n_valid", "n_missing"])
    for end in ("source", "target"):
        rows = X.nfkc(rows, end, "normal").withColumn(f"{end}_key", X.entity_key(F.col("normal"))).drop("normal")
    rows = G.resolve_endpoints(rows, few(index))
    rows = rows.withColumnRenamed("conditions", "given").withColumn("conditions", F.when(F.size("given") > 0, "given"))
    if plan is None:
        rows = X.nfkc(rows, "relation_type", "normal").withColumns({"relation_key": X.label_key(F.col("normal")), "rule": F.lit(None).cast("string"), "symmetric": F.lit(False)})
        tests = F.coalesce(F.col("source_id").isNull() | F.col("target_id").isNull() | (F.col("source_id") == F.col("target_id")) | (F.col("n_missing") > 0) | (F.col("n_valid") == 0), F.lit(False))
        rows = rows.withColumn("reject", F.when(tests, "unresolved node or evidence"))
    else:
        labels = X.nfkc(plan.categories, "label", "normal").groupBy(X.label_key(F.col("normal")).alias("form")).agg(F.lower(F.trim(F.max_by("id", "ord"))).alias("category"))
        labels = staged(labels, "build-categories")
        small = labels.count() <= 1000
        for end in ("source", "target"):
            side = labels.withColumnRenamed("category", f"{end}_category")
            rows = X.nfkc(rows, f"{end}_type", "normal").withColumn("form", X.label_key(F.col("normal"))).drop("normal", f"{end}_type")
            rows = rows.join(F.broadcast(side) if small else side.hint("merge"), "form", "left").drop("form").withColumnRenamed(f"{end}_category", f"{end}_type")
        rows = G.relation_gate(rows, _rules(plan), plan.threshold)
    gated = staged(rows, "build-gated")

    lost = F.when(F.col("n_missing") > 0, F.col("missing")).otherwise(F.array(F.lit("unresolved node or evidence required")))
    lost_relations = gated.filter("reject is not null").select(F.lit("relation").alias("kind"), "project_id", F.concat_ws(" ", "source", "relation_type", "target").alias("name"), F.col("reject").alias("reason"), lost.alias("missing"))
    key = G.edge_key(F.col("relation_key"), F.col("source_id"), F.col("target_id"), F.coalesce("symmetric", F.lit(False)))
    kept = gated.filter("reject is null").withColumn("edge", X.scoped_id(F.col("project_id"), "edge", key))
    label = F.coalesce("rule", F.trim("relation_type"))
    lost_relations = staged(lost_relations, "build-lost")
    first = kept.groupBy("project_id", "edge").agg(
        F.min("ord").alias("ord"), F.min_by(F.struct("source_id", "target_id", label.alias("label"), F.coalesce("symmetric", F.lit(False)).alias("symmetric"), F.coalesce("status", F.lit("reported")).alias("status"), "given", "scope"), "ord").alias("f")
    )
    proof = cites.join(kept.select("project_id", "ord", "edge", "confidence", F.col("confidence_reason").alias("reason")).hint("merge"), ["project_id", "ord"])
    proof = staged(proof, "build-proof")
    discard(cites, relations)
    each = proof.groupBy("edge", "evidence_id").agg(F.min(F.struct("ord", "j")).alias("place"))
    lists = each.groupBy("edge").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence_id"))), lambda x: x["evidence_id"]).alias("evidence_ids"))
    score = G.running_edge_confidence(proof).select("edge", "confidence", "reason")
    first, lists, score = staged(first, "build-first"), staged(lists, "build-lists"), staged(score, "build-score")
    discard(gated, proof)
    edges = first.join(lists.hint("merge"), "edge").join(score.hint("merge"), "edge").select(
        "project_id", F.col("edge").alias("edge_id"), "ord", "f.source_id", "f.target_id", F.col("f.label").alias("relation_type"), F.when(F.col("f.symmetric"), "symmetric").otherwise("directed").alias("direction"),
        "confidence", F.col("reason").alias("confidence_reason"), "evidence_ids", F.col("f.status").alias("status"), F.col("f.given").alias("conditions"), "f.scope",
    )
    return Graph(nodes, staged(edges, "build-edges"), evidence, lost_entities.unionByName(lost_relations))
