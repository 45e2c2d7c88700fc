"""Graph building and reading: endpoints, relation gate, edges, search, neighbourhoods, retrieval, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.scratch import few, staged
from .candidates import signal, signal_reason
from .order import running_sums


def split_evidence_ids(cited: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """keys + n_valid, n_missing of the distinct cited ids. ``cited``: keys, evidence_id."""
    known = evidence.select("evidence_id", F.lit(True).alias("ok"))
    rows = cited.select(*keys, "evidence_id").distinct().join(known.hint("merge"), "evidence_id", "left")
    return rows.groupBy(*keys).agg(F.count("ok").alias("n_valid"), (F.count(F.lit(1)) - F.count("ok")).alias("n_missing"))


def name_index(nodes: DataFrame) -> DataFrame:
    """project_id, key, node_id, type: the last node that registers a name has it.

    ``nodes``: project_id, node_id, ord, type, names (canonical, display, aliases in this order, already normalised).
    """
    rows = nodes.select("project_id", "node_id", "ord", "type", F.posexplode("names").alias("i", "key")).filter("key <> ''")
    last = F.struct("ord", "i")
    return rows.groupBy("project_id", "key").agg(F.max_by(F.struct("node_id", "type"), last).alias("n")).select("project_id", "key", "n.node_id", "n.type")


def resolve_endpoints(relations: DataFrame, names: DataFrame) -> DataFrame:
    """``relations`` (project_id, source_key, target_key, ...) + source_id, source_type, target_id, target_type; null if unknown."""
    for end in ("source", "target"):
        side = names.select("project_id", F.col("key").alias(f"{end}_key"), F.col("node_id").alias(f"{end}_id"), F.col("type").alias(f"{end}_type"))
        relations = relations.join(side, ["project_id", f"{end}_key"], "left")
    return relations


def relation_gate(relations: DataFrame, rules: DataFrame, threshold: float) -> DataFrame:
    """+ relation_key, rule (its label, or null) and reject, the first reason against a relation, or null.

    ``rules`` (a plan has at most 24): label, symmetric, requires_conditions, allow_inferred, sources, targets (empty: any type), and ord if labels can
    repeat: labels are compared without case and in NFKC, and the last rule of a label holds. With ``named`` false a rule doesn't lend its label.
    """
    order = F.col("ord") if "ord" in rules.columns else F.lit(0)
    named = X.nfkc(rules, "label", "normal").withColumns({"relation_key": X.label_key(F.col("normal")), "place": order})
    lent = F.when(F.col("named"), F.col("label")) if "named" in rules.columns else F.col("label")
    named = named.withColumn("label", lent)
    fields = ("label", "symmetric", "requires_conditions", "allow_inferred", "sources", "targets")
    r = staged(named.groupBy("relation_key").agg(F.max_by(F.struct(*fields), "place").alias("r")).select("relation_key", F.col("r.label").alias("rule"), F.lit(True).alias("known"), *[f"r.{f}" for f in fields[1:]]), "gate-rules")
    small = r.count() <= 1000
    allowed = lambda types, t: (F.size(types) == 0) | F.coalesce(F.array_contains(types, F.col(t)), F.lit(False))
    tests = [
        ("source unresolved", F.col("source_id").isNull()), ("target unresolved", F.col("target_id").isNull()), ("same node", F.col("source_id") == F.col("target_id")),
        ("missing evidence", F.col("n_missing") > 0), ("no evidence", F.col("n_valid") == 0), ("unknown relation type", F.col("known").isNull()),
        ("source type", ~allowed("sources", "source_type")), ("target type", ~allowed("targets", "target_type")), ("inferred", (F.col("status") == "inferred") & ~F.col("allow_inferred")),
        ("conditions", F.col("requires_conditions") & (F.coalesce("conditions", F.lit("")) == "")), ("confidence", F.col("confidence") < threshold),
    ]
    keyed = X.nfkc(relations, "relation_type", "__normal").withColumn("relation_key", X.label_key(F.col("__normal"))).drop("__normal")
    met = keyed.join(F.broadcast(r) if small else r.hint("merge"), "relation_key", "left")
    return met.withColumn("reject", F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in tests]))


def edge_key(relation_key: Column, source: Column, target: Column, symmetric: Column) -> Column:
    """What duplicates of an edge have in common; the ends of a symmetric relation in order."""
    a = F.when(symmetric, F.least(source, target)).otherwise(source)
    b = F.when(symmetric, F.greatest(source, target)).otherwise(target)
    return F.concat_ws("|", a, relation_key, b)


def running_edge_confidence(rows: DataFrame) -> DataFrame:
    """edge + confidence, reason and evidence: the highest value of its drafts in order (the last on ties), each being the given confidence or, where
    absent, the signal of the evidence that the edge has once the draft's is added.

    ``rows``: edge, ord (of the draft), confidence (or null), evidence_id, document_id, block_id, text, and reason if drafts give one; a row for each
    evidence of a draft. What was seen before counts once. First occurrences come from groupings, running totals from ranges, so that one edge
    with most of the drafts is spread over tasks.
    """
    given = F.col("reason") if "reason" in rows.columns else F.lit(None).cast("string")
    rows = staged(rows.select("edge", "ord", "confidence", given.alias("reason"), "evidence_id", "document_id", "block_id", F.least(F.length(F.trim("text")) / 600.0, F.lit(1.0)).alias("m")), "edge-drafts")
    first = rows.groupBy("edge", "evidence_id").agg(F.min("ord").alias("ord"), F.first("document_id").alias("document_id"), F.first("block_id").alias("block_id"), F.first("m").alias("m"))
    none = F.lit(0)
    steps = first.select("edge", "ord", F.lit(1).alias("e"), none.alias("d"), none.alias("b"), "m")
    for c, name in (("d", "document_id"), ("b", "block_id")):
        step = first.groupBy("edge", name).agg(F.min("ord").alias("ord"))
        steps = steps.unionByName(step.select("edge", "ord", none.alias("e"), F.lit(int(c == "d")).alias("d"), F.lit(int(c == "b")).alias("b"), F.lit(0.0).alias("m")))
    added = steps.groupBy("edge", "ord").agg(*[F.sum(c).alias(c) for c in "edbm"])
    drafts = rows.groupBy("edge", "ord").agg(F.first("confidence").alias("confidence"), F.first("reason").alias("reason"))
    seen = running_sums(drafts.join(added.hint("merge"), ["edge", "ord"], "left").fillna(0, list("edbm")), ["edge"], "ord", *"edbm")
    value = F.coalesce(X.clamp01(F.col("confidence")), signal(F.col("e"), F.col("d"), F.col("b"), F.col("m") / F.col("e")))
    best = seen.withColumns({"value": value, "reason": F.coalesce("reason", signal_reason(F.col("e"), F.col("d"), F.col("b"), "confidence"))})
    return best.groupBy("edge").agg(F.max("value").alias("confidence"), F.max_by("reason", F.struct("value", "ord")).alias("reason"), F.max("e").alias("evidence"))


def touching(edges: DataFrame, ids: DataFrame, both: bool = False) -> DataFrame:
    """Edges with an end (or both ends) in ``ids`` (id): two equi-joins, not a nested loop, and each edge goes through them once."""
    ids = ids.select("id").distinct()
    at = lambda e: edges.join(ids.withColumnRenamed("id", e), e, "left_semi")
    if both:
        return at("source_id").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*edges.columns)
    flagged = lambda rows, end, flag: rows.join(ids.select(F.col("id").alias(end), F.lit(True).alias(flag)), end, "left")
    met = flagged(flagged(edges, "source_id", "__source"), "target_id", "__target")
    return met.filter(F.coalesce("__source", "__target")).select(*edges.columns)


def neighbors(edges: DataFrame, nodes: DataFrame, centre: DataFrame, relation: str | None = None, node_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) one hop around the centre; a type filter also removes the centre; edges are not filtered by it."""
    near = touching(edges if relation is None else edges.filter(F.col("relation_type") == relation), centre)
    ends = near.select(F.col("source_id").alias("node_id")).union(near.select("target_id")).union(centre.select("id")).distinct()
    found = nodes.join(ends, "node_id", "left_semi")
    return (found if node_type is None else found.filter(F.col("type") == node_type)), near


def related_nodes(edges: DataFrame, centre: DataFrame) -> DataFrame:
    """Distinct (id, node_id) adjacent in either direction."""
    c = centre.select("id").distinct()
    out = edges.join(c, edges["source_id"] == c["id"]).select("id", F.col("target_id").alias("node_id"))
    back = edges.join(c, edges["target_id"] == c["id"]).select("id", F.col("source_id").alias("node_id"))
    return out.union(back).distinct()


def all_terms(text: Column, query: str) -> Column:
    out = F.lit(True)
    for term in query.lower().split():
        out = out & F.contains(F.lower(text), F.lit(term))
    return out


def search(nodes: DataFrame, edges: DataFrame, node_evidence: DataFrame, edge_evidence: DataFrame, evidence: DataFrame, query: str, limit: int | None = 100, node_types: list[str] | None = None, relation_types: list[str] | None = None) -> DataFrame:
    """kind (node, edge, evidence), id of what a query finds.

    Nodes: all terms in the names, summary, aliases and property values together, or in one evidence text; the first ``limit`` (null: all) by ord. Edges: with an end
    among the nodes found, or all terms in their relation; of these the first ``limit`` that touch a shown node. Evidence: of what is shown.
    ``nodes``: node_id, ord, type, name, display_name, summary, aliases, properties (text). Types are compared without regard to case. ``evidence`` may have ``shown_as``, the id
    to return where links know it by another.
    """
    allowed = lambda c, types: F.lit(True) if types is None else F.lower(F.trim(c)).isin([t.strip().lower() for t in types])
    hit = evidence.filter(all_terms(F.col("original_text"), query)).select("evidence_id")
    by_evidence = node_evidence.join(hit, "evidence_id", "left_semi").select("node_id")
    by_text = nodes.filter(all_terms(F.concat_ws(" ", "name", "display_name", "summary", "aliases", "properties"), query)).select("node_id")
    found = nodes.filter(allowed(F.col("type"), node_types)).join(by_text.union(by_evidence).distinct(), "node_id", "left_semi").select("node_id", "ord")
    top = lambda rows, *by: rows if limit is None else rows.orderBy(*by).limit(max(1, limit))
    shown = staged(top(found, "ord", "node_id"), "search-nodes")  # edges with a shown end are among those of found nodes
    shown = few(shown)
    near = touching(edges.filter(allowed(F.col("relation_type"), relation_types)), shown.select(F.col("node_id").alias("id")))
    near = top(near, "edge_id")
    cited = node_evidence.join(shown, "node_id", "left_semi").select("evidence_id").union(edge_evidence.join(near, "edge_id", "left_semi").select("evidence_id")).distinct()
    part = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("id"))
    proof = evidence.join(cited.hint("merge"), "evidence_id", "left_semi")
    return part(shown, "node", "node_id").union(part(near, "edge", "edge_id")).union(part(proof, "evidence", "shown_as" if "shown_as" in evidence.columns else "evidence_id"))


def search_simple(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, project: str | None, query: str) -> DataFrame:
    """kind, id of what a project (null: each of them) shows for a query taken as one substring: nodes with it in their names, summary and aliases together (in any case),
    edges with such an end, and all evidence of the project. An empty query finds all nodes."""
    mine = lambda rows: rows if project is None else rows.filter(F.col("project_id") == project)
    shown = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("display_name", "name", "summary", "aliases")]))
    found = staged(mine(nodes).filter(F.contains(shown, F.lit(query.lower()))).select(F.col("node_id").alias("id")), "search-nodes")
    part = lambda rows, kind, c: rows.select(F.lit(kind).alias("kind"), F.col(c).alias("id"))
    return part(found, "node", "id").union(part(touching(mine(edges), found), "edge", "edge_id")).union(part(mine(evidence), "evidence", "evidence_id"))


def node_catalog(nodes: DataFrame, n: int = 160) -> DataFrame:
    return nodes.orderBy(F.desc("importance"), F.desc("confidence"), "node_id").limit(n)


def excerpts(links: DataFrame, evidence: DataFrame, key: str, k: int, chars: int, on: str = "evidence_id") -> DataFrame:
    """key + the first ``k`` evidence texts by id, clipped. ``links``: key, evidence_id, and ``on`` if evidence has another column that tells it apart."""
    rows = links.join(evidence.select(on, F.substring("original_text", 1, chars).alias("x")).hint("merge"), on)
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("evidence_id"))).filter(F.col("r") <= k)
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "x"))), lambda s: s["x"]), " / ").alias("excerpts"))


def retrieve_context(
    questions: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame, node_evidence: DataFrame, edge_evidence: DataFrame,
    n_seeds: int = 8, n_edges: int = 12, n_nodes: int = 12, n_evidence: int = 36,
) -> DataFrame:
    """question, kind (node, edge, evidence), id: what an answer may use; no text.

    ``questions``: question, node_id, ord; ``nodes``, ``evidence``: id, ord; ``edges``: edge_id, ord, confidence, source_id, target_id. Of a question's known seeds the first ones
    count; its edges are those touching one, by falling confidence; its nodes the seeds, then the edges' other ends in the order of the
    table; its evidence that of these nodes and edges, in the order of the table. Ties go to the smaller id. Nodes without any of this evidence are left out, and so are
    edges without, or without one of their ends. All questions are answered in one pass; each limit is applied before rows are shuffled. A question without known seeds has no rows.
    """
    top = lambda df, k, *order: df.withColumn("__r", F.row_number().over(Window.partitionBy("question").orderBy(*order))).filter(F.col("__r") <= k)
    place = nodes.groupBy("node_id").agg(F.min("ord").alias("place"))
    known = questions.groupBy("question", "node_id").agg(F.min("ord").alias("ord")).join(place.select("node_id"), "node_id", "left_semi")
    seed = staged(top(known, n_seeds, F.col("ord"), F.col("node_id")).select("question", "node_id", F.col("__r").cast("long").alias("o")), "context-seeds")
    ends = [edges.join(seed.select("question", F.col("node_id").alias(e)), e) for e in ("source_id", "target_id")]
    near = ends[0].unionByName(ends[1]).select("question", "edge_id", "ord", "confidence", "source_id", "target_id").distinct()
    near = staged(top(near, n_edges, F.desc("confidence"), F.col("ord"), F.col("edge_id")).drop("__r"), "context-edges")
    others = near.select("question", F.explode(F.array("source_id", "target_id")).alias("node_id")).hint("merge").join(place, "node_id").select("question", "node_id", F.lit(1).alias("g"), F.col("place").cast("long").alias("o"))
    every = seed.select("question", "node_id", F.lit(0).alias("g"), "o").unionByName(others)
    mine = staged(top(every.groupBy("question", "node_id").agg(F.min(F.struct("g", "o")).alias("o")), n_nodes, F.col("o"), F.col("node_id")).select("question", "node_id"), "context-nodes")
    of_nodes, of_edges = mine.join(node_evidence, "node_id"), near.join(edge_evidence, "edge_id")
    cited = of_nodes.select("question", "evidence_id").union(of_edges.select("question", "evidence_id")).distinct().join(evidence.groupBy("evidence_id").agg(F.min("ord").alias("place")), "evidence_id")
    proof = staged(top(cited, n_evidence, F.col("place"), F.col("evidence_id")).select("question", "evidence_id"), "context-proof")
    proven = lambda rows: rows.join(proof, ["question", "evidence_id"], "left_semi")
    shown = staged(proven(of_nodes).select("question", "node_id").distinct(), "context-shown")
    kept = proven(of_edges).select("question", "edge_id", "source_id", "target_id").distinct()
    for end in ("source_id", "target_id"):
        kept = kept.join(shown.withColumnRenamed("node_id", end), ["question", end], "left_semi")
    part = lambda df, kind, c: df.select("question", F.lit(kind).alias("kind"), F.col(c).alias("id"))
    return part(shown, "node", "node_id").union(part(kept, "edge", "edge_id")).union(part(proof, "evidence", "evidence_id"))


def records(parts: dict[str, DataFrame], columns: tuple[str, ...]) -> DataFrame:
    """One table of several record kinds; absent fields are blank."""
    out = None
    for kind, df in parts.items():
        row = df.select(F.lit(kind).alias("record_type"), *[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in columns])
        out = row if out is None else out.unionByName(row)
    return out
