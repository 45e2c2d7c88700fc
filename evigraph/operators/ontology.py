"""Generation plans as tables: categories, rules, extensions and their fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .order import numbered


def profile_categories(types: DataFrame, most: int = 16) -> DataFrame:
    """project_id, id, label, role of declared types: role and a running number per role. ``types``: project_id, ord, label, role."""
    number = F.row_number().over(Window.partitionBy("project_id", "role").orderBy("ord"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("ord"))
    rows = types.withColumn("n", number).withColumn("place", place).filter(F.col("place") <= most)
    return rows.select("project_id", F.concat("role", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise("")).alias("id"), "label", "role")


def ordered_union(parts: list[DataFrame], most: int) -> DataFrame:
    """project_id, place, label: distinct labels in order of the parts, then of ord; blanks dropped. Each part: project_id, ord, label."""
    rows = None
    for i, p in enumerate(parts):
        p = p.select("project_id", F.lit(i).alias("part"), "ord", F.trim("label").alias("label")).filter("label <> ''")
        rows = p if rows is None else rows.union(p)
    first = rows.groupBy("project_id", "label").agg(F.min(F.struct("part", "ord")).alias("o"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("o", "label"))
    return first.withColumn("place", place.cast("long")).filter(F.col("place") <= most).select("project_id", "place", "label")


def ontology_extension(base: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed categories (project_id, id, label, role) that the frozen plan lacks: no equal role (but ``other``), id or label, nor one crosswise."""
    out = proposed.join(base.filter("role <> 'other'").select("project_id", "role").distinct(), ["project_id", "role"], "left_anti")
    names = base.select("project_id", F.lower("id").alias("k")).union(base.select("project_id", F.lower("label"))).distinct()
    for c in ("id", "label"):
        out = out.join(names.select("project_id", F.col("k").alias(f"__{c}")), (out["project_id"] == names["project_id"]) & (F.lower(out[c]) == F.col(f"__{c}")), "left_anti")
    return out


def default_relation_rules(types: DataFrame, rules: DataFrame) -> DataFrame:
    """project_id, id, label, symmetric, allow_inferred: a project's own rules, and a strict one for each relation type without: inference is not allowed.

    ``types``: project_id, ord, label; ``rules``: project_id, id, label, symmetric, allow_inferred. Labels are compared in NFKC without case. The new rules are numbered
    on from the project's own.
    """
    key = lambda rows: X.nfkc(rows, "label", "__n").withColumn("__k", X.label_key(F.col("__n"))).drop("__n")
    own = rules.groupBy("project_id").agg(F.count(F.lit(1)).alias("own"))
    lacking = key(types).join(key(rules).select("project_id", "__k").distinct().hint("merge"), ["project_id", "__k"], "left_anti")
    numbers = numbered(lacking.select("project_id", "ord", "label"), ["project_id"], F.col("ord"), F.col("label")).join(own.hint("merge"), "project_id", "left")
    added = numbers.select("project_id", F.concat(F.lit("relation-"), (F.coalesce("own", F.lit(0)) + F.col("place")).cast("string")).alias("id"), "label", F.lit(False).alias("symmetric"), F.lit(False).alias("allow_inferred"))
    return rules.select(*added.columns).unionByName(added)


def default_field_rules(important: DataFrame, required: DataFrame, rules: DataFrame) -> DataFrame:
    """project_id, id, label, priority: a project's own field rules, else one for each of the first 32 distinct important and required labels.

    As many rules as there are important labels, repeats and blanks included, are critical (one at least), the rest high. ``important``, ``required``:
    project_id, ord, label (blanks and nulls make no rule); ``rules``: project_id, id, label, priority. A project without labels and rules has none.
    """
    labels = ordered_union([important, required], 32).join(rules.select("project_id").distinct(), "project_id", "left_anti")
    counts = important.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    critical = F.col("place") <= F.greatest(F.lit(1), F.coalesce("n", F.lit(0)))
    made = labels.join(counts, "project_id", "left").select("project_id", F.concat(F.lit("field-"), F.col("place").cast("string")).alias("id"), "label", F.when(critical, "critical").otherwise("high").alias("priority"))
    return rules.select("project_id", "id", "label", "priority").unionByName(made)


def remap_category_ids(rules: DataFrame, categories: DataFrame, original: DataFrame) -> DataFrame:
    """Rules (project_id, rule, category) with ``mapped``: the category of this id, else of the original's role."""
    direct = categories.select("project_id", F.col("id").alias("category"), F.col("id").alias("direct"))
    roles = original.select("project_id", F.col("id").alias("category"), "role").join(categories.groupBy("project_id", "role").agg(F.min("id").alias("by_role")), ["project_id", "role"], "left").drop("role")
    joined = rules.join(direct, ["project_id", "category"], "left").join(roles, ["project_id", "category"], "left")
    return joined.select("project_id", "rule", "category", F.coalesce("direct", "by_role").alias("mapped"))


def supersede_proposals(proposals: DataFrame, gone: DataFrame) -> DataFrame:
    """Pending proposals (proposal_id, status, document_ids) without the deleted documents; superseded if none is left."""
    live = proposals.select("proposal_id", F.explode("document_ids").alias("document_id")).join(gone.select("document_id").distinct(), "document_id", "left_anti")
    kept = live.groupBy("proposal_id").agg(F.array_sort(F.collect_set("document_id")).alias("kept"))
    empty = F.array().cast("array<string>")
    joined = proposals.join(kept, "proposal_id", "left").withColumn("kept", F.when(F.col("status") == "pending", F.coalesce("kept", empty)).otherwise(F.col("document_ids")))
    return joined.select("proposal_id", F.when((F.col("status") == "pending") & (F.size("kept") == 0), "superseded").otherwise(F.col("status")).alias("status"), F.col("kept").alias("document_ids"))


def safe_type(rows: DataFrame, categories: DataFrame, col: str, fallback: str) -> DataFrame:
    """+ safe_type: the proposed label if it is controlled (in any case), else the fallback. A plan has at most 16 categories a project."""
    known = categories.select("project_id", F.lower(F.trim("label")).alias("__k"), F.col("label").alias("__label")).dropDuplicates(["project_id", "__k"])
    joined = rows.join(known, (rows["project_id"] == known["project_id"]) & (F.lower(F.trim(rows[col])) == F.col("__k")), "left").drop(known["project_id"])
    return joined.withColumn("safe_type", F.coalesce("__label", F.lit(fallback))).drop("__k", "__label")


def project_state(projects: DataFrame, builds: DataFrame) -> DataFrame:
    """project_id, wiki_revision, rebuild_required. ``projects``: project_id, revision, old_hash, new_hash; ``builds``: project_id, one row each."""
    n = builds.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    changed = ~F.col("old_hash").eqNullSafe(F.col("new_hash"))
    return projects.join(n, "project_id", "left").select("project_id", (F.col("revision") + F.coalesce("n", F.lit(0))).alias("wiki_revision"), changed.alias("rebuild_required"))
