"""Whole generation plans: what profiles and proposed plans come to, and conservative plans where none was proposed.

Tables, each with project_id: ``profiles``: preset, unit, quality, language (any may be null), at most one row a project; ``plans``: language, preset, unit, one row a project;
``lists``: origin (profile, plan), kind, ord, label, the lists of both by their kinds: entity_types, important_fields, preferred_relations, target_questions and exclude of profiles,
required_knowledge, relation_types and target_questions of plans. Labels are trimmed; blank and null ones and repeats are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .classify import category_label, type_role
from .ontology import default_field_rules, default_relation_rules, ordered_union

# Thresholds by the quality that a profile prefers; the last line is for all others.
THRESHOLDS = ("relevance", "entity", "relation", "critical_coverage", "generic_relations", "publish", "review")
POLICIES = {
    "precision_first": (0.6, 0.72, 0.8, 0.9, 0.05, 0.68, 0.42),
    "recall_first": (0.3, 0.5, 0.68, 0.95, 0.15, 0.48, 0.28),
    None: (0.42, 0.6, 0.74, 0.9, 0.1, 0.58, 0.34),
}
# Relations, rules of exclusion, units of analysis and summaries where nothing is given.
RELATIONS = {"en": ["defines", "applies to", "depends on", "causes", "measured by"], "zh": ["定义", "应用于", "依赖于", "导致", "通过…测量"]}
EXCLUSION = {"en": "administrative text, tables of contents, references without substantive content", "zh": "行政信息、目录、无实质内容的参考文献"}
UNIT = {"en": "an evidence-supported knowledge unit reusable across sources", "zh": "可跨来源复用、可由证据独立说明的知识单元"}
SUMMARY = {"en": "A conservative plan based on the current documents and research goal.", "zh": "基于当前文档与研究目标生成的保守分类计划。"}
# Limits of a plan's lists.
CATEGORIES, KNOWLEDGE, QUESTIONS, EXCLUSIONS, CLAIM_KINDS = 16, 24, 20, 12, 16


def by_language(said: dict[str, str], language: Column) -> Column:
    return F.when(language == "zh", said["zh"]).otherwise(said["en"])


def plan_categories(plans: DataFrame, declared: DataFrame, proposed: DataFrame) -> DataFrame:
    """project_id, place, id, label, role, definition (null for a role's own): the declared types if a project has any, else the proposed categories, else one for concepts.

    ``declared``: project_id, place, label, already distinct; ``proposed``: project_id, ord, id, label, role, definition. Declared types are numbered in their role.
    """
    number = F.row_number().over(Window.partitionBy("project_id", "role").orderBy("place"))
    own = declared.join(plans.select("project_id", "language"), "project_id").withColumn("role", F.coalesce(type_role(F.col("label")), F.lit("other"))).withColumn("n", number)
    wish = F.when(F.col("language") == "zh", F.concat(F.lit("用户明确要求保留的“"), "label", F.lit("”类知识。"))).otherwise(F.concat(F.lit("User-requested "), "label", F.lit(" knowledge.")))
    own = own.select("project_id", "place", F.concat("role", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise("")).alias("id"), "label", "role", wish.alias("definition"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("ord", "id")).cast("long")
    rest = proposed.join(declared.select("project_id").distinct(), "project_id", "left_anti").withColumn("place", place)
    given = own.unionByName(rest.select(*own.columns)).filter(F.col("place") <= CATEGORIES)
    none = plans.join(declared.select("project_id").union(proposed.select("project_id")).distinct(), "project_id", "left_anti")
    concept = F.lit("concept")
    return given.unionByName(none.select("project_id", F.lit(1).cast("long").alias("place"), concept.alias("id"), category_label(concept, F.col("language")).alias("label"), concept.alias("role"), F.lit(None).cast("string").alias("definition")))


def normalize_plan(plans: DataFrame, profiles: DataFrame, lists: DataFrame, categories: DataFrame, field_rules: DataFrame, relation_rules: DataFrame) -> dict[str, DataFrame]:
    """The tables of the plans in force: settings (one row a project), categories, and by place the lists required_knowledge, relation_types, target_questions,
    exclusion_rules and claim_kinds; field_rules and relation_rules.

    What a profile says comes first, and its declared types replace the proposed categories. ``categories``, ``field_rules`` and ``relation_rules`` are those proposed, in the form of ``plan_categories``,
    ``default_field_rules`` and ``default_relation_rules``; the categories that relation rules allow are mapped by ``ontology.remap_category_ids``. A project without a profile has the middle thresholds.
    """
    part = lambda origin, kind: lists.filter((F.col("origin") == origin) & (F.col("kind") == kind)).select("project_id", "ord", "label")
    placed = lambda rows: rows.select("project_id", F.col("place").alias("ord"), "label")
    both = plans.join(profiles.select("project_id", F.col("preset").alias("wanted"), F.col("unit").alias("own_unit"), "quality"), "project_id", "left")
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    level = lambda i: F.coalesce(*[F.when(F.col("quality") == q, F.lit(v[i])) for q, v in POLICIES.items() if q], F.lit(POLICIES[None][i]))
    unit = F.coalesce(given("own_unit"), given("unit"))
    settings = both.select(
        "project_id", "language", F.coalesce(F.when(F.col("wanted") != "auto", F.col("wanted")), "preset", F.lit("auto")).alias("preset"), F.coalesce(unit, F.lit("")).alias("unit"),
        F.coalesce(unit, by_language(UNIT, F.col("language"))).alias("analysis_unit"), *[level(i).alias(name) for i, name in enumerate(THRESHOLDS)],
    )
    important = part("profile", "important_fields")
    required = ordered_union([important, part("plan", "required_knowledge")], KNOWLEDGE)
    relations = ordered_union([part("profile", "preferred_relations"), part("plan", "relation_types")], KNOWLEDGE)
    always = plans.select("project_id", F.lit(0).alias("ord"), by_language(EXCLUSION, F.col("language")).alias("label"))
    return {
        "settings": settings,
        "categories": plan_categories(plans, ordered_union([part("profile", "entity_types")], CATEGORIES), categories),
        "required_knowledge": required,
        "relation_types": relations,
        "target_questions": ordered_union([part("profile", "target_questions"), part("plan", "target_questions")], QUESTIONS),
        "exclusion_rules": ordered_union([part("profile", "exclude"), always], EXCLUSIONS),
        "claim_kinds": ordered_union([important, placed(required)], CLAIM_KINDS),
        "field_rules": default_field_rules(important, placed(required), field_rules),
        "relation_rules": default_relation_rules(placed(relations), relation_rules),
    }


def fallback_plan(profiles: DataFrame, lists: DataFrame, blocks: DataFrame) -> dict[str, DataFrame]:
    """The tables of ``normalize_plan`` for profiles alone, and documents (project_id, document_id): those of the blocks, which the plan counts as analysed.

    Without preferred relations a project has general ones in its language (English where none is set), since an empty wish isn't one for no edges. ``settings`` has a summary as well.
    """
    spark, language = profiles.sparkSession, F.coalesce("language", F.lit("en"))
    plans = profiles.select("project_id", language.alias("language"), F.coalesce("preset", F.lit("auto")).alias("preset"), F.coalesce("unit", F.lit("")).alias("unit"))
    mine = lists.filter("origin = 'profile'").select("project_id", "origin", "kind", "ord", "label")
    wishes = mine.filter("kind = 'preferred_relations' and trim(label) <> ''").select("project_id").distinct()
    general = F.when(F.col("language") == "zh", F.array(*map(F.lit, RELATIONS["zh"]))).otherwise(F.array(*map(F.lit, RELATIONS["en"])))
    usual = plans.join(wishes, "project_id", "left_anti").select("project_id", F.lit("plan").alias("origin"), F.lit("relation_types").alias("kind"), F.posexplode(general).alias("ord", "label"))
    none = lambda schema: spark.createDataFrame([], "project_id string, id string, label string, " + schema)
    out = normalize_plan(plans, profiles, mine.unionByName(usual), none("ord int, role string, definition string"), none("priority string"), none("symmetric boolean, allow_inferred boolean"))
    out["settings"] = out["settings"].withColumn("summary", by_language(SUMMARY, F.col("language")))
    return out | {"documents": blocks.join(profiles.select("project_id"), "project_id", "left_semi").select("project_id", "document_id").distinct()}
