"""Rule-based roles of entities, checked classifications and the categories of a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Patterns of the roles in the order in which they are tried, names that only state a relation, signs of a formula.
ROLE_PATTERNS = [
    ("law", r"定律|定则|\b(?:law|laws|rule|rules)\b"),
    ("theorem", r"定理|\btheorems?\b"),
    ("theory", r"理论|\btheor(?:y|ies)\b"),
    ("model", r"模型|\bmodels?\b"),
    ("method", r"(?:方法|算法|技术|分析法|method|algorithm|technique|analysis)\b|(?:方法|算法|技术|分析法|分析)$"),
    ("formula", r"(?:公式|方程|表达式|formula|equation|expression)\b|(?:公式|方程|表达式)$"),
    ("quantity", r"(?:加速度|速度|动量|角动量|能量|质量|时间|位移|距离|频率|波长|振幅|温度|压力|电压|电流|功率|密度|长度|面积|体积|quantity|metric|parameter)$"),
    ("experiment", r"(?:实验|试验|测试|experiment|test)\b|(?:实验|试验|测试)$"),
    ("phenomenon", r"(?:现象|效应|行为|phenomenon|effect|behavior)\b|(?:现象|效应)$"),
]
RELATION_LIKE = r"(?:关系|关联|相关性|变化率|比例关系|依赖关系|relationship|relation|correlation|rate of change)$"
FORMULA = r"(?:公式|方程|表达式|等式|formula|equation|expression|\b[a-zα-ω]\s*=|[=∑∫∂])"
IDENTITY_ROLES = ("law", "theorem", "theory")
# The types that name a role.
TYPE_ALIASES = {
    "law": ["law", "rule", "定律", "定则"],
    "theorem": ["theorem", "定理"],
    "theory": ["theory", "理论"],
    "model": ["model", "模型"],
    "concept": ["concept", "notion", "principle", "概念", "原理"],
    "method": ["method", "algorithm", "technique", "方法", "算法", "技术"],
    "formula": ["formula", "equation", "expression", "公式", "方程", "表达式"],
    "quantity": ["quantity", "metric", "parameter", "indicator", "物理量", "指标", "参数"],
    "experiment": ["experiment", "test", "实验", "试验", "测试"],
    "phenomenon": ["phenomenon", "effect", "behavior", "现象", "效应", "行为"],
    "person": ["person", "researcher", "人物", "研究者"],
    "material": ["material", "substance", "sample", "材料", "物质", "样品"],
    "other": ["other", "其他"],
}
# Labels of the roles' own categories in Chinese; in English they are the roles' names with a capital.
ZH_LABELS = {
    "law": "定律", "theorem": "定理", "theory": "理论", "model": "模型", "concept": "概念", "method": "方法", "formula": "公式",
    "quantity": "指标", "experiment": "实验", "phenomenon": "现象", "person": "人物", "material": "材料", "other": "其他",
}
ACCEPT = 0.72  # fixed value: below this confidence a proposal needs review


def _matches(text: Column, pattern: str) -> Column:
    """Without regard to case; a word is of ASCII letters, digits and underscores, and ``$`` is the very end."""
    edge = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    return text.rlike("(?iu)" + pattern.replace(r"\b", edge).replace("$", r"\z"))


def name_role(name: Column) -> Column:
    """The role that a name claims, or null."""
    return F.coalesce(*[F.when(_matches(name, p), F.lit(role)) for role, p in ROLE_PATTERNS])


def type_role(kind: Column) -> Column:
    """The role whose alias a type is, or null."""
    return F.coalesce(*[F.when(X.label_key(kind).isin(words), F.lit(role)) for role, words in TYPE_ALIASES.items()])


def content_role(content: Column, kind: Column) -> Column:
    """Formula if the content (name, summary, properties) shows one, else the type's role unless it claims an identity, else concept."""
    typed = F.when(~type_role(kind).isin(*IDENTITY_ROLES), type_role(kind))
    return F.when(_matches(content, FORMULA), "formula").otherwise(F.coalesce(typed, F.lit("concept")))


def classify_entities(rows: DataFrame, roles: list[str]) -> DataFrame:
    """+ role, status, source, decision_confidence.

    rows: name, type, content and a proposal (proposed, confidence, identity: explicit and verified, needs_review, proposal_source), null where
    there is none. ``roles`` are those of the plan's categories, the first category being the last resort.
    Without a proposal the name decides, then the content. A proposal that the plan lacks, or of a law, theorem or theory
    without verified identity, falls back to the content.
    """
    p, named, content = F.col("proposed"), name_role(F.col("name")), content_role(F.col("content"), F.col("type"))
    planned = lambda role: F.when(role.isin(*roles), role).otherwise("concept" if "concept" in roles else roles[0])
    none = p.isNull()
    surface = planned(F.coalesce(named, content))
    unproven = p.isin(*IDENTITY_ROLES) & ~F.coalesce("identity", F.lit(False))
    bad = ~p.isin(*roles) | unproven
    corrected = named.isNull() & F.coalesce(type_role(F.col("type")) != surface, F.lit(False))
    conflict = F.coalesce(named != p, F.lit(False)) & ~F.coalesce(F.col("proposal_source") == "review", F.lit(False))
    doubt = (F.col("confidence") < ACCEPT) | F.coalesce("needs_review", F.lit(False)) | conflict
    status = (
        F.when(none & corrected, "corrected").when(none, "needs_review").when(unproven & (content == "concept"), "needs_review").when(bad, "corrected")
        .when(doubt, "needs_review").otherwise("accepted")
    )
    source = F.when(none, F.when(named.isNotNull(), "lexical").otherwise("fallback")).when(bad, "fallback").otherwise(F.coalesce("proposal_source", F.lit("llm")))
    return rows.select(
        *rows.columns, F.when(none, surface).when(bad, planned(content)).otherwise(p).alias("role"), status.alias("status"), source.alias("source"),
        F.when(none, F.when(named.isNotNull(), 0.55).otherwise(0.45)).otherwise(F.col("confidence")).alias("decision_confidence"),
    )


def category_label(role: Column, language: Column) -> Column:
    """The label of a role's own category."""
    zh = F.coalesce(*[F.when(role == r, label) for r, label in ZH_LABELS.items()])
    return F.when(language == "zh", zh).otherwise(F.initcap(role))


def ensure_categories(categories: DataFrame, entities: DataFrame, most: int = 16, plans: DataFrame | None = None) -> DataFrame:
    """project_id, place, label, role: the plan's categories and one more for each role that its entities need, in order of first need.

    ``categories``: project_id, ord, label, role; ``entities``: project_id, ord, name, type, content. With ``most`` categories the first one of role
    ``other`` makes room, and without one the role stays out. New labels are in the plan's language, and a frozen plan stays as it is: ``plans``: project_id,
    language, frozen, one row a project; without a row (or plans) a project is in English and not frozen. There are no more roles than ``TYPE_ALIASES`` has, so the fold is over short arrays.
    """
    role = F.coalesce(name_role(F.col("name")), content_role(F.col("content"), F.col("type")))
    first = entities.select("project_id", role.alias("role"), "ord").groupBy("project_id", "role").agg(F.min("ord").alias("ord"))
    needed = first.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("ord", "role"))).alias("needed"))
    plan = categories.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("ord", "label", "role"))).alias("plan"))
    said = plans.select("project_id", "language", "frozen") if plans is not None else categories.select("project_id", F.lit("en").alias("language"), F.lit(False).alias("frozen")).limit(0)
    entry = lambda r: F.struct(F.lit(None).cast("long").alias("ord"), category_label(r, F.col("language")).alias("label"), r.alias("role"))

    def add(cats: Column, need: Column) -> Column:
        other = F.array_position(F.transform(cats, lambda c: c["role"]), F.lit("other")).cast("int")
        without = F.concat(F.slice(cats, F.lit(1), other - 1), F.slice(cats, other + 1, F.size(cats)))
        more = F.array(entry(need["role"]))
        return F.when(F.exists(cats, lambda c: c["role"] == need["role"]), cats).when(F.size(cats) < most, F.concat(cats, more)).when(other > 0, F.concat(without, more)).otherwise(cats)

    grown = F.when(~F.coalesce("frozen", F.lit(False)), F.aggregate("needed", F.col("plan"), add))
    folded = plan.hint("merge").join(needed, "project_id", "left").join(said, "project_id", "left").select("project_id", F.coalesce(grown, F.col("plan")).alias("plan"))
    return folded.select("project_id", F.posexplode("plan").alias("place", "c")).select("project_id", "place", "c.label", "c.role")
