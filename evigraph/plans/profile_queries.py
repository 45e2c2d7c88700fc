"""Queries and SQL of whole plans: a profile for each region, whose lists are its nations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import planning as P
from ..sources.fixtures import Star

Q: dict = {}
SQL: dict[str, str] = {}

#: Types of region 3 and relations of regions 0, 3 and 4 aren't given.
PROFILES = """WITH profiles AS (SELECT 'proj-' || r_regionkey AS project_id, CASE WHEN r_regionkey = 4 THEN NULL WHEN r_regionkey % 2 = 0 THEN 'zh' ELSE 'en' END AS language, CASE r_regionkey WHEN 1 THEN 'textbook' WHEN 3 THEN NULL ELSE 'auto' END AS preset,
  CASE r_regionkey WHEN 2 THEN 'a law of trade' ELSE '' END AS unit, CASE r_regionkey % 3 WHEN 0 THEN 'precision_first' WHEN 1 THEN 'recall_first' END AS quality FROM region),
 n AS (SELECT 'proj-' || n_regionkey AS project_id, n_regionkey AS r, n_nationkey AS k, n_name FROM nation),
 lists AS (SELECT project_id, 'entity_types' AS kind, k, CASE k % 6 WHEN 0 THEN ' Theory' WHEN 2 THEN CASE WHEN k % 4 = 0 THEN 'metric' ELSE 'Parameter ' END ELSE n_name END AS label FROM n WHERE k % 2 = 0 AND r <> 3
  UNION ALL SELECT project_id, 'important_fields', k, n_name FROM n WHERE k % 3 = 0 UNION ALL SELECT project_id, 'preferred_relations', k, lower(n_name) FROM n WHERE k % 2 = 1 AND r IN (1, 2)
  UNION ALL SELECT project_id, 'target_questions', k, n_name || '?' FROM n WHERE k % 2 = 1 UNION ALL SELECT project_id, 'exclude', k, n_name FROM n WHERE k % 7 = 0),
 uniq AS (SELECT *, row_number() OVER (PARTITION BY project_id, kind ORDER BY k) AS place FROM (SELECT project_id, kind, trim(label) AS label, min(k) AS k FROM lists GROUP BY ALL)),
 spoken AS (SELECT *, coalesce(language, 'en') = 'zh' AS zh FROM profiles)
"""


def profiles(s: Star) -> DataFrame:
    k = F.col("r_regionkey")
    return s.raw("region").select(
        F.concat(F.lit("proj-"), k.cast("string")).alias("project_id"), F.when(k == 4, None).when(k % 2 == 0, "zh").otherwise("en").alias("language"), F.when(k == 1, "textbook").when(k != 3, "auto").alias("preset"),
        F.when(k == 2, "a law of trade").otherwise("").alias("unit"), F.when(k % 3 == 0, "precision_first").when(k % 3 == 1, "recall_first").alias("quality"),
    )


def profile_lists(s: Star) -> DataFrame:
    k, r, name = F.col("n_nationkey"), F.col("n_regionkey"), F.col("n_name")
    kind = F.when(k % 6 == 0, " Theory").when(k % 6 == 2, F.when(k % 4 == 0, "metric").otherwise("Parameter ")).otherwise(name)
    parts = {"entity_types": (kind, (k % 2 == 0) & (r != 3)), "important_fields": (name, k % 3 == 0), "preferred_relations": (F.lower(name), (k % 2 == 1) & r.isin(1, 2)), "target_questions": (F.concat(name, F.lit("?")), k % 2 == 1), "exclude": (name, k % 7 == 0)}
    said = F.array(*[F.when(where, F.struct(F.lit(of).alias("kind"), label.alias("label"))) for of, (label, where) in parts.items()])
    rows = s.raw("nation").select(F.concat(F.lit("proj-"), r.cast("string")).alias("project_id"), k.alias("ord"), F.explode(F.array_compact(said)).alias("x"))
    return rows.select("project_id", F.lit("profile").alias("origin"), "x.kind", "ord", "x.label")


def _long(tables: dict[str, DataFrame]) -> DataFrame:
    """project_id, kind, place, value of all tables of plans."""
    out = None
    for kind, rows in tables.items():
        place = F.col("place").cast("long") if "place" in rows.columns else F.lit(0).cast("long")
        fields = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in rows.columns if c not in ("project_id", "place")]
        part = rows.select("project_id", F.lit(kind).alias("kind"), place.alias("place"), F.concat_ws("|", *fields).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def _quoted(said: dict[str, str]) -> str:
    return f"CASE WHEN zh THEN '{said['zh']}' ELSE '{said['en']}' END"


FALLBACK = PROFILES + f""", relations AS (SELECT project_id, place, label FROM uniq WHERE kind = 'preferred_relations' UNION ALL
   SELECT project_id, generate_subscripts(l, 1), unnest(l) FROM (SELECT project_id, CASE WHEN zh THEN ['定义', '应用于', '依赖于', '导致', '通过…测量'] ELSE ['defines', 'applies to', 'depends on', 'causes', 'measured by'] END AS l FROM spoken WHERE project_id NOT IN (SELECT project_id FROM uniq WHERE kind = 'preferred_relations'))),
 roles AS (SELECT *, CASE WHEN label = 'Theory' THEN 'theory' WHEN label IN ('metric', 'Parameter') THEN 'quantity' ELSE 'other' END AS role FROM uniq WHERE kind = 'entity_types'),
 excluded AS (SELECT project_id, place, label FROM uniq WHERE kind = 'exclude' UNION ALL SELECT project_id, 1 + coalesce((SELECT max(place) FROM uniq u WHERE u.kind = 'exclude' AND u.project_id = spoken.project_id), 0), {_quoted(P.EXCLUSION)} FROM spoken)
 SELECT project_id, 'settings' AS kind, 0::BIGINT AS place, concat_ws('|', CASE WHEN zh THEN 'zh' ELSE 'en' END, coalesce(preset, 'auto'), unit, CASE WHEN unit <> '' THEN unit ELSE {_quoted(P.UNIT)} END,
   CASE quality WHEN 'precision_first' THEN '0.6|0.72|0.8|0.9|0.05|0.68|0.42' WHEN 'recall_first' THEN '0.3|0.5|0.68|0.95|0.15|0.48|0.28' ELSE '0.42|0.6|0.74|0.9|0.1|0.58|0.34' END, {_quoted(P.SUMMARY)}) AS value FROM spoken
 UNION ALL SELECT project_id, 'categories', place, concat_ws('|', role || CASE WHEN i > 1 THEN '-' || i ELSE '' END, label, role, CASE WHEN zh THEN '用户明确要求保留的“' || label || '”类知识。' ELSE 'User-requested ' || label || ' knowledge.' END)
   FROM (SELECT *, row_number() OVER (PARTITION BY project_id, role ORDER BY place) AS i FROM roles) JOIN spoken USING (project_id)
 UNION ALL SELECT project_id, 'categories', 1, 'concept|' || CASE WHEN zh THEN '概念' ELSE 'Concept' END || '|concept|-' FROM spoken WHERE project_id NOT IN (SELECT project_id FROM roles)
 UNION ALL SELECT project_id, unnest(['required_knowledge', 'claim_kinds']), place, label FROM uniq WHERE kind = 'important_fields' UNION ALL SELECT project_id, 'target_questions', place, label FROM uniq WHERE kind = 'target_questions'
 UNION ALL SELECT project_id, 'relation_types', place, label FROM relations UNION ALL SELECT project_id, 'exclusion_rules', place, label FROM excluded
 UNION ALL SELECT project_id, 'field_rules', 0, 'field-' || place || '|' || label || '|critical' FROM uniq WHERE kind = 'important_fields' UNION ALL SELECT project_id, 'relation_rules', 0, 'relation-' || place || '|' || label || '|false|false' FROM relations
 UNION ALL SELECT DISTINCT 'proj-' || n_regionkey, 'documents', 0, 'doc-' || o_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def fallback_plan(spark, d):
    s = Star(spark, d)
    blocks = s.blocks().join(s.documents().select("document_id", "project_id"), "document_id")
    return _long(P.fallback_plan(profiles(s), profile_lists(s), blocks))


Q["fallback_plan"], SQL["fallback_plan"] = fallback_plan, FALLBACK
