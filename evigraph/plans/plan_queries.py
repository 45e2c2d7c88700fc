"""Queries and SQL for plans, classification, rewriting and incremental arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analysis as N
from ..operators import fingerprint as P
from ..operators import ontology as O
from ..operators import publishing
from ..sources.fixtures import Star, Texts
from .scratch import new_path
from .text_queries import LINES, tree

Q: dict = {}
SQL: dict[str, str] = {}

TYPES = "types AS (SELECT 'proj-' || n_regionkey AS project_id, CAST(n_nationkey AS BIGINT) AS ord, n_name AS label, CASE n_nationkey % 3 WHEN 0 THEN 'concept' WHEN 1 THEN 'model' ELSE 'other' END AS role FROM nation)"
CATS = "cats AS (SELECT project_id, role || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS id, label, role, ord FROM (SELECT *, row_number() OVER (PARTITION BY project_id, role ORDER BY ord) AS n FROM types))"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def types(s: Star) -> DataFrame:
    k = F.col("n_nationkey")
    role = F.when(k % 3 == 0, "concept").when(k % 3 == 1, "model").otherwise("other")
    return s.raw("nation").select(F.concat(F.lit("proj-"), F.col("n_regionkey").cast("string")).alias("project_id"), k.cast("long").alias("ord"), F.col("n_name").alias("label"), role.alias("role"))


@query(f"WITH {TYPES}, {CATS} SELECT project_id, id, label, role FROM cats")
def profile_categories(spark, d):
    return O.profile_categories(types(Star(spark, d)))


@query(f"WITH {TYPES}, u AS (SELECT project_id, label, min((0, ord)) AS o FROM types GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY o, label) AS place FROM u) SELECT project_id, place, label FROM r WHERE place <= 4")
def normalize_plan(spark, d):
    t = types(Star(spark, d)).select("project_id", "ord", "label")
    return O.ordered_union([t, t.withColumn("label", F.concat(F.lit(" "), "label", F.lit(" ")))], 4)


@query(f"WITH {TYPES} SELECT project_id, 1 + row_number() OVER (PARTITION BY project_id ORDER BY ord) - 1 AS place, label FROM types WHERE ord % 2 = 0")
def default_contract(spark, d):
    return O.ordered_union([types(Star(spark, d)).filter("ord % 2 = 0").select("project_id", "ord", "label")], 16)


@query(f"WITH {TYPES}, {CATS} SELECT project_id, id, label, role FROM (SELECT project_id, 'x-' || id AS id, lower(label) AS label, CASE WHEN ord % 2 = 0 THEN 'new' ELSE role END AS role, ord FROM cats WHERE ord >= 5) c WHERE role NOT IN (SELECT role FROM cats b WHERE b.ord < 15 AND b.project_id = c.project_id AND role <> 'other') AND label NOT IN (SELECT lower(label) FROM cats b WHERE b.ord < 15 AND b.project_id = c.project_id)")
def ontology_extension(spark, d):
    t = types(Star(spark, d))
    c = O.profile_categories(t).join(t.select("project_id", "label", "ord"), ["project_id", "label"])
    proposed = c.filter("ord >= 5").select("project_id", F.concat(F.lit("x-"), "id").alias("id"), F.lower("label").alias("label"), F.when(F.col("ord") % 2 == 0, "new").otherwise(F.col("role")).alias("role"))
    return O.ontology_extension(c.filter("ord < 15").select("project_id", "id", "label", "role"), proposed)


@query(f"""WITH {TYPES}, own AS (SELECT project_id, 'own-' || ord AS id, ' ' || lower(label) || ' ' AS label, true AS symmetric, ord % 2 = 0 AS allow_inferred FROM types WHERE ord % 3 = 0),
  lacking AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ord) AS place FROM types t WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.project_id = t.project_id AND lower(trim(o.label)) = lower(trim(t.label)))),
  n AS (SELECT project_id, count(*) AS n FROM own GROUP BY 1)
  SELECT * FROM own UNION ALL SELECT project_id, 'relation-' || (place + coalesce(n, 0)), label, false, false FROM lacking LEFT JOIN n USING (project_id)""")
def default_relation_rules(spark, d):
    t = types(Star(spark, d)).select("project_id", "label", "ord")
    own = t.filter("ord % 3 = 0").select("project_id", F.concat(F.lit("own-"), F.col("ord").cast("string")).alias("id"), F.concat(F.lit(" "), F.lower("label"), F.lit(" ")).alias("label"), F.lit(True).alias("symmetric"), (F.col("ord") % 2 == 0).alias("allow_inferred"))
    return O.default_relation_rules(t, own)


@query(f"""WITH {TYPES}, mine AS (SELECT project_id, 'own-' || ord AS id, label, 'normal' AS priority FROM types WHERE project_id = 'proj-0'),
  u AS (SELECT project_id, label, min((CASE WHEN ord % 2 = 0 THEN 0 ELSE 1 END, ord)) AS o FROM types WHERE project_id NOT IN (SELECT project_id FROM mine) GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY o, label) AS place FROM u), n AS (SELECT project_id, count(*) FILTER (ord % 2 = 0) AS n FROM types GROUP BY 1)
  SELECT * FROM mine UNION ALL SELECT project_id, 'field-' || place, label, CASE WHEN place <= greatest(1, n) THEN 'critical' ELSE 'high' END FROM r JOIN n USING (project_id) WHERE place <= 32""")
def default_field_rules(spark, d):
    t = types(Star(spark, d))
    own = t.filter("project_id = 'proj-0'").select("project_id", F.concat(F.lit("own-"), F.col("ord").cast("string")).alias("id"), "label", F.lit("normal").alias("priority"))
    plain = t.select("project_id", "ord", "label")
    return O.default_field_rules(plain.filter("ord % 2 = 0"), plain, own)


@query(f"WITH {TYPES}, {CATS} SELECT c.project_id, c.label AS rule, c.id AS category, coalesce(CASE WHEN c.ord % 2 = 0 THEN c.id END, (SELECT min(id) FROM cats k WHERE k.project_id = c.project_id AND k.role = c.role AND k.ord % 2 = 0)) AS mapped FROM cats c")
def remap_category_ids(spark, d):
    t = types(Star(spark, d))
    c = O.profile_categories(t).join(t.select("project_id", "label", "ord"), ["project_id", "label"])
    return O.remap_category_ids(c.select("project_id", F.col("label").alias("rule"), F.col("id").alias("category")), c.filter("ord % 2 = 0"), c)


@query("""SELECT 'p' || o_custkey AS proposal_id, CASE WHEN o_custkey % 2 = 1 THEN 'accepted' WHEN bool_and(o_orderkey % 3 = 0) THEN 'superseded' ELSE 'pending' END AS status,
  coalesce(string_agg('d' || o_orderkey, ',' ORDER BY 'd' || o_orderkey) FILTER (o_custkey % 2 = 1 OR o_orderkey % 3 > 0), '') AS document_ids FROM orders GROUP BY o_custkey""")
def supersede_proposals(spark, d):
    o = Star(spark, d).raw("orders")
    doc = F.concat(F.lit("d"), F.col("o_orderkey").cast("string"))
    p = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(doc)).alias("document_ids")).select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("proposal_id"), F.when(F.col("o_custkey") % 2 == 1, "accepted").otherwise("pending").alias("status"), "document_ids")
    gone = o.filter("o_orderkey % 3 = 0").select(doc.alias("document_id"))
    return O.supersede_proposals(p, gone).withColumn("document_ids", F.array_join("document_ids", ","))


@query(f"WITH {TYPES}, {tree("SELECT project_id AS k, sha256('category|' || label || '|' || role) AS o, o AS h FROM types", 'plan_tree')} SELECT k AS project_id, h AS fingerprint FROM plan_tree_3")
def plan_fingerprint(spark, d):
    return P.plan_fingerprint(types(Star(spark, d)).select("project_id", F.lit("category").alias("kind"), "label", F.col("role").alias("value")))


@query(f"WITH {TYPES}, c AS (SELECT 'proj-' || (c_nationkey % 5) AS project_id, c_custkey, n_name AS t FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT c_custkey, coalesce(label, 'Concept') AS safe_type FROM c LEFT JOIN types ON types.project_id = c.project_id AND lower(trim(t)) = lower(label)")
def safe_type(spark, d):
    s = Star(spark, d)
    rows = s.raw("customer").join(s.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("proj-"), (F.col("c_nationkey") % 5).cast("string")).alias("project_id"), "c_custkey", F.lower(F.concat(F.lit(" "), "n_name")).alias("t"))
    return O.safe_type(rows, types(s), "t", "Concept").select("c_custkey", "safe_type")


@query("SELECT 'p' || c_custkey AS project_id, 1 + coalesce(n, 0) AS wiki_revision, c_custkey % 4 <> 0 AS rebuild_required FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def project_state(spark, d):
    s = Star(spark, d)
    k = F.col("c_custkey")
    p = s.raw("customer").select(F.concat(F.lit("p"), k.cast("string")).alias("project_id"), F.lit(1).alias("revision"), F.when(k % 4 != 1, "h").alias("old_hash"), F.when(k % 4 == 0, "h").otherwise("g").alias("new_hash"))
    return O.project_state(p, s.raw("orders").select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("project_id")))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_custkey % 3 = 0 THEN 'C' || o_custkey END, 'c' || o_custkey) AS source FROM orders")
def rewrite_relations(spark, d):
    o = Star(spark, d).raw("orders")
    names = o.filter("o_custkey % 3 = 0").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("key"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("name")).distinct()
    return N.rewrite_ends(o.select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source")), names, ["source"])


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, 'n' || o_custkey AS resolved FROM orders WHERE o_custkey % 2 = 0 AND o_custkey % 4 <> 2")
def resolve_node_suffix(spark, d):
    o = Star(spark, d).raw("orders")
    suffix = lambda k: F.substring(F.sha2(k.cast("string").cast("binary"), 256), 1, 16)
    k = F.col("o_custkey")
    known = o.select("o_custkey").distinct()
    n = known.select(F.concat(F.lit("p:node:"), suffix(k)).alias("node_id"), F.concat(F.lit("n"), k.cast("string")).alias("name")).unionByName(
        known.filter("o_custkey % 4 = 2").select(F.concat(F.lit("q:node:"), suffix(k)).alias("node_id"), F.lit("other").alias("name")))
    asked = o.select(F.col("o_orderkey").cast("string").alias("id"), F.when(k % 2 == 0, F.concat(F.lit("x:node:"), suffix(k))).otherwise(F.lit("y:concept:1")).alias("asked"))
    return N.resolve_node_suffix(asked, n).select("id", F.col("name").alias("resolved"))


ITEMS = LINES + """, words AS (SELECT *, string_split(text, ' ') AS w FROM lines),
  items AS (SELECT project_id, document_id, doc_id, ord, ord // 4 AS slice, w[1] AS theme, array_to_string(w[1:2], ' ') AS entity, array_to_string(w[1:3], ' ') AS title, text AS statement,
    ((doc_id * 7 + ord * 3) % 11)::DOUBLE / 10 AS importance, CASE WHEN ord % 3 = 0 THEN array_to_string(w[2:4], ' ') END AS topic FROM words)"""


def said(items: DataFrame, text: str) -> DataFrame:
    """One of the columns of the analysis items as texts."""
    return items.filter(F.col(text).isNotNull()).withColumn("text", F.col(text))


@query(f"""WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ord) AS e, row_number() OVER (PARTITION BY document_id ORDER BY importance DESC, ord) AS p,
    CASE WHEN topic IS NOT NULL THEN row_number() OVER (PARTITION BY document_id, topic IS NULL ORDER BY ord) END AS t, row_number() OVER (PARTITION BY document_id, theme ORDER BY ord) AS again FROM items)
  SELECT document_id, (SELECT string_agg(theme, ' / ' ORDER BY ord) FROM (SELECT theme, ord FROM r q WHERE q.document_id = r.document_id AND again = 1 AND theme <> '' ORDER BY ord LIMIT 32)) AS themes,
    string_agg(entity, ' / ' ORDER BY e) FILTER (e <= 30) AS entities, string_agg(title || ': ' || statement, ' / ' ORDER BY p) FILTER (p <= 40) AS points,
    string_agg(topic, ' / ' ORDER BY t) FILTER (t <= 16) AS topics, count(*) FILTER (ord % 3 > 0) AS unresolved FROM r GROUP BY document_id""")
def compact_analyses(spark, d):
    items = Texts(spark, d).analysis_items()
    points = items.withColumn("text", F.concat_ws(": ", "title", "statement"))
    return N.compact_analyses(items, said(items, "theme"), said(items, "entity"), points, said(items, "topic"), items)


@query(f"WITH {LINES} SELECT document_id, left(string_agg(text, ' ' ORDER BY ord), 2500) AS summary, count(*) AS blocks FROM lines GROUP BY 1")
def default_slices(spark, d):
    return N.default_slices(Texts(spark, d).line_blocks())


@query("SELECT 'doc-' || doc_id AS document_id, CASE doc_id % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'direct' WHEN 2 THEN 'contextual' ELSE 'out_of_scope' END AS relevance FROM documents")
def document_relevance(spark, d):
    k = F.col("doc_id") % 4
    t = Texts(spark, d).documents()
    one = t.select("document_id", F.when(k == 0, "direct").when(k == 1, "partial").when(k == 2, "contextual").otherwise("out_of_scope").alias("relevance"))
    return N.document_relevance(one.union(t.filter("doc_id % 4 = 1").select("document_id", F.lit("direct"))))


@query(f"WITH {LINES} SELECT block_id, CASE WHEN ord % 3 = 0 THEN 'analysed' ELSE 'unresolved' END AS status FROM lines")
def analysis_coverage(spark, d):
    b = Texts(spark, d).line_blocks()
    seen = b.filter("ord % 3 < 2").select("block_id", F.lit("analysed").alias("status")).union(b.filter("ord % 3 = 1").select("block_id", F.lit("unresolved")))
    return N.analysis_coverage(b, seen)


@query(f"""WITH {ITEMS}, slices AS (SELECT document_id, slice, string_agg(statement, ' ' ORDER BY ord) AS summary FROM items GROUP BY ALL),
  themes AS (SELECT document_id, theme, min((slice, ord)) AS o, min(slice) AS since FROM items WHERE theme <> '' GROUP BY ALL),
  places AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY o) AS place FROM themes),
  e AS (SELECT s.document_id, s.slice, i.entity, i.title, i.ord, row_number() OVER (PARTITION BY s.document_id, s.slice ORDER BY i.ord DESC) AS back
    FROM slices s JOIN items i ON i.document_id = s.document_id AND i.slice < s.slice),
  lists AS (SELECT document_id, slice, string_agg(entity, ' / ' ORDER BY ord) FILTER (back <= 60) AS entities, string_agg(title, ' / ' ORDER BY ord) FILTER (back <= 80) AS points FROM e GROUP BY ALL),
  told AS (SELECT s.document_id, s.slice, string_agg(theme, ' / ' ORDER BY place) AS themes FROM slices s JOIN places p ON p.document_id = s.document_id AND p.since < s.slice AND place <= 24 GROUP BY ALL),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY slice) AS i, string_agg(summary, ' / ') OVER (PARTITION BY document_id ORDER BY slice ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS summaries FROM slices)
  SELECT n.document_id, n.slice, summaries, CASE WHEN i > 1 THEN coalesce(themes, '') END AS themes, CASE WHEN i > 1 THEN coalesce(entities, '') END AS entities, CASE WHEN i > 1 THEN coalesce(points, '') END AS points
  FROM numbered n LEFT JOIN lists USING (document_id, slice) LEFT JOIN told USING (document_id, slice)""")
def rolling_digest(spark, d):
    items = Texts(spark, d).analysis_items()
    joined = F.transform(F.array_sort(F.collect_list(F.struct("ord", "statement"))), lambda x: x["statement"])  # four lines at most
    slices = items.groupBy("document_id", "slice").agg(F.array_join(joined, " ").alias("summary"))
    return N.rolling_digest(slices, said(items, "theme"), said(items, "entity"), said(items, "title"))


@query(f"""WITH {ITEMS}, docs AS (SELECT project_id, doc_id, left(string_agg(statement, ' ' ORDER BY ord), 2500) AS summary FROM items GROUP BY ALL),
  t AS (SELECT project_id, 'themes' AS kind, theme AS x, doc_id, 0 AS part, ord FROM items UNION ALL SELECT project_id, 'required', title, doc_id, 0, ord FROM items WHERE importance >= 0.6
    UNION ALL SELECT project_id, 'required', topic, doc_id, 1, ord FROM items),
  f AS (SELECT project_id, kind, x, min((doc_id, part, ord)) AS o FROM t WHERE x <> '' GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY project_id, kind ORDER BY o, x) AS place FROM f),
  l AS (SELECT project_id, string_agg(x, ' / ' ORDER BY place) FILTER (kind = 'themes') AS themes, string_agg(x, ' / ' ORDER BY place) FILTER (kind = 'required') AS required FROM r WHERE place <= 24 GROUP BY 1)
  SELECT project_id, left(string_agg(summary, ' ' ORDER BY doc_id), 2000) AS corpus_summary, any_value(themes) AS themes, any_value(required) AS required FROM docs LEFT JOIN l USING (project_id) GROUP BY 1""")
def corpus_plan_fallback(spark, d):
    t = Texts(spark, d)
    items = t.analysis_items()
    ids = t.documents().select("document_id", "project_id", "doc_id")
    summaries = N.default_slices(t.line_blocks()).join(ids, "document_id").select("project_id", "doc_id", "summary")
    return N.corpus_plan_fallback(summaries, said(items, "theme"), said(items, "title"), said(items, "topic"))


@query(f"WITH {LINES} SELECT block_id, 'unresolved' AS status FROM lines WHERE doc_id % 10 = 7")
def proposal_fallbacks(spark, d):
    b = Texts(spark, d).line_blocks()
    return N.fallbacks(b.select("block_id"), b.filter("doc_id % 10 <> 7").select("block_id"), "block_id", {"status": "unresolved"})


@query()
def incremental_build(spark, d):
    from ..streaming.incremental import build_once

    return build_once(spark, f"{d}/documents.parquet")


@query(f"WITH {LINES}, d AS (SELECT source AS project_id, count(*) AS n FROM documents GROUP BY 1) SELECT d.project_id, n, (SELECT count(*) FROM lines l WHERE l.project_id IS NOT DISTINCT FROM d.project_id) AS blocks FROM d")
def publish_tables(spark, d):
    t, root = Texts(spark, d), new_path(spark, "published")
    publishing.publish(spark, root, {"documents": t.documents().select("document_id", "project_id"), "blocks": t.line_blocks()}, "project_id")
    counts = [publishing.read(spark, root, name).groupBy("project_id").agg(F.count(F.lit(1)).alias(n)) for name, n in (("documents", "n"), ("blocks", "blocks"))]
    same = counts[0]["project_id"].eqNullSafe(counts[1]["project_id"])
    return counts[0].join(counts[1], same, "left").select(counts[0]["project_id"], "n", F.coalesce("blocks", F.lit(0)).alias("blocks"))
