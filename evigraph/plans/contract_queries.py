"""Queries and SQL of nested contract checks, document analyses and concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import consolidation as M
from ..operators import contracts as C
from ..operators import synthesis as S
from ..sources.fixtures import Star, Texts
from .plan_queries import ITEMS
from .scratch import staged
from .text_queries import NORM, WS

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def trimmed(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}', ''), '{WS}$', '')"


def size(path: str, x: str, most: int, least: int = 1) -> str:
    """CASE: what is wrong with the length of a text."""
    short = f"WHEN length({x}) < {least} THEN {path} || ': shorter than {least}' " if least else ""
    return f"CASE WHEN {x} IS NULL THEN {path} || ': missing' {short}WHEN length({x}) > {most} THEN {path} || ': longer than {most}' END"


def _faults() -> str:
    at = lambda name, sub, i="i": f"'{name}[' || {i} || ']{sub}'"
    lines = [
        (4, 0, size(at("themes", ""), "theme", 160)), (5, 0, size(at("entities", ".name"), "entity", 200)), (5, 1, f"CASE WHEN ord % 4 < 3 AND length(theme) > 100 THEN {at('entities', '.type')} || ': longer than 100' END"),
        (5, 2, size(at("entities", ".aliases[0]"), "theme", 200)),
        (6, 0, f"CASE WHEN (doc_id + ord) % 23 = 7 THEN {at('knowledge_points', '.kind')} || ': not one of definition, concept, entity, method, finding, relationship, contradiction, other' END"),
        (6, 1, size(at("knowledge_points", ".title"), "title", 200)), (6, 2, size(at("knowledge_points", ".statement"), "statement", 1500)),
        (6, 3, f"CASE WHEN ord % 19 = 5 THEN {at('knowledge_points', '.importance')} || ': missing' END"),
        (7, 0, f"CASE WHEN topic IS NOT NULL THEN {size(at('suggested_topics', '.title', 'j'), 'topic', 200)} END"), (7, 1, f"CASE WHEN topic IS NOT NULL THEN {size(at('suggested_topics', '.reason', 'j'), 'statement', 800)} END"),
        (8, 0, size(at("concept_links", ".reason"), "title", 500)), (9, 0, size(at("coverage", ".reason"), "title", 500)),
    ]
    heads = [
        (0, size("'summary'", "summary", 2500)), (1, "CASE WHEN (doc_id + slice) % 5 = 4 THEN 'relevance: not one of direct, partial, contextual, out_of_scope' END"),
        (2, size("'relevance_reason'", "reason", 800)), (3, "CASE WHEN (doc_id + slice) % 13 = 0 THEN 'source_boundary: missing' END"),
    ]
    parts = [f"SELECT document_id, slice, {n} AS fld, 0 AS i, 0 AS p, {x} AS fault FROM heads" for n, x in heads] + [f"SELECT document_id, slice, {n}, i, {p}, {x} FROM s" for n, p, x in lines]
    return " UNION ALL ".join(parts)


SLICES = ITEMS + f""", s AS (SELECT project_id, document_id, doc_id, ord, slice, 'doc-' || doc_id || ':block:' || ord AS block_id, importance, {trimmed('theme')} AS theme, {trimmed('entity')} AS entity, {trimmed('title')} AS title,
    {trimmed('statement')} AS statement, {trimmed('topic')} AS topic, row_number() OVER (PARTITION BY document_id, slice ORDER BY ord) - 1 AS i, count(topic) OVER (PARTITION BY document_id, slice ORDER BY ord) - 1 AS j FROM items),
  heads AS (SELECT document_id, doc_id, slice, {trimmed("string_agg(statement, ' ' ORDER BY ord)")} AS summary, first(title ORDER BY ord) AS reason FROM (SELECT document_id, doc_id, slice, ord, statement, {trimmed('title')} AS title FROM items) GROUP BY ALL),
  faults AS (SELECT * FROM ({_faults()}) WHERE fault IS NOT NULL)"""


@query(f"""WITH {SLICES}, scores AS (SELECT document_id, slice, string_agg(CAST(CASE WHEN ord % 2 = 0 THEN 0.9::DOUBLE ELSE importance END AS VARCHAR), ',' ORDER BY ord) AS importance FROM s GROUP BY ALL)
  SELECT document_id, slice, coalesce(string_agg(fault, '; ' ORDER BY fld, i, p), '') AS faults, CASE WHEN count(fault) = 0 THEN any_value(importance) END AS importance
  FROM heads LEFT JOIN faults USING (document_id, slice) JOIN scores USING (document_id, slice) GROUP BY ALL""")
def validate_analysis_slices(spark, d):
    rows = C.validated(Texts(spark, d).slice_drafts(), "draft", C.SLICE)
    scores = F.array_join(F.transform("draft.knowledge_points", lambda p: p["importance"].cast("string")), ",")
    return rows.select("document_id", "slice", F.array_join("faults", "; ").alias("faults"), scores.alias("importance"))


@query(f"""WITH a AS (SELECT conv_id AS t, CAST(turn AS BIGINT) AS ord, text, string_split(text, '. ') AS ps FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
  p AS (SELECT t, ord, i, ps[i + 1] AS x FROM (SELECT *, unnest(range(len(ps))) AS i FROM a)),
  f AS (SELECT t, ord, 0 AS fld, -1 AS i, 0 AS p, {size("'answer'", 'text', 8000)} AS fault FROM a
    UNION ALL SELECT t, ord, 1, -1, 0, CASE WHEN len(ps) > 8 THEN 'claims: more than 8' END FROM a
    UNION ALL SELECT t, ord, 1, i, 0, {size("'claims[' || i || '].text'", 'x', 1000)} FROM p UNION ALL SELECT t, ord, 1, i, 1, CASE WHEN (t + i) % 4 = 3 THEN 'claims[' || i || '].status: not one of observed, reported, inferred' END FROM p
    UNION ALL SELECT t, ord, 1, i, 2, CASE WHEN (t + i) % 3 = 0 THEN 'claims[' || i || '].node_ids: fewer than 1' END FROM p UNION ALL SELECT t, ord, 1, i, 3, CASE WHEN (ord + i) % 5 = 0 THEN 'claims[' || i || '].evidence_ids: missing' END FROM p
    UNION ALL SELECT t, ord, 2, -1, 0, CASE WHEN len(ps) > 40 THEN 'citations: more than 40' END FROM a
    UNION ALL SELECT t, ord, 2, i, 0, CASE WHEN i % 7 = 6 THEN 'citations[' || i || '].document_name: shorter than 1' END FROM p
    UNION ALL SELECT t, ord, 2, i, 1, CASE WHEN (t + i) % 9 = 0 THEN 'citations[' || i || '].page: not a positive whole number' END FROM p
    UNION ALL SELECT t, ord, 2, i, 2, {size("'citations[' || i || '].topic'", trimmed('x'), 160)} FROM p
    UNION ALL SELECT t, ord, 2, i, 3, CASE WHEN (t + i) % 4 = 2 THEN 'citations[' || i || '].status: not one of observed, reported, inferred' END FROM p
    UNION ALL SELECT t, ord, 3, -1, 0, CASE WHEN t % 3 = 0 THEN 'limitations: missing' WHEN len(ps) > 5 THEN 'limitations: more than 5' END FROM a
    UNION ALL SELECT t, ord, 3, i, 0, CASE WHEN t % 3 > 0 THEN {size("'limitations[' || i || ']'", 'x', 800)} END FROM p)
  SELECT t AS thread_id, ord, coalesce(string_agg(fault, '; ' ORDER BY fld, i, p), '') AS faults FROM f GROUP BY ALL""")
def validate_answers(spark, d):
    rows = C.validated(Texts(spark, d).answer_drafts(), "draft", C.ANSWER)
    return rows.select("thread_id", "ord", F.array_join("faults", "; ").alias("faults"))


def _lists() -> str:
    key = lambda x: f"lower({NORM.format(x)})"
    kinds = [
        ("themes", "theme", 32, "theme", "true"), ("entities", key("entity"), 160, "entity || '(' || CASE WHEN ord % 4 < 3 THEN theme ELSE '' END || ')[' || theme || ']{' || block_id || '}'", "true"),
        ("points", f"{key('title')} || '|' || {key('statement')}", 320, "document_id || ':analysis-point:' || left(sha256('finding|' || title || '|' || statement || '|' || block_id), 20) || ' ' || CAST(CASE WHEN ord % 2 = 0 THEN 0.9::DOUBLE ELSE importance END AS VARCHAR)", "true"),
        ("topics", key("topic"), 80, "topic || '{' || block_id || '}'", "topic IS NOT NULL"), ("links", "block_id", 80, "'r' || ord % 4 || '{' || block_id || '}'", "ord % 4 < 3 AND project_id IS NOT NULL"),
    ]
    out = []
    for name, by, most, text, only in kinds:
        out.append(f"""{name}_1 AS (SELECT document_id, src, ord, {text} AS x FROM x WHERE {only} AND {by} <> '' QUALIFY row_number() OVER (PARTITION BY document_id, {by} ORDER BY src, ord) = 1),
  {name}_2 AS (SELECT * FROM {name}_1 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY src, ord) <= {most}), {name}_3 AS (SELECT document_id, string_agg(x, ' / ' ORDER BY src, ord) AS {name} FROM {name}_2 GROUP BY 1)""")
    return ", ".join(out)


@query(f"""WITH {SLICES}, ok AS (SELECT *, (doc_id + slice) % 5 AS rel FROM heads WHERE (document_id, slice) NOT IN (SELECT document_id, slice FROM faults)),
  x AS (SELECT s.*, slice AS src FROM s JOIN ok USING (document_id, slice) UNION ALL SELECT s.*, -1 FROM s JOIN ok USING (document_id, slice) WHERE slice = 1 AND s.doc_id % 5 = 0), {_lists()},
  said AS (SELECT document_id, left(string_agg(summary, ' ' ORDER BY slice), 2500) AS summary, left(string_agg(reason, ' ' ORDER BY slice), 800) AS reason, left(string_agg(document_id, ' ' ORDER BY slice), 1000) AS boundary, min(rel) AS rel FROM ok GROUP BY 1),
  syn AS (SELECT document_id, 'all of ' || document_id AS summary, reason, document_id AS boundary, rel FROM ok WHERE slice = 1 AND doc_id % 5 = 0),
  open AS (SELECT document_id, count(*) FILTER (ok.slice IS NULL OR ord % 6 = 4) AS unresolved FROM s LEFT JOIN ok USING (document_id, slice) GROUP BY 1),
  d AS (SELECT 'doc-' || doc_id AS document_id, CASE WHEN lang = 'zh' THEN '{S.NOTHING["zh"]}' ELSE '{S.NOTHING["en"]}' END AS nothing FROM documents)
  SELECT d.document_id, coalesce(syn.summary, said.summary, nothing) AS summary, coalesce(syn.reason, said.reason, nothing) AS relevance_reason, coalesce(syn.boundary, said.boundary, nothing) AS source_boundary,
    ['direct', 'partial', 'contextual', 'out_of_scope'][coalesce(syn.rel, said.rel, 3) + 1] AS relevance, coalesce(themes, '') AS themes, coalesce(entities, '') AS entities, coalesce(points, '') AS points, coalesce(topics, '') AS topics,
    coalesce(links, '') AS links, coalesce(unresolved, 0) AS unresolved
  FROM d LEFT JOIN said USING (document_id) LEFT JOIN syn USING (document_id) LEFT JOIN open USING (document_id) LEFT JOIN themes_3 USING (document_id) LEFT JOIN entities_3 USING (document_id) LEFT JOIN points_3 USING (document_id)
    LEFT JOIN topics_3 USING (document_id) LEFT JOIN links_3 USING (document_id)""")
def document_analysis(spark, d):
    t = Texts(spark, d)
    slices = staged(C.validated(t.slice_drafts(), "draft", C.SLICE).select("document_id", "slice", "draft"), "slices")
    fifth = F.regexp_extract("document_id", "([0-9]+)$", 1).cast("long") % 5 == 0
    synthesis = slices.filter((F.col("slice") == 1) & fifth).select("document_id", F.col("draft").withField("summary", F.concat(F.lit("all of "), "document_id")).alias("draft")).filter("draft.relevance is not null")
    registry = t.documents().select("project_id").distinct().select("project_id", F.explode(F.array(*[F.lit(r) for r in ("r0", "r1", "r2")])).alias("registry_entry_id"))
    out, coverage = S.document_analysis(t.documents(), t.line_blocks().select("document_id", "block_id"), slices, registry, synthesis)
    open_blocks = coverage.groupBy("document_id").agg(F.count_if(F.col("status") == "unresolved").alias("unresolved"))
    told = lambda c, f: F.array_join(F.transform(c, f), " / ")
    ids = lambda x: F.concat(F.lit("{"), F.array_join(x["evidence"], ","), F.lit("}"))
    entity = lambda x: F.concat(x["item"]["name"], F.lit("("), F.coalesce(x["item"]["type"], F.lit("")), F.lit(")["), F.array_join(x["item"]["aliases"], ","), F.lit("]"), ids(x))
    return out.join(open_blocks.hint("merge"), "document_id", "left").select(
        "document_id", "summary", "relevance", "relevance_reason", "source_boundary", F.array_join("themes", " / ").alias("themes"), told("entities", entity).alias("entities"),
        told("knowledge_points", lambda x: F.concat(x["id"], F.lit(" "), x["item"]["importance"].cast("string"))).alias("points"), told("suggested_topics", lambda x: F.concat(x["item"]["name"], ids(x))).alias("topics"),
        told("concept_links", lambda x: F.concat(x["item"]["registry_entry_id"], ids(x))).alias("links"), F.coalesce("unresolved", F.lit(0)).alias("unresolved"),
    )


def concept_tables(s: Star) -> dict:
    """Parts as candidates, their brands and sizes as overlapping groups, brands as registry entries."""
    k, text = F.col("p_partkey"), lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    parts = s.raw("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").withColumns({"project_id": text("proj-", (k % 5).cast("string")), "candidate_id": text("c", F.lpad(k.cast("string"), 9, "0"))})
    parts = staged(parts, "concept-parts")
    candidates = parts.select(
        "project_id", "candidate_id", F.col("candidate_id").alias("ord"), F.when(k % 10 == 9, "ignore").otherwise("review").alias("decision"), F.col("p_name").alias("name"), F.when(k % 4 == 0, text("The ", F.col("p_type"))).alias("canonical_name"),
        F.lower("p_name").alias("canonical_key"), F.col("p_type").alias("type"), F.when(k % 6 == 0, F.array(F.upper("p_name"), F.col("p_brand"))).alias("aliases"), F.when(k % 7 > 0, text("about ", F.col("candidate_id"))).alias("summary"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string"), text("odd", (k % 3).cast("string")), F.col("candidate_id")).alias("properties"), F.array(text("e", (k % 13).cast("string"))).alias("evidence_ids"),
        F.array(text("m", (k % 17).cast("string")), text("m", (k % 3).cast("string"))).alias("claim_ids"), ((k % 11).cast("double") / 10).alias("importance"),
    )
    by = lambda n, c: parts.select(F.concat_ws("|", F.lit(n), "project_id", F.col(c).cast("string")).alias("group_id"), "project_id", F.lit(n).alias("n"), F.col(c).cast("string").alias("of"), "p_partkey", "candidate_id", "p_type", "p_size")
    rows = by("1", "p_brand").unionByName(by("2", "p_size"))
    lead = rows.groupBy("group_id", "project_id", "n", "of").agg(F.min_by(F.struct("candidate_id", "p_type"), "candidate_id").alias("low"), F.max_by(F.struct("candidate_id", "p_type"), "candidate_id").alias("high"))
    first = F.col("n") == "1"
    last = F.substring("of", -1, 1)
    score = F.when(first, F.when(last.isin("1", "2"), 0.9).otherwise(0.75)).otherwise(F.when(last.isin("0", "3", "6", "9"), 0.6).when(last.isin("1", "4", "7"), 0.8).otherwise(0.95))
    groups = lead.select(
        "project_id", "group_id", F.col("group_id").alias("ord"), F.when(first, F.col("low.candidate_id")).otherwise(F.col("high.candidate_id")).alias("canonical"), F.when(first, text("r", F.col("of"))).alias("registry_id"), text("Concept ", F.col("of")).alias("name"),
        F.when(last == "4", "unknown").otherwise(F.when(first, F.col("low.p_type")).otherwise(F.col("high.p_type"))).alias("type"), F.when(last == "5", "").otherwise(text("sum ", F.col("of"))).alias("summary"), score.alias("confidence"), text("why ", F.col("of")).alias("reason"),
    )
    action = F.when(k % 5 == 1, "keep_separate").when(k % 8 == 3, "uncertain").when(k % 2 == 0, "same_as").otherwise("facet_of")
    members = rows.select("group_id", F.col("candidate_id").alias("member_id"), F.col("candidate_id").alias("place"), action.alias("action"), text("as ", F.col("candidate_id")).alias("reason"))
    brands = parts.select("project_id", "p_brand").distinct()
    b = F.col("p_brand")
    registry = brands.select(
        "project_id", text("r", b).alias("registry_id"), text("Reg ", b).alias("name"), text("Type of ", b).alias("type"), text("old ", b).alias("summary"), F.array(text("Old ", b), F.upper(text("reg ", b))).alias("aliases"), F.array(F.lit("c0")).alias("member_ids"),
        F.array(F.lit("m1")).alias("claim_ids"), F.array(F.lit("e99"), F.lit("e1")).alias("evidence_ids"), F.lit(0.85).alias("confidence"), F.when(b.endswith("3"), "orphaned").otherwise("active").alias("status"),
    )
    categories = parts.select("project_id", F.col("p_type").alias("ord"), F.col("p_type").alias("label")).distinct().filter("label > 'F'")
    return {"candidates": candidates, "groups": staged(groups, "concept-groups"), "members": members, "registry": registry, "categories": categories}


def key_sql(x: str) -> str:
    return f"trim(lower(regexp_replace(regexp_replace({x}, '[\\s_-]+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\s.+#]', '', 'g')))"


@query(f"""WITH RECURSIVE c AS (SELECT 'proj-' || p_partkey % 5 AS project_id, 'c' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, p_partkey AS k, p_name AS name, CASE WHEN p_partkey % 4 = 0 THEN 'The ' || p_type END AS cname, p_type AS type, p_brand AS brand, CAST(p_size AS VARCHAR) AS size,
    CASE WHEN p_partkey % 6 = 0 THEN [upper(p_name), p_brand] ELSE [] END AS aliases, CASE WHEN p_partkey % 7 > 0 THEN 'about c' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS summary FROM part),
  able AS (SELECT * FROM c WHERE k % 10 <> 9), m AS (SELECT '1|' || project_id || '|' || brand AS g, '1' AS n, brand AS of, c.* FROM c UNION ALL SELECT '2|' || project_id || '|' || size, '2', size, c.* FROM c),
  g AS (SELECT g, n, of, project_id, CASE WHEN n = '1' THEN min(id) ELSE max(id) END AS canonical, CASE WHEN n = '1' THEN 'r' || of END AS reg, 'Concept ' || of AS gname, CASE WHEN right(of, 1) = '4' THEN 'unknown' WHEN n = '1' THEN arg_min(type, id) ELSE arg_max(type, id) END AS gtype,
    CASE WHEN right(of, 1) = '5' THEN '' ELSE 'sum ' || of END AS gsummary, CASE WHEN n = '1' THEN CASE WHEN right(of, 1) IN ('1', '2') THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END WHEN right(of, 1) IN ('0', '3', '6', '9') THEN 0.6::DOUBLE WHEN right(of, 1) IN ('1', '4', '7') THEN 0.8::DOUBLE ELSE 0.95::DOUBLE END AS conf FROM m GROUP BY g, n, of, project_id),
  gl AS (SELECT g.*, row_number() OVER (PARTITION BY project_id ORDER BY g) AS r, ids FROM g JOIN (SELECT g, list(id) FILTER (k % 10 <> 9) AS ids FROM m GROUP BY g) USING (g)),
  went AS (SELECT DISTINCT project_id, 0::BIGINT AS r, NULL::VARCHAR AS g, []::VARCHAR[] AS taken, false AS ok FROM gl UNION ALL
    SELECT w.project_id, l.r, l.g, CASE WHEN coalesce(list_contains(l.ids, l.canonical), false) AND NOT list_contains(w.taken, l.canonical) THEN list_concat(w.taken, l.ids) ELSE w.taken END, coalesce(list_contains(l.ids, l.canonical), false) AND NOT list_contains(w.taken, l.canonical)
    FROM went w JOIN gl l ON l.project_id = w.project_id AND l.r = w.r + 1),
  won AS (SELECT m.id, min(m.g) AS g FROM m JOIN went ON went.g = m.g AND ok WHERE k % 10 <> 9 GROUP BY 1),
  rows AS (SELECT a.*, g.g, g.canonical, gname, gtype, gsummary, conf, reg, of, coalesce(conf >= 0.72::DOUBLE AND (a.id = g.canonical OR NOT (k % 5 = 1 OR k % 8 = 3)), false) AS merged,
    CASE WHEN k % 5 = 1 THEN 'keep_separate' WHEN k % 8 = 3 THEN 'uncertain' WHEN k % 2 = 0 THEN 'same_as' ELSE 'facet_of' END AS action FROM able a LEFT JOIN won USING (id) LEFT JOIN g ON g.g = won.g),
  ent AS (SELECT *, CASE WHEN merged THEN 'g|' || g ELSE 'c|' || id END AS entry FROM rows),
  firsts AS (SELECT project_id, min(type) AS first, list(DISTINCT type) AS every FROM c WHERE type > 'F' GROUP BY 1),
  old AS (SELECT DISTINCT project_id, 'r' || brand AS reg, brand AS b FROM c WHERE right(brand, 1) <> '3'),
  h AS (SELECT e.project_id, entry, any_value(merged) AS merged, any_value(CASE WHEN merged THEN e.canonical ELSE e.id END) AS canonical, any_value(gname) AS gname, any_value(gtype) AS gtype, any_value(gsummary) AS gsummary, any_value(conf) AS conf, any_value(reg) AS reg, any_value(of) AS of,
    string_agg(e.id || ':' || CASE WHEN merged THEN action ELSE 'keep_separate' END, ',' ORDER BY e.id) AS members, list(e.id ORDER BY e.id) AS ids, max((k % 11)::DOUBLE / 10) AS importance, list(DISTINCT 'e' || k % 13) AS ev, list(k ORDER BY e.id) AS ks FROM ent e GROUP BY e.project_id, entry),
  h2 AS (SELECT h.*, b, a.name AS aname, a.cname, a.type AS atype, a.summary AS asummary, a.k AS ak, a.size AS asize, CASE WHEN b IS NOT NULL THEN 'Reg ' || b WHEN h.merged THEN gname ELSE coalesce(a.cname, a.name) END AS name,
    CASE WHEN b IS NOT NULL THEN h.reg ELSE h.project_id || ':concept:' || left(sha256(lower(a.name)), 20) END AS rid,
    coalesce(CASE WHEN b IS NOT NULL THEN 'Type of ' || b END, CASE WHEN h.merged AND list_contains(every, gtype) THEN gtype END, CASE WHEN list_contains(every, a.type) THEN a.type END, first) AS type
    FROM h LEFT JOIN old ON old.project_id = h.project_id AND old.reg = h.reg AND h.merged JOIN able a ON a.id = h.canonical JOIN firsts ON firsts.project_id = h.project_id),
  h3 AS (SELECT *, coalesce(CASE WHEN merged THEN nullif(gsummary, '') END, 'old ' || b, asummary, name) AS summary, CASE WHEN merged THEN conf ELSE 1.0::DOUBLE END AS proposed FROM h2),
  said AS (SELECT project_id, entry, id, i, l[i + 1] AS alias, g, merged FROM (SELECT *, unnest(range(len(l))) AS i FROM (SELECT *, list_concat([name, cname], aliases) AS l FROM ent)) WHERE l[i + 1] <> ''),
  spoken AS (SELECT entry, alias, min((1, id, i)) AS p FROM said GROUP BY 1, 2 UNION ALL SELECT entry, 'Old ' || b, (0, '', 0) FROM h3 WHERE b IS NOT NULL UNION ALL SELECT entry, upper('reg ' || b), (0, '', 1) FROM h3 WHERE b IS NOT NULL),
  al AS (SELECT entry, string_agg(alias, ',' ORDER BY p) AS aliases FROM (SELECT s.entry, alias, min(p) AS p FROM spoken s JOIN h3 USING (entry) WHERE {key_sql("alias")} <> {key_sql("h3.name")} GROUP BY 1, 2) GROUP BY 1),
  props AS (SELECT entry, string_agg(p || '=' || v, ';' ORDER BY p) AS properties FROM (SELECT entry, p, arg_min(v, (id <> canonical, id)) AS v FROM (SELECT h3.entry, h3.canonical, e.id, unnest(['size', 'odd' || e.k % 3]) AS p, unnest([e.size, e.id]) AS v FROM ent e JOIN h3 ON h3.entry = e.entry) GROUP BY 1, 2) GROUP BY 1),
  claims AS (SELECT entry, string_agg(x, ',' ORDER BY p) AS claim_ids FROM (SELECT entry, x, min(p) AS p FROM (SELECT entry, 'm' || k % 17 AS x, (1, id, 0) AS p FROM ent UNION ALL SELECT entry, 'm' || k % 3, (1, id, 1) FROM ent UNION ALL SELECT entry, 'm1', (0, '', 0) FROM h3 WHERE b IS NOT NULL) GROUP BY 1, 2) GROUP BY 1),
  proof AS (SELECT entry, string_agg(x, ',' ORDER BY x) AS evidence FROM (SELECT DISTINCT entry, x FROM (SELECT entry, unnest(CASE WHEN b IS NOT NULL THEN list_concat(ev, ['e99', 'e1']) ELSE ev END) AS x FROM h3)) GROUP BY 1),
  w AS (SELECT *, CASE WHEN merged AND proposed < 0.82::DOUBLE THEN 'needs_review' ELSE 'active' END AS status FROM h3 LEFT JOIN al USING (entry) LEFT JOIN props USING (entry) LEFT JOIN claims USING (entry) LEFT JOIN proof USING (entry))
  SELECT 'resolution' AS output, project_id, project_id || ':resolution:' || left(sha256('3|' || rid || '|' || array_to_string(ids, '|')), 20) AS id, concat_ws('|', rid, canonical, name, type, summary, members, CASE WHEN merged THEN 'why ' || of ELSE '{M.SINGLE}' END, CASE WHEN status = 'active' THEN 'accepted' ELSE status END, CASE WHEN merged THEN 'ai' ELSE 'fallback' END) AS detail, proposed AS value FROM w
  UNION ALL SELECT 'registry', project_id, entry, concat_ws('|', rid, name, type, summary, coalesce(aliases, ''), CASE WHEN b IS NOT NULL THEN 'c0,' ELSE '' END || array_to_string(ids, ','), claim_ids, evidence, status), greatest(CASE WHEN b IS NOT NULL THEN 0.85::DOUBLE ELSE 0 END, proposed) FROM w
  UNION ALL SELECT 'entity', project_id, entry, concat_ws('|', rid, name, type, summary, coalesce(aliases, ''), properties, evidence), importance FROM w
  UNION ALL SELECT 'name', s.project_id, {key_sql("alias")}, arg_max(h3.name, (s.g IS NULL, coalesce(s.g, ''), NOT s.merged, CASE WHEN s.merged THEN '' ELSE id END, id, i)), NULL FROM said s JOIN h3 USING (entry) GROUP BY 2, 3""")
def consolidate_concepts(spark, d):
    out = M.consolidate(**concept_tables(Star(spark, d)), revision=3)
    listed = lambda c: F.array_join(c, ",")
    told = F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["candidate_id"], m["action"])), ",")
    resolutions = out.resolutions.select(F.lit("resolution").alias("output"), "project_id", F.col("resolution_id").alias("id"), F.concat_ws("|", "registry_id", "canonical", "name", "type", "summary", told, "reason", "status", "source").alias("detail"), F.col("confidence").alias("value"))
    registry = out.registry.select(F.lit("registry"), "project_id", "entry", F.concat_ws("|", "registry_id", "name", "type", "summary", listed("aliases"), listed("member_ids"), listed("claim_ids"), listed("evidence_ids"), "status"), "confidence")
    entities = out.entities.select(F.lit("entity"), "project_id", "entry", F.concat_ws("|", "registry_id", "name", "type", "summary", listed("aliases"), X.props_text(F.col("properties")), listed("evidence_ids")), "importance")
    return resolutions.union(registry).union(entities).union(out.names.select(F.lit("name"), "project_id", "form", "name", F.lit(None).cast("double")))
