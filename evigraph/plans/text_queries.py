"""Queries and SQL of the scalar functions and of the operators over the text fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import blocks as B
from ..operators import chat as C
from ..operators import fingerprint as P
from ..sources.fixtures import Texts

WS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x0B\x1C-\x1F\x85]+"
NORM = "trim(regexp_replace({}, '" + WS.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'))"
LINES = """lines AS (SELECT source AS project_id, 'doc-' || doc_id AS document_id, doc_id, CAST(i - 1 AS BIGINT) AS ord, 'doc-' || doc_id || ':block:' || (i - 1) AS block_id, ls[i] AS text
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)) WHERE ls[i] <> '')"""
DECISIONS = "decisions AS (SELECT doc_id, quality = 1 OR doc_id % 2 = 0 AS keep, 0.3::DOUBLE + 0.5::DOUBLE * quality - 0.25::DOUBLE * toxic AS score FROM labels)"
MESSAGES = "messages AS (SELECT conv_id AS thread_id, 'proj-' || (conv_id % 20) AS project_id, CAST(turn AS BIGINT) AS ord, role, text FROM conversations)"

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return Texts(spark, d).raw("documents")


# scalar functions


@query(f"SELECT doc_id, {NORM.format('text')} AS value FROM documents")
def normalise_ws(spark, d):
    return docs(spark, d).select("doc_id", X.normalise_ws(F.col("text")).alias("value"))


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<(?:w:)?tab\s*/?>', chr(9), 'g'), '(?i)<(?:w:)?br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'),
  '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') AS value FROM pages""")
def decode_entities(spark, d):
    return Texts(spark, d).raw("pages").select("page_id", X.decode_entities(F.col("html")).alias("value"))


@query(f"SELECT doc_id, lower({NORM.format('nfc_normalize(text)')}) AS value FROM documents")
def normalize_text(spark, d):
    return X.nfkc(docs(spark, d).select("doc_id", "text"), "text", "n").select("doc_id", X.text_key(F.col("n")).alias("value"))


@query("SELECT p_partkey, lower(trim(p_type)) AS value FROM part")
def normalize_label(spark, d):
    return X.nfkc(Texts(spark, d).raw("part"), "p_type", "n").select("p_partkey", X.label_key(F.col("n")).alias("value"))


@query("SELECT doc_id, sha256(base64(encode(text))) AS value FROM documents")
def content_hash(spark, d):
    return docs(spark, d).select("doc_id", X.content_hash(F.col("text")).alias("value"))


@query("SELECT c_custkey, 'proj-' || (c_nationkey % 5) || ':node:' || left(sha256(lower(c_name)), 16) AS value FROM customer")
def scoped_id(spark, d):
    project = F.concat(F.lit("proj-"), (F.col("c_nationkey") % 5).cast("string"))
    return Texts(spark, d).raw("customer").select("c_custkey", X.scoped_id(project, "node", F.lower("c_name")).alias("value"))


@query(f"WITH {LINES} SELECT block_id, document_id || ':block:' || left(sha256(concat_ws('|', 'h', 1, 'paragraph', ord, text)), 20) AS value FROM lines")
def stable_block_id(spark, d):
    b = Texts(spark, d).line_blocks()
    return b.select("block_id", X.stable_block_id(F.col("document_id"), F.lit("h"), F.lit(1), F.lit("paragraph"), F.col("ord"), F.col("text")).alias("value"))


@query("""SELECT o_orderkey, CASE WHEN trim(w) = '' THEN 0.0::DOUBLE WHEN lower(trim(w)) IN ('high', 'very high') THEN 0.9::DOUBLE WHEN lower(trim(w)) = 'medium' THEN 0.6::DOUBLE WHEN lower(trim(w)) = 'low' THEN 0.3::DOUBLE
  WHEN try_cast(w AS DOUBLE) IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, try_cast(w AS DOUBLE))) ELSE 0.5::DOUBLE END AS value
  FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey % 100 AS VARCHAR) || 'e-2' WHEN 1 THEN ' ' WHEN 2 THEN lower(split_part(o_orderpriority, '-', 2)) WHEN 3 THEN ' Very High' WHEN 4 THEN CAST(o_orderkey AS VARCHAR) ELSE 'none' END AS w FROM orders)""")
def coerce_score(spark, d):
    k = F.col("o_orderkey")
    w = (
        F.when(k % 6 == 0, F.concat((k % 100).cast("string"), F.lit("e-2"))).when(k % 6 == 1, " ").when(k % 6 == 2, F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))))
        .when(k % 6 == 3, " Very High").when(k % 6 == 4, k.cast("string")).otherwise("none")
    )
    return Texts(spark, d).raw("orders").select("o_orderkey", w.alias("w")).select("o_orderkey", X.coerce_score(F.col("w")).alias("value"))


@query("SELECT event_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 100)) AS clamped, floor(value / 100 * 10000 + 0.5) / 10000::DOUBLE AS rounded FROM events")
def clamp01_round4(spark, d):
    v = F.col("value") / 100
    return Texts(spark, d).raw("events").select("event_id", X.clamp01(v).alias("clamped"), X.round4(v).alias("rounded"))


@query("SELECT doc_id, left(text, 280) AS value FROM documents")
def clip(spark, d):
    return docs(spark, d).select("doc_id", X.clip(F.col("text"), 280).alias("value"))


@query("""SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) IS NOT NULL AS parsed FROM events""")
def extract_json_object(spark, d):
    chat = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    got = X.extract_json(chat, "map<string,string>")
    return Texts(spark, d).raw("events").select("event_id", (F.size(got) > 0).alias("parsed"))


@query(f"""WITH {MESSAGES} SELECT thread_id, coalesce(nullif(left({NORM.format('text')}, 72), ''), 'New chat') AS title FROM messages WHERE ord = 0""")
def thread_title(spark, d):
    return Texts(spark, d).messages().filter("ord = 0").select("thread_id", X.thread_title(F.col("text")).alias("title"))


@query("SELECT o_orderkey, '\"' || replace(o_clerk || '\"x', '\"', '\"\"') || '\"' AS value FROM (SELECT o_orderkey, o_orderpriority AS o_clerk FROM orders)")
def csv_cell(spark, d):
    return Texts(spark, d).raw("orders").select("o_orderkey", X.csv_cell(F.concat("o_orderpriority", F.lit('"x'))).alias("value"))


@query("SELECT doc_id, regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)(the|of\\.)', '<mark>\\1</mark>', 'g') AS value FROM documents")
def highlight_terms(spark, d):
    return docs(spark, d).select("doc_id", X.highlight_terms(F.col("text"), " the of. ").alias("value"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_. -]', '_', 'g') AS value FROM pages")
def sanitize_file_name(spark, d):
    return Texts(spark, d).raw("pages").select("page_id", X.sanitize_file_name(F.col("url")).alias("value"))


@query("SELECT c_custkey, sha256('{\"name\":\"' || c_name || '\",\"nation\":' || c_nationkey || '}') AS value FROM customer")
def canonical_json(spark, d):
    got = X.canonical_json(nation=F.col("c_nationkey"), name=F.col("c_name"), gone=F.lit(None).cast("string"))
    return Texts(spark, d).raw("customer").select("c_custkey", F.sha2(got.cast("binary"), 256).alias("value"))


@query("""SELECT c_custkey, '{"a":[' || CASE WHEN c_custkey % 3 = 0 THEN 'null,' ELSE '' END || '{"k":{' || CASE WHEN c_custkey % 2 = 0 THEN '"m":{"y":1},' ELSE '' END || '"z":{"y":2}},"n":"' || c_name || '"}],"b":{"c":' || c_nationkey || CASE WHEN c_custkey % 5 > 0 THEN ',"d":"x"' ELSE '' END || '}}' AS json FROM customer""")
def canonical_json_nested(spark, d):
    k = F.col("c_custkey")
    deep = F.create_map(F.lit("z"), F.create_map(F.lit("y"), F.lit(2), F.lit("gone"), F.lit(None).cast("int")), F.lit("m"), F.when(k % 2 == 0, F.create_map(F.lit("y"), F.lit(1))))
    item = F.struct(F.col("c_name").alias("n"), deep.alias("k"), F.lit(None).cast("string").alias("e"))
    value = F.struct(F.struct(F.when(k % 5 > 0, "x").alias("d"), F.col("c_nationkey").alias("c")).alias("b"), F.when(k % 3 == 0, F.array(F.lit(None), item)).otherwise(F.array(item)).alias("a"))
    return X.nested_json(Texts(spark, d).raw("customer").select("c_custkey", value.alias("value")), "value", "json").drop("value")


def _brand_props(spark, d):
    li = Texts(spark, d).raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.create_map(F.col("l_returnflag"), F.col("l_partkey").cast("string"), F.concat(F.col("l_returnflag"), F.lit("x")), F.col("l_suppkey").cast("string")).alias("props"))
    return li, [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")]


_FOLD = """SELECT l_orderkey, string_agg(k || '=' || v, ';' ORDER BY k) AS props FROM (
  SELECT l_orderkey, k, arg_{m}(v, o) AS v FROM (
    SELECT l_orderkey, (l_linenumber, l_partkey, l_suppkey, l_quantity) AS o, l_returnflag AS k, CAST(l_partkey AS VARCHAR) AS v FROM lineitem
    UNION ALL SELECT l_orderkey, (l_linenumber, l_partkey, l_suppkey, l_quantity), l_returnflag || 'x', CAST(l_suppkey AS VARCHAR) FROM lineitem) GROUP BY 1, 2) GROUP BY 1"""


@query(_FOLD.format(m="min"))
def props_first_wins(spark, d):
    df, order = _brand_props(spark, d)
    return X.props_fold(df, ["l_orderkey"], "props", order, last=False).select("l_orderkey", X.props_text(F.col("props")).alias("props"))


@query(_FOLD.format(m="max"))
def props_last_wins(spark, d):
    df, order = _brand_props(spark, d)
    return X.props_fold(df, ["l_orderkey"], "props", order, last=True).select("l_orderkey", X.props_text(F.col("props")).alias("props"))


@query("SELECT l_orderkey, string_agg(split_part(p, '=', 1) || '=' || split_part(p, '=', 2), ';' ORDER BY i) AS props FROM (SELECT l_orderkey, unnest(string_split(props, ';')[1:2]) AS p, unnest([1, 2][1:len(string_split(props, ';')[1:2])]) AS i FROM (" + _FOLD.format(m="min") + ")) GROUP BY 1")
def props_head(spark, d):
    df, order = _brand_props(spark, d)
    return X.props_fold(df, ["l_orderkey"], "props", order, last=False).select("l_orderkey", X.props_text(X.props_head(F.col("props"), 2)).alias("props"))


# scans and blocks


@query("SELECT doc_id, 'doc-' || doc_id AS document_id, text FROM documents WHERE source = 'src3'")
def scan_sources(spark, d):
    return B.scan_sources(Texts(spark, d).documents(), "src3").select("doc_id", "document_id", "text")


@query("SELECT doc_id, coalesce(source, 'none') AS project_id, coalesce(CAST(NULL AS BIGINT), 1) AS ontology_revision FROM documents")
def load_with_defaults(spark, d):
    got = B.load_with_defaults(spark, f"{d}/documents.parquet", "doc_id long, source string, ontology_revision long", {"source": "none", "ontology_revision": 1})
    return got.select("doc_id", F.col("source").alias("project_id"), "ontology_revision")


@query(r"""WITH p AS (SELECT page_id, regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1) AS ps FROM pages),
  r AS (SELECT page_id, unnest(range(1, len(ps) + 1)) AS paragraph, ps FROM p),
  t AS (SELECT page_id, paragraph, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(ps[paragraph], '(?i)<(?:w:)?tab\s*/?>', chr(9), 'g'), '(?i)<(?:w:)?br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'),
    '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') AS x FROM r)
  SELECT page_id, paragraph, """ + NORM.format("x") + " AS text FROM t WHERE " + NORM.format("x") + " <> ''")
def markup_paragraphs(spark, d):
    return B.markup_paragraphs(Texts(spark, d).raw("pages"))


@query(f"""WITH p AS (SELECT doc_id, string_split(replace(text, chr(10), chr(12)), chr(12)) AS ps FROM documents), r AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, ps FROM p)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS page, ps[i] AS text FROM r WHERE {NORM.format('ps[i]')} <> ''""")
def split_pages(spark, d):
    return B.split_pages(docs(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("text")))


@query()
def chunk_blocks(spark, d):
    return B.chunk_blocks(docs(spark, d).select("doc_id", "text")).select("doc_id", "chunk", "start", "text")


@query()
def build_blocks(spark, d):
    return B.build_blocks(Texts(spark, d).documents()).select("document_id", "block_id", "ord", "block_count", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))


#: Batches by following each opening to the next: ``l`` has k, i (places from 1), n (lengths) and the columns that are asked for.
PACKED = """sums AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY i) AS upto FROM l),
  leads AS MATERIALIZED (SELECT a.k, a.i, least(a.i + 28, greatest(a.i + 1, coalesce(b.i, 0) + 1)) AS nxt FROM sums a ASOF LEFT JOIN sums b ON a.k = b.k AND a.upto - a.n + 18000 >= b.upto),
  opens AS (SELECT k, i, nxt, 0::BIGINT AS batch FROM leads WHERE i = 1 UNION ALL SELECT o.k, l.i, l.nxt, o.batch + 1 FROM opens o JOIN leads l ON l.k = o.k AND l.i = o.nxt),
  packed AS (SELECT s.*, o.batch FROM sums s ASOF JOIN opens o ON s.k = o.k AND s.i >= o.i)"""


def sized_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their lengths; ``done`` is false for some."""
    done = (F.col("doc_id") * 7 + F.col("ord")) % 29 > 0
    return Texts(spark, d).line_blocks().select("project_id", "document_id", "doc_id", "ord", "block_id", F.length("text").alias("len"), done.alias("done"))


@query(f"WITH RECURSIVE {LINES}, l AS (SELECT document_id AS k, row_number() OVER (PARTITION BY document_id ORDER BY ord) AS i, length(text) AS n, block_id FROM lines), {PACKED} SELECT block_id, batch FROM packed")
def pack_text_budget(spark, d):
    return B.pack_text_budget(sized_lines(spark, d), ["document_id"], "ord", "len", 18_000, 28).select("block_id", "batch")


@query(f"WITH RECURSIVE {LINES}, l AS (SELECT coalesce(project_id, '') AS k, row_number() OVER (PARTITION BY project_id ORDER BY doc_id, ord) AS i, length(text) AS n, block_id FROM lines), {PACKED} SELECT block_id, batch FROM packed")
def pack_project_budget(spark, d):
    lines = sized_lines(spark, d).withColumn("at", F.struct("doc_id", "ord"))
    return B.pack_text_budget(lines, ["project_id"], "at", "len", 18_000, 28).select("block_id", "batch")


@query(f"""WITH RECURSIVE {LINES}, l AS (SELECT document_id AS k, row_number() OVER (PARTITION BY document_id ORDER BY ord) AS i, length(text) AS n, (doc_id * 7 + ord) % 29 > 0 AS done FROM lines), {PACKED},
  each AS (SELECT k, batch, count(*) AS items, sum(n) AS chars, bool_and(done) AS whole FROM packed GROUP BY ALL)
  SELECT k AS document_id, count(*) AS batches, CAST(sum(items) AS BIGINT) AS items, CAST(sum(chars) AS BIGINT) AS chars, count(*) FILTER (whole) AS completed, count(*) FILTER (whole) / count(*)::DOUBLE AS ratio FROM each GROUP BY k""")
def batch_stats(spark, d):
    packed = B.pack_text_budget(sized_lines(spark, d), ["document_id"], "ord", "len", 18_000, 28)
    return B.batch_stats(packed, ["document_id"], "len", "done")


# relevance and coverage


@query(f"WITH {LINES}, {DECISIONS} SELECT block_id FROM lines LEFT JOIN (SELECT doc_id, bool_or(keep AND score >= 0.42) AS pass FROM decisions GROUP BY 1) USING (doc_id) WHERE coalesce(pass, true)")
def relevance_filter(spark, d):
    t = Texts(spark, d)
    return B.relevance_filter(t.line_blocks(), t.relevance_decisions(), "doc_id").select("block_id")


@query(f"WITH {LINES} SELECT block_id FROM lines WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_coverage(spark, d):
    t = Texts(spark, d)
    return B.missing_coverage(t.line_blocks(), t.raw("labels").select("doc_id"), ["doc_id"]).select("block_id")


@query(f"WITH {LINES} SELECT block_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN toxic = 1 THEN 'no_goal_relevant_claim' WHEN quality = 1 THEN 'claimed' ELSE 'unresolved' END AS status FROM lines LEFT JOIN labels l USING (doc_id)")
def coverage_status(spark, d):
    t = Texts(spark, d)
    status = F.when(F.col("quality").isNull(), "missing").when(F.col("toxic") == 1, "no_goal_relevant_claim").when(F.col("quality") == 1, "claimed").otherwise("unresolved")
    return t.line_blocks().join(t.raw("labels"), "doc_id", "left").select("block_id", status.alias("status"))


@query(f"WITH {LINES} SELECT project_id, bool_and(coalesce(toxic = 0 AND quality = 0, true)) AS unresolved_only FROM lines LEFT JOIN labels USING (doc_id) GROUP BY 1")
def unresolved_only(spark, d):
    t = Texts(spark, d)
    rows = t.line_blocks().join(t.raw("labels"), "doc_id", "left").select("project_id", F.coalesce((F.col("toxic") == 0) & (F.col("quality") == 0), F.lit(True)).alias("open"))
    return rows.groupBy("project_id").agg(F.bool_and("open").alias("unresolved_only"))


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'new' WHEN doc_id % 10 = 8 THEN 'removed' WHEN doc_id % 10 = 7 THEN 'retry' ELSE 'kept' END AS state FROM documents""")
def delta_documents(spark, d):
    k = F.col("doc_id") % 10
    every = docs(spark, d).select("doc_id")
    return B.delta_documents(every.filter(k != 8), every.filter(k != 9).select("doc_id", (k == 7).alias("failed")), "doc_id")


@query("SELECT 'doc-' || doc_id AS document_id, doc_id % 3 AS version FROM documents WHERE doc_id % 3 <> 1 UNION ALL SELECT 'doc-' || doc_id, 9 FROM documents WHERE doc_id % 3 = 1")
def replace_analyses(spark, d):
    old = docs(spark, d).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"), (F.col("doc_id") % 3).alias("version"))
    return B.replace_rows(old, old.filter("version = 1").select("document_id", F.lit(9).cast("long").alias("version")), ["document_id"])


# manifests


def tree(leaves: str, name: str) -> str:
    """CTEs ``name``_0 to ``name``_3: a plain hash tree over a query with k, o (order) and h; ``name``_3 has k, n and the root h."""
    out = f"{name}_0 AS (SELECT k, h, row_number() OVER (PARTITION BY k ORDER BY o) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM ({leaves}))"
    for level in (1, 2, 3):
        root = f"CASE WHEN n <= {256 ** (level - 1)} THEN any_value(h) ELSE sha256(string_agg(h, ',' ORDER BY i)) END" if level > 1 else "sha256(string_agg(h, ',' ORDER BY i))"
        out += f", {name}_{level} AS (SELECT k, n, up AS i, {root} AS h FROM (SELECT *, i // 256 AS up FROM {name}_{level - 1}) GROUP BY k, n, up)"
    return out


DOC_ROOTS = tree("SELECT document_id AS k, ord AS o, sha256(ord || '|' || text) AS h FROM lines", "docs_tree")


@query(f"WITH {LINES}, {DOC_ROOTS} SELECT k AS document_id, n AS block_count, h AS fingerprint FROM docs_tree_3")
def manifest_documents(spark, d):
    return P.manifest_documents(Texts(spark, d).line_blocks())


@query(f"""WITH {LINES}, {DOC_ROOTS}, {tree("SELECT project_id AS k, h AS o, h FROM docs_tree_3 JOIN (SELECT DISTINCT document_id, project_id FROM lines) ON document_id = k", "in_tree")}
  SELECT k AS project_id, sha256('v1|' || h) AS fingerprint FROM in_tree_3""")
def input_fingerprint(spark, d):
    t = Texts(spark, d)
    m = P.manifest_documents(t.line_blocks()).join(t.documents().select("document_id", "project_id"), "document_id")
    return P.input_fingerprint(m, "v1")


@query("SELECT source AS project_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(text) NULLS FIRST, doc_id) AS place FROM documents")
def manifest_order(spark, d):
    rows = docs(spark, d).select(F.col("source").alias("project_id"), "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return P.manifest_order(rows, "hash", "doc_id").drop("hash")


# chat tables


@query(f"WITH {MESSAGES} SELECT thread_id, ord, string_agg(left(text, 1600), ' / ' ORDER BY ord) OVER (PARTITION BY thread_id ORDER BY ord ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS history FROM messages")
def history_tail(spark, d):
    return C.history_tail(Texts(spark, d).messages())


@query(f"WITH {MESSAGES} SELECT thread_id, ord, role FROM messages WHERE thread_id = 3")
def messages_in_order(spark, d):
    return C.messages_in_order(Texts(spark, d).messages(), 3).select("thread_id", "ord", "role")


@query(f"WITH {MESSAGES} SELECT thread_id, count(*) AS n FROM messages WHERE thread_id % 7 <> 2 GROUP BY 1")
def delete_thread(spark, d):
    m = Texts(spark, d).messages()
    gone = m.filter("thread_id % 7 = 2").select("thread_id").distinct()
    return B.without(m, gone, ["thread_id"]).groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'proj-' || (user_id % 5) AS project_id, arg_max(event_type, (ts, event_id)) AS status, max(event_id) FILTER (true) >= 0 AS known FROM events GROUP BY 1")
def latest_job(spark, d):
    jobs = Texts(spark, d).raw("events").select(F.concat(F.lit("proj-"), (F.col("user_id") % 5).cast("string")).alias("project_id"), "event_id", "ts", F.col("event_type").alias("status"))
    return C.latest_job(jobs).select("project_id", "status", F.lit(True).alias("known"))


@query("SELECT 'proj-' || (user_id % 50) AS project_id FROM events GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) = 'click'")
def chat_readiness(spark, d):
    jobs = Texts(spark, d).raw("events").select(F.concat(F.lit("proj-"), (F.col("user_id") % 50).cast("string")).alias("project_id"), "event_id", "ts", F.col("event_type").alias("status"))
    return C.latest_job(jobs).filter("status = 'click'").select("project_id")
