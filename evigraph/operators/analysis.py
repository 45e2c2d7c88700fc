"""Document analyses, rewriting of names, guards on answers, and publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Relevance from best to worst.
RELEVANCE = ("direct", "partial", "contextual", "out_of_scope")


def rewrite_ends(relations: DataFrame, names: DataFrame, ends: list[str]) -> DataFrame:
    """Both ends to their canonical names (key, name); unmapped ends stay."""
    for end in ends:
        side = names.select(F.col("key").alias(end), F.col("name").alias("__name"))
        relations = relations.join(side, end, "left").withColumn(end, F.coalesce("__name", end)).drop("__name")
    return relations


def resolve_node_suffix(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Asked ids to nodes: an exact id, else a ``:node:hash`` suffix that one node alone has."""
    exact = asked.join(nodes.withColumnRenamed("node_id", "asked"), "asked")
    rest = asked.join(nodes.select(F.col("node_id").alias("asked")), "asked", "left_anti")
    suffix = lambda c: F.regexp_extract(c, ":node:([0-9a-f]+)$", 1)
    only = nodes.withColumn("suffix", suffix("node_id")).filter("suffix <> ''").groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in nodes.columns if c != "node_id"]).filter("n = 1").drop("n")
    near = rest.withColumn("suffix", suffix("asked")).filter("suffix <> ''").join(only, "suffix").drop("suffix")
    return exact.select(*near.columns).unionByName(near)


def top_texts(rows: DataFrame, key: str, k: int, sep: str, order: tuple[str | Column, ...] = ("ord",)) -> DataFrame:
    """key + the first ``k`` texts in this order."""
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("r") <= k)
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda s: s["text"]), sep).alias("texts"))


def first_distinct(rows: DataFrame, key: str, k: int, order: list[str]) -> DataFrame:
    """key, text, place, first: the first ``k`` distinct texts of a key with the order columns of their first places. Null and empty texts are none."""
    first = rows.filter("text <> ''").groupBy(key, "text").agg(F.min(F.struct(*order)).alias("first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("first", "text"))
    return first.withColumn("place", place).filter(F.col("place") <= k)


def default_slices(blocks: DataFrame, chars: int = 2500) -> DataFrame:
    """The model-free analysis: texts joined in order and clipped. A block adds a character at least, so ``chars`` blocks suffice."""
    count = blocks.groupBy("document_id").agg(F.count(F.lit(1)).alias("blocks"))
    texts = top_texts(blocks.select("document_id", "ord", F.substring("text", 1, chars).alias("text")), "document_id", chars, " ")
    return texts.join(count, "document_id").select("document_id", F.substring("texts", 1, chars).alias("summary"), "blocks")


def document_relevance(slices: DataFrame) -> DataFrame:
    """The best relevance of a document's slices."""
    order = F.array(*[F.lit(r) for r in RELEVANCE])
    best = slices.groupBy("document_id").agg(F.min(F.array_position(order, F.col("relevance"))).alias("r"))
    return best.select("document_id", F.element_at(order, F.col("r").cast("int")).alias("relevance"))


def analysis_coverage(blocks: DataFrame, seen: DataFrame) -> DataFrame:
    """analysed if some slice says so and none says unresolved; everything else is unresolved."""
    by = seen.groupBy("block_id").agg((F.bool_or(F.col("status") == "analysed") & ~F.bool_or(F.col("status") == "unresolved")).alias("ok"))
    return blocks.select("block_id").join(by, "block_id", "left").select("block_id", F.when(F.coalesce("ok", F.lit(False)), "analysed").otherwise("unresolved").alias("status"))


def compact_analyses(analyses: DataFrame, themes: DataFrame, entities: DataFrame, points: DataFrame, topics: DataFrame, coverage: DataFrame, sep: str = " / ") -> DataFrame:
    """document_id, themes, entities, points, topics, unresolved: what planning reads of each analysis.

    The first 32 distinct themes (as many as an analysis has), the first 30 entities, the 40 points of most importance (ties in order) and the first 16 topics. ``analyses`` has document_id, the others
    document_id, ord and text; points also importance; ``coverage``: document_id, status. A document without items has nulls and 0.
    """
    out = analyses.select("document_id").distinct()
    tops = [("themes", themes, 32, ("place",)), ("entities", entities, 30, ("ord",)), ("points", points, 40, (F.desc("importance"), "ord")), ("topics", topics, 16, ("ord",))]
    for name, rows, k, order in tops:
        rows = first_distinct(rows, "document_id", k, ["ord"]) if name == "themes" else rows
        out = out.join(top_texts(rows, "document_id", k, sep, order).withColumnRenamed("texts", name), "document_id", "left")
    open_blocks = coverage.filter("status = 'unresolved'").groupBy("document_id").agg(F.count(F.lit(1)).alias("unresolved"))
    return out.join(open_blocks, "document_id", "left").fillna(0, ["unresolved"])


def _last_before(slices: DataFrame, items: DataFrame, k: int, name: str, sep: str) -> DataFrame:
    """document_id, slice and the last ``k`` items of the document's earlier slices, joined.

    Items are numbered within their document and each slice stands just behind those before it, so that a frame holds
    ``k`` items at most however long the document is.
    """
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("slice", "ord"))
    numbered = items.select("document_id", number.cast("long").alias("at"), F.lit(None).cast("long").alias("slice"), "text")
    counts = items.groupBy("document_id", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("document_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    marks = slices.select("document_id", "slice").join(counts, ["document_id", "slice"], "left")
    marks = marks.select("document_id", (F.coalesce(before, F.lit(0)) + 1).alias("at"), "slice", F.lit(None).cast("string").alias("text"))
    last = F.collect_list("text").over(Window.partitionBy("document_id").orderBy("at").rangeBetween(-k, -1))
    seen = numbered.union(marks).withColumn("last", last).filter("slice is not null")
    return seen.select("document_id", "slice", F.array_join("last", sep).alias(name))


def rolling_digest(slices: DataFrame, themes: DataFrame, entities: DataFrame, points: DataFrame, sep: str = " / ") -> DataFrame:
    """document_id, slice, summaries, themes, entities, points: what a slice is told of the earlier slices of its document.

    The last 3 summaries, the first 24 distinct themes, the last 60 entities and the last 80 points; all null for the first slice.
    ``slices``: document_id, slice, summary; the others: document_id, slice, ord, text. Items without a slice of their own are counted nowhere; null
    texts leave no gap in what is joined.
    """
    items = [t.filter("text is not null").join(slices.select("document_id", "slice"), ["document_id", "slice"], "left_semi") for t in (themes, entities, points)]
    doc = Window.partitionBy("document_id").orderBy("slice")
    out = slices.select("document_id", "slice", F.row_number().over(doc).alias("i"), F.array_join(F.collect_list("summary").over(doc.rowsBetween(-3, -1)), sep).alias("summaries"))
    first = first_distinct(items[0], "document_id", 24, ["slice", "ord"]).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("place", "first.slice", "text"))).alias("all"))
    met = F.filter("all", lambda t: t["slice"] < F.col("slice"))
    out = out.join(first, "document_id", "left").withColumn("themes", F.coalesce(F.array_join(F.transform(met, lambda t: t["text"]), sep), F.lit("")))
    for name, rows, k in (("entities", items[1], 60), ("points", items[2], 80)):
        out = out.join(_last_before(slices, rows, k, name, sep), ["document_id", "slice"])
    return out.select("document_id", "slice", *[F.when(F.col("i") > 1, F.col(c)).alias(c) for c in ("summaries", "themes", "entities", "points")])


def corpus_plan_fallback(summaries: DataFrame, themes: DataFrame, points: DataFrame, topics: DataFrame, sep: str = " / ") -> DataFrame:
    """project_id, corpus_summary, themes, required: the plan of a corpus without a model's.

    The documents' summaries joined and clipped to 2,000 characters (a document adds a character at least, so 2,000 documents suffice), the first 24
    distinct themes, and the first 24 distinct titles of points with an importance of at least .6 and of topics, documents in order and points first.
    ``summaries``: project_id, doc_id, summary; the others: project_id, doc_id, ord, text (points: importance). Lists without an entry are null.
    """
    chars = 2000
    joined = top_texts(summaries.select("project_id", "doc_id", F.substring("summary", 1, chars).alias("text")), "project_id", chars, " ", ("doc_id",))
    out = joined.select("project_id", F.substring("texts", 1, chars).alias("corpus_summary"))
    part = lambda rows, i: rows.select("project_id", "doc_id", F.lit(i).alias("part"), "ord", "text")
    for name, rows in (("themes", part(themes, 0)), ("required", part(points.filter("importance >= 0.6"), 0).union(part(topics, 1)))):
        first = first_distinct(rows, "project_id", 24, ["doc_id", "part", "ord"])
        out = out.join(top_texts(first, "project_id", 24, sep, ("place",)).withColumnRenamed("texts", name), "project_id", "left")
    return out


def fallbacks(expected: DataFrame, proposals: DataFrame, key: str, default: dict[str, str]) -> DataFrame:
    """Safe defaults for what has no proposal."""
    return expected.join(proposals.select(key).distinct(), key, "left_anti").select(key, *[F.lit(v).alias(c) for c, v in default.items()])


def leaking(text: Column, known_ids: Column) -> Column:
    """Whether a text has a known id of at least 8 characters in it, or the shape of an internal reference."""
    known = F.exists(known_ids, lambda i: (F.length(i) >= 8) & F.contains(text, i))
    return F.coalesce(known, F.lit(False)) | X.refers_internally(text)


def answer_guard(answers: DataFrame) -> DataFrame:
    """+ reject, the first reason against an answer, or null.

    ``answers``: text, lang, claims (array of struct text, status, citations), known_ids (of the context), limitations (array of texts).
    """
    every = F.concat(F.array("text"), F.transform("claims", lambda c: c["text"]), F.coalesce("limitations", F.array().cast("array<string>")))
    inferred = F.filter("claims", lambda c: c["status"] == "inferred")
    unmarked = (F.size(inferred) > 0) & (~X.has_inference_marker(F.col("text"), F.col("lang")) | F.exists(inferred, lambda c: ~X.has_inference_marker(c["text"], F.col("lang"))))
    tests = [
        ("internal id", F.exists(every, lambda t: leaking(t, F.col("known_ids")))), ("unmarked inference", unmarked),
        ("unknown citation", F.exists("claims", lambda c: F.exists(c["citations"], lambda i: ~F.array_contains("known_ids", i)))), ("no claim", F.size("claims") == 0),
    ]
    return answers.withColumn("reject", F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in tests]))
