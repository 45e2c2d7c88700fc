"""One analysis a document from the checked drafts of its slices and, where there is one, their synthesis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.scratch import few, staged
from .analysis import RELEVANCE

# How many entries an analysis holds of each kind, and what it says when nothing reliable was found.
LIMITS = {"entity": 160, "point": 320, "topic": 80, "link": 80}
NOTHING = {
    "zh": "文档分析未能生成可靠摘要；所有未确认区块均保留为 unresolved。",
    "en": "Document analysis did not produce a reliable summary; every unconfirmed block remains unresolved.",
}
ITEM = "struct<name:string,type:string,aliases:array<string>,kind:string,statement:string,status:string,scope:string,conditions:map<string,string>,importance:double,confidence:double,reason:string,registry_entry_id:string>"


def _items(drafts: DataFrame) -> DataFrame:
    """document_id, source, i, sort, item, ids: the entries of all kinds in one shape."""
    full = [f.split(":")[0] for f in ITEM[7:-1].replace("map<string,string>", "map").split(",")]

    def shape(sort: str, ids: Column, **have: Column) -> Column:
        item = F.struct(*[have.get(f, F.lit(None)).alias(f) for f in full]).cast(ITEM)
        return F.struct(F.lit(sort).alias("sort"), item.alias("item"), ids.alias("ids"))

    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    entity = lambda x: shape("entity", x["evidence_block_ids"], name=x["name"], type=some(x["type"]), aliases=F.slice(F.array_distinct(F.filter(x["aliases"], lambda a: a != "")), 1, 20))
    point = lambda x: shape("point", x["evidence_block_ids"], name=x["title"], kind=x["kind"], statement=x["statement"], status=x["status"], scope=some(x["scope"]), conditions=x["conditions"], importance=X.clamp01(x["importance"]), confidence=X.clamp01(x["confidence"]))
    topic = lambda x: shape("topic", x["evidence_block_ids"], name=x["title"], reason=x["reason"])
    link = lambda x: shape("link", x["evidence_block_ids"], registry_entry_id=x["registry_entry_id"], reason=x["reason"])
    every = F.concat(*[F.transform(f"draft.{c}", f) for c, f in (("entities", entity), ("knowledge_points", point), ("suggested_topics", topic), ("concept_links", link))])
    return drafts.select("document_id", "source", F.posexplode(every).alias("i", "x")).select("document_id", "source", "i", "x.*")


def _cited(items: DataFrame, blocks: DataFrame, documents: DataFrame, registry: DataFrame) -> DataFrame:
    """``items`` with ``evidence``: the distinct ids that are blocks of the document, in order; entries without any go, and so do links to what isn't in the project's registry.

    A synthesis (source -1) may only cite what a slice has cited. Rows of ids alone meet blocks, documents and registry; whole items are dealt once, by document, and stay
    there for what groups them by a document and more; texts are normalised before that, as a Python step forgets how rows are dealt.
    """
    rows = items.select("document_id", "source", "i", "sort", F.col("item.registry_entry_id").alias("__r"), F.posexplode("ids").alias("at", "block_id"))
    known = staged(rows.join(blocks.select("document_id", "block_id").hint("merge"), ["document_id", "block_id"], "left_semi"), "analysis-evidence")
    said = known.filter("source >= 0").select("document_id", "block_id")
    known = known.filter("source >= 0").unionByName(known.filter("source < 0").join(said.hint("merge"), ["document_id", "block_id"], "left_semi"))
    entries = staged(registry.select("project_id", F.col("registry_entry_id").alias("__r")).distinct(), "analysis-registry")
    links = known.filter("sort = 'link'").join(documents.select("document_id", "project_id").hint("merge"), "document_id").join(few(entries), ["project_id", "__r"])
    ids = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "block_id"))), lambda x: x["block_id"]))  # an entry's own
    at = lambda rows: rows.groupBy("document_id", "source", "i").agg(ids.alias("evidence"))
    both = _keyed(items.drop("ids")).unionByName(at(known.filter("sort <> 'link'")).unionByName(at(links)), allowMissingColumns=True)
    whole = both.repartition("document_id").groupBy("document_id", "source", "i").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("sort", "item", "key", "evidence")])
    return whole.filter("evidence is not null")


def _keyed(items: DataFrame) -> DataFrame:
    """``items`` with ``key``, the normal form by which entries are told apart; null for links, which have none without their evidence."""
    named = X.nfkc(X.nfkc(items.withColumns({"__n": F.col("item.name"), "__s": F.col("item.statement")}), "__n", "__n"), "__s", "__s")
    key = F.when(F.col("sort") == "point", F.concat_ws("|", "item.kind", X.text_key(F.col("__n")), X.text_key(F.col("__s")))).otherwise(X.text_key(F.col("__n")))
    return named.withColumn("key", F.when(F.col("sort") != "link", key)).drop("__n", "__s")


def _texts(drafts: DataFrame, sizes: dict[str, int], *more: Column) -> DataFrame:
    """document_id and, of each named text, the trimmed ones of the slices in order, joined and cut, and ``more`` aggregates; a text adds a character at least, so as many slices as characters suffice."""
    cut = {f"t_{name}": F.nullif(F.substring(X.normalise_ends(F.col(f"draft.{name}")), 1, most), F.lit("")) for name, most in sizes.items()}
    rows = drafts.filter("source >= 0").withColumns(cut)
    so_far = Window.partitionBy("document_id").orderBy("source").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"r_{name}": F.count(f"t_{name}").over(so_far) for name in sizes})
    told = lambda name, most: F.array_sort(F.collect_list(F.when(F.col(f"t_{name}").isNotNull() & (F.col(f"r_{name}") <= most), F.struct(F.col(f"r_{name}").alias("r"), F.col(f"t_{name}").alias("t")))))
    joined = lambda name, most: F.nullif(F.substring(F.array_join(F.transform(told(name, most), lambda x: x["t"]), " "), 1, most), F.lit(""))
    return rows.groupBy("document_id").agg(*more, *[joined(name, most).alias(name) for name, most in sizes.items()])


def document_analysis(documents: DataFrame, blocks: DataFrame, slices: DataFrame, registry: DataFrame, synthesis: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The analyses, a row a document, and the coverage, a row a block.

    ``documents``: document_id, project_id, output_language; ``blocks``: document_id, block_id; ``slices``: document_id, slice (from 0), draft as ``contracts.SLICE`` reads it, null if
    it was rejected; ``registry``: project_id, registry_entry_id; ``synthesis``: document_id, draft as ``contracts.SYNTHESIS``.
    The synthesis comes before the slices, slices in order; of entries with the same normal form the first stays. A block is analysed if some slice says so
    and none says unresolved. A document without a slice has the fallback texts, is out of scope and keeps all its blocks unresolved.
    """
    drafts = slices.filter("draft is not null").select("document_id", F.col("slice").cast("long").alias("source"), "draft")
    both = _items(drafts)
    if synthesis is not None:
        both = both.unionByName(_items(synthesis.filter("draft is not null").select("document_id", F.lit(-1).cast("long").alias("source"), "draft")))
    items = staged(both, "analysis-items")
    cited = _cited(items, blocks, documents, registry)
    link = F.concat_ws("|", "item.registry_entry_id", F.array_join("evidence", "|"))
    named = cited.withColumn("key", F.when(F.col("sort") == "link", link).otherwise(F.col("key"))).filter("key <> ''")
    first = named.groupBy("document_id", "sort", "key").agg(F.min_by(F.struct("item", "evidence", "source", "i"), F.struct("source", "i")).alias("x")).select("document_id", "sort", "x.*")
    place = F.row_number().over(Window.partitionBy("document_id", "sort").orderBy("source", "i"))
    most = F.create_map(*[F.lit(v) for kv in LIMITS.items() for v in kv])
    top = first.withColumn("place", place).filter(F.col("place") <= max(LIMITS.values())).filter(F.col("place") <= most[F.col("sort")])
    hashed = F.concat_ws("|", "item.kind", "item.name", "item.statement", F.array_join("evidence", "|"))
    ids = F.when(F.col("sort") == "point", F.concat(F.col("document_id"), F.lit(":analysis-point:"), X.short_hash(hashed, 20)))
    entry = F.struct("place", "item", "evidence", ids.alias("id"))
    lists = top.groupBy("document_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("sort") == s, entry)), lambda a, b: a["place"] - b["place"]).alias(name) for s, name in (("entity", "entities"), ("point", "knowledge_points"), ("topic", "suggested_topics"), ("link", "concept_links"))])

    # Joined by merging, all by document: what is there stays where it is, and the lists come last.
    rank = F.min(F.array_position(F.array(*[F.lit(r) for r in RELEVANCE]), F.col("draft.relevance"))).alias("__best")
    sizes = {"summary": 2500, "relevance_reason": 800, "source_boundary": 1000}
    out = documents.select("document_id", "project_id", "output_language").join(_texts(drafts, sizes, rank).hint("merge"), "document_id", "left")
    nothing = F.when(F.col("output_language") == "zh", NOTHING["zh"]).otherwise(NOTHING["en"])
    themes = drafts.select("document_id", "source", F.posexplode("draft.themes").alias("i", "text"))
    if synthesis is not None:
        own = synthesis.filter("draft is not null")
        syn = F.struct(*[F.col(f"draft.{c}").alias(c) for c in ("relevance", *sizes)]).alias("__syn")
        out = out.join(own.select("document_id", syn).hint("merge"), "document_id", "left")
        themes = themes.unionByName(own.select("document_id", F.lit(-1).cast("long").alias("source"), F.posexplode("draft.themes").alias("i", "text")))
    for name in sizes:
        said = F.nullif(X.normalise_ends(F.col(f"__syn.{name}")), F.lit("")) if synthesis is not None else F.lit(None)
        out = out.withColumn(name, F.coalesce(said, name, nothing))
    best = F.element_at(F.array(*[F.lit(r) for r in RELEVANCE]), F.coalesce("__best", F.lit(len(RELEVANCE))).cast("int"))
    out = out.withColumn("relevance", F.coalesce(F.col("__syn.relevance"), best) if synthesis is not None else best)
    met = themes.withColumn("text", X.normalise_ends(F.col("text"))).filter("text <> ''").groupBy("document_id", "text").agg(F.min(F.struct("source", "i")).alias("first"))
    met = met.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("first"))).filter("place <= 32")
    met = met.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("themes"))
    out = out.join(met.hint("merge"), "document_id", "left").join(lists.hint("merge"), "document_id", "left").drop("__best", "__syn")
    out = out.withColumns({c: F.coalesce(c, F.array()) for c in ("themes", "entities", "knowledge_points", "suggested_topics", "concept_links")})

    seen = drafts.select("document_id", F.explode("draft.coverage").alias("c")).groupBy("document_id", F.col("c.block_id").alias("block_id"))
    seen = seen.agg((F.bool_or(F.col("c.status") == "analyzed") & ~F.bool_or(F.col("c.status") == "unresolved")).alias("ok"))
    coverage = blocks.select("document_id", "block_id").join(seen.hint("merge"), ["document_id", "block_id"], "left")
    return out, coverage.select("document_id", "block_id", F.when(F.coalesce("ok", F.lit(False)), "analysed").otherwise("unresolved").alias("status"))
