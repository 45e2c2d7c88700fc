"""Secret scans with corpus-wide ownership frequency.

Base kinds (assign, access, hex) are always reported. Wider kinds (private keys, signed tokens,
vendor tokens and opaque mixed-case blobs) are candidates only: candidate values of all kinds are
hashed, the distinct repositories and owners of each hash are counted over the whole corpus, and
a wide candidate is reported if its value belongs to one owner, however often that one repeats it, or to few of both. What many own
is a copied example. Without a column of repositories the distinct texts are them, so that copies of a document are one.
Base spans of such values are reported as ``live`` as well; others count as examples.

Positions come from the texts between matches: their lengths and those of the matches, summed up. A wide span that
overlaps a base span of its text is dropped; spans are met in order of their places, forwards and backwards. All patterns
take time in proportion to the text: a run of characters is entered where it begins only.

Nulls: a null text is empty and has no span; a null owner or repository counts as one more of its
kind. Repeated rows with equal id and text are reported each, with the same spans. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import staged


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The base kinds as agreed, then the wide ones: (kind, pattern, group whose length counts, its least length, base).
KINDS = (
    ("assign", "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    ("access", "AKIA[A-Z0-9]+", 0, 20, True),
    ("hex", "(?<![0-9a-f])[0-9a-f]{24,}", 0, 24, True),
    ("pem", "-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[A-Za-z0-9+/=\n\r ]{16,}", 0, 44, False),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}", 0, 29, False),
    ("vendor", "(ghp_|gho_|ghs_|sk_live_|rk_live_|xoxb-|xoxp-|AIza)[A-Za-z0-9_-]{16,}", 0, 20, False),
    ("blob", "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}", 0, 32, False),
)
#: What any text with a match of any kind has: a long run (hex and blob), or the beginning of another kind.
ANY = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}|eyJ|AKIA|-----BEGIN |" + KINDS[5][1] + "|" + KINDS[0][1]
NAMES = [k for k, *_ in KINDS]


def _matches(text: Column, kind: str, pattern: str, group: int) -> Column:
    """array<struct(kind int, gap int, span string, value string)>, gaps being the texts before the matches."""
    whole, p = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(pattern)
    values = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern), lambda g: F.length(g))
    row = F.transform(F.slice(F.arrays_zip(gaps, whole, values), F.lit(1), F.size(whole)), lambda r: F.struct(F.lit(NAMES.index(kind)).alias("kind"), r["0"].alias("gap"), r["1"].alias("span"), r["2"].alias("value")))
    return F.when(text.rlike(pattern), row).otherwise(F.array().cast("array<struct<kind:int,gap:int,span:string,value:string>>"))


def candidate_spans(docs: DataFrame, id_col: str, text_col: str, repo_col: str | None, owner_col: str) -> DataFrame:
    """doc_id, h (of the text), repo, owner, kind, begin, end, secret (hash of the value)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.col(repo_col) if repo_col else F.xxhash64(text)).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), text.alias("text"), F.xxhash64(text).alias("h")
    ).filter(text.rlike(ANY))
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    per_kind = F.array(*[_matches(F.col("text"), k, p, g) for k, p, g, *_ in KINDS])
    found = rows.select("doc_id", "h", "repo", "owner", "rid", F.explode(per_kind).alias("m")).select("doc_id", "h", "repo", "owner", "rid", F.posexplode("m").alias("i", "m")).select("doc_id", "h", "repo", "owner", "rid", "i", "m.*")
    before = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("span")
    end = F.sum(F.col("gap") + length).over(before)
    ok = F.lit(False)
    for k, (_, _, _, least, _) in enumerate(KINDS):
        more = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]") if NAMES[k] == "blob" else F.lit(True)
        ok = ok | ((F.col("kind") == k) & (F.length("value") >= least) & more)
    return found.withColumn("end", end).filter(ok).select("doc_id", "h", "repo", "owner", "kind", (F.col("end") - length).alias("begin"), "end", F.sha2(F.col("value").cast("binary"), 256).alias("secret"))


def ownership(spans: DataFrame) -> DataFrame:
    """secret -> owners, repos: distinct counts over the corpus, first reduced to distinct pairs."""
    count = lambda c: spans.select("secret", c).distinct().groupBy("secret").agg(F.count(F.lit(1)).alias(f"{c}s"))
    return count("owner").hint("merge").join(count("repo"), "secret")


def scan(docs: DataFrame, max_owners: int = 2, max_repos: int = 8, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str = "source") -> DataFrame:
    """A row per row of ``docs``: doc_id, spans, an array of struct(begin, kind int, end, live) by begin, kind, end."""
    spans = staged(candidate_spans(docs, id_col, text_col, repo_col, owner_col), "secret-spans")
    owned = staged(ownership(spans), "secret-owned")  # a table, so that adaptive execution can split a value that many rows share
    live = (F.col("owners") == 1) | (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    base = F.col("kind") < sum(1 for *_, b in KINDS if b)
    judged = spans.hint("merge").join(owned, "secret").select("doc_id", "h", "begin", "kind", "end", live.alias("live")).filter(base | F.col("live")).distinct()
    forth = Window.partitionBy("doc_id", "h").orderBy("begin", "kind").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("doc_id", "h").orderBy(F.desc("begin"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    reach, following = F.max(F.when(base, F.col("end"))).over(forth), F.min(F.when(base, F.col("begin"))).over(back)
    met = judged.withColumn("reach", reach).withColumn("following", following)
    apart = F.coalesce(F.col("reach") <= F.col("begin"), F.lit(True)) & F.coalesce(F.col("following") >= F.col("end"), F.lit(True))
    per_doc = met.filter(base | apart).groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("begin", "kind", "end", "live"))).alias("spans"))
    ids = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    right = per_doc.withColumnsRenamed({"doc_id": "__id", "h": "__h"})
    empty = F.array().cast("array<struct<begin:bigint,kind:int,end:bigint,live:boolean>>")
    return ids.hint("merge").join(right, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")), "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:begin:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["begin"], s["end"])), ",")
