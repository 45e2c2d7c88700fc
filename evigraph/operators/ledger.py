"""Claims, coverage and contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

DISPOSITIONS = ("candidate", "attach", "ignore")
SORT = ("kind", "statement", "suggested_name", "disposition")


def check(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with ``errors``, the names of the rules that do not hold (null counts as not holding)."""
    return rows.withColumn("errors", F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda e: e.isNotNull()))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") == 0).drop("errors")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") > 0)


def between(c: str, low: float, high: float) -> Column:
    return F.col(c).isNull() | F.col(c).between(low, high)


def text_within(c: str, least: int, most: int) -> Column:
    return F.length(c).between(least, most)


def validate_claim_drafts(drafts: DataFrame) -> DataFrame:
    """Limits of a claim draft; a null confidence or importance becomes .6 first."""
    filled = drafts.withColumns({c: F.coalesce(c, F.lit(0.6)) for c in ("importance", "confidence")})
    return check(
        filled,
        {
            "disposition": F.col("disposition").isin(*DISPOSITIONS),
            "statement": text_within("statement", 1, 2000),
            "suggested_name": F.col("suggested_name").isNull() | text_within("suggested_name", 1, 200),
            "importance": between("importance", 0, 1),
            "confidence": between("confidence", 0, 1),
        },
    )


def _further(drafts: DataFrame) -> list[str]:
    """Columns that a ledger passes through; they break ties, so they must be orderable."""
    known = {*SORT, "project_id", "block_id", "block_key", "disposition", "kind", "statement", "suggested_name", "suggested_type", "importance", "confidence"}
    return sorted(c for c in drafts.columns if c not in known)


def claim_occurrence(drafts: DataFrame) -> DataFrame:
    """Index from 0 of a claim in its block after the five-key sort. Drafts may carry ``block_key``, which the block determines: if they are dealt by it, they are not shuffled again."""
    order = [*[F.coalesce(c, F.lit("")) for c in SORT], "importance", "confidence", *_further(drafts)]
    block = [c for c in ("block_key", "block_id") if c in drafts.columns]
    return drafts.withColumn("occurrence", (F.row_number().over(Window.partitionBy(*block).orderBy(*order)) - 1).cast("long"))


def claim_ledger(drafts: DataFrame) -> DataFrame:
    """Drafts to claims: stable ids; what is not ignored but has no name is ignored with a reason."""
    rows = claim_occurrence(drafts)
    nameless = (F.col("disposition") != "ignore") & (F.coalesce(F.trim("suggested_name"), F.lit("")) == "")
    value = F.concat_ws("|", "block_id", F.col("occurrence").cast("string"), "kind", "statement")
    return rows.select(
        X.scoped_id(F.col("project_id"), "claim", value, 20).alias("claim_id"), "project_id", "block_id", "occurrence", "kind", "statement", "suggested_name", "suggested_type", "importance", "confidence", *_further(drafts),
        F.when(nameless, "ignore").otherwise(F.col("disposition")).alias("disposition"), F.when(nameless, "no suggested name").alias("reason"),
    )


def coverage_ledger(blocks: DataFrame, drafts: DataFrame, claims: DataFrame) -> DataFrame:
    """block_id, status, n_claims: first draft of a block (by ord) wins; claimed needs a catalogable claim."""
    first = drafts.groupBy("block_id").agg(F.min_by("status", "ord").alias("drafted"))
    count = claims.groupBy("block_id").agg(F.count(F.lit(1)).alias("n_claims"), F.sum((F.col("disposition") != "ignore").cast("long")).alias("useful"))
    joined = blocks.select("block_id").join(first, "block_id", "left").join(count, "block_id", "left")
    useful = F.coalesce("useful", F.lit(0))
    status = F.when(F.col("drafted").isNull() | ((F.col("drafted") == "claimed") & (useful == 0)), "unresolved").otherwise(F.col("drafted"))
    return joined.select("block_id", status.alias("status"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Incoming rows replace stored ones by key; keys are unique on each side."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
