"""Near copies by exact Jaccard similarity of word shingles.

Two texts link if their sets of 5-word shingles have a Jaccard similarity of at least 0.8. The method
is op6's: SimHash fingerprints of the shingles and links within ``RADIUS`` bits through the vantage-point tree
give the first candidate pairs. An exact check follows, since near copies can differ in more bits: candidates
from prefix filtering, which loses no pair: under any fixed order of the shingles, two such sets
share one of their first  n - ceil(0.8 n) + 1. The order puts shingles that are common in a bounded
sample last, so that the prefixes are rare ones; only the work depends on the sample, never the links.
Texts that share one become a pair only if their sketches allow it: bits that say of how many shingles of a
residue there is an odd number. Sets differ in as many shingles at least as their sketches in bits.
All candidate pairs are verified on their whole sets. Within the texts that share a prefix shingle two
pivots are held against all others first; what they link is one group. While all pairs of different groups
would be many more than the entries of the prefixes, more pivots are held against texts of other groups; at last
all pairs of groups that are still different are compared. Components come from rounds of random local contraction.

Rows are told apart by a hash of all their columns. Nulls: null and blank texts are copies of each
other; a null id is never the first of a group that has others. Rows equal in all columns count as
one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import discard, staged
from .simhash import SEED, components, links

WORDS = 5

#: Bits in which fingerprints of candidates may differ: unlike texts are seldom as near, so that links do not run together; beyond op6's 3 the trees are built in blocks of bits.
RADIUS = 8

#: While comparing all groups would meet more than ``CROWDED`` times the entries of the prefixes, and the last round has taken a quarter of that,
#: ``PIVOTS`` more pivots come first. Only the work depends on these, never the links.
CROWDED, PIVOTS = 8, 8

#: Longs of a sketch, a power of two. Only the work depends on it: sets of some thousand shingles fill it, and all their pairs are verified.
SKETCH = 8
BITS = [f"s{i}" for i in range(SKETCH)]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct 64-bit shingle hashes of a text, sorted (A-Z lower-cased, words between white space; a shorter text is one shingle)."""
    from xxhash import xxh64_intdigest

    parts = text.encode().lower().split() if text else []
    line, n = b" ".join(parts), len(parts)
    if n <= words:
        return np.array([xxh64_intdigest(line, SEED)], np.uint64).view(np.int64)
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends[:-1]]
    return np.unique(np.fromiter((xxh64_intdigest(line[s : e - 1], SEED) for s, e in zip(starts, ends[words - 1 :])), np.uint64, n - words + 1).view(np.int64))


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes: each bit the strict majority over them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def sketch(hashes: np.ndarray) -> np.ndarray:
    """``SKETCH`` longs whose bits are the parities of the numbers of hashes with each residue."""
    odd = np.bincount(hashes & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).cast("binary"))


def _common(docs: DataFrame, text: Column, n: int, sample_rows: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of the sampled distinct texts have, sorted, and in how many."""
    span = 1 << 30
    lot = F.pmod(F.xxhash64(text, F.lit(11)), F.lit(span)) < int(span * min(1.0, sample_rows / max(n, 1)))
    sample = docs.select(text.alias("text")).filter(lot).distinct()

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch["text"]:
                yield pd.DataFrame({"h": shingles(t)})

    counted = sample.mapInPandas(explode, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").orderBy(F.desc("k"), "h").limit(most).toArrow()
    h, k = counted["h"].to_numpy(), counted["k"].to_numpy()
    order = np.argsort(h)
    return h[order], k[order]


def _prefix_column(spark, common: tuple[np.ndarray, np.ndarray], text: Column) -> Column:
    """struct(n int, fp long, prefix array<long>, s0 long, ...): the number of shingles, their fingerprint, as many as the filter needs from the rare end of the order, and their sketch."""
    shared = spark.sparkContext.broadcast(common)

    @F.pandas_udf(f"n int, fp long, prefix array<long>, {', '.join(f'{b} long' for b in BITS)}")
    def prefixes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, times = shared.value
        for texts in batches:
            out = []
            for t in texts:
                s = shingles(t)
                at = np.searchsorted(known, s)
                weight = np.zeros(len(s), np.int64)
                ok = at < len(known)
                ok[ok] = known[at[ok]] == s[ok]
                weight[ok] = times[at[ok]]
                out.append((len(s), fingerprint(s), s[np.lexsort((s, weight))[: len(s) - (4 * len(s) + 4) // 5 + 1]], *sketch(s)))
            yield pd.DataFrame(out, columns=["n", "fp", "prefix", *BITS])

    return prefixes(text)


def _sets_column(text: Column) -> Column:
    @F.pandas_udf("array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t) for t in texts], dtype=object)

    return sets(text)


def _few(table: DataFrame, most: int = 500_000) -> DataFrame:
    """A staged table of ids or keys for a join that filters texts: broadcast up to ``most`` rows (of 40 bytes at most), so that the texts are not shuffled."""
    return F.broadcast(table) if table.count() <= most else table.hint("merge")


def _may(a: str, b: str) -> Column:
    """Whether two sets that share the shingles at these places of their orders, and none before, can be similar enough, and their sketches too:
    similar sets differ in a ninth of their sizes at most."""
    sizes = F.col(f"{a}_n") + F.col(f"{b}_n")
    rest = F.least(F.col(f"{a}_n") - F.col(f"{a}_pos"), F.col(f"{b}_n") - F.col(f"{b}_pos"))
    apart = reduce(add, [F.bit_count(F.col(f"{a}_{s}").bitwiseXOR(F.col(f"{b}_{s}"))) for s in BITS])
    return (9 * rest >= 4 * sizes) & (9 * apart <= sizes)


def _verified(pairs: DataFrame, texts: DataFrame, keyed: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least 0.8; ``keyed``: key, text.

    Similar sets have 4/9 of their sizes in common at least. Of the set whose prefix ends first in the order, all common shingles
    up to there are in both prefixes, and no more than the rest of it can be common beyond: pairs that share fewer in their
    prefixes go before whole sets are read.
    """
    side = lambda df, x, *more: df.select(F.col("tid").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in more]).hint("merge")
    pairs = staged(pairs, "near-candidates")
    met_ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("tid")).distinct(), "near-ends")
    some = texts.join(_few(met_ids), "tid", "left_semi")
    met = pairs.join(side(some, "a", "n", "prefix"), "a").join(side(some, "b", "n", "prefix"), "b")
    both, sizes = F.size(F.array_intersect("a_prefix", "b_prefix")), F.col("a_n") + F.col("b_n")
    beyond = F.greatest(*[F.col(f"{x}_n") - F.size(f"{x}_prefix") for x in ("a", "b")])
    left = staged(met.filter(9 * (both + beyond) >= 4 * sizes).select("a", "b"), "near-pairs")
    if left.isEmpty():
        return left
    # What is only needed for the answer goes as soon as that is written.
    ends = staged(left.select(F.explode(F.array("a", "b")).alias("tid")).distinct(), "near-ends")
    wanted = staged(texts.join(_few(ends), "tid", "left_semi").select("tid", F.col("first.key").alias("key")), "near-wanted")
    sets = keyed.join(_few(wanted), "key").select("tid", "text").dropDuplicates(["tid"])
    sets = staged(sets.select("tid", _sets_column(F.col("text")).alias("set")), "near-sets")
    both = F.size(F.array_intersect("a_set", "b_set"))
    near = left.join(side(sets, "a", "set"), "a").join(side(sets, "b", "set"), "b").filter(9 * both >= 4 * (F.size("a_set") + F.size("b_set")))
    near = staged(near.select("a", "b"), "near-links")
    discard(left, sets, pairs)
    return near


def _linked_pairs(texts: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Texts with one fingerprint, and those whose fingerprints the vantage-point tree links, each with a representative."""
    leads = staged(texts.groupBy("fp").agg(F.min("tid").alias("lead")), "near-prints")
    same = texts.select("tid", "fp").join(leads.hint("merge"), "fp").filter("tid <> lead").select(F.col("lead").alias("a"), F.col("tid").alias("b"))
    met = links(leads.select("fp"), radius).distinct()
    end = lambda x: leads.select(F.col("fp").alias(x), F.col("lead").alias(f"{x}_tid")).hint("merge")
    near = met.join(end("a"), "a").join(end("b"), "b").select("a_tid", "b_tid")
    return same.unionByName(near.select(F.least("a_tid", "b_tid").alias("a"), F.greatest("a_tid", "b_tid").alias("b"))).distinct()


def _pivot_pairs(shared: DataFrame, seeds: tuple[int, ...] = (1, 2)) -> DataFrame:
    """In each bucket a pivot a seed with all others that may be near copies of it; entries with a ``root`` meet those of other roots only."""
    rooted = [c for c in ("root",) if c in shared.columns]
    pick = lambda i: F.min(F.struct(F.xxhash64("tid", F.lit(i)).alias("r"), "tid", "n", "pos", *BITS, *rooted))
    pivots = shared.groupBy("h").agg(*[pick(i).alias(f"p{i}") for i in seeds]).select("h", F.explode(F.array(*[f"p{i}" for i in seeds])).alias("p"))
    pivots = pivots.select("h", F.col("p.tid").alias("p"), *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("n", "pos", *BITS, *rooted)]).distinct()
    met = shared.select("h", F.col("tid").alias("o"), *[F.col(c).alias(f"o_{c}") for c in ("n", "pos", *BITS, *rooted)]).join(pivots.hint("merge"), "h")
    apart = F.col("p_root") != F.col("o_root") if rooted else F.col("p") != F.col("o")
    return met.filter(_may("p", "o") & apart).select(F.least("p", "o").alias("a"), F.greatest("p", "o").alias("b")).distinct()


def _placed(shared: DataFrame, root: DataFrame) -> tuple[DataFrame, int]:
    """The entries of buckets with several groups, with their group and the bucket's largest, and how many pairs all comparisons of groups would meet."""
    placed = shared.join(root.hint("merge"), shared["tid"] == root["fp"], "left").select("h", "tid", "n", "pos", *BITS, F.coalesce("root", "tid").alias("root"))
    sizes = placed.groupBy("h", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("h").agg(F.max(F.struct("k", "root")).alias("top"), F.count(F.lit(1)).alias("groups"), F.sum("k").alias("all"))
    mixed = staged(sizes.filter("groups > 1").select("h", F.col("top.root").alias("top"), ((F.col("all") - F.col("top.k")) * F.col("all")).alias("work")), "near-mixed")
    return staged(placed.join(mixed.select("h", "top").hint("merge"), "h"), "near-placed"), mixed.agg(F.sum("work")).first()[0] or 0


def _other_pairs(placed: DataFrame) -> DataFrame:
    """All pairs of a bucket that are in different groups; one of them is outside the bucket's largest group."""
    side = lambda x: [F.col("tid").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "pos", *BITS, "root")]]
    few = placed.filter("root <> top").select("h", *side("p"))
    met = few.join(placed.select("h", *side("o")).hint("merge"), "h").filter((F.col("p_root") != F.col("o_root")) & _may("p", "o"))
    return met.select(F.least("p", "o").alias("a"), F.greatest("p", "o").alias("b")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 5000, most_common: int = 1_000_000) -> DataFrame:
    """A row per row of ``docs``: key (``row_key``), and lead, the key of the row that stays for its group: the one with the least (id, key)."""
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    common = _common(docs, text, docs.count(), sample_rows, most_common)
    first = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), row_key(docs).alias("key"))
    same = F.md5(text.cast("binary"))
    prints = docs.select(first.alias("first"), same.alias("same"), _prefix_column(spark, common, text).alias("p"))
    texts = prints.groupBy("same").agg(F.min("first").alias("first"), F.min("p").alias("p"))  # equal texts have equal prefixes
    texts = staged(texts.select(F.monotonically_increasing_id().alias("tid"), "same", "first", "p.*"), "near-texts")
    listed = texts.select("tid", "n", F.posexplode("prefix").alias("pos", "h"))
    several = listed.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("h")
    bare = staged(listed.join(several.hint("merge"), "h"), "near-entries")
    shared = staged(bare.join(texts.select("tid", *BITS).hint("merge"), "tid"), "near-shared")  # sketches only where a shingle is shared
    discard(bare)

    keyed = docs.select(row_key(docs).alias("key"), text.alias("text"))
    first_links = _verified(_linked_pairs(texts), texts, keyed)
    pivots = _verified(_pivot_pairs(shared).join(first_links.hint("merge"), ["a", "b"], "left_anti"), texts, keyed)
    known = first_links.union(pivots)
    placed, work = _placed(shared, components(known))
    entries = shared.count()
    before, seed = 2 * work, 3
    while CROWDED * entries < work <= 0.75 * before:
        known = known.union(_verified(_pivot_pairs(placed, tuple(range(seed, seed + PIVOTS))), texts, keyed))
        discard(placed)
        before, seed = work, seed + PIVOTS
        placed, work = _placed(shared, components(known))
    more = _verified(_other_pairs(placed), texts, keyed)
    root = components(known.union(more))
    rooted = texts.join(root.hint("merge"), texts["tid"] == root["fp"], "left").select("same", "first", F.coalesce("root", "tid").alias("root"))
    rooted = staged(rooted, "near-rooted")
    leads = rooted.groupBy("root").agg(F.min("first").alias("lead"))
    named = staged(rooted.join(leads.hint("merge"), "root").select("same", F.col("lead.key").alias("lead")), "near-named")
    discard(texts, shared, placed, first_links, pivots, more, rooted)
    return docs.select(same.alias("same"), row_key(docs).alias("key")).join(named.hint("merge"), "same").select("key", "lead")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each group of near copies: the one with the least (id, row key)."""
    leads = near_groups(docs, id_col, text_col).filter("key = lead").select(F.col("key").alias("__key")).distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(docs).alias("__key"))
    return keyed.join(leads.hint("merge"), "__key", "left_semi").dropDuplicates(["__key"]).select("row.*")
