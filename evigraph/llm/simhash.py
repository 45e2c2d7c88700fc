"""SimHash near-duplicates with vantage-point trees.

Fingerprints: each bit of the 64 is the strict majority over the XXH64 hashes of a text's word
shingles. Linking: equal fingerprints collapse first. The distinct ones are dealt to the leaves
of a vantage-point tree (inner: within radius mu of the vantage point, outer: beyond) that is
built from a bounded sample; a fingerprint also visits every leaf that the triangle bound
cannot exclude. A pair that splits at a node is looked for from its inner side only. Inside a
leaf the same tree goes on in memory, and below it all remaining pairs are compared, so links
are exact. A leaf that outgrows a task is cut into a grid: each part of those who live there meets
each part of all who visit, and no pair is lost. A leaf reports each linked fingerprint with one representative instead of all pairs,
which joins the same components with rows in proportion to the fingerprints. Components of the
whole corpus come from rounds of random local contraction.

Wide radii exclude few leaves, and visits would grow with the number of leaves. Beyond ``TREE_RADIUS``
fingerprints are dealt by blocks of their bits instead: two within r bits agree in one of r + 1 blocks at
least, so that each goes to r + 1 shards whatever the size of the table, and the tree is built in each shard.

Nulls: a null or blank text has fingerprint zero, which is linked like any other; a null id is
never the smallest of a component that has others. Repeated rows are documents of their own. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import accumulate, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import staged

SEED = 42

#: The widest radius at which a tree over the whole table deals the fingerprints.
TREE_RADIUS = 4


def fingerprint(text: str | None, words: int = 3) -> int:
    """The signed 64-bit fingerprint of one text (A-Z lower-cased, words between white space)."""
    from xxhash import xxh64_intdigest

    parts = text.encode().lower().split() if text else []
    if not parts:
        return 0
    line, n = b" ".join(parts), len(parts)
    w = min(words, n)
    ends = list(accumulate(len(p) + 1 for p in parts))  # one past the space after each word
    starts = [0, *ends[:-1]]
    hashes = np.fromiter((xxh64_intdigest(line[s : e - 1], SEED) for s, e in zip(starts, ends[w - 1 :])), dtype="<u8", count=n - w + 1)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        block = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_column(text: Column, words: int = 3) -> Column:
    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return prints(text)


class VpTree:
    """Inner nodes (vantage point, mu, inner child, outer child); leaves are numbered."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int = 7):
        self.nodes: list[tuple[int, int, int, int]] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self.root = self._build(sample, leaf, rng)

    def _build(self, points: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        if len(points) > leaf:
            best = None
            view = points if len(points) <= 2048 else rng.choice(points, 2048, replace=False)
            for vp in rng.choice(points, min(6, len(points)), replace=False):
                d = np.bitwise_count(view ^ vp)
                mu = int(np.median(d))
                cut = float(np.mean(d <= mu))
                spread = float(d.std()) * min(cut, 1 - cut)
                if cut < 1 and (best is None or spread > best[0]):
                    best = (spread, int(vp), mu)
            if best:
                _, vp, mu = best
                inside = np.bitwise_count(points ^ np.uint64(vp)) <= mu
                if 0 < inside.sum() < len(points):
                    at = len(self.nodes)
                    self.nodes.append((vp, mu, 0, 0))
                    self.nodes[at] = (vp, mu, self._build(points[inside], leaf, rng), self._build(points[~inside], leaf, rng))
                    return at
        self.leaves += 1
        return -self.leaves

    def route(self, points: np.ndarray, home: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, indexes into points, which of them live there)."""
        todo = [(self.root, np.arange(len(points)), home)]
        while todo:
            at, rows, own = todo.pop()
            if not len(rows):
                continue
            if at < 0:
                yield -at - 1, rows, own
                continue
            vp, mu, inner, outer = self.nodes[at]
            d = np.bitwise_count(points[rows] ^ np.uint64(vp)).astype(np.int16)
            near, far = d <= mu, d >= mu + 1 - radius
            go_in = near | (~own & (d <= mu + radius))
            go_out = ~near | far
            todo.append((inner, rows[go_in], own[go_in]))
            todo.append((outer, rows[go_out], (own & ~near)[go_out]))


def _join_leaf(labels: np.ndarray, points: np.ndarray, homes: np.ndarray, rows: np.ndarray, radius: int, block: int = 1 << 20) -> np.ndarray:
    """Give all rows of points that link, through this leaf's homes, the least label among them; return the linked rows."""
    step, h, live, first = max(1, block // max(1, len(homes))), points[homes], rows, None
    while True:
        changed, keep = False, [rows[:0]]
        for i in range(0, len(live), step):
            part = live[i : i + step]
            near = np.bitwise_count(points[part][:, None] ^ h[None, :]) <= radius
            if first is None:
                linked = (near & (part[:, None] != homes[None, :])).any(axis=1)
                part, near = part[linked], near[linked]
                keep.append(part)
            if not len(part):
                continue
            least = np.minimum(np.where(near, labels[homes][None, :], len(labels)).min(axis=1), labels[part])
            own = np.minimum(np.where(near, least[:, None], len(labels)).min(axis=0), labels[homes])
            changed |= bool((least < labels[part]).any() or (own < labels[homes]).any())
            labels[part] = np.minimum(labels[part], least)
            labels[homes] = np.minimum(labels[homes], own)
        if first is None:
            first = live = np.concatenate(keep)
        if not changed:
            return first


def link_shard(points: np.ndarray, home: np.ndarray, radius: int, leaf: int = 512) -> np.ndarray:
    """Labels (index of a representative) of the points of one shard; unlinked points keep their own."""
    labels = np.arange(len(points))
    leaves = [(rows[own], rows) for _, rows, own in VpTree(points[home], leaf).route(points, home, radius) if own.any() and len(rows) > 1]
    while True:
        before = labels.copy()
        leaves = [(homes, linked) for homes, rows in leaves if len(linked := _join_leaf(labels, points, homes, rows, radius))]
        while not np.array_equal(jump := labels[labels], labels):
            labels = jump
        if np.array_equal(labels, before):
            return labels


def grid(tree: VpTree, sample: np.ndarray, share: float, radius: int, part_rows: int) -> dict[int, tuple[int, int]]:
    """leaf -> into how many parts its homes and all its visitors are cut, so that parts have about ``part_rows`` each."""
    parts = lambda n: max(1, math.ceil(n / share / part_rows))
    return {leaf: (parts(own.sum()), parts(len(rows))) for leaf, rows, own in tree.route(sample, np.ones(len(sample), bool), radius)}


def links(nodes: DataFrame, radius: int = 3, leaf_rows: int = 4096, sample_rows: int = 20_000, part_rows: int = 1 << 18) -> DataFrame:
    """(fp) distinct -> (a, b): a spanning set of the links within ``radius``, one row per linked
    fingerprint and visited shard. The tree's sample has about ``sample_rows`` fingerprints whatever their number;
    a shard has about ``part_rows`` homes and as many visitors at most.
    """
    if radius > TREE_RADIUS:
        return _links_by_blocks(nodes, radius, part_rows)
    n = nodes.count()
    share = min(1.0, sample_rows / max(n, 1))
    lot = F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(1 << 30))
    sample = np.array([r["fp"] for r in nodes.filter(lot < int(share * (1 << 30))).select("fp").orderBy("fp").collect()], dtype=np.int64).view(np.uint64)
    built = VpTree(sample, max(64, math.ceil(leaf_rows * share)))
    tree = nodes.sparkSession.sparkContext.broadcast((built, grid(built, sample, share, radius, part_rows)))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        router, cuts = tree.value
        for batch in batches:
            points = batch["fp"].to_numpy(np.int64).view(np.uint64)
            lot = ((points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            for leaf, rows, own in router.route(points, np.ones(len(points), bool), radius):
                n_home, n_all = cuts.get(leaf, (1, 1))
                for i, j in product(range(n_home), range(n_all)):
                    home = own & (lot[rows] % n_home == i)
                    here = home | (lot[rows] % n_all == j)
                    yield pd.DataFrame({"leaf": leaf, "part": i * n_all + j, "fp": points[rows[here]].view(np.int64), "home": home[here]})

    dealt = nodes.select("fp").mapInPandas(deal, "leaf int, part int, fp long, home boolean")
    return dealt.groupBy("leaf", "part").applyInPandas(_linker(radius), "a long, b long")


def _linker(radius: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The links of one shard (fp, home): each linked fingerprint with a representative."""

    def link(batch: pd.DataFrame) -> pd.DataFrame:
        points = batch["fp"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(points)
        points, home = points[order], batch["home"].to_numpy(bool)[order]
        if not home.any():
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        labels = link_shard(points, home, radius)
        moved = labels != np.arange(len(points))
        return pd.DataFrame({"a": points[moved].view(np.int64), "b": points[labels[moved]].view(np.int64)})

    return link


def by_blocks(nodes: DataFrame, radius: int, part_rows: int) -> DataFrame:
    """(fp) -> (block, value, one, other, fp, home): each fingerprint by the value of each of its ``radius`` + 1 blocks. A value that more
    than ``part_rows`` have is cut into parts, of which all pairs (one, other) meet."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    values = F.array(*[F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:])])
    keyed = nodes.select("fp", F.posexplode(values).alias("block", "value"))
    parts = keyed.groupBy("block", "value").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts")).filter("parts > 1")
    crowded = F.broadcast(parts)  # the radius bounds the blocks, the bits of a block its values
    mine = F.pmod(F.xxhash64("fp", F.lit(9)), F.coalesce("parts", F.lit(1))).cast("int")
    cut = keyed.join(crowded, ["block", "value"], "left").select("block", "value", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("met"))
    return cut.select("block", "value", F.least("mine", "met").alias("one"), F.greatest("mine", "met").alias("other"), "fp", (F.col("mine") <= F.col("met")).alias("home"))


def _links_by_blocks(nodes: DataFrame, radius: int, part_rows: int) -> DataFrame:
    return by_blocks(nodes, radius, part_rows).groupBy("block", "value", "one", "other").applyInPandas(_linker(radius), "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) -> (fp, root) for every end of an edge: the same root exactly for connected ends.

    In each round every end picks, among itself and its neighbours, the one with the least seeded
    hash; edges move to the picks and the ones that became loops go. The number of ends falls by a
    constant factor a round in expectation, whatever the shape.
    """
    edges = staged(edges.distinct(), "simhash-edges")
    root = None
    for i in range(rounds):
        if edges.isEmpty():
            break
        both = edges.select("a", "b").union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(i)).alias("h"), F.col(c).alias("v"))
        picked = staged(both.groupBy("a").agg(F.min(rank("b")).alias("r")).select(F.col("a").alias("v"), F.least(rank("a"), F.col("r"))["v"].alias("p")), "simhash-picked")
        moved = (
            edges.join(picked.select(F.col("v").alias("a"), F.col("p").alias("pa")).hint("merge"), "a")
            .join(picked.select(F.col("v").alias("b"), F.col("p").alias("pb")).hint("merge"), "b")
            .filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
        edges = staged(moved, "simhash-edges")
        if root is None:
            root = picked.select(F.col("v").alias("fp"), F.col("p").alias("root"))
        else:
            step = root.join(picked.select(F.col("v").alias("root"), "p").hint("merge"), "root", "left")
            root = staged(step.select("fp", F.coalesce("p", "root").alias("root")), "simhash-roots")
    else:
        if not edges.isEmpty():
            raise RuntimeError("components did not settle")
    if root is None:
        return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    return root


def near_duplicates(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", leaf_rows: int = 4096, sample_rows: int = 20_000, part_rows: int = 1 << 18) -> DataFrame:
    """A row per row of ``docs``: doc_id, fp (signed long), component_id (the least doc_id reachable over links)."""
    prints = staged(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col)).alias("fp")), "simhash-prints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("lead")), "simhash-nodes")
    root = components(links(nodes, radius, leaf_rows, sample_rows, part_rows))
    rooted = nodes.join(root.hint("merge"), "fp", "left").select("fp", "lead", F.coalesce("root", "fp").alias("root"))
    leads = rooted.groupBy("root").agg(F.min("lead").alias("component_id"))
    named = staged(rooted.join(leads.hint("merge"), "root").select("fp", "component_id"), "simhash-named")
    return prints.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
