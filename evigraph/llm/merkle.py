"""Merkle manifest of a dataset, with a proof for every row, by pointer jumping.

Leaves are numbered within their group by a sort over ranges, so that a group with most of the rows is spread over tasks. Trees
grow ``STEP`` levels a job: an aligned stretch of 2^STEP nodes is folded in one row. The groups' roots are the leaves of a tree of
their own; its path to the root is put on top of each group's tree, which gives every leaf of a group the same depth.

Proofs: each node first holds the segment of siblings to its parent. A round joins the nodes at every second of the present
levels with their ancestors, appends the ancestors' segments and thereby doubles the distance; after log2(depth) self-joins the
leaves hold all siblings up to the root. Every round is a written table. Digests are bytes in the tables and lowercase hex where they are hashed.

Nulls: a null column of a leaf is written as ``-``; a null group is a group of its own and comes first, as does a null in the order.
Rows of equal order are ordered by their leaves; equal rows each have a leaf and a proof of their own. A group of one row is its own root.
An empty table has no rows and no root. Only the named columns are read, whatever others are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from ..plans.scratch import staged

STEP = 10


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def hashed(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 of the columns' values, each with its length in bytes before it."""
    value = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return hashed(F.concat(*[value(c) for c in columns]))


def height(n: Column) -> Column:
    """Levels above ``n`` leaves: ceil(log2(n))."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _parents(row: Column) -> Column:
    """The level above an array of digests; a last one without a partner is hashed alone."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(row) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: hashed(F.concat(hexed(F.get(row, 2 * i)), F.coalesce(hexed(F.get(row, 2 * i + 1)), F.lit("")))))


def tree(leaves: DataFrame) -> DataFrame:
    """(tree, idx, n, digest), n being the leaves of a tree -> all nodes: tree, n, level, idx, digest, sib (null without one)."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    parts, base, rows = [], 0, leaves
    while not parts or base < (most - 1).bit_length():
        levels = F.least(F.lit(STEP), height(F.col("n")) - base)
        stretch = rows.groupBy("tree", "n", F.shiftright("idx", STEP).alias("at")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("row"))
        first = F.array(F.transform("row", lambda x: x["digest"]))
        grown = F.when(levels > 0, F.aggregate(F.sequence(F.lit(1), levels), first, lambda had, _: F.concat(had, F.array(_parents(F.element_at(had, -1)))))).otherwise(first)
        grown = staged(stretch.select("tree", "n", "at", grown.alias("rows")), "merkle-stretches")
        row = grown.select("tree", "n", "at", F.posexplode("rows").alias("up", "row"))
        node = row.select("tree", "n", "at", "up", "row", F.posexplode("row").alias("i", "digest"))
        node = node.select(
            "tree", "n", (F.col("up") + base).alias("level"), (F.expr(f"shiftleft(at, {STEP} - up)") + F.col("i")).alias("idx"), "digest",
            F.get("row", F.col("i").bitwiseXOR(F.lit(1))).alias("sib"),
        )
        last = F.col("level") == height(F.col("n"))
        parts.append(node.filter((F.col("level") < base + STEP) | last))
        rows = node.filter((F.col("level") == base + STEP) & ~last).select("tree", "idx", "n", "digest")
        base += STEP
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _jump(nodes: DataFrame, depth: int) -> DataFrame:
    """(tree, level, idx, seg, ends, entry) -> the leaves, with the segments and the ends of all their ancestors."""
    d = 1
    while d <= depth:
        on = lambda name: F.col(name).alias(f"a_{name}")
        above = nodes.filter(F.col("level") % (2 * d) == d).select(*map(on, ("tree", "level", "idx", "seg", "ends")))
        up = F.shiftright("idx", d) if d < 63 else F.lit(0).cast("long")
        met = nodes.filter(F.col("level") % (2 * d) == 0).join(
            above.hint("merge"), (F.col("tree") == F.col("a_tree")) & (F.col("level") + d == F.col("a_level")) & (up == F.col("a_idx")), "left"
        )
        seg = F.when(F.col("a_seg").isNull(), F.col("seg")).otherwise(F.concat("seg", "a_seg"))
        nodes = staged(met.select("tree", "level", "idx", seg.alias("seg"), F.coalesce("a_ends", "ends").alias("ends"), "entry"), "merkle-segments")
        d *= 2
    return nodes.filter("level = 0")


def prove(rows: DataFrame, group: str, order: str, digest: str, *keep: str) -> DataFrame:
    """``rows`` (leaves with their digest) -> order, digest and ``keep`` with siblings array<binary> (null: none on that level), lefts array<boolean>
    (whether the sibling is the left one), both from the leaf's level to that below the root, subroot and root."""
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # a null group first; the order of the others is kept
    light = rows.select(key.alias("tree"), F.col(order).alias("by"), F.col(digest).alias("digest"), F.struct(order, digest, *keep).alias("entry"))
    light = light.withColumn("tie", F.monotonically_increasing_id())  # equal rows may be a large part of a group
    placed = numbered(light, ["tree"], F.col("by").asc_nulls_first(), F.col("digest"), F.col("tie"), total="n")
    leaves = staged(placed.select("tree", (F.col("place") - 1).alias("idx"), "n", "digest", "entry"), "merkle-leaves")

    nodes = tree(leaves.drop("entry"))
    ends = staged(nodes.filter(F.col("level") == height(F.col("n"))).select("tree", "n", F.col("digest").alias("subroot")), "merkle-subroots")
    groups = numbered(ends, [], F.col("tree"), name="rank", total="groups").select("tree", "n", "subroot", (F.col("rank") - 1).alias("rank"), "groups")
    groups = staged(groups, "merkle-groups")
    shape = groups.agg(F.max("n"), F.max("groups")).first()
    most, over = (((x or 0) - 1).bit_length() if x else 0 for x in shape)
    top = tree(groups.select(F.lit("").alias("tree"), F.col("rank").alias("idx"), F.col("groups").alias("n"), F.col("subroot").alias("digest")))
    top = staged(top.select(F.col("level").alias("t"), F.col("idx").alias("at"), "digest", "sib"), "merkle-top")

    path = groups.select("tree", "n", "subroot", "rank", F.explode(F.sequence(F.lit(0), F.lit(over))).alias("t"))
    path = path.withColumn("at", F.expr("shiftright(rank, t)")).join(top.hint("merge"), ["t", "at"])
    nothing = F.array().cast("array<binary>")
    path = path.select(
        "tree", (height(F.col("n")) + F.col("t")).alias("level"), F.lit(0).cast("long").alias("idx"), F.when(F.col("t") < over, F.array("sib")).otherwise(nothing).alias("seg"),
        F.when(F.col("t") == over, F.struct("rank", "subroot", F.col("digest").alias("root"))).alias("ends"),
    )
    below = nodes.filter(F.col("level") < height(F.col("n"))).select("tree", "level", "idx", F.array("sib").alias("seg"), F.lit(None).cast(path.schema["ends"].dataType).alias("ends"))
    every = below.unionByName(path)
    low = every.filter("level = 0").join(leaves.select("tree", "idx", F.struct("n", "entry").alias("entry")).hint("merge"), ["tree", "idx"])
    high = every.filter("level > 0").withColumn("entry", F.lit(None).cast(low.schema["entry"].dataType))
    reached = _jump(staged(low.unionByName(high), "merkle-segments"), most + over)

    h = height(F.col("entry.n"))
    bit = lambda t: F.when(t < h, F.getbit(F.col("idx"), t)).otherwise(F.getbit(F.col("ends.rank"), F.greatest(t - h, F.lit(0))))
    lefts = F.transform("seg", lambda _, t: bit(t) == 1)
    sided = reached.withColumn("lefts", lefts)  # before the caller's columns come out, whose names may be those used here
    return sided.select("entry.entry.*", F.col("seg").alias("siblings"), "lefts", "ends.subroot", "ends.root")


def folded(leaf: Column, siblings: Column, lefts: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    steps = F.arrays_zip(siblings.alias("s"), lefts.alias("l"))
    other = lambda x: F.coalesce(hexed(x["s"]), F.lit(""))
    return F.aggregate(steps, leaf, lambda had, x: hashed(F.when(x["l"], F.concat(other(x), hexed(had))).otherwise(F.concat(hexed(had), other(x)))))


def proof_digest(siblings: Column) -> Column:
    """SHA-256 of a proof's siblings in order."""
    return hashed(F.array_join(F.transform(siblings, hexed), ""))
