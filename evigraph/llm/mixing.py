"""Mixing sources to target token weights by entropy balancing.

Every document starts with rate 1. Among all rates that give each source its token target and
stay within ``cap``, the ones nearest to 1 in relative entropy are

    rate(document) = min(cap, exp(lambda[source] * tokens(document)))

where the multipliers solve the convex dual of the token constraints. Since a rate depends on
the source and the token count alone, the dual is solved on the histogram (source, tokens) of
the corpus; each Newton iteration is one distributed aggregation over it. The rates are then
rounded into whole copies: cumulative rounding down the sizes of a source, a settling step that
spends what the rounding left over, and a seeded choice of the documents that get one copy more.

Nulls: a null or blank text has 0 tokens, rate 1, one copy and takes nothing. A null source is a
source of its own, ordered last. Repeated rows count as documents of their own. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import staged
from .shards import one_by_one

WORD = r"[^\x20\x09-\x0D]+"
DYADIC = float(1 << 20)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast a table whose row count was checked; a larger one is joined by shuffling. Rows are a few numbers, 100 bytes as a
    broadcast at most: 100,000 of them are 10 MB."""
    return F.broadcast(df) if rows <= limit else df.hint("merge")


def water_fill(sources: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """(source, source_size) -> + sid, weight, target.

    Sources are numbered by code point, null last, and weighted by ``weights`` repeated. The
    shares add up to all tokens; a target above ``cap`` x its source's size stops there and the
    excess is shared by weight among the rest until none is above.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    sources = staged(
        sources.withColumn("sid", F.row_number().over(by_name) - 1).withColumn(
            "weight",
            F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")).cast("double"),
        ),
        "mix-sources",
    )
    row = sources.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("w")).first()
    total, theta = float(row["all"] or 0), (row["all"] or 0) / (row["w"] or 1)
    most = F.col("source_size") * F.lit(cap)
    while True:
        over = F.lit(theta) * F.col("weight") >= most
        got = sources.agg(
            F.coalesce(F.sum(F.when(over, most)), F.lit(0.0)).alias("capped"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("free"),
        ).first()
        if not got["free"]:
            break
        higher = (total - got["capped"]) / got["free"]
        if higher <= theta:
            break
        theta = higher
    return sources.withColumn("target", F.least(F.lit(theta) * F.col("weight"), most))


def solve_dual(strata: DataFrame, targets: DataFrame, cap: float, broadcast_sources: int, tolerance: float = 1e-9, iterations: int = 80) -> DataFrame:
    """(sid, size, m), (sid, source_size, target) -> (sid, lam): the multipliers of the token constraints.

    Newton's method on the logarithm of each source's constraint, kept inside a shrinking bracket
    (rates are capped, so the plain step can overshoot).
    """
    top = F.log(F.lit(cap))
    x = F.col("size").cast("double")
    shape = strata.groupBy("sid").agg(F.min("size").alias("least"), F.sum(F.col("m") * x * x).alias("squares"))
    ratio = F.col("target") / F.col("source_size")
    full = ratio >= cap  # every rate is the cap
    hi = F.when(ratio > 1, top / F.col("least") * (1 + 1e-12)).otherwise(0.0)
    state = targets.filter("target > 0").join(shape, "sid").select(
        "sid", "target", F.when(full, hi).otherwise(F.log(ratio) * F.col("source_size") / F.col("squares")).alias("lam"),
        F.when(ratio < 1, F.log(ratio) / F.col("least")).otherwise(0.0).alias("lo"), hi.alias("hi"), full.alias("done"),
    )
    state = staged(state, "mix-dual")
    n = state.count()
    for _ in range(iterations):
        z = F.col("lam") * x
        rate = F.when(z >= top, F.lit(cap)).otherwise(F.exp(z))
        sums = (
            strata.join(_small(state.select("sid", "lam"), n, broadcast_sources), "sid")
            .groupBy("sid")
            .agg(F.sum(F.col("m") * x * rate).alias("f"), F.sum(F.when(z < top, F.col("m") * x * x * rate).otherwise(0.0)).alias("df"))
        )
        joined = state.join(_small(sums, n, broadcast_sources), "sid")
        high = F.col("f") > F.col("target")
        lo, hi = F.when(high, F.col("lo")).otherwise(F.col("lam")), F.when(high, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - F.try_divide(F.log(F.col("f") / F.col("target")) * F.col("f"), F.col("df"))
        done = F.col("done") | (F.abs(F.col("f") - F.col("target")) <= F.col("target") * tolerance) | (hi - lo <= F.lit(1e-14) * F.abs("lam"))
        step = F.when((newton >= lo) & (newton <= hi) & (newton != F.col("lam")), newton).otherwise((lo + hi) / 2)
        state = staged(
            joined.select("sid", "target", F.when(done, F.col("lam")).otherwise(step).alias("lam"), lo.alias("lo"), hi.alias("hi"), done.alias("done")),
            "mix-dual",
        )
        if state.filter(~F.col("done")).isEmpty():
            break
    # Ten digits are well beyond the tolerance's effect on copies and hide the order in which sums were added.
    return state.select("sid", F.format_string("%.10e", "lam").cast("double").alias("lam"))


def round_rates(strata: DataFrame, multipliers: DataFrame, targets: DataFrame, cap: float, broadcast_sources: int, settle: int = 3) -> DataFrame:
    """Whole copies for each stratum (source, tokens): (sid, size, m, copies, rate).

    Copies are rounded on their running total from long to short documents, so that errors cancel
    along the way; then what a source is still off its target by is added to, or taken from,
    the longest documents that fit into it.
    """
    n = targets.count()
    z = F.coalesce(F.col("lam"), F.lit(0.0)) * F.col("size")
    rate = F.when(F.col("lam").isNull(), F.lit(0.0)).when(z >= F.log(F.lit(cap)), F.lit(cap)).otherwise(F.floor(F.exp(z) * DYADIC) / DYADIC)
    down = Window.partitionBy("sid").orderBy(F.col("size").desc())
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)
    most = (F.col("m") * int(cap)).cast("long")
    out = (
        strata.join(_small(multipliers, n, broadcast_sources), "sid", "left")
        .withColumn("rate", rate)
        .withColumn("run", F.sum(F.col("m") * F.col("rate")).over(so_far))
        .withColumn("copies", F.floor(F.col("run") + 0.5) - F.floor(F.col("run") - F.col("m") * F.col("rate") + 0.5))
        .select("sid", "size", "m", "rate", F.least(most, F.greatest(F.lit(0), F.col("copies"))).cast("long").alias("copies"))
    )
    for _ in range(settle):
        out = staged(out, "mix-copies")
        off = (
            out.groupBy("sid").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
            .join(_small(targets.select("sid", "target"), n, broadcast_sources), "sid")
            .select("sid", (F.round("target") - F.col("taken")).cast("long").alias("off"))
        )
        fits = F.col("size") <= F.abs("off")
        room = F.when(~fits, F.lit(0)).when(F.col("off") > 0, most - F.col("copies")).otherwise(F.col("copies"))
        left = F.abs("off") - (F.sum(F.col("room") * F.col("size")).over(so_far) - F.col("room") * F.col("size"))
        out = (
            out.join(_small(off, n, broadcast_sources), "sid")
            .withColumn("room", room)
            .withColumn("left", left)
            .withColumn("move", F.when(F.col("left") > 0, F.least(F.col("room"), F.floor(F.col("left") / F.col("size")))).otherwise(0))
            .select("sid", "size", "m", "rate", (F.col("copies") + F.signum("off") * F.col("move")).cast("long").alias("copies"))
        )
    return staged(out, "mix-copies")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cell_rows: int = 512,
    broadcast_sources: int = 100_000,
    broadcast_strata: int = 100_000,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, rate, copies, taken.

    ``copies`` (0 to ``cap``) is how often the document enters the mix. Which documents of a
    stratum get one copy more is decided by a seeded hash of the id, so reruns agree; strata are
    cut into cells of about ``cell_rows`` rows so that a stratum with a third of the corpus
    does not meet in one task. Where more than ``cell_rows`` rows of a stratum have one id, or none, they are told apart by numbers, which are the
    same in every run, if not for the same of these equal rows.
    """
    light = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "mix-docs")
    targets = staged(water_fill(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, float(cap)), "mix-targets")
    n_sources = targets.count()
    light = light.alias("d").join(
        _small(targets.withColumnRenamed("source", "s_name"), n_sources, broadcast_sources),
        F.col("source").eqNullSafe(F.col("s_name")),
    ).drop("s_name")
    strata = staged(light.filter("size > 0").groupBy("sid", "size").agg(F.count(F.lit(1)).alias("m")), "mix-strata")
    dual = solve_dual(strata, targets, float(cap), broadcast_sources)
    copies = round_rates(strata, dual, targets, float(cap), broadcast_sources)
    n_strata = copies.count()

    shape = copies.select(
        "sid", "size", "rate", "m", F.floor(F.col("copies") / F.col("m")).alias("each"), (F.col("copies") % F.col("m")).alias("extra"),
        F.ceil(F.col("m") / cell_rows).alias("cells"),
    )
    placed = one_by_one(light.withColumn("unit", F.xxhash64("sid", "size", "doc_id")), "unit", cell_rows).drop("unit")
    placed = placed.join(_small(shape, n_strata, broadcast_strata), ["sid", "size"], "left").withColumn(
        "cell", F.when(F.col("cells") > 1, F.pmod(F.xxhash64(F.lit(seed), "doc_id", "i"), F.col("cells"))).otherwise(0)
    )
    by_cell = Window.partitionBy("sid", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = (
        placed.filter("cells > 1").groupBy("sid", "size", "cell").agg(F.count(F.lit(1)).alias("n"), F.first("m").alias("m"), F.first("extra").alias("extra"))
        .withColumn("upto", F.sum("n").over(by_cell))
        .select("sid", "size", "cell", (F.floor(F.col("extra") * F.col("upto") / F.col("m")) - F.floor(F.col("extra") * (F.col("upto") - F.col("n")) / F.col("m"))).alias("cell_extra"))
    )
    cells = staged(cells, "mix-cells")
    in_cell = Window.partitionBy("sid", "size", "cell").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "i"), "doc_id", "i")
    more = F.when(F.row_number().over(in_cell) <= F.coalesce("cell_extra", "extra"), 1).otherwise(0)
    return (
        placed.join(_small(cells, cells.count(), broadcast_strata), ["sid", "size", "cell"], "left")
        .withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(F.coalesce(F.col("each"), F.lit(0)) + more).cast("int"))
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("rate", F.lit(1.0)).alias("rate"), "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
    )


def repeat(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with every row as often as its copies say; ids must be unique. Columns may have any names."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"))
    copies = mixed.filter("copies > 0").select(F.col("doc_id").alias("key"), "copies")
    joined = row.join(copies.hint("merge"), F.col("id").eqNullSafe(F.col("key")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
