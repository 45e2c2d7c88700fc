"""Sharding by a two-pass external shuffle.

Pass one scatters the records over buckets that fit in memory, by a seeded hash of their contents, so that null or repeated
ids spread like any others. Equal records can't be told apart by a hash: where more than ``bucket_rows`` are equal, they are numbered, over ranges in many
tasks, and each is dealt by its number. Pass two runs Spark's built-in Fisher-Yates ``shuffle`` over each bucket's array.
Counting the buckets first gives each its offset, so a record's place in the whole order, its shard and its slot follow without
another shuffle: shard s holds places floor(s*n/k) up to floor((s+1)*n/k). ``write_shards`` writes a folder for each shard.

Nulls: a null is hashed like any value. Repeated rows are records of their own. Other columns pass through, whatever their names and types (maps are hashed
as text), but columns named shard or slot, in upper or lower case, are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from ..operators.order import numbered
from ..plans.scratch import staged


def one_by_one(rows: DataFrame, h: str, limit: int) -> DataFrame:
    """``rows`` + i: 0, or where more than ``limit`` rows have the same ``h`` the number of the row among them, from 1."""
    crowded = staged(rows.groupBy(h).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select(h), "crowds")  # rows / limit of them at most
    if crowded.isEmpty():
        return rows.withColumn("i", F.lit(0).cast("long"))
    alone = rows.join(crowded.hint("merge"), h, "left_anti").select(*rows.columns, F.lit(0).cast("long").alias("i"))
    crowd = rows.join(crowded.hint("merge"), h, "left_semi").withColumn("__tie", F.monotonically_increasing_id())
    return alone.unionByName(numbered(crowd, [h], F.col("__tie"), name="i").select(*rows.columns, F.col("i").cast("long").alias("i")))


def _hashable(field: StructField) -> Column:
    """A column, as text if it has maps, which can't be hashed."""
    c = F.col(f"`{field.name}`")
    return F.to_json(F.struct(c.alias("c"))) if "map<" in field.dataType.simpleString() else c


def two_pass_shuffle(
    records: DataFrame,
    n_shards: int = 8,
    seed: int = 29,
    size: Column | None = None,
    bucket_rows: int = 4096,
    bucket_bytes: int = 16 << 20,
    broadcast_buckets: int = 100_000,
) -> DataFrame:
    """``records`` + shard int, slot long (0, 1, 2, ... in each shard), uniformly shuffled; reruns agree.

    Shards differ by one record at most. ``size`` gives each record's bytes and keeps buckets under about ``bucket_bytes``.
    Offsets of up to ``broadcast_buckets`` buckets (24 bytes each) are broadcast, more are joined by a shuffle.
    """
    fields = [f for f in records.schema.fields if f.name.lower() not in ("shard", "slot")]
    total = F.coalesce(F.sum(F.lit(0) if size is None else size), F.lit(0))
    got = records.agg(F.count(F.lit(1)).alias("n"), total.alias("b")).first()
    n, buckets = got["n"], max(1, math.ceil(got["n"] / bucket_rows), math.ceil(got["b"] / bucket_bytes))
    row = F.struct(*[F.col(f"`{f.name}`") for f in fields]).alias("row")
    rows = one_by_one(records.select(row, F.xxhash64(*map(_hashable, fields)).alias("h")), "h", bucket_rows)
    dealt = rows.select(F.pmod(F.xxhash64(F.lit(seed), "h", "i"), F.lit(buckets)).alias("bucket"), F.struct(F.xxhash64(F.lit(seed + 1), "h", "i").alias("h"), "row").alias("r"))

    counts = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    # Offsets in two levels: within thousands of buckets, then over the thousands.
    thousand = F.floor(F.col("bucket") / 1024)
    inner = Window.partitionBy(thousand).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy(thousand.alias("k")).agg(F.sum("rows").alias("rows")).select("k", F.coalesce(F.sum("rows").over(outer), F.lit(0)).alias("before"))
    small = buckets <= broadcast_buckets
    offsets = (
        counts.withColumn("inside", F.coalesce(F.sum("rows").over(inner), F.lit(0))).withColumn("k", thousand)
        .join(F.broadcast(blocks) if small else blocks.hint("merge"), "k")
        .select("bucket", (F.col("inside") + F.col("before")).alias("offset"))
    )
    every = F.collect_list("r")
    by_hash = lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0)
    in_order = F.array_sort(every, by_hash) if "map<" in records.schema.simpleString() else F.array_sort(every)  # maps have no order
    filled = (
        dealt.repartition(max(1, math.ceil(buckets / 4)), "bucket")
        .groupBy("bucket").agg(in_order.alias("rs"))
        .sortWithinPartitions("bucket")
        .withColumn("rs", F.shuffle("rs", seed))
    )
    placed = filled.join(F.broadcast(offsets) if small else offsets.hint("merge"), "bucket").select("offset", F.posexplode("rs").alias("i", "r"))
    placed = placed.select((F.col("offset") + F.col("i")).alias("place"), F.col("r.row").alias("row"))
    shard = F.expr(f"((place + 1) * {n_shards} - 1) div {max(n, 1)}")
    cut = placed.select("row", "place", shard.alias("s"))
    return cut.select("row.*", F.col("s").cast("int").alias("shard"), (F.col("place") - F.expr(f"(s * {n}) div {n_shards}")).cast("long").alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> DataFrame:
    """Write a folder per shard and read all back; rows carry their slot, which is the reading order."""
    shuffled.write.partitionBy("shard").parquet(path)
    return shuffled.sparkSession.read.schema(shuffled.schema).parquet(path).select(*[f"`{c}`" for c in shuffled.columns])
