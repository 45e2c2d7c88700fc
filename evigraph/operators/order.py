"""Places in an order over whole tables without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import few, staged


def numbered(rows: DataFrame, by: list[str], *order: Column, name: str = "place", total: str | None = None) -> DataFrame:
    """``rows`` + place (1, 2, ...) in ``order`` within each group of ``by``, and as ``total`` the rows of the group; the order must be total,
    and the columns of ``by`` without nulls.

    Rows are sorted by range over all groups at once, so a group with most of the rows, or the only group, is spread over tasks. They are numbered
    as they lie in their range and written so; a place is that number less the group's first one in the range, after all rows of the group in earlier ranges.
    """
    sort = [*by, *order]
    ranged = staged(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id()), "order-ranges")
    ranged = ranged.withColumn("__range", F.shiftright("__at", 33))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))  # a row for each range
    extra = []
    if total:
        sizes, extra = sizes.withColumn("__all", F.sum("__n").over(Window.partitionBy(*by))), [F.col("__all").alias(total)]
    sizes = staged(sizes, "order-sizes")
    placed = ranged.join(few(sizes), [*by, "__range"])
    return placed.select(*rows.columns, (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias(name), *extra)


def running_sums(rows: DataFrame, by: list[str], order: str, *sums: str) -> DataFrame:
    """``rows`` with each of ``sums`` replaced by its running total in ``order`` within a group of ``by``; ``order`` must be total.

    As in ``numbered`` the rows are sorted by range over all groups, so that one group is spread over tasks.
    """
    ranged = staged(rows.repartitionByRange(*by, order).withColumn("__range", F.spark_partition_id()), "running-ranges")
    so_far = Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = ranged.groupBy(*by, "__range").agg(*[F.sum(c).alias(c) for c in sums]).select(*by, "__range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__{c}") for c in sums])
    inside = ranged.withColumns({c: F.sum(c).over(so_far) for c in sums}).join(before.hint("merge"), [*by, "__range"])
    return inside.withColumns({c: F.col(c) + F.col(f"__{c}") for c in sums}).select(*rows.columns)
