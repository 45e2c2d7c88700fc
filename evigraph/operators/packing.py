"""Greedy batches under a budget, with a hot key spread over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import staged
from .order import numbered

STRETCH = 4096


def _next_starts(sizes: np.ndarray, own: int, max_chars: int, max_items: int) -> list[int]:
    """For each of the first ``own`` items, the item that opens the next batch if this one opens a batch."""
    ends = np.cumsum(sizes)
    at = np.arange(own)
    full = np.searchsorted(ends, ends[:own] - sizes[:own] + max_chars, side="right")
    return np.minimum(np.maximum(full, at + 1), at + max_items).tolist()


def _stretches(placed: DataFrame, length: int, max_items: int) -> DataFrame:
    """__k, stretch, own, sizes: the items of each stretch of ``length`` places and the ``max_items`` behind it, which its last batch may reach."""
    at = F.col("__at") - 1
    stretch, inside = F.floor(at / length), at % length
    ahead = F.when((stretch > 0) & (inside < max_items), F.array(stretch, stretch - 1)).otherwise(F.array(stretch))
    rows = placed.select("__k", "__at", "__size", F.explode(ahead).alias("stretch"))
    own = F.count_if(F.col("__at") <= (F.col("stretch") + 1) * length).cast("int")
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("__at", "__size"))), lambda x: x["__size"])
    return rows.groupBy("__k", "stretch").agg(own.alias("own"), sizes.alias("sizes"))


def _entries(stretches: DataFrame, length: int, max_chars: int, max_items: int) -> DataFrame:
    """__k, stretch, entry: where in each stretch its first batch opens.

    A batch opened before a stretch ends within its first ``max_items`` places, so a stretch maps that many possible entries to
    entries of the next one. These maps are composed by doubling: after the rounds, map number i skips 2^i stretches, and
    going through them from the longest down, every stretch is reached from those known.
    """

    @F.pandas_udf("array<int>")
    def exits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sizes, own in batches:
            out = []
            for s, n in zip(sizes, own):
                leads = _next_starts(s, n, max_chars, max_items)
                for i in range(n - 1, -1, -1):
                    if leads[i] < n:
                        leads[i] = leads[leads[i]]
                out.append([e - length for e in leads[:max_items]])
            yield pd.Series(out)

    known = stretches.filter("stretch = 0").select("__k", F.lit(0).cast("long").alias("stretch"), F.lit(0).alias("entry"))
    last = stretches.agg(F.max("stretch")).first()[0] or 0
    if last == 0:
        return known
    inner = stretches.join(stretches.select("__k", (F.col("stretch") - 1).alias("stretch")).hint("merge"), ["__k", "stretch"])
    leap = inner.select("__k", "stretch", F.posexplode(exits("sizes", "own")).alias("entry", "to"))
    leaps = [staged(leap, "packing-leaps")]
    while 2 ** len(leaps) <= last:
        a, step = leaps[-1], 2 ** (len(leaps) - 1)
        b = a.select("__k", (F.col("stretch") - step).alias("stretch"), F.col("entry").alias("to"), F.col("to").alias("beyond"))
        leaps.append(staged(a.join(b.hint("merge"), ["__k", "stretch", "to"]).select("__k", "stretch", "entry", F.col("beyond").alias("to")), "packing-leaps"))
    for i in range(len(leaps) - 1, -1, -1):
        reached = known.join(leaps[i].hint("merge"), ["__k", "stretch", "entry"]).select("__k", (F.col("stretch") + 2**i).alias("stretch"), F.col("to").alias("entry"))
        known = staged(known.union(reached), "packing-entries")
    return known


def pack_text_budget(items: DataFrame, keys: list[str], order: str, length: str, max_chars: int, max_items: int, stretch: int = STRETCH) -> DataFrame:
    """``items`` with ``batch``: greedy next-fit in order within each key (all items are one sequence if there are no keys).

    A new batch opens when the current one is full by items or would exceed the characters; an oversize item stands alone, and a length that is null
    or below 1 counts as 1. Null keys are a key. Items with equal ``order`` come in any order, but in one only.

    No task holds a key: places come from a sort by range, and lengths are looked at in stretches of ``stretch`` places. In each of them every possible
    first opening is followed to where it leaves the stretch, and the openings that happen are found by doubling over stretches.
    """
    stretch = max(stretch, max_items)
    key = F.struct(*keys) if keys else F.struct(F.lit(0))
    rows = items.select("*", key.alias("__k"), F.greatest(F.lit(1), F.coalesce(F.col(length), F.lit(1))).cast("long").alias("__size"))
    placed = staged(numbered(rows, ["__k"], F.col(order), name="__at"), "packing-places")
    stretches = staged(_stretches(placed, stretch, max_items), "packing-stretches")

    @F.pandas_udf("array<int>")
    def opened(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sizes, own, entry in batches:
            out = []
            for s, n, i in zip(sizes, own, entry):
                leads, opens = _next_starts(s, n, max_chars, max_items), np.zeros(n, dtype=np.int32)
                while i < n:
                    opens[i] = 1
                    i = leads[i]
                out.append(np.cumsum(opens))
            yield pd.Series(out)

    counted = stretches.join(_entries(stretches, stretch, max_chars, max_items).hint("merge"), ["__k", "stretch"]).select("__k", "stretch", opened("sizes", "own", "entry").alias("opened"))
    counted = staged(counted, "packing-opened")
    earlier = Window.partitionBy("__k").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    before = counted.select("__k", "stretch", F.element_at("opened", -1).cast("long").alias("n")).select("__k", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    batches = counted.join(before.hint("merge"), ["__k", "stretch"]).select("__k", "stretch", "before", F.posexplode("opened").alias("i", "n"))
    batches = batches.select("__k", (F.col("stretch") * stretch + F.col("i") + 1).alias("__at"), (F.col("before") + F.col("n") - 1).alias("batch"))
    return placed.join(batches.hint("merge"), ["__k", "__at"]).select(*items.columns, "batch")


def batch_stats(packed: DataFrame, keys: list[str], length: str, done: str) -> DataFrame:
    """keys + batches, items, chars, completed and ratio: how far each sequence of batches is; a batch is completed when all its items are (null: not)."""
    size = F.greatest(F.lit(1), F.coalesce(F.col(length), F.lit(1))).cast("long")
    each = packed.groupBy(*keys, "batch").agg(F.count(F.lit(1)).alias("items"), F.sum(size).alias("chars"), F.bool_and(F.coalesce(F.col(done), F.lit(False))).alias("whole"))
    out = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("batches"), F.sum("items").alias("items"), F.sum("chars").alias("chars"), F.count_if("whole").alias("completed"))
    return out.withColumn("ratio", F.col("completed") / F.col("batches"))
