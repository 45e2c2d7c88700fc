"""Chat formatting with cumulative-snapshot collapse.

Logs often hold the same conversation again and again, each time a few turns longer. Every turn gets
the rolling hash of the conversation up to it; a conversation whose whole hash is a proper prefix hash of
another one is a snapshot and goes (an anti-join), equal ones collapse to the smallest id, and what remains is
rendered.

Turns are told apart and ordered by (turn, role, digest of the text), so that everything up to the rendering runs on
rows without texts. They are sorted by range over all conversations at once; a conversation's turns in one range are a chunk, so one
with a third of all turns, or many turns with one number, is spread over as many tasks. Positions and the rolling hash, a running XOR of
two independent 64-bit hashes of (position, role, text digest), are summed in two levels: within chunks, then over
a conversation's chunks. Texts are joined back for the kept conversations only. Rendering is cut into parts
0, 1, ... of ``part_turns`` turns; joined in order they are the whole conversation.

Nulls: a null role renders as ``user`` and a null text as the empty text, but both differ from the written value when
conversations are compared; a null turn comes first. Rows repeated in full count once; different rows with one turn number
are ordered by role, then by the MD5 of the text. Rows without conv_id are dropped. Extra columns are ignored. Turn markers inside a role or a text
are broken by a space after their first character, so that no turn can forge another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import staged

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
KEY = ["conv_id", "turn", "role", "digest"]


def _log(log: DataFrame) -> DataFrame:
    rows = log.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).filter("conv_id is not null")
    return rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def positions(log: DataFrame) -> DataFrame:
    """Distinct turns without their texts: conv_id, turn, role, digest, chunk, pos; staged."""
    rows = _log(log).select(*KEY).distinct()
    ranged = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("digest").asc_nulls_first())
    chunked = staged(ranged.withColumn("chunk", F.spark_partition_id()), "chat-chunks")
    sizes = chunked.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    by = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("digest").asc_nulls_first())
    placed = chunked.withColumn("i", F.row_number().over(by)).join(sizes.hint("merge"), ["conv_id", "chunk"])
    return staged(placed.select(*KEY, "chunk", (F.col("i") + F.col("before")).alias("pos")), "chat-positions")


def rolling(turns: DataFrame) -> DataFrame:
    """conv_id, pos, a, b: hashes of the conversation up to each turn; staged."""
    word = lambda salt: F.xxhash64(F.lit(salt), "pos", F.col("role").isNull(), "role", F.col("digest").isNull(), "digest")
    hashed = turns.select("conv_id", "chunk", "pos", word(1).alias("x"), word(2).alias("y"))
    upto = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = hashed.select("conv_id", "chunk", "pos", F.bit_xor("x").over(upto).alias("x"), F.bit_xor("y").over(upto).alias("y"))
    totals = hashed.groupBy("conv_id", "chunk").agg(F.bit_xor("x").alias("tx"), F.bit_xor("y").alias("ty"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(c) for c in ("tx", "ty")])
    whole = run.join(totals.hint("merge"), ["conv_id", "chunk"]).select("conv_id", "pos", F.col("x").bitwiseXOR(F.col("tx")).alias("a"), F.col("y").bitwiseXOR(F.col("ty")).alias("b"))
    return staged(whole, "chat-hashes")


def collapse(turns: DataFrame) -> DataFrame:
    """``positions`` -> conv_id, n_turns, copies of the maximal conversations; ``copies`` counts the equal ones."""
    hashes = rolling(turns)
    lengths = hashes.groupBy("conv_id").agg(F.max(F.struct("pos", "a", "b")).alias("w"))
    whole = lengths.groupBy("w").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")).select("conv_id", "copies", "w.*")
    proper = hashes.join(lengths.select("conv_id", F.col("w.pos").alias("last")).hint("merge"), "conv_id").filter("pos < last").select("pos", "a", "b").distinct()
    return staged(whole.hint("merge").join(proper, ["pos", "a", "b"], "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"), "copies"), "chat-kept")


def _safe(c: Column) -> Column:
    for mark in (OPEN, CLOSE):
        c = F.replace(c, F.lit(mark), F.lit(f"{mark[0]} {mark[1:]}"))
    return c


def render(log: DataFrame, turns: DataFrame, kept: DataFrame, part_turns: int = 256) -> DataFrame:
    """conv_id, part, n_turns, copies, text: a row for each part of the kept conversations."""
    shown = F.concat(F.lit(OPEN), F.coalesce(_safe(F.col("role")), F.lit("user")), F.lit("\n"), F.coalesce(_safe(F.col("text")), F.lit("")), F.lit(f"{CLOSE}\n"))
    wanted = turns.join(kept.hint("merge"), "conv_id").select(*[F.col(c).alias(f"k_{c}") for c in KEY], "pos", "n_turns", "copies")
    same = F.lit(True)
    for c in KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    met = _log(log).join(wanted.hint("merge"), same)
    part = F.floor((F.col("pos") - 1) / part_turns).cast("long").alias("part")
    parts = met.groupBy("conv_id", part, "n_turns", "copies").agg(F.array_sort(F.collect_set(F.struct("pos", shown.alias("s")))).alias("ts"))
    return parts.select("conv_id", "part", "n_turns", "copies", F.array_join(F.col("ts")["s"], "").alias("text"))


def format_chats(log: DataFrame, part_turns: int = 256) -> DataFrame:
    turns = positions(log)
    return render(log, turns, collapse(turns), part_turns)
