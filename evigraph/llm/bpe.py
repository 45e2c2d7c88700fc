"""Byte-level BPE encoding of texts in overlapping chunks, and decoding.

A text of up to ``chunk_chars`` characters is encoded where it lies. A longer one is cut into chunks that reach ``overlap`` characters into
the next one:

1. each chunk is pre-tokenised by itself, in parallel; a chunk that begins within a pre-token has wrong boundaries at first,
2. of two neighbours the first boundary that both have where they overlap is where they run in step; a pattern that looks ahead only
   makes them agree from there on, and since the first chunk begins rightly, all later ones are right from their meeting points on,
3. where neighbours don't meet, a pre-token or several are longer than the overlap: such chunks are joined and
   the step is repeated with what they make (a pre-token is encoded whole in any case),
4. the pieces between meeting points are encoded, each with its own chunk.

Boundaries closer than ``LOOK`` characters to where a chunk was cut are not taken: no alternative of the patterns looks further ahead. Decoding looks
the bytes of the ids up and concatenates them. No special tokens; the ranks are a parameter, read on the driver and broadcast: a vocabulary of
at most ``MOST_RANKS`` entries.

Nulls: a null text counts as empty and has no ids, as one piece. Ids of documents may be null or repeat and are carried through; repeated rows
are encoded each. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..plans.scratch import staged

LOOK = 4
MOST_RANKS = 1_000_000
IDS = pa.list_(pa.int32())


class Coder:
    """A vocabulary of ranks and its pre-token pattern, which must look ahead only, by at most ``LOOK`` characters beyond a match."""

    def __init__(self, path: str, pattern: str, cached: int = 500_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if len(self.ranks) > MOST_RANKS:
            raise ValueError(f"{len(self.ranks)} ranks are more than are broadcast")
        self.pattern, self.cached = pattern, cached
        self._ready()

    def __getstate__(self):
        return self.ranks, self.pattern, self.cached

    def __setstate__(self, state):
        self.ranks, self.pattern, self.cached = state
        self._ready()

    def _ready(self) -> None:
        self.tokens = self.encoding = None
        self.known: dict[str, bytes] = {}
        self.bytes = {rank: token for token, rank in self.ranks.items()}

    def pretokens(self, text: str) -> list[str]:
        self.tokens = self.tokens or regex.compile(self.pattern)
        return self.tokens.findall(text)

    def ids(self, pretokens: list[str]) -> np.ndarray:
        """The ids of pre-tokens; each is merged by itself, what has been met is looked up."""
        if self.encoding is None:
            import tiktoken

            self.encoding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        if len(self.known) > self.cached:
            self.known.clear()
        known, merge = self.known, self.encoding.encode_ordinary
        for new in set(pretokens).difference(known):
            known[new] = np.array(merge(new), np.int32).tobytes()
        return np.frombuffer(b"".join(map(known.__getitem__, pretokens)), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def _arrays(ids: pa.Array) -> Iterator[np.ndarray]:
    flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *ids.value_lengths().to_numpy(zero_copy_only=False)])
    return (flat[a:b] for a, b in zip(ends[:-1], ends[1:]))


def encode_column(shared, text: Column) -> Column:
    """array<int>: the ids of whole texts; ``shared`` is the broadcast coder."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        coder = shared.value
        return _lists([coder.ids(coder.pretokens(t or "")) for t in texts.to_pylist()])

    return ids(text)


def decode_column(shared, ids: Column) -> Column:
    """binary: the bytes of ids (null for null)."""

    @F.arrow_udf("binary")
    def raw(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else shared.value.decode(np.array(x, np.int32)) for x in lists.to_pylist()], pa.binary())

    return raw(ids)


def _chunks(docs: DataFrame, chunk_chars: int, overlap: int) -> DataFrame:
    """(row, doc_id, text) -> row, doc_id, start, stop, whole (nothing was cut at the end), text from start to stop and the overlap."""
    schema = StructType([
        docs.schema["row"], docs.schema["doc_id"], StructField("start", LongType()), StructField("stop", LongType()), StructField("whole", BooleanType()), StructField("text", StringType()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                starts = range(0, len(text), chunk_chars)
                for j in range(0, len(starts), 256):  # a bounded number at a time
                    some = starts[j : j + 256]
                    at = pa.array([i] * len(some), pa.int64())
                    stops = [min(s + chunk_chars, len(text)) for s in some]
                    rows = [pa.array(some, pa.int64()), pa.array(stops, pa.int64()), pa.array([e + overlap >= len(text) for e in stops]), pa.array([text[s : e + overlap] for s, e in zip(some, stops)], pa.string())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *rows], names=schema.names)

    return docs.mapInArrow(cut, schema)


def _marks(chunks: DataFrame, shared, overlap: int) -> DataFrame:
    """row, start, stop, head and tail: the sure boundaries of a chunk where it overlaps the one before and the one after."""
    schema = StructType([*[chunks.schema[c] for c in ("row", "start", "stop")], StructField("head", ArrayType(LongType())), StructField("tail", ArrayType(LongType()))])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for start, stop, whole, text in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3, 4)]):
                ends = start + np.fromiter(accumulate(map(len, shared.value.pretokens(text)), initial=0), np.int64)
                sure = ends if whole else ends[ends <= start + len(text) - LOOK]
                heads.append(sure[sure <= start + overlap])
                tails.append(sure[(sure >= stop) & (sure <= stop + overlap)])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (0, 1, 2)], pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=schema.names)

    return chunks.select("row", "start", "stop", "whole", "text").mapInArrow(mark, schema)


def _joined(chunks: DataFrame, meets: DataFrame) -> DataFrame:
    """The chunks of texts in which neighbours don't meet, those neighbours made one."""
    bad = meets.filter("meet is null").select("row").distinct()
    open_ = meets.join(bad.hint("merge"), "row", "left_semi")
    so_far = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = open_.select("row", "start", F.sum(F.when(F.col("meet").isNull(), 0).otherwise(1)).over(so_far).alias("part"))  # a text's few numbers, not the text
    parts = chunks.join(named.hint("merge"), ["row", "start"]).groupBy("row", "part").agg(
        F.max("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.max(F.struct("start", "whole")).alias("last"),
        F.array_sort(F.collect_list(F.struct("start", "stop", "text"))).alias("all"),
    )
    cores = F.transform("all", lambda c: F.when(c["stop"] == F.col("stop"), c["text"]).otherwise(F.substring(c["text"], F.lit(1), (c["stop"] - c["start"]).cast("int"))))
    return parts.select("row", "doc_id", "start", "stop", F.col("last.whole").alias("whole"), F.array_join(cores, "").alias("text"))


def _pieces(chunks: DataFrame, meets: DataFrame, shared) -> DataFrame:
    """doc_id, row, start, ids of the pieces between the meeting points."""
    begins = meets.select("row", "start", F.col("meet").alias("begin"))
    ends = meets.filter("start > 0").select("row", F.col("start").alias("stop"), F.col("meet").alias("end"))
    mine = chunks.join(begins.hint("merge"), ["row", "start"]).join(ends.hint("merge"), ["row", "stop"], "left")
    schema = StructType([chunks.schema["doc_id"], chunks.schema["row"], StructField("start", LongType()), StructField("ids", ArrayType(IntegerType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder, out = shared.value, []
            for start, begin, end, text in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4, 5)]):
                if end is None:
                    out.append(coder.ids(coder.pretokens(text[begin - start :])))
                    continue
                tokens = coder.pretokens(text[begin - start : end - start + LOOK])
                n = list(accumulate(map(len, tokens), initial=begin)).index(end)
                out.append(coder.ids(tokens[:n]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _lists(out)], names=schema.names)

    return mine.select("doc_id", "row", "start", "begin", "end", "text").mapInArrow(encode, schema)


def encode_long(docs: DataFrame, shared, chunk_chars: int, overlap: int) -> DataFrame:
    """(doc_id, text) -> doc_id, row (names a text), start, ids: pieces in the order of their start."""
    if not LOOK < overlap <= chunk_chars:
        raise ValueError("the overlap must be longer than what patterns look ahead and fit into a chunk")
    chunks = staged(_chunks(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), chunk_chars, overlap), "bpe-chunks")
    out = None
    while True:
        # Dealt by chunk: the chunks of a text go to different tasks.
        marks = staged(_marks(chunks.repartition("row", "start"), shared, overlap), "bpe-marks")
        before = marks.select("row", F.col("stop").alias("start"), "tail")
        met = marks.select("row", "start", "head").join(before.hint("merge"), ["row", "start"], "left")
        meet = F.when(F.col("start") == 0, 0).otherwise(F.array_min(F.array_intersect("head", "tail")))
        meets = staged(met.select("row", "start", meet.cast("long").alias("meet")), "bpe-meets")
        bad = meets.filter("meet is null").select("row").distinct()
        done = meets.join(bad.hint("merge"), "row", "left_anti")
        pieces = _pieces(chunks, done, shared)
        out = pieces if out is None else out.unionByName(pieces)
        if bad.isEmpty():
            return out
        chunks = staged(_joined(chunks, meets), "bpe-chunks")


def _split(docs: DataFrame, coder: Coder, chunk_chars: int, overlap: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, object]:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(coder)
    size = F.length("text")
    short = rows.filter(size <= chunk_chars).select("doc_id", encode_column(shared, F.col("text")).alias("ids"))
    return short, encode_long(rows.filter(size > chunk_chars), shared, chunk_chars, overlap), shared


def encode(docs: DataFrame, coder: Coder, chunk_chars: int = 16_384, overlap: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as one or more pieces: doc_id, row (names a long text, null for others), start (its first character), ids."""
    short, long, _ = _split(docs, coder, chunk_chars, overlap, id_col, text_col)
    whole = short.select("doc_id", F.lit(None).cast("long").alias("row"), F.lit(0).cast("long").alias("start"), "ids")
    return whole.unionByName(long)


def digests(docs: DataFrame, coder: Coder, chunk_chars: int = 16_384, overlap: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, n_tokens, ids_sha256 (of the decimal ids with a space between), decoded_sha256 (of the bytes of the ids).

    The pieces of a long text are read in order, one after another, and only the state of the hashes is kept.
    """
    short, long, shared = _split(docs, coder, chunk_chars, overlap, id_col, text_col)
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def line(ids: np.ndarray) -> bytes:
        return " ".join(map(str, ids.tolist())).encode()

    @F.arrow_udf(kind)
    def hashed(lists: pa.Array) -> pa.Array:
        got = [(len(x), hashlib.sha256(line(x)).hexdigest(), hashlib.sha256(shared.value.decode(x)).hexdigest()) for x in _arrays(lists)]
        columns = [pa.array([r[i] for r in got], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
        return pa.StructArray.from_arrays(columns, names=["n_tokens", "ids_sha256", "decoded_sha256"])

    out = short.select("doc_id", hashed("ids").alias("d")).select("doc_id", "d.*")
    names = out.columns

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = state = None

        def closed() -> pa.RecordBatch:
            doc, n, a, b = state
            return pa.RecordBatch.from_arrays([doc, pa.array([n], pa.int64()), pa.array([a.hexdigest()]), pa.array([b.hexdigest()])], names=names)

        for batch in batches:
            for i, ids in enumerate(_arrays(batch.column(3))):
                if batch.column(1)[i].as_py() != row:
                    if state:
                        yield closed()
                    row, state = batch.column(1)[i].as_py(), [batch.column(0).slice(i, 1), 0, hashlib.sha256(), hashlib.sha256()]
                if len(ids):
                    state[2].update((b" " if state[1] else b"") + line(ids))
                    state[3].update(shared.value.decode(ids))
                    state[1] += len(ids)
        if state:
            yield closed()

    in_order = long.repartition("row").sortWithinPartitions("row", "start")
    return out.unionByName(in_order.mapInArrow(follow, out.schema))
