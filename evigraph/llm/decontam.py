"""Benchmark decontamination by q-gram lemma filtering.

Texts are lower-cased and white space is collapsed. Every stretch of ``window`` characters of a benchmark
item is a window, one beginning at each character (an item shorter than ``window`` is one window). A window
occurs in a document if some region of it is within ``budget`` edits. By the q-gram lemma such a region
shares at least  w - q + 1 - q * edits  of the window's q-grams on diagonals no further apart than
the edits, so

1. stretches of the document whose q-grams are in the benchmark that densely are found first,
2. of stretches with the same characters around them the first is looked up; items of which no stretch of hits can be extended to a whole window
   within the edits on either side are left out, so that a phrase that many items share costs them one short extension each,
   (a window that occurs has a piece without an edit, and the longest extension goes through it),
3. their hits are counted per item in overlapping diagonal bands (twice as wide as the budget,
   one every budget), and windows that meet the bound are retained,
4. retained regions are verified by banded alignment, from the item's first window on.

No item is left out for its length: one of fewer than ``exact_below`` characters, where a few edits make
another phrase of it, occurs if a document has it word for word (no letter or digit right before or after).

The benchmark is the stated query set. It is held against all documents in blocks of at most ``block_chars``
characters, one block after another: each is broadcast, its result is written, and it is released before the
next one is read. An item longer than ``piece_chars`` is cut into pieces that share ``window`` - 1
characters, so that no window is lost; its pieces are reported each.

Nulls: null texts match nothing, and so do items that are null or blank. Equal items are reported each under their id; a
null item id is reported as null. Ids of any type are carried through unchanged. Repeated documents are
reported each. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..plans.scratch import staged

Q = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 8-gram at each position, by three doublings."""
    h = points.astype(np.uint64)
    for step, mult in ((1, 0x100000001B3), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        if len(h) <= step:
            return h[:0]
        h = (h[:-step] * np.uint64(mult)) ^ (h[step:] * _MIX)
        h ^= h >> np.uint64(29)
    return h


def slice_hashes(points: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of points[b : b + length] for each b of ``begin``, which may reach over the ends: two overlapping
    stretches of a power of two, each hashed by doublings."""
    pad = np.full(length, 0xFFFFFFFF, np.uint64)
    h, step = np.concatenate([pad, points.astype(np.uint64), pad]), 1
    while 2 * step <= length:
        h = (h[:-step] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[step:] * _MIX)
        h ^= h >> np.uint64(29)
        step *= 2
    at = np.clip(begin + length, 0, len(h) - 1)
    return h[at] * np.uint64(0x100000001B3) ^ h[np.clip(at + length - step, 0, len(h) - 1)] * np.uint64(0x165667B19E3779F9)


def banded_edits(pattern: np.ndarray, starts: np.ndarray, w: int, text: np.ndarray, low: np.ndarray, width: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Banded alignment of many candidates at once.

    Candidate j aligns pattern[starts[j] : starts[j] + w] with a region of ``text`` that begins at
    low[j] + d, on the ``width`` diagonals d. Returns the fewest edits (above ``limit``: big) and
    where the region begins. Candidates that are already above the limit are dropped on the way.
    """
    big, pad = 1 << 20, width + w + 1
    padded = np.concatenate([np.full(pad, 0xFFFFFFFF, np.uint32), text, np.full(pad, 0xFFFFFFFF, np.uint32)])
    best, where = np.full(len(starts), big), np.zeros(len(starts), np.int64)
    live, ramp = np.arange(len(starts)), np.arange(width)
    base = np.clip(low, -pad + 1, len(text)) + pad
    cost = np.zeros((len(live), width), np.int64)
    origin = np.broadcast_to(ramp, cost.shape).copy()
    edge = np.full((len(live), 1), big)
    for i in range(w):
        move = cost + (padded[base[live][:, None] + ramp + i] != pattern[starts[live] + i][:, None])
        drop = np.concatenate([cost[:, 1:] + 1, edge[: len(live)]], axis=1)  # the pattern's character is left out
        pick = drop < move
        run = np.where(pick, drop, move) - ramp
        origin = np.where(pick, np.concatenate([origin[:, 1:], origin[:, :1]], axis=1), origin)
        least = np.minimum.accumulate(run, axis=1)  # text characters left over: one edit for each diagonal further
        source = np.maximum.accumulate(np.where(run == least, ramp, 0), axis=1)
        cost, origin = least + ramp, np.take_along_axis(origin, source, axis=1)
        if i % 4 == 3 or i == w - 1:
            stay = cost.min(axis=1) <= limit
            if not stay.all():
                live, cost, origin = live[stay], cost[stay], origin[stay]
            if not len(live):
                break
    if len(live):
        end = cost.argmin(axis=1)
        best[live] = cost[np.arange(len(live)), end]
        where[live] = np.maximum(0, low[live] + origin[np.arange(len(live)), end])
    return best, where


def extensions(pattern: np.ndarray, at: np.ndarray, room: np.ndarray, text: np.ndarray, place: np.ndarray, edits: int, step: int) -> np.ndarray:
    """How many characters of a pattern can be aligned with the text, by the number of edits: row k is for k edits.

    Candidate j goes from pattern[at[j]] and text[place[j]] on in the direction of ``step``, over ``room[j]`` characters at most. On each diagonal the
    furthest place is kept and equal characters are passed for nothing.
    """
    n, ramp = len(at), np.arange(-edits, edits + 1)
    reach = np.full((n, 2 * edits + 1), -edits - 2)
    reach[:, edits] = 0
    out = np.zeros((edits + 1, n), np.int64)
    for k in range(edits + 1):
        if k:
            wide = np.pad(reach, ((0, 0), (1, 1)), constant_values=-edits - 2)
            reach = np.maximum(np.maximum(wide[:, :-2], wide[:, 1:-1] + 1), wide[:, 2:] + 1)
            reach = np.minimum(reach, room[:, None])
        who, d = np.nonzero(reach >= 0)
        while len(who):
            x = reach[who, d]
            y = place[who] + step * (x + ramp[d])
            same = (x < room[who]) & (y >= 0) & (y < len(text))
            who, d, x, y = who[same], d[same], x[same], y[same]
            same = pattern[at[who] + step * x] == text[y]
            who, d = who[same], d[same]
            reach[who, d] += 1
        out[k] = np.maximum(reach.max(axis=1), 0)
    return out


class BenchmarkIndex:
    """The windows and q-grams of some items: (key, text, place of the text in its item)."""

    def __init__(self, items: list[tuple], window: int = 80, budget: float = 0.075, exact_below: int = 40):
        self.items, self.short = [], {}
        for key, text, offset in items:
            text = normalise(text)
            if len(text) < max(exact_below, Q) and not offset:
                if text:
                    self.short.setdefault(text, []).append(key)
                continue
            points = code_points(text)
            w = min(window, len(points))
            edits = min(int(budget * w), (w - Q) // Q)
            self.items.append((key, points, w, edits, w - Q + 1 - Q * edits, offset))
        hashes = [gram_hashes(x[1]) for x in self.items]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.concatenate([np.full(len(h), i, np.int32) for i, h in enumerate(hashes)]) if hashes else np.zeros(0, np.int32)
        place = np.concatenate([np.arange(len(h), dtype=np.int32) for h in hashes]) if hashes else np.zeros(0, np.int32)
        order = np.argsort(every, kind="stable")
        self.hashes, self.owner, self.place = every[order], owner[order], place[order]
        self.bits = max(16, min(24, int(math.log2(len(every) + 1)) + 5))
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[(self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.flat = np.concatenate([x[1] for x in self.items]) if self.items else np.zeros(0, np.uint32)
        self.begin = np.cumsum([0, *[len(x[1]) for x in self.items]])
        self.w, self.edits, self.need = (np.array([x[i] for x in self.items], np.int64) for i in (2, 3, 4))
        self.least = min((x[4] for x in self.items), default=0)
        self.reach = max((x[2] + x[3] for x in self.items), default=0)
        self._words = None

    def find(self, text: str | None, any_one: bool = False) -> list[tuple]:
        """(key, window start, document start, edits): for each item its first window that occurs, where it does first.
        With ``any_one`` the search ends at the first item found."""
        line = normalise(text)
        if not line:
            return []
        out = self._exact(line)
        if out and any_one:
            return out
        return out + [(self.items[k][0], self.items[k][5] + s, *rest) for k, (s, *rest) in sorted(self._similar(line, any_one).items())]

    def _exact(self, line: str) -> list[tuple]:
        if not self.short:
            return []
        if self._words is None:  # in the worker that needs it
            self._words = ahocorasick.Automaton()
            for t in self.short:
                self._words.add_word(t, t)
            self._words.make_automaton()
        seen: dict[str, int] = {}
        for end, t in self._words.iter(line):
            begin = end + 1 - len(t)
            if t not in seen and not line[begin - 1 : begin].isalnum() and not line[end + 1 : end + 2].isalnum():
                seen[t] = begin
        return [(key, 0, begin, 0) for t, begin in seen.items() for key in self.short[t]]

    def _similar(self, line: str, any_one: bool) -> dict[int, tuple[int, int, int]]:
        found: dict[int, tuple[int, int, int]] = {}
        if not self.items or len(line) < Q:
            return found
        points = code_points(line)
        hashes = gram_hashes(points)
        hit = np.flatnonzero(self.filter[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)])
        if len(hit) < self.least:
            return found
        if self.least > 1:  # hits with enough others within reach, before or after
            n = self.least - 1
            close = hit[n:] - hit[:-n] <= self.reach
            mark = np.zeros(len(hit) + 1, np.int64)
            first = np.flatnonzero(close)
            np.add.at(mark, first, 1)
            np.add.at(mark, first + n + 1, -1)
            hit = hit[np.cumsum(mark[:-1]) > 0]
        if len(hit) > 2 * self.reach:  # repeated characters: of places with the same ones as far as an alignment reaches, the first
            around = slice_hashes(points, hit - self.reach, 2 * self.reach + Q)
            hit = np.sort(hit[np.unique(around, return_index=True)[1]])
        failed: dict[int, np.ndarray] = {}  # item -> hashes of what was aligned in vain
        size = 1 << 14
        i = 0
        while i < len(hit) and not (found and any_one):  # in pieces, each with what lies within reach beyond its end
            j = int(np.searchsorted(hit, hit[i] + size + 2 * self.reach))
            self._piece(points, hashes, hit[i:j], found, failed, any_one)
            i = int(np.searchsorted(hit, hit[i] + size))
        return found

    def _piece(self, points: np.ndarray, hashes: np.ndarray, hit: np.ndarray, found: dict[int, tuple[int, int, int]], failed: dict[int, np.ndarray], any_one: bool) -> None:
        left, right = np.searchsorted(self.hashes, hashes[hit]), np.searchsorted(self.hashes, hashes[hit], side="right")
        n = right - left
        if n.sum() < self.least:
            return
        where = np.repeat(hit, n)
        entry = np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        owner, place = self.owner[entry], self.place[entry].astype(np.int64)
        order = np.lexsort((place, where - place, owner))
        where, owner, place = where[order], owner[order], place[order]
        keep = self._may_fit(points, where, owner, place)[owner]
        where, owner, place = where[keep], owner[keep], place[keep]
        if not len(owner):
            return
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(owner)]):
            _, pattern, w, edits, need, _ = self.items[owner[a]]
            if b - a < need:
                continue
            step, k = max(1, edits), int(owner[a])
            tried = [self._retained(where[a:b] - place[a:b], place[a:b], shift, step, len(pattern) - w + 1, w - Q, need) for shift in (0, 1)]
            begin, low = (np.concatenate(x) for x in zip(*tried))
            if k in found:
                low, begin = low[begin <= found[k][0]], begin[begin <= found[k][0]]
            order = np.lexsort((low, begin))
            begin, low = begin[order], low[order]
            width, keys = 2 * (step + edits), np.zeros(0, np.uint64)
            if len(begin) > 256:  # repeated lines: the same window against the same characters is aligned once
                keys = slice_hashes(points, begin + low - edits, w + width) + begin.astype(np.uint64) * _MIX
                first = np.sort(np.unique(keys, return_index=True)[1])
                if k in failed:
                    first = first[~np.isin(keys[first], failed[k])]
                begin, low, keys = begin[first], low[first], keys[first]
            j, size = 0, 16
            while j < len(begin):  # whole window starts at a time; the first that occurs ends the search
                end = int(np.searchsorted(begin, begin[min(j + size, len(begin)) - 1], side="right"))
                s, d = begin[j:end], low[j:end] - edits
                cost, at = banded_edits(pattern, s, w, points, s + d, width, edits)
                hits = np.flatnonzero(cost <= edits)
                if len(hits):
                    got = min((int(s[x]), int(at[x]), int(cost[x])) for x in hits)
                    found[k] = min(got, found.get(k, got))
                    break
                j, size = end, min(2 * size, 4096)
            failed[k] = np.concatenate([failed.get(k, keys[:0]), keys[:j]])
            if any_one and found:
                return

    def _may_fit(self, points: np.ndarray, where: np.ndarray, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
        """For each item whether a stretch of its hits (sorted by owner, diagonal and place) extends to a window within the edits."""
        fits = np.zeros(len(self.items), bool)
        new = np.ones(len(where), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1) | (where[1:] != where[:-1] + 1)
        first = np.flatnonzero(new)
        length = np.diff(first, append=len(where))
        enough = (np.bincount(owner, minlength=len(self.items)) >= self.need)[owner[first]]
        long = enough & (length >= np.maximum(1, self.w[owner[first]] // (self.edits[owner[first]] + 1) - Q + 1))  # a piece without an edit
        first, length = first[long], length[long] + Q - 1
        own = owner[first]
        for edits in np.unique(self.edits[own]):
            for j in np.array_split(np.flatnonzero(self.edits[own] == edits), max(1, len(own) >> 15)):
                k, x, y = own[j], place[first[j]], where[first[j]]
                end, size = x + length[j], self.begin[k + 1] - self.begin[k]
                right = extensions(self.flat, self.begin[k] + end, np.minimum(size - end, self.w[k]), points, y + length[j], int(edits), 1)
                left = extensions(self.flat, self.begin[k] + x - 1, np.minimum(x, self.w[k]), points, y - 1, int(edits), -1)
                fits[k[(length[j] + (right + left[::-1]).max(axis=0)) >= self.w[k]]] = True
        return fits

    @staticmethod
    def _retained(diagonal: np.ndarray, at: np.ndarray, shift: int, step: int, n_starts: int, span: int, need: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows that meet the bound in a band: (window start, lowest diagonal). Bands are two steps wide; the
        two shifts together begin one at every step."""
        band = (diagonal // step + shift) // 2
        by = np.lexsort((at, band))
        band, at = band[by], at[by]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (band[1:] != band[:-1]) | (at[1:] != at[:-1])
        band, at = band[fresh], at[fresh]
        names, first, count = np.unique(band, return_index=True, return_counts=True)
        begin, low = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for name, i, n in zip(names[count >= need], first[count >= need], count[count >= need]):
            mine = at[i : i + n]
            close = np.flatnonzero(mine[need - 1 :] - mine[: n - need + 1] <= span)  # that many hits fit into one window
            mark = np.zeros(n_starts + 1, np.int64)  # it may begin from where it still holds the last of them up to the first
            np.add.at(mark, np.clip(mine[close + need - 1] - span, 0, n_starts), 1)
            np.add.at(mark, np.minimum(mine[close] + 1, n_starts), -1)
            got = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            begin.append(got)
            low.append(np.full(len(got), (2 * name - shift) * step, np.int64))
        return np.concatenate(begin), np.concatenate(low)


def _pieces(benchmark: DataFrame, id_col: str, text_col: str, window: int, piece_chars: int) -> DataFrame:
    """id, offset, text: normalised items, the very long ones in overlapping pieces; staged."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    schema = StructType([rows.schema["id"], StructField("offset", IntegerType()), rows.schema["text"]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, offsets, texts = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                line = normalise(text)
                for begin in range(0, max(1, len(line) - window + 1), piece_chars - window + 1):
                    at.append(i)
                    offsets.append(begin)
                    texts.append(line[begin : begin + piece_chars])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(offsets, pa.int32()), pa.array(texts, pa.string())], names=schema.names)

    return staged(rows.mapInArrow(cut, schema).filter("text <> ''"), "benchmark-pieces")


def blocks(benchmark: DataFrame, window: int = 80, budget: float = 0.075, exact_below: int = 40, block_chars: int = 4_000_000, piece_chars: int = 100_000, id_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[BenchmarkIndex, pa.Array, bool]]:
    """(index, ids of its keys, whether it is the last), each of about ``block_chars`` characters at most."""
    rows = _pieces(benchmark, id_col, text_col, window, piece_chars)
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = math.ceil(total / block_chars * (1 if total <= block_chars else 1.25))
    for i in range(n):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i) if n > 1 else rows
        got = part.toArrow().combine_chunks()
        items = list(zip(range(got.num_rows), got["text"].to_pylist(), got["offset"].to_pylist()))
        yield BenchmarkIndex(items, window, budget, exact_below), got["id"].combine_chunks() if got.num_rows else pa.array([], got["id"].type), i == n - 1


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", **settings) -> DataFrame:
    """A row for every document and benchmark item of which a window occurs in it: doc_id, item_id, item_start, doc_start,
    edits, the places being those in the normalised texts. More than one block is worked off at once, each result being staged."""
    spark, parts = docs.sparkSession, []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    item_id = benchmark.schema[item_id_col].dataType
    schema = StructType([rows.schema["doc_id"], StructField("item_id", item_id), *[StructField(c, IntegerType()) for c in ("item_start", "doc_start", "edits")]])
    for index, ids, last in blocks(benchmark, id_col=item_id_col, **settings):
        shared = spark.sparkContext.broadcast((index, ids))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held, names = shared.value
            for batch in batches:
                got = [(i, *x) for i, t in enumerate(batch.column(1).to_pylist()) for x in held.find(t)]
                row, key, *places = zip(*got) if got else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), names.take(pa.array(key, pa.int64())), *[pa.array(p, pa.int32()) for p in places]], names=schema.names
                )

        part = rows.mapInArrow(search, schema)
        if not (last and not parts):
            part = staged(part, "leaks")
            shared.destroy()
        parts.append(part)
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """``docs`` without those in which a window of a benchmark item occurs; a null text stays."""
    for index, _, last in blocks(benchmark, **settings):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.filter(~_leaks_in(shared)(F.col(text_col).cast("string")))
        if not last:  # one block in memory at a time
            docs = staged(docs, "decontaminated")
            shared.destroy()
    return docs


def _leaks_in(shared):
    @F.pandas_udf("boolean")
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([bool(shared.value.find(t, any_one=True)) for t in texts], dtype=bool)

    return leaks
