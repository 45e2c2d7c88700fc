"""Runs of periodic words by recompression.

A run is a stretch of words with smallest period q, at least ``floor`` words and ``4 * q`` long, that no neighbouring word extends keeping the period.

1. Grid: a run of period p covers four places in a row among 0, p, 2p, ..., which have the same word, and so have the places half a period
   further. Over all p up to n/4 that is a harmonic sum, n log n places at most, which are compared as arrays.
2. Grammar: the words of the documents with such places are recompressed, all of a batch at once: blocks of an equal symbol become one
   symbol, then pairs whose first symbol falls to the left and second to the right half of the alphabet, and so on in turn. Equal stretches are
   parsed alike but for their rims, so that equal symbols have equal words and the longest common extension of two places
   is found by climbing while both are at the rim of their parents and descending where they differ. A symbol that closes each document is met once.
3. Extension: for the first of a period's places on the grid the grammar gives how far the words repeat at that distance in both directions, exactly.
   Places inside the run are done; the rest is asked for again. Of periods with the same extent the smallest is the run's.

Memory: about ``batch_words`` words at a time, or one document if it is longer (some 200 bytes a word). Nulls: a null text has no words and no
run; null and repeated ids are carried through, repeated rows are reported each. Empty tables give an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
ARROW_RUN = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_GRIDS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def words(text: Column) -> Column:
    """The words of a text, between ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def grid(n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) for places that are multiples of their period with three more after them below ``n``, periods ``low`` to ``high`` - 1."""
    period = np.arange(low, min(high, n // 4 + 1))
    many = np.maximum((n - 1) // period - 2, 0)
    p = np.repeat(period, many)
    return (np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)) * p, p


def suspects(w: np.ndarray, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The places of the grid over the word ids ``w`` that a run may cover, by period and place."""
    n, found, low = len(w), [], 1
    small = n <= 4096
    if small:
        size = -(-n // 64) * 64
        if size not in _GRIDS:
            _GRIDS[size] = grid(size, 1, size)
    while low <= n // 4:
        high = n if small else low + max(1, block * low // n)
        at, p = _GRIDS[size] if small else grid(n, low, high)
        if small:
            inside = at + 3 * p < n
            at, p = at[inside], p[inside]
        for shift in (0, 1, 2):
            same = w[at + shift * p] == w[at + (shift + 1) * p]
            at, p = at[same], p[same]
        half = p // 2
        same = (w[at + half] == w[at + half + p]) & (w[at + half + p] == w[at + half + 2 * p])
        found.append((at[same], p[same]))
        low = high
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Grammar:
    """Recompression of ``symbols``; those from ``ends`` on close the documents and occur once each, the first and the last of all among them.

    The nodes of all levels lie in flat arrays, level after level: symbol, words spanned, parent, first child, and whether the
    parent is a block.
    """

    def __init__(self, symbols: np.ndarray, ends: int):
        cur, size, begin = symbols.astype(np.int64), np.ones(len(symbols), np.int64), np.full(len(symbols), -1, np.int64)
        closed = fresh = int(cur.max()) + 1
        documents, base, level = closed - ends, 0, 0
        syms, spans, firsts, parents, blocky = [], [], [], [], []
        while True:
            syms.append(cur), spans.append(size), firsts.append(begin)
            if len(cur) <= 3 * documents or level == 400:
                break
            block = level % 2 == 0
            head = np.ones(len(cur), bool)
            if block:
                head[1:] = cur[1:] != cur[:-1]
            else:
                half = ((cur.astype(np.uint64) + np.uint64(level * 7919 + 1)) * _ODD >> np.uint64(45)) & np.uint64(1)
                free = (cur < ends) | (cur >= closed)
                head[1:] = ~((half[:-1] == 0) & (half[1:] == 1) & free[:-1] & free[1:])
            at = np.flatnonzero(head)
            many = np.diff(at, append=len(cur))
            parents.append(base + len(cur) + np.cumsum(head) - 1)
            blocky.append(np.full(len(cur), block))
            merged, name = many > 1, cur[at]
            where = at[merged]
            keys, inverse = np.unique(cur[where] * (len(cur) + 1) + many[merged] if block else cur[where] * fresh + cur[where + 1], return_inverse=True)
            name[merged] = fresh + inverse
            fresh += len(keys)
            begin, size = base + at, np.add.reduceat(size, at)
            base, cur, level = base + len(cur), name, level + 1
        parents.append(np.full(len(cur), base + len(cur)))  # of the top: a node that has no child
        blocky.append(np.zeros(len(cur), bool))
        small = lambda parts, *more: np.concatenate([*parts, np.array(more, np.int64)]).astype(np.int32)
        self.sym, self.span, self.parent, self.first, self.blocky = small(syms), small(spans), small(parents), small(firsts, -2, -2), np.concatenate(blocky)

    def extension(self, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """How many words from x and y on are equal, going forward (step 1) or backward (-1)."""
        got, who, down = np.zeros(len(x), np.int64), np.arange(len(x)), np.zeros(len(x), bool)
        x, y, first = x.astype(np.int64), y.astype(np.int64), self.first
        while len(who):
            px, py = self.parent[x], self.parent[y]
            same = self.sym[x] == self.sym[y]
            if step > 0:
                rim, left = (first[px] == x) & (first[py] == y), np.minimum(first[px + 1] - x, first[py + 1] - y)
            else:
                rim, left = (first[px + 1] == x + 1) & (first[py + 1] == y + 1) & (first[px] >= 0), np.minimum(x - first[px], y - first[py]) + 1
            climb = same & ~down & rim
            move = np.where(same & ~climb, np.where(self.blocky[x], left, 1), 0)
            got[who] += move * self.span[x]
            fall = ~same
            below = lambda node: first[node] if step > 0 else first[node + 1] - 1
            nx = np.where(climb, px, np.where(fall, below(x), x + step * move))
            ny = np.where(climb, py, np.where(fall, below(y), y + step * move))
            stay = same | (first[x] >= 0)
            who, x, y, down = who[stay], nx[stay], ny[stay], (down | fall)[stay]
        return got


def runs_of(texts: list[np.ndarray], floor: int = 6, block: int = 1 << 17) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each sequence of word ids, by start and period."""
    hits = [suspects(w) for w in texts]
    use = [i for i, (at, _) in enumerate(hits) if len(at)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not use:
        return out
    ends = max(int(texts[i].max()) for i in use) + 1
    line, offset, at = [np.array([ends])], [], 1
    for k, i in enumerate(use):
        offset.append(at)
        line += [texts[i], np.array([ends + 1 + k])]
        at += len(texts[i]) + 1
    grammar = Grammar(np.concatenate(line), ends)
    doc = np.repeat(np.arange(len(use)), [len(hits[i][0]) for i in use])
    at, p = (np.concatenate([hits[i][x] for i in use]) for x in (0, 1))
    at = at + np.array(offset)[doc]
    best: dict[tuple[int, int, int], int] = {}
    rounds = 0
    while len(at):
        lead = np.ones(len(at), bool)
        if rounds < 8:  # the first place of each document and period
            lead[1:] = (doc[1:] != doc[:-1]) | (p[1:] != p[:-1])
        mine = np.flatnonzero(lead)
        until = np.empty(len(mine), np.int64)
        for a in range(0, len(mine), block):
            some = mine[a : a + block]
            x, y = at[some], at[some] + p[some]
            stop, start = y + grammar.extension(x, y, 1), x - grammar.extension(x - 1, y - 1, -1)
            until[a : a + block] = stop
            long = stop - start >= np.maximum(floor, 4 * p[some])
            for d, s, e, q in zip(doc[some][long].tolist(), start[long].tolist(), stop[long].tolist(), p[some][long].tolist()):
                best[d, s, e] = min(q, best.get((d, s, e), q))
        over = until[np.cumsum(lead) - 1]
        rest = ~lead & (at + 3 * p >= over)
        doc, at, p, rounds = doc[rest], at[rest], p[rest], rounds + 1
    for (d, s, e), q in sorted(best.items(), key=lambda x: (x[0][0], x[0][1], x[1])):
        out[use[d]].append((s - offset[d], e - s, q))
    return out


def _kept(parts: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined."""
    if not runs:
        return b" ".join(parts)
    depth = np.zeros(len(parts) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([parts[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", floor: int = 6, batch_words: int = 1 << 17) -> DataFrame:
    """A row per row of ``docs``: doc_id, runs (array of start, length, period by start, then period), collapsed (the text's words, one space between them,
    without those that repeat a run's first period)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    schema = StructType([rows.schema["doc_id"], StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, a = batch.column(1), 0
            while a < batch.num_rows:
                parts, ids, names, size, b = [], [], defaultdict(count().__next__), 0, a
                while b < batch.num_rows and (b == a or size < batch_words):
                    parts.append((texts[b].as_py() or b"").split())
                    ids.append(np.fromiter(map(names.__getitem__, parts[-1]), np.int64, len(parts[-1])))
                    size, b = size + len(parts[-1]), b + 1
                runs = runs_of(ids, floor)
                listed = pa.array([[dict(zip(RUN.names, map(int, r))) for r in x] for x in runs], ARROW_RUN)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), listed, pa.array(list(map(_kept, parts, runs)), pa.binary()).cast(pa.string())], names=schema.names)
                a = b

    return rows.mapInArrow(search, schema)
