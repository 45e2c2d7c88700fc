"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score(x) = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pairwise part is
computed in time linear in the features as half of  sum_f (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2.

Features: words of the whole text hashed into ``buckets`` (log counts, scaled to unit length), one
indicator for each binned structure statistic (shares of upper case, digits, punctuation, white space and
non-ASCII bytes, word length, repetition of words and lines, length) and for each binned metadata column.

Fitting reads about ``max_fit_rows`` labelled rows at most, chosen by a hash of their text, equal ones once, in
one task on an executor; the model (buckets x (rank + 1) numbers) is broadcast. Scoring reads whole texts.

Nulls: a null text is the empty text, which has its own indicators and so a score; a null metadata value has
an indicator of its own; rows with a null label are not learned from. With nothing to learn from the score is
0.5. Repeated rows are scored alike. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 10
STATS = 10
_KIND = np.zeros(256, np.int8)
_KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 4
_KIND[33:48] = _KIND[58:65] = _KIND[91:97] = _KIND[123:127] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 5


def _bin(x: float, top: float) -> int:
    return min(BINS - 1, int(BINS * x / top)) if x > 0 else 0


def features(text: str | None, meta: tuple, buckets: int, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, values): words in [0, buckets), then statistics, then metadata."""
    text = text or ""
    raw = text.encode()
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=6) / max(1, len(raw))
    words = text.lower().split()
    counts = Counter(words)
    lines = text.split("\n")
    n = len(words)
    stats = (
        _bin(kinds[1], 0.5), _bin(kinds[2], 0.25), _bin(kinds[3], 0.25), _bin(kinds[4], 0.5), _bin(kinds[5], 0.4),
        _bin((len(text) / n) if n else 0, 15), _bin(len(counts) / n if n else 0, 1.0001), _bin(len(set(lines)) / len(lines), 1.0001),
        _bin(np.log2(1 + n), 20), _bin(max(counts.values()) / n if n else 0, 0.5),
    )
    index = [buckets + BINS * i + b for i, b in enumerate(stats)]
    for i, m in enumerate(meta):
        known = m is not None and m == m
        index.append(buckets + BINS * STATS + (BINS + 1) * i + (_bin(np.log2(1 + max(0.0, float(m))), 24) if known else BINS))
    hashed: dict[int, int] = {}
    for w, k in counts.items():
        b = cache.get(w)
        if b is None:
            if len(cache) > 500_000:
                cache.clear()
            b = cache[w] = zlib.crc32(w.encode()) % buckets
        hashed[b] = hashed.get(b, 0) + k
    idx = np.fromiter(hashed.keys(), np.int32, len(hashed))
    val = np.log1p(np.fromiter(hashed.values(), np.float32, len(hashed)))
    if len(val):
        val /= np.sqrt((val * val).sum())
    return np.concatenate([idx, np.array(index, np.int32)]), np.concatenate([val, np.full(len(index), 0.3, np.float32)])


class FactorisationMachine:
    def __init__(self, dim: int, rank: int = 8, seed: int = 11, buckets: int | None = None):
        """``buckets``: of the words, for whoever makes features for this machine."""
        rng, self.buckets = np.random.default_rng(seed), buckets
        self.w0, self.w = 0.0, np.zeros(dim, np.float32)
        self.v = (0.05 * rng.standard_normal((dim, rank))).astype(np.float32)

    def margin(self, idx: np.ndarray, val: np.ndarray) -> float:
        vx = self.v[idx] * val[:, None]
        s = vx.sum(axis=0)
        return float(self.w0 + self.w[idx] @ val + 0.5 * ((s * s).sum() - (vx * vx).sum()))

    def score(self, idx: np.ndarray, val: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(idx, val), -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, rate: float = 0.1, decay: float = 1e-5, seed: int = 11) -> None:
        """AdaGrad on the logistic loss, in batches; both labels weigh the same."""
        rng, y = np.random.default_rng(seed), labels.astype(np.float32)
        share = float(y.mean()) if len(y) else 0.5
        if not 0 < share < 1:
            self.w0 = 0.0 if not len(y) else (3.0 if share == 1 else -3.0)
            return
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        gw, gv, g0 = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), 32):
                part = order[i : i + 32]
                idx = np.concatenate([rows[k][0] for k in part])
                val = np.concatenate([rows[k][1] for k in part])
                row = np.repeat(np.arange(len(part)), [len(rows[k][0]) for k in part])
                starts = np.concatenate([[0], np.cumsum([len(rows[k][0]) for k in part])[:-1]])
                vx = self.v[idx] * val[:, None]
                s = np.add.reduceat(vx, starts, axis=0)
                z = self.w0 + np.add.reduceat(self.w[idx] * val, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight[part] / len(part)
                e = err[row] * val
                used, inverse = np.unique(idx, return_inverse=True)
                dw = np.bincount(inverse, e, len(used)).astype(np.float32) + decay * self.w[used]
                each = e[:, None] * (s[row] - vx)
                dv = np.stack([np.bincount(inverse, each[:, f], len(used)) for f in range(each.shape[1])], axis=1).astype(np.float32) + decay * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                g0 += float(err.sum()) ** 2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
                self.w0 -= rate * float(err.sum()) / np.sqrt(g0)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label", meta_cols: tuple[str, ...] = (), buckets: int = 1 << 14, rank: int = 8, max_fit_rows: int = 8000) -> FactorisationMachine:
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"), *[F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(meta_cols)]).filter("label is not null")
    n, span = rows.count(), 1 << 30
    sample = rows.filter(F.pmod(F.xxhash64("text", F.lit(13)), F.lit(span)) < int(span * min(1.0, max_fit_rows / max(1, n)))).distinct()  # a text that fills much of the rows counts once
    dim, metas = buckets + BINS * STATS + (BINS + 1) * len(meta_cols), [f"m{i}" for i in range(len(meta_cols))]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        for b in batches:
            meta = list(zip(*[b[m] for m in metas])) if metas else [()] * len(b)
            got = [features(t, m, buckets, cache) for t, m in zip(b["text"], meta)]
            yield pd.DataFrame({"label": b["label"].to_numpy(), "idx": [x[0] for x in got], "val": [x[1] for x in got]})

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [b for b in batches if len(b)]
        machine = FactorisationMachine(dim, rank)
        if every:
            b = pd.concat(every)
            key = [zlib.crc32(i.tobytes() + v.tobytes()) for i, v in zip(b["idx"], b["val"])]
            b = b.iloc[np.lexsort((b["label"].to_numpy(), key))]  # the order in which rows arrive doesn't matter
            machine.fit([(np.asarray(i, np.int64), np.asarray(v, np.float32)) for i, v in zip(b["idx"], b["val"])], b["label"].to_numpy())
        yield pd.DataFrame({"w0": [float(machine.w0)], "w": [machine.w.tobytes()], "v": [machine.v.tobytes()]})

    encoded = sample.mapInPandas(encode, "label int, idx array<int>, val array<float>")
    got = encoded.repartition(1).mapInPandas(train, "w0 double, w binary, v binary").collect()
    machine = FactorisationMachine(dim, rank, buckets=buckets)
    if got and n:
        machine.w0 = got[0]["w0"]
        machine.w = np.frombuffer(bytes(got[0]["w"]), np.float32)
        machine.v = np.frombuffer(bytes(got[0]["v"]), np.float32).reshape(dim, rank)
    else:
        machine.v = np.zeros_like(machine.v)
    return machine


def score_column(machine: FactorisationMachine, spark, text: Column, *meta: Column) -> Column:
    shared, buckets = spark.sparkContext.broadcast(machine), machine.buckets

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        cache: dict[str, int] = {}
        for columns in batches:
            texts, metas = columns[0], columns[1:]
            meta = list(zip(*metas)) if metas else [()] * len(texts)
            yield pd.Series([shared.value.score(*features(t, m, buckets, cache)) for t, m in zip(texts, meta)], dtype="float64")

    return score(text, *[m.cast("double") for m in meta])
