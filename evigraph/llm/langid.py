"""Language identification with word-first backoff.

The model holds, for each language, the counts of all its words and of their character n-grams. A word that any
language knows is scored by its log frequency in each; an unseen word falls back to its 4-grams, and as long as none of
them is known to 3-, 2- and 1-grams. Words and n-grams are kept by 64-bit hashes with the languages that have them, so the model
grows with what was seen and not with the number of languages.

The model is fitted on a bounded sample of the labelled texts: about ``docs_per_lang`` a language, chosen by a hash of the
text, equal ones once. All words and n-grams of the sample are kept and counted by Spark. If they
are more than ``max_entries`` (22 bytes each, broadcast and held by the driver), the sample is halved until they fit.
Scoring reads whole texts.

``evidence`` says how much of a text its language explains, 0 to 1: a word that at least two of the sampled texts of the
predicted language have counts 1, another word the share of its 4-grams that at least two of them have. So junk does not vouch
for itself.

Nulls: a null text or one without a letter is ``und`` with score 0 and without evidence, and so is everything if there
is nothing to learn from; rows without lang are not learned from. Ties go to the first language in
code-point order. Extra columns are ignored, repeated rows are scored alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..plans.scratch import staged

TOKEN = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
GRAMS = 4
WORD = 0  # the order of whole words
CACHE = 400_000


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    found = TOKEN.findall(text.lower()) if text else []
    if "".join(found).isalpha():
        return found
    return [w for w in found if any(map(str.isalpha, w))]  # numerals such as fractions aren't letters


def grams(word: str, n: int) -> list[str]:
    padded = f"\x02{word}\x03" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _signed(key: str) -> int:
    h = xxh64_intdigest(key.encode())
    return h - (1 << 64) if h >> 63 else h


class _Table:
    """Log frequencies of the keys of one order: rows of (language, what it has over an unseen key), and which are shared by texts."""

    def __init__(self, keys: np.ndarray, langs: np.ndarray, n: np.ndarray, shared: np.ndarray, n_langs: int):
        order = np.lexsort((langs, keys))
        keys, self.langs, n, self.shared = keys[order], langs[order].astype(np.int32), n[order].astype(np.float64), shared[order]
        self.keys, self.first = np.unique(keys, return_index=True)
        self.last = np.append(self.first[1:], len(keys)).astype(np.int64)
        self.gain = (np.log(n + 0.5) - np.log(0.5)).astype(np.float32)
        totals = np.bincount(self.langs, n, n_langs) + 0.5 * (len(self.keys) + 1)
        self.base = np.log(0.5) - np.log(totals)  # the log frequency of a key that a language doesn't have
        self.n_langs = n_langs
        self.pairs = np.repeat(np.arange(len(self.keys)), self.last - self.first) * n_langs + self.langs  # (row, language), ascending
        self.cache: dict[str, int] = {}

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    def find(self, keys: list[str]) -> list[int]:
        """The row of each key, -1 if no language has it."""
        cache, new = self.cache, []
        out = [cache.get(k) for k in keys]
        new = [i for i, x in enumerate(out) if x is None]
        if new and len(self.keys):
            hashes = np.fromiter((_signed(keys[i]) for i in new), np.int64, len(new))
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            at = np.where(self.keys[at] == hashes, at, -1)
            if len(cache) > CACHE:
                cache.clear()
            for i, x in zip(new, at.tolist()):
                out[i] = cache[keys[i]] = x
        return out if len(self.keys) else [-1] * len(keys)

    def score(self, rows: np.ndarray, weight: np.ndarray, n_langs: int) -> np.ndarray:
        """The weighted sum of the rows' log frequencies in each language."""
        size = self.last[rows] - self.first[rows]
        at = np.repeat(self.first[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.langs[at], np.repeat(weight, size) * self.gain[at], n_langs) + weight.sum() * self.base

    def shared_by(self, rows: np.ndarray, lang: int) -> np.ndarray:
        """Whether several texts of a language have the key in each row; rows may be -1."""
        if not len(self.pairs):
            return np.zeros(len(rows), bool)
        want = rows * self.n_langs + lang
        at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        return (rows >= 0) & (self.pairs[at] == want) & self.shared[at]


class LanguageModel:
    """Built from (order, key hash, language, count, number of texts), order 0 being words."""

    def __init__(self, langs: list[str], order: np.ndarray, key: np.ndarray, lang: np.ndarray, n: np.ndarray, texts: np.ndarray):
        self.langs, size = langs, len(langs)
        self.tables = [_Table(key[order == k], lang[order == k], n[order == k], texts[order == k] > 1, size) for k in range(GRAMS + 1)]
        self.explained: dict[int, dict[str, float]] = {}  # language -> word -> how much of it is explained, as met so far

    def __getstate__(self):
        return {**self.__dict__, "explained": {}}

    @classmethod
    def from_counts(cls, counts: dict[str, dict[str, int]]) -> LanguageModel:
        """From language -> word -> count."""
        rows = [(k, _signed(x), i, c) for i, lang in enumerate(sorted(counts)) for w, c in counts[lang].items() for k in range(GRAMS + 1) for x in ([w] if k == WORD else grams(w, k))]
        frame = pd.DataFrame(rows, columns=["order", "key", "lang", "n"]).groupby(["order", "key", "lang"], as_index=False)["n"].sum()
        return cls(sorted(counts), *[frame[c].to_numpy(np.int64) for c in ("order", "key", "lang", "n", "n")])

    def backoff(self, unseen: list[tuple[str, int]]) -> np.ndarray:
        """The score of unseen words with their counts: each word's longest n-grams that any language knows, averaged."""
        score = np.zeros(len(self.langs))
        for n in range(GRAMS, 0, -1):
            parts = [grams(w, n) for w, _ in unseen]
            rows = np.array(self.tables[n].find([g for p in parts for g in p]), np.int64)
            word = np.repeat(np.arange(len(unseen)), [len(p) for p in parts])[rows >= 0]
            known = np.bincount(word, minlength=len(unseen))
            if len(word):
                times = np.array([k for _, k in unseen], np.float64)
                score += self.tables[n].score(rows[rows >= 0], (times / np.maximum(known, 1))[word], len(self.langs))
            unseen = [u for u, k in zip(unseen, known) if not k]
            if not unseen:
                break
        return score

    def assess(self, text: str | None, with_evidence: bool = True) -> tuple[str, float, float | None]:
        """(language, share of the posterior, evidence); the score takes the evidence of 30 words at most."""
        counts = Counter(tokens(text))
        if not counts or not self.langs:
            return UNKNOWN, 0.0, None
        words, times = list(counts), np.fromiter(counts.values(), np.float64, len(counts))
        rows = np.array(self.tables[WORD].find(words), np.int64)
        score = self.tables[WORD].score(rows[rows >= 0], times[rows >= 0], len(self.langs))
        unseen = [(words[i], int(times[i])) for i in np.flatnonzero(rows < 0)]
        for i in range(0, len(unseen), 4096):
            score = score + self.backoff(unseen[i : i + 4096])
        score = score * (min(times.sum(), 30) / times.sum())
        odds = np.exp(score - score.max())
        best = int(np.argmax(odds))
        return self.langs[best], float(odds[best] / odds.sum()), self._evidence(words, times, rows, best) if with_evidence else None

    def _evidence(self, words: list[str], times: np.ndarray, rows: np.ndarray, lang: int) -> float:
        cache = self.explained.setdefault(lang, {})
        got = [cache.get(w) for w in words]
        new = [i for i, x in enumerate(got) if x is None]
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            for j, x in zip(part, self._explained([words[j] for j in part], rows[part], lang)):
                got[j] = cache[words[j]] = x
        if new and sum(map(len, self.explained.values())) > CACHE:
            self.explained.clear()
        return float(np.array(got) @ times / times.sum())

    def _explained(self, words: list[str], rows: np.ndarray, lang: int) -> list[float]:
        """How much of each word its language explains, 0 to 1."""
        got = self.tables[WORD].shared_by(rows, lang).astype(np.float64)
        rest = [i for i in np.flatnonzero(got == 0) if len(words[i]) + 2 >= GRAMS]  # a single letter is known as a word or not at all
        parts = [grams(words[i], GRAMS) for i in rest]
        size = np.array([len(p) for p in parts], np.int64)
        found = np.array(self.tables[GRAMS].find([g for p in parts for g in p]), np.int64)
        if rest:
            got[rest] = np.bincount(np.repeat(np.arange(len(rest)), size), self.tables[GRAMS].shared_by(found, lang), len(rest)) / size
        return got.tolist()

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.assess(text, with_evidence=False)[:2]


def _entries(sample: DataFrame, n_tasks: int) -> DataFrame:
    """(text, lang) -> lang, order, key, n (count), texts (how many have it; words and 4-grams only); staged."""
    dealt = sample.repartition(n_tasks, F.xxhash64("text"))  # by texts, not by their compressed bytes

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                n: Counter = Counter()
                having: Counter = Counter()
                having_part: Counter = Counter()
                for text in texts:
                    mine = Counter(tokens(text))
                    n.update(mine)
                    having.update(mine.keys())
                    having_part.update({g for w in mine for g in grams(w, GRAMS)})
                keys = np.fromiter(map(_signed, n), np.int64, len(n))
                yield pd.DataFrame({"lang": lang, "order": WORD, "key": keys, "n": list(n.values()), "texts": [having[w] for w in n]})
                for k in range(1, GRAMS + 1):
                    part: Counter = Counter()
                    for w, times in n.items():
                        for g in grams(w, k):
                            part[g] += times
                    keys = np.fromiter(map(_signed, part), np.int64, len(part))
                    yield pd.DataFrame({"lang": lang, "order": k, "key": keys, "n": list(part.values()), "texts": [having_part[g] for g in part] if k == GRAMS else 0})

    counted = dealt.mapInPandas(count, "lang string, order int, key long, n long, texts long")
    return staged(counted.groupBy("lang", "order", "key").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")), "language-entries")


def fit(labelled: DataFrame, docs_per_lang: int = 5000, max_entries: int = 8_000_000, text_col: str = "text", lang_col: str = "lang", docs_per_task: int = 500, broadcast_langs: int = 100_000) -> LanguageModel:
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    sizes = staged(rows.groupBy("lang").count(), "language-sizes")
    span = 1 << 30
    n_langs = sizes.count()
    if not n_langs:
        return LanguageModel([], *[np.zeros(0, np.int64)] * 5)
    upto = sizes.select("lang", (F.least(F.lit(1.0), F.lit(docs_per_lang) / F.col("count")) * span).cast("long").alias("upto"))
    shares = F.broadcast(upto) if n_langs <= broadcast_langs else upto.hint("merge")
    some = rows.join(shares, "lang").filter(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(span)) < F.col("upto")).select("text", "lang")
    sample = staged(some.distinct(), "language-sample")  # a text that fills much of the rows is there once
    n, halved = sample.count(), 0
    while True:
        entries = _entries(sample.filter(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << halved)) == 0) if halved else sample, max(1, math.ceil(n / docs_per_task)))
        if entries.count() <= max_entries:
            break
        halved, n = halved + 1, n // 2
    got = entries.toArrow()
    if not got.num_rows:
        return LanguageModel([], *[np.zeros(0, np.int64)] * 5)
    names = got["lang"].combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    code = {x: i for i, x in enumerate(langs)}
    lang = np.array([code[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
    return LanguageModel(langs, got["order"].to_numpy(), got["key"].to_numpy(), lang, got["n"].to_numpy(), got["texts"].to_numpy())


def predict_column(model: LanguageModel, text: Column, spark, with_evidence: bool = False) -> Column:
    """struct(lang string, score double, evidence double)"""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, evidence double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.assess(t, with_evidence) for t in texts], columns=["lang", "score", "evidence"]).astype({"evidence": "float64"})

    return predict(text)


def keep_known(docs: DataFrame, share: float = 0.5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without those that the operator rejects: texts without a letter, and texts whose evidence in their predicted language is
    less than ``share`` of the median of all documents with that prediction.

    A language whose own texts share nothing sets no bar. Without a labelled text nothing can be told apart, and texts with a letter stay.
    Repeated rows are judged alike; the columns of ``docs`` pass through whatever their names.
    """
    spark = docs.sparkSession
    model = fit(docs, text_col=text_col, lang_col=lang_col)
    if not model.langs:
        return docs.filter(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    judged = staged(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), predict_column(model, F.col(text_col), spark, True).alias("p")), "language-judged")
    bars = judged.filter("p.evidence is not null").groupBy(F.col("p.lang").alias("bar_of")).agg((F.median(F.round("p.evidence", 3)) * share).alias("bar"))
    bars = staged(bars, "language-bars")
    side = F.broadcast(bars) if bars.count() <= 10_000 else bars.hint("merge")  # a row for each language of the model at most
    return judged.join(side, F.col("p.lang") == F.col("bar_of")).filter("p.evidence >= bar").select("row.*")
