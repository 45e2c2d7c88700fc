"""The language stage on planted junk and on clean texts."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from evigraph.llm import langid

from .test_llm_operators import rows


def test_language_rejects_planted_junk_and_keeps_clean(spark):
    rng = random.Random(3)
    run = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(n))
    latin, cyrillic, greek = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшщыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
    junk = [run(letters, n) for letters in (latin, cyrillic, greek) for n in (5, 40, 300)] + ["bcdfg" * 900, "12 34 !?"]
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = clean.columns
    planted = spark.createDataFrame([(10**9 + i, t, lang, "s0", len(t)) for i, t in enumerate(junk) for lang in ("en",)], "doc_id long, text string, lang string, source string, n_chars int").select(*names)
    unlabelled = planted.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("lang", F.lit(None).cast("string"))
    given = clean.unionByName(planted).unionByName(unlabelled)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, given, "").select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in rows(clean)}


def test_language_keeps_held_out_clean_texts(spark):
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = F.col("doc_id") % 2 == 1
    model = langid.fit(clean.filter(~odd))
    usual = {}
    for r in rows(clean.filter(~odd)):
        lang, _, evidence = model.assess(r["text"])
        usual.setdefault(lang, []).append(evidence)
    held = rows(clean.filter(odd))
    judged = [model.assess(r["text"]) for r in held]
    assert len(held) > 300 and all(e >= sorted(usual[lang])[len(usual[lang]) // 2] / 2 > 0.4 for lang, _, e in judged)


def test_many_languages_and_a_bounded_model(spark):
    data = [(i, " ".join(f"{chr(97 + lang % 26)}{chr(97 + lang // 26)}{'xyz'[(i + k) % 3]}{chr(97 + k)}" for k in range(20)), f"l{lang:04}") for i in range(3) for lang in range(650)]
    table = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(table)
    assert len(model.langs) == 650 and all(model.predict(t)[0] == lang for _, t, lang in data[::97])
    small = langid.fit(table, max_entries=20_000)
    assert sum(len(t.langs) for t in small.tables) <= 20_000 and len(small.langs) > 10
    joined = langid.fit(table, broadcast_langs=0)
    assert joined.langs == model.langs and joined.predict(data[5][1]) == model.predict(data[5][1])


class SlowModel:
    """The posterior by plain dictionaries."""

    def __init__(self, counts):
        self.langs, self.logs = sorted(counts), {}
        for n in range(5):
            per = {x: Counter() for x in self.langs}
            for x in self.langs:
                for w, k in counts[x].items():
                    for g in langid.grams(w, n) if n else [w]:
                        per[x][g] += k
            keys, total = {k for x in self.langs for k in per[x]}, {x: sum(per[x].values()) for x in self.langs}
            self.logs[n] = {k: [math.log(per[x][k] + 0.5) - math.log(total[x] + 0.5 * (len(keys) + 1)) for x in self.langs] for k in keys}

    def shares(self, text):
        score, words = [0.0] * len(self.langs), langid.tokens(text)
        for w in words:
            for n in (0, 4, 3, 2, 1):
                known = [g for g in (langid.grams(w, n) if n else [w]) if g in self.logs[n]]
                if known:
                    score = [s + sum(self.logs[n][g][i] for g in known) / len(known) for i, s in enumerate(score)]
                    break
        score = [s * min(len(words), 30) / len(words) for s in score]
        e = [math.exp(s - max(score)) for s in score]
        return dict(zip(self.langs, (x / sum(e) for x in e)))


def test_scores_against_plain_dictionaries(spark):
    table = rows(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars < 3000"))
    counts = {}
    for lang, text in {(r["lang"], r["text"]) for r in table[::2]}:
        counts.setdefault(lang, Counter()).update(langid.tokens(text))
    plain, model = SlowModel(counts), langid.fit(spark.createDataFrame(table[::2]))
    for text in [r["text"] for r in table[1::4]] + ["zzgrümpf theing", "q", "ñandú"]:
        want, (lang, score) = plain.shares(text), model.predict(text)
        assert abs(score - want[lang]) < 1e-4 and want[lang] >= max(want.values()) - 1e-6


def test_language_keeps_a_small_language(spark):
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    one = spark.createDataFrame([(10**9, "каждый охотник желает знать", "ru"), (10**9 + 1, None, "ru")], clean.schema)
    assert corpus_pipeline.language(spark, clean.unionByName(one), "").filter("lang = 'ru'").count() == 1
