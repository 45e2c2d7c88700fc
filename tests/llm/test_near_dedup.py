"""The near_dedup stage against brute-force Jaccard."""

import random

import corpus_pipeline
from evigraph.llm import neardup

from .test_llm_operators import docs, rows


def slow_near(given):
    """Kept ids by comparing all pairs of 5-word shingle sets."""

    def sets(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    s = {r["doc_id"]: sets(r["text"]) for r in given}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in s:
        for b in s:
            if a < b and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(i for i in s if find(i) == i)


def test_near_dedup_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.near_dedup(spark, table, "")
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == slow_near(rows(table))


def test_near_dedup_chains_and_crowds(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(900)}"
    data, line = [], " ".join(word() for _ in range(40))
    for g in range(6):
        text = [word() for _ in range(rng.choice((30, 80, 200)))]
        for k in range(25):  # each a copy of the one before with a few words changed, so that the ends are far apart
            data.append((g * 100 + k, " ".join(text), "s"))
            text = list(text)
            for _ in range(rng.choice((0, 1, 1, 2))):
                text[rng.randrange(len(text))] = word()
    data += [(700 + i, f"{line} {' '.join(word() for _ in range(rng.choice((2, 6, 12))))}", "s") for i in range(60)]  # a common line
    data += [(800 + i, line + " " * i, "s") for i in range(5)]
    given = docs(spark, data)
    kept = sorted(r["doc_id"] for r in rows(corpus_pipeline.near_dedup(spark, given, "")))
    assert kept == slow_near(rows(given)) and 6 < len(kept) < len(data)
    assert neardup.keep_first(docs(spark, [])).count() == 0


def test_near_dedup_links_through_the_tree(spark, monkeypatch):
    """The first candidates are those of the fingerprints' tree; fingerprints of equal and barely changed sets are near."""
    asked = []
    tree = neardup.links
    monkeypatch.setattr(neardup, "links", lambda nodes, radius, *a: asked.append((nodes.count(), radius)) or tree(nodes, radius, *a))
    text = " ".join(f"w{i}" for i in range(3000))
    given = docs(spark, [(1, text, "s"), (2, text + " end", "s"), (3, text.upper(), "s"), (4, "quite another text about rivers and bridges", "s")])
    assert sorted(r["doc_id"] for r in rows(corpus_pipeline.near_dedup(spark, given, ""))) == [1, 4]
    assert asked == [(len({neardup.fingerprint(neardup.shingles(r["text"])) for r in rows(given)}), neardup.RADIUS)]
    prints = [neardup.fingerprint(neardup.shingles(t)) for t in (text, text + " end")]
    assert ((prints[0] ^ prints[1]) & (2**64 - 1)).bit_count() <= neardup.RADIUS
