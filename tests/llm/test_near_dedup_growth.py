"""What near_dedup deals and compares grows with the documents, not with the square of a group."""

import random

import corpus_pipeline
from evigraph.llm import neardup, simhash

from .test_llm_operators import docs, rows
from .test_near_dedup import slow_near


def random_prints(n, seed):
    rng = random.Random(seed)
    near = lambda x: x ^ sum(1 << b for b in rng.sample(range(64), rng.choice((3, 7, 8, 9))))
    some = [rng.getrandbits(64) for _ in range(n)]
    some += [near(x) for x in some[: n // 10]]
    return sorted({x - (1 << 64) if x >> 63 else x for x in some})


def test_wide_links_deal_a_fixed_number_of_rows(spark):
    for n in (500, 5000):
        nodes = spark.createDataFrame([(x,) for x in random_prints(n, n)], "fp long")
        assert simhash.by_blocks(nodes, 8, 1 << 18).count() == 9 * nodes.count()


def test_wide_links_equal_brute_force(spark):
    prints = random_prints(600, 3)
    nodes = spark.createDataFrame([(x,) for x in prints], "fp long").repartition(3)
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(prints):
        for y in prints[:i]:
            if ((x ^ y) & (2**64 - 1)).bit_count() <= 8:
                root[find(x)] = find(y)
    want = {}
    for x in prints:
        want.setdefault(find(x), set()).add(x)
    for part_rows in (1 << 18, 4):  # also with values that many have, cut into parts
        got = {}
        for r in simhash.components(simhash.links(nodes, 8, part_rows=part_rows)).collect():
            got.setdefault(r["root"], set()).add(r["fp"])
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_near_dedup_compares_few_pairs_of_a_crowd(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, data = [word() for _ in range(300)], []
    for i in range(240):
        text = list(base)
        for _ in range(rng.choice((2, 3, 3, 4, 4, 4))):
            text[rng.randrange(300)] = word()
        data.append((i, " ".join(text), "s"))
    compared, stage = [], neardup.staged

    def counted(df, name):
        out = stage(df, name)
        if name == "near-pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(neardup, "staged", counted)
    given = docs(spark, data)
    assert sorted(r["doc_id"] for r in rows(corpus_pipeline.near_dedup(spark, given, ""))) == slow_near(rows(given))
    print("compared", compared)
    assert sum(compared) < 25 * len(data)
