"""Pairs that share a prefix shingle become candidates only if their sketches allow it, and no similar pair is lost by that."""

import random

import corpus_pipeline
import numpy as np
from evigraph.llm import neardup

from .test_llm_operators import docs, rows
from .test_near_dedup import slow_near


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60, 400, 5000):
        for cut in (0, 1, n // 9, n // 2, n):
            a, new = rng.integers(-(2**63), 2**63, n), rng.integers(-(2**63), 2**63, cut)
            b = np.concatenate([a[cut:], new])
            apart = sum(int(x).bit_count() for x in (neardup.sketch(a) ^ neardup.sketch(b)).view(np.uint64))
            assert apart <= len(set(a.tolist()) ^ set(b.tolist()))
            if cut == n // 2 and 60 <= n <= 400:
                assert 9 * apart > 2 * n  # so that unlike sets are told apart


def test_unlike_texts_that_share_a_passage_are_no_candidates(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(100)]
    data = []
    for i in range(120):  # two words are new, so that any two texts have some two thirds of their shingles in common
        text = list(base)
        for at in rng.sample(range(5), 2):
            text[20 * at + rng.randrange(5, 15)] = word()
        data.append((i, " ".join(text), "s"))
    data += [(1000 + i, data[i][1] + " more", "s") for i in range(0, 120, 10)]
    pairs, stage = [], neardup.staged

    def told(df, name):
        out = stage(df, name)
        if name == "near-candidates":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(neardup, "staged", told)
    given = docs(spark, data)
    assert sorted(r["doc_id"] for r in rows(corpus_pipeline.near_dedup(spark, given, ""))) == slow_near(rows(given))
    print("candidates", pairs)
    assert sum(pairs) < 5 * len(data)  # of 8,646 pairs
