"""Decontamination against its definition: every window of every item, every region of every text."""

import random

import numpy as np
import pytest

from evigraph.llm import decontam

from .test_llm_operators import AWKWARD, docs, rows


def occurs(item, text, window=80, budget=0.075):
    """Whether some window of the item is within its edits of some region of the text: all windows at once, column by column."""
    item, text = " ".join(item.lower().split()), " ".join(text.lower().split())
    if not item:
        return False
    if len(item) < 40:
        at = text.find(item)
        while at >= 0:
            if not text[at - 1 : at].isalnum() and not text[at + len(item) : at + len(item) + 1].isalnum():
                return True
            at = text.find(item, at + 1)
        return False
    w = min(window, len(item))
    limit = min(int(budget * w), (w - 8) // 8)
    pattern = np.array([[ord(c) for c in item[s : s + w]] for s in range(len(item) - w + 1)])
    ramp = np.arange(w + 1)
    cost = np.broadcast_to(ramp, (len(pattern), w + 1)).copy()
    for c in map(ord, text):
        new = np.zeros_like(cost)
        new[:, 1:] = np.minimum(cost[:, :-1] + (pattern != c), cost[:, 1:] + 1)
        cost = np.minimum.accumulate(new - ramp, axis=1) + ramp
        if (cost[:, -1] <= limit).any():
            return True
    return False


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        out[i] = rng.choice(("", "q", out[i] + "z"))
    return "".join(out)


def prose(rng, n):
    return " ".join("".join(rng.choice(("the", "an", "or", "ing", "st", "eau", "é")) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randint(9, 30))) for i in range(8)] + [(90, "tiny"), (91, None), (92, "Orst  anor\nx"), (93, " ")]
    texts = []
    for i in range(40):
        item = items[i % 8][1]
        whole = edited(rng, item.upper() if i % 3 else item, i // 5)
        begin = rng.randrange(max(1, len(whole) - 90)) if i % 2 else 0
        texts.append((i, f"{prose(rng, 12)} {whole[begin : begin + rng.choice((60, 76, 80, 95, 400))]}\n\n{prose(rng, 7)}", "s"))
    texts += [(100, prose(rng, 120), "s"), (101, items[2][1] * 5, "s"), (102, "a tiny, orst anor x", "s"), (103, "destiny tinyx anorst anor xy", "s")]
    want = {(d, k) for d, t, _ in texts for k, item in items if item and occurs(item, t)}
    table = spark.createDataFrame(items, "item_id long, text string")
    for size in (4_000_000, 400):
        got = rows(decontam.find_leaks(docs(spark, texts), table, block_chars=size))
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
        kept = {r["doc_id"] for r in rows(decontam.drop_leaks(docs(spark, texts), table, block_chars=size))}
        assert kept == {d for d, _, _ in texts} - {d for d, _ in want}
    assert len(want) > 25 and (102, 90) in want and (102, 92) in want and not any(d == 103 for d, k in want if k > 8)


@pytest.mark.parametrize("size", [80, 81, 90, 120])
def test_every_excerpt_of_a_window_is_found(spark, size):
    items = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    rng = random.Random(size)
    index = decontam.BenchmarkIndex([(i, t, 0) for i, t in enumerate(items)])
    lines = [decontam.normalise(t) for t in items]
    tried = 0
    for i, t in enumerate(lines):
        for begin in rng.sample(range(max(1, len(t) - size + 1)), min(5, max(1, len(t) - size + 1))):
            if len(t) >= size:
                tried += 1
                assert i in {k for k, *_ in index.find(f"wholly unlike words {t[begin : begin + size]} and others again")}
    assert tried > 100


def test_leaks_awkward(spark):
    bench = spark.createDataFrame([(1, None), (None, "one two three four " * 9), (2, "")], "item_id long, text string")
    big = (1 << 60) + 1
    given = docs(spark, AWKWARD + [(9, "x one two three four " * 20000, "s"), (None, "one two three four " * 9, "s"), (big, "one two three four " * 9, "s")])
    got = rows(decontam.find_leaks(given.coalesce(1), bench))
    assert sorted(str(r["doc_id"]) for r in got) == [str(big), "None"] and got[0]["item_id"] is None
    assert {str(r["doc_id"]) for r in rows(given)} - {str(r["doc_id"]) for r in rows(decontam.drop_leaks(given, bench))} == {str(big)}
    assert decontam.find_leaks(docs(spark, []), bench).count() == 0 and decontam.find_leaks(docs(spark, AWKWARD), bench.limit(0)).count() == 0
    assert decontam.drop_leaks(docs(spark, AWKWARD), bench.limit(0)).count() == len(AWKWARD)


def test_ids_of_any_type_and_very_long_items(spark):
    rng = random.Random(9)
    long = prose(rng, 3000)
    bench = spark.createDataFrame([("item/1", long)], "item_id string, text string")
    cut = [decontam.normalise(long)[i : i + 100] for i in (0, 900, 950, 2000, 7777)]
    texts = spark.createDataFrame([(f"doc/{i}", f"none of it {t} either") for i, t in enumerate(cut)] + [("doc/z", prose(rng, 60))], "doc_id string, text string")
    for settings in ({}, {"piece_chars": 1000}, {"piece_chars": 1000, "block_chars": 3000}):
        got = rows(decontam.find_leaks(texts, bench, **settings))
        assert {r["doc_id"] for r in got} == {f"doc/{i}" for i in range(5)} and {r["item_id"] for r in got} == {"item/1"}
        for i, s in enumerate((0, 900, 950, 2000, 7777)):
            assert any(abs(r["item_start"] - s) <= 12 for r in got if r["doc_id"] == f"doc/{i}")


def test_a_phrase_that_many_items_share_is_cheap():
    """3,000 items end in one sentence; texts with that sentence, once and hundreds of times, leak nothing, and quickly."""
    import time

    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz "
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n)).strip()
    shared = "choose the correct answer from the four options that are listed"
    items = [(i, f"{noise(200)} {shared}", 0) for i in range(3000)]
    index = decontam.BenchmarkIndex(items)
    index.find(noise(300))
    for text, most in ((f"{noise(15)} {shared} {noise(15)}", 0.5), (f"{shared}. " * 300, 5.0), (" ".join(f"{noise(20)} {shared}" for _ in range(20)), 10.0)):
        began = time.process_time()
        assert index.find(text) == []
        assert time.process_time() - began < most
    few = decontam.BenchmarkIndex(items[:40])
    leak = f"{noise(60)} {items[7][1][150:]} {noise(9)} {shared}"
    assert [x[0] for x in few.find(leak)] == [7] == [x[0] for x in index.find(leak)]
