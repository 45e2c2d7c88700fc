"""Runs by recompression against a scan of every period."""

import hashlib
import random
import zlib

import numpy as np
from evigraph.llm import queries, repeats


def brute(w, floor=6):
    out, n = {}, len(w)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(floor, 4 * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_random_sequences_equal_the_scan():
    rng, texts = random.Random(5), []
    for k in range(300):
        n, kinds = rng.randint(0, 130), rng.choice([1, 2, 3, 6])
        w = [rng.randrange(kinds) for _ in range(n)]
        if n > 20 and k % 2:
            s = rng.randrange(n // 2)
            p = rng.randint(1, (n - s) // 4)
            w[s:] = [w[s + i % p] for i in range(n - s)]
            if k % 4 == 1:
                w[rng.randrange(n)] = 99
        texts.append(np.array(w, np.int64))
    assert [[tuple(r) for r in x] for x in repeats.runs_of(texts)] == [brute(list(w)) for w in texts]


def test_long_runs_in_long_texts():
    rng = np.random.default_rng(3)
    w = rng.integers(0, 400, 60_000)
    w[10_000:30_000] = w[10_000 + np.arange(20_000) % 4321]
    w[40_000:40_050] = 7
    got = [tuple(map(int, r)) for r in repeats.runs_of([w, np.zeros(30_000, np.int64)])[0]]
    near = lambda s: [r for r in got if abs(r[0] - s) < 5 and r[1] > 20]
    assert near(10_000)[0][2] == 4321 and near(10_000)[0][1] >= 20_000 and near(40_000)[0][2] == 1
    assert [tuple(map(int, r)) for r in repeats.runs_of([w, np.zeros(30_000, np.int64)])[1]] == [(0, 30_000, 1)]


def test_operator_on_awkward_rows(spark):
    rows = [(1, None, "x"), (None, "", "x"), (2, "a b " * 5, "x"), (2, "a b " * 5, "x"), (3, "  z\tz\nz z\x0bz z  y ", "x"), (4, "one two three", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Runs string")
    got = sorted((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in repeats.find_runs(docs, batch_words=8).collect())
    two = (2, [(0, 10, 2)], "a b")
    assert got == [(0, [], ""), (1, [], ""), two, two, (3, [(0, 6, 1)], "z y"), (4, [], "one two three")]
    assert repeats.find_runs(docs.limit(0)).count() == 0


def test_query_equals_the_scan(spark, sf):
    got = {r["doc_id"]: r for r in queries.op11_runs(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    found = 0
    for doc_id, text in rows:
        w = [x.decode() for x in (text or "").encode().split()]
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        if n > 1500:
            continue
        runs = brute(w)
        found += len(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[doc_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (best[1] * 1000 // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert found > 10
