"""Chunked byte-level BPE against the library on whole texts."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from evigraph.llm import bpe, queries

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(PATH, P.PATTERN)


def awkward():
    rng = random.Random(4)
    texts = [None, "", " ", "x", "\n \n  a", "don't we'll 'tis 's'll''ve", "<|endoftext|>", "a" * 900, " " * 700 + "b", "1" * 333 + "é" * 444, "\U0001f600" * 130 + "   z"]
    bits = ["'", "'l", "l", "'re", " ", "  ", "\n", "\t", "a", "Zürich", "漢字", "1", "23", "!", "?!", " ", "\U0001f600", "é", "\r\n", "'" * 9]
    for n in (30, 100, 400, 1500):
        texts += ["".join(rng.choice(bits) for _ in range(n)) for _ in range(12)]
    return texts + ["".join(rng.choice(["ab", "c"]) for _ in range(3000)) + " end", ("w" * 90 + " ") * 20, ("v" * 200 + "1") * 9]


def test_chunks_of_any_text_meet(spark, coder, library):
    texts = awkward()
    docs = spark.createDataFrame([(None if i == 3 else i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, Row int")
    for chunk, overlap in ((64, 32), (200, 8)):
        got: dict = {}
        for r in bpe.encode(docs, coder, chunk_chars=chunk, overlap=overlap).orderBy("start").collect():
            got.setdefault(r["doc_id"], []).extend(r["ids"])
        for i, t in enumerate(texts):
            assert got[None if i == 3 else i] == library.encode_ordinary(t or ""), (chunk, t)
    long = bpe.encode(docs, coder, chunk_chars=64, overlap=32).filter("row is not null").groupBy("row").count().agg({"count": "max"}).first()[0]
    assert long > 20


def test_decoding_gives_the_bytes_back(spark, coder):
    texts = [t or "" for t in awkward()]
    shared = spark.sparkContext.broadcast(coder)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    back = docs.select("doc_id", bpe.decode_column(shared, bpe.encode_column(shared, docs["text"])).alias("raw")).collect()
    assert {r["doc_id"]: bytes(r["raw"]) for r in back} == {i: t.encode() for i, t in enumerate(texts)}


def test_digests_of_pieces_and_of_repeated_rows(spark, coder, library):
    texts = awkward() + ["so " * 200] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, texts[-1])] * 2, "doc_id long, text string")
    rows = bpe.digests(docs, coder, chunk_chars=100, overlap=40).collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = [(i, library.encode_ordinary(t or ""), t or "") for i, t in [*enumerate(texts), (5, texts[-1]), (5, texts[-1])]]
    assert sorted(tuple(r) for r in rows) == sorted((i, len(x), sha(" ".join(map(str, x)).encode()), sha(t.encode())) for i, x, t in want)
    assert bpe.digests(docs.limit(0), coder).count() == 0


def test_a_bad_overlap_is_refused(spark, coder):
    docs = spark.createDataFrame([(1, "a " * 99)], "doc_id long, text string")
    with pytest.raises(ValueError):
        bpe.encode(docs, coder, chunk_chars=10, overlap=20)
    assert np.array_equal(coder.ids([]), np.zeros(0, np.int32))


def test_query_equals_the_library(spark, sf, library):
    got = {r["doc_id"]: r for r in queries.op12_bpe(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids, r = library.encode_ordinary(text or ""), got[doc_id]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
