"""However documents are cut into batches, and whatever batch is replayed, the tables end the same."""

import random

from evigraph.streaming import incremental as I

SCHEMA = "doc_id long, text string, version long"


def rows_of(spark, target):
    return sorted(tuple(r) for r in I.current(spark, target).collect())


def run(spark, target, batches, replay=()):
    I.prepare(spark, target)
    for n, rows in enumerate(batches):
        for _ in range(1 + (n in replay)):
            I.apply(spark.createDataFrame(rows, SCHEMA), n, target)
    return rows_of(spark, target)


def test_any_split_gives_the_same_tables(spark, tmp_path):
    r = random.Random(3)
    words = ["alpha beta", "gamma. " * 300, "delta " * 500, "", None]
    rows = [(d, r.choice(words), v) for d in range(6) for v in range(3)] + [(1, "alpha beta", 2), (2, "same", 7), (2, "same", 8), (None, "no id", 1)]
    want = run(spark, str(tmp_path / "one"), [rows])
    for k in range(2):
        r.shuffle(rows)
        cut = r.randrange(1, len(rows))
        assert run(spark, str(tmp_path / f"split{k}"), [rows[:cut], rows[cut:]], replay=(0, 1)) == want


def test_changed_and_emptied_documents(spark, tmp_path):
    target = str(tmp_path / "t")
    long = "one two three. " * 200
    assert len(run(spark, target, [[(1, long, 1), (2, "x", 1), (3, "y", 1)]])) > 4
    I.apply(spark.createDataFrame([(1, "short", 2), (2, None, 2), (3, "y", 2), (4, "new", 1)], SCHEMA), 1, target)
    assert [(d, c) for d, _, _, c in rows_of(spark, target)] == [("doc-1", 5), ("doc-3", 1), ("doc-4", 3)]
    I.apply(spark.createDataFrame([(1, long, 1)], SCHEMA), 2, target)
    assert len(rows_of(spark, target)) == 3


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for version, text in ((1, "first"), (2, "second text")):
        spark.createDataFrame([(1, text, version), (version + 10, "x", 1)], SCHEMA).write.mode("append").parquet(source)
        I.start(spark, source, spark.read.parquet(source).schema, target, checkpoint).awaitTermination()
    assert [(d, c) for d, _, _, c in rows_of(spark, target)] == [("doc-1", 11), ("doc-11", 1), ("doc-12", 1)]
