"""Overlap of texts in linear time, and batches to a model."""

import random
import threading
import time

from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.plans.embedding import embedded


def brute(a, b):
    return max(i for i in range(min(len(a), len(b)) + 1) if a[len(a) - i :] == b[:i])


def test_overlap_is_that_of_all_lengths(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choices("ab", k=rng.randint(0, 40))), "".join(rng.choices("ab", k=rng.randint(0, 40)))) for _ in range(400)]
    pairs += [("x" * 30 + "hällo wörld, hällo wörld", "hällo wörld, hällo wörld again"), ("abc" * 40, "abc" * 50), ("a" * 17, "a" * 17), ("日本" * 20, "本日" * 20)]
    assert all(T.overlap_of(a, b) == brute(a, b) for a, b in pairs)
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([*pairs, ("a", None), (None, "a")])], "i int, a string, b string")
    got = {r["i"]: r["n"] for r in df.select("i", T.overlap(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {i: brute(a, b) for i, (a, b) in enumerate(pairs)} | {len(pairs): 0, len(pairs) + 1: 0}


def test_overlap_of_long_periodic_texts_is_quick():
    for a, b, n in (("a" * 10**6, "a" * 10**6, 10**6), ("a" * 10**6 + "b", "a" * 10**6, 0), ("ab" * 500_000, "b" + "ab" * 500_000, 999_999)):
        began = time.time()
        assert T.overlap_of(a, b) == n and time.time() - began < 2


def rows(spark, n=53):
    return spark.range(n).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("content"), F.lit("x").alias("embed_error")).coalesce(1)


def test_batches_have_their_size_across_borders_and_keep_their_order(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        model = lambda texts: [[len(texts), float(t[1:])] for t in texts]
        got = embedded(rows(spark), model, size=10, workers=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["id"] for r in got] == list(range(53)) and all(r["embed_error"] is None for r in got)
    assert [r["content_vector"] for r in got] == [[10.0 if i < 50 else 3.0, float(i)] for i in range(53)]


def test_a_slow_and_a_failing_batch_leave_nulls_with_a_reason(spark):
    def model(texts):
        if "t10" in texts:
            raise ValueError("no")
        if "t20" in texts:
            threading.Event().wait(5)
        if "t30" in texts:
            return [[1.0]]
        return [[1.0] if t != "t45" else None for t in texts]

    began = time.time()
    got = {r["id"]: (r["content_vector"], r["embed_error"]) for r in embedded(rows(spark), model, size=10, workers=2, seconds=1.0).collect()}
    assert time.time() - began < 30
    assert all(got[i] == (None, "ValueError: no") for i in range(10, 20))
    assert all(got[i] == (None, "deadline") for i in range(20, 30)) and all(got[i] == (None, "1 vectors for 10 texts") for i in range(30, 40))
    assert all(got[i] == ([1.0], None) for i in [*range(10), *range(40, 45), *range(46, 53)]) and got[45] == (None, None)


def test_null_texts_and_no_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "ab")], "id int, content string")
    got = {r["id"]: r["content_vector"] for r in embedded(df, lambda ts: [[len(t)] for t in ts]).collect()}
    assert got == {1: [0.0], 2: [2.0]} and embedded(df.limit(0), lambda ts: []).collect() == []


def test_neighbours_of_queries_in_blocks(spark, monkeypatch):
    from lorewell.operators import vector

    rows = spark.createDataFrame([(i, [float((i * 7) % 11 - 5), float((i * 3) % 5 - 2), 1.0][: 2 + i % 2]) for i in range(60)], "id int, embedding array<double>")
    asked = rows.where("id < 20").selectExpr("id AS query_id", "embedding AS query_vector")
    whole = sorted(map(tuple, vector.knn(rows, asked, 4).collect()))
    monkeypatch.setattr(vector, "BLOCK", 6)
    assert sorted(map(tuple, vector.knn(rows, asked, 4).collect())) == whole and len(whole) == 80
