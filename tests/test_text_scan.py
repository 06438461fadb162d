"""Full text by a scan against the joins of ``lexical.bm25``."""

from pyspark.sql import functions as F

from lorewell import queries
from lorewell.operators import lexical, text_scan
from lorewell.operators.text_scan import TextScan


def rows_of(df, *more):
    return {(r["query_id"], *[r[c] for c in more], r["id"], r["score"], r["rank"]) for r in df.collect()}


def test_scan_equals_the_joins(spark, monkeypatch):
    words = ["red", "fox", "blue", "whale", "sea", "moon", "none"]
    docs = [(f"d{i}", " ".join(words[(i * j + j // 3) % 6] for j in range(i % 23)), ["a"] if i % 3 else ["a", "b"]) for i in range(80)]
    docs += [("long", "red " * 40 + "whale", ["b"]), ("null", None, ["a"]), ("empty", "", ["b"]), ("other", "x y z", ["a"])]
    chunks = spark.createDataFrame(docs, "id string, content string, kbs array<string>")
    asked = spark.createDataFrame([(1, "red fox red"), (2, "none"), (3, "whale sea"), (4, ""), (5, None), (None, "moon")], "query_id long, query string")
    want = rows_of(lexical.top_k(lexical.bm25(chunks, asked, "id"), 5))
    assert rows_of(TextScan(chunks, asked).search(5)) == want and len(want) == 15
    some = F.col("id").isin("d7", "d8", "long")
    monkeypatch.setattr(text_scan, "PART", 3)
    monkeypatch.setattr(text_scan, "NUMBERS", 2)
    monkeypatch.setattr(text_scan, "SCORES", 12)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
        assert rows_of(TextScan(chunks.repartition(5), asked).search(5)) == want
        assert rows_of(TextScan(chunks, asked, among=some).search(5)) == rows_of(lexical.top_k(lexical.bm25(chunks, asked, "id", among=some), 5))
        scan = TextScan(chunks, asked, groups=F.col("kbs"))
        every = lexical.bm25(chunks, asked, "id").join(chunks.select("id", F.explode("kbs").alias("group")), "id")
        best = rows_of(lexical.top_k(every, 4, ["query_id", "group"]), "group")
        assert rows_of(scan.search(4), "group") == best
        hits = spark.createDataFrame([(1, "d7"), (1, "null"), (3, "long"), (2, "d8")], "query_id long, id string")
        scores = {(r["query_id"], r["id"]): r["score"] for r in lexical.bm25(chunks, asked, "id").collect()}
        assert {(r["query_id"], r["id"]): r["score"] for r in scan.scored(hits).collect()} == {k: scores[k] for k in ((1, "d7"), (3, "long")) if k in scores}
        monkeypatch.setattr(text_scan, "BROADCAST_TERMS", 1)
        assert rows_of(TextScan(chunks, asked).search(5)) == want and rows_of(TextScan(chunks, asked, groups=F.col("kbs")).search(4), "group") == best
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert TextScan(chunks, asked.limit(0)).search(5).collect() == [] and TextScan(chunks.limit(0), asked).search(5).collect() == []


def test_no_pair_of_a_query_and_a_chunk_is_joined(spark):
    plan = queries.v2_bm25(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1


def test_texts_are_not_shuffled_to_be_reranked(spark):
    plan = queries.v9_rerank(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
