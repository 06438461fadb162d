"""The stored text index against BM25 over all chunks."""

import random
from pathlib import Path

import pytest

from lorewell.operators import lexical
from lorewell.operators.text_index import TextIndex
from lorewell.plans.retrieve import retrieve

WORDS = [f"w{i}" for i in range(60)]


def texts(n, seed=1):
    rng = random.Random(seed)
    return [(f"c{i:04}", " ".join(rng.choices(WORDS, weights=[1 / (j + 1) for j in range(60)], k=rng.randint(0, 30)))) for i in range(n)]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(texts(600) + [("n1", None), ("n2", "")], "id string, content string").repartition(3).cache()


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(WORDS, k=n))) for i, n in enumerate([1, 2, 5, 9])] + [(90, ""), (91, "nowhere"), (92, None)]
    return spark.createDataFrame(rows, "query_id int, query string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())


def files(path):
    return {(str(p), p.stat().st_mtime_ns) for p in Path(path).rglob("*.parquet")}


def scan(chunks, queries, k):
    return rows(lexical.top_k(lexical.bm25(chunks, queries, "id"), k))


def test_batches_give_what_a_scan_gives_and_are_merged_in_levels(spark, chunks, queries, tmp_path):
    index = TextIndex.create(spark, str(tmp_path / "i"), block=16, fan=3)
    assert rows(index.search(queries, 3)) == []
    levels, seen = [], set()
    for part in range(7):
        before = files(tmp_path / "i" / "segments")
        index.add(chunks.where(f"pmod(hash(id), 7) = {part}"))
        seen |= before
        now = files(tmp_path / "i" / "segments")
        levels.append(sorted(r["level"] for r in index.segments().collect()))
        if len(levels[-1]) == part + 1:  # nothing merged: all that was there is there, untouched
            assert before <= now
    assert levels == [[0], [0, 0], [1], [0, 1], [0, 0, 1], [1, 1], [0, 1, 1]]
    for k in (1, 10, 1000):
        assert rows(index.search(queries, k)) == scan(chunks, queries, k)


def test_fewer_hits_read_fewer_postings(spark, queries, tmp_path):
    # a rare word in few ranges: their bound stands out
    made = [(f"c{i:04}", t + (" rare rare rare" if i % 150 == 0 else "") + " common") for i, (_, t) in enumerate(texts(1200, 3))]
    chunks = spark.createDataFrame(made, "id string, content string")
    asked = spark.createDataFrame([(1, "rare common"), (2, "rare")], "query_id int, query string")
    index = TextIndex.create(spark, str(tmp_path / "i"), block=16)
    index.add(chunks)
    for k in (2, 20):
        assert rows(index.search(asked, k)) == scan(chunks, asked, k)
    few, more, every = (index.reads(asked, k).first() for k in (2, 20, 5000))
    assert few["read"] < more["read"] <= every["read"] == every["postings"] and few["read"] < every["postings"] / 5


def test_replaced_and_removed_chunks(spark, chunks, queries, tmp_path):
    index = TextIndex.create(spark, str(tmp_path / "i"), block=16, fan=10)
    index.add(chunks.selectExpr("id", "reverse(content) AS content"))
    index.add(chunks)
    index.remove(chunks.where("id < 'c0300'"))
    found = {r[2] for r in rows(index.search(queries, 500))}
    left = chunks.where("id >= 'c0300'")
    assert found == {r[2] for r in scan(left, queries, 500)}  # at once; statistics follow with a merge
    index.add(chunks.where("id between 'c0100' and 'c0150'"))
    index.compact()
    assert index.segments().count() == 1
    assert rows(index.search(queries, 20)) == scan(chunks.where("id >= 'c0300' or id between 'c0100' and 'c0150'"), queries, 20)


def test_retrieval_reads_the_index(spark, chunks, queries, tmp_path):
    index = TextIndex.create(spark, str(tmp_path / "i"), block=64)
    index.add(chunks)
    whole = chunks.selectExpr("id", "coalesce(content, '') AS content")
    want = rows(retrieve(whole, queries, "fulltext", k=5, least=0.2))
    assert rows(retrieve(whole, queries, "fulltext", k=5, least=0.2, text=index)) == want and want
    with pytest.raises(ValueError):
        retrieve(whole, queries, "fulltext", doc_ids=[1], text=index)


def test_no_more_than_k_rows_of_a_range_and_a_query_leave_a_task(spark, chunks, tmp_path):
    """A row for every query and posting used to be shuffled, by id for what was removed and again for the sums."""
    index = TextIndex.create(spark, str(tmp_path / "i"), block=64, fan=9)
    index.add(chunks.selectExpr("id", "reverse(content) AS content"))
    index.add(chunks)
    asked = spark.createDataFrame([(i, "w0 w1 w2") for i in range(30)], "query_id int, query string")
    blocks, heads = index._bounds(asked, "query_id", "query")
    found = index._scores(blocks, heads, 2)
    ranges = heads.select("segment", "range").distinct().count()
    assert 0 < found.count() <= 2 * 30 * ranges < 30 * 600
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.index("MapInArrow") < text.index("Join")  # joins are below: of postings, not of hits


def test_texts_are_shuffled_once_and_blocks_as_they_are(spark, chunks, queries, tmp_path):
    """A batch used to shuffle its texts, its postings and its blocks twice, and a search a row a posting with its segment's name."""
    index, seen = TextIndex.create(spark, str(tmp_path / "i"), block=16), []
    write = index._write
    index._write = lambda blocks, *a: (seen.append(blocks._jdf.queryExecution().executedPlan().toString()), write(blocks, *a))[1]
    twice = chunks.unionByName(chunks.selectExpr("id", "concat(content, ' w1') AS content").where("id < 'c0100'"))
    index.add(twice)
    assert len(seen) == 1 and seen[0].count("Exchange hashpartitioning") == 1 and "Aggregate" not in seen[0]
    longer = twice.groupBy("id").agg({"content": "max"}).withColumnRenamed("max(content)", "content")
    assert rows(index.search(queries, 20)) == scan(longer, queries, 20)
    blocks, heads = index._bounds(queries.where("query_id < 4"), "query_id", "query")
    plan = index._scores(blocks, heads, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan


def test_gains_of_very_many_terms_are_dealt(spark, chunks, queries, tmp_path, monkeypatch):
    index = TextIndex.create(spark, str(tmp_path / "i"), block=16, fan=9)
    index.add(chunks.selectExpr("id", "reverse(content) AS content"))
    index.add(chunks)
    want = rows(index.search(queries, 5))
    for name in ("BROADCAST_TERMS", "BROADCAST_RANGES", "NAMED_TERMS"):
        monkeypatch.setattr(f"lorewell.operators.text_index.{name}", 2)
    assert rows(index.search(queries, 5)) == want and want
