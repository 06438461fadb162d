"""Splitting in Python: results do not depend on batches, and few Python objects are held at a time."""

import tracemalloc

import pyarrow as pa

from lorewell.operators import split


def test_batches_do_not_change_chunks(spark, monkeypatch):
    docs = [(i, [f"s{i} {j} is so" for j in range(i % 7)], [(j % 3 == 0, "h" if j % 2 else None) for j in range(max(0, i % 7 - 2))] if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, sentences array<string>, boundaries array<struct<is_boundary:boolean,header:string>>")
    want = [(d, i, c) for d, s, b in docs for i, c in enumerate(split.topic_chunks(s, [(x, h or "") for x, h in b or []], 20, 3))]
    monkeypatch.setattr(split, "OUT", 40)
    monkeypatch.setattr(split, "BATCH", 3)
    found = split.topic_split(df, 20, 3)
    assert sorted((r["doc_id"], r["chunk_index"], r["content"]) for r in found.collect()) == want
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()  # a batch of documents is never a list of Python objects
    texts = spark.createDataFrame([(i, "\n".join(["word " * (i % 9)] * (i % 5))) for i in range(50)], "doc_id long, text string")
    cut = texts.select("doc_id", split.recursive_split(texts["text"], 12, 2).alias("p"))
    assert {r["doc_id"]: r["p"] for r in cut.collect()} == {r["doc_id"]: split.pieces_of(r["text"], split.SEPARATORS, 12, 2) for r in texts.collect()}


def test_few_values_are_objects_at_a_time():
    values = pa.array(["x" * 2000] * 5000)
    tracemalloc.start()
    got = split.by_value(values, lambda t: [t[i : i + 10] for i in range(0, len(t), 10)], pa.list_(pa.string()))
    peak = tracemalloc.get_traced_memory()[1]  # Arrow's own memory does not count
    tracemalloc.stop()
    assert len(got) == 5000 and peak < 5_000_000
