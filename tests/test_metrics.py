"""Counters and histograms against counting by hand."""

import pytest
from pyspark.sql import functions as F

from lorewell.operators import metrics


def test_buckets_are_cumulative_and_labels_apart(spark):
    rows = spark.createDataFrame([(0.01, "a"), (0.02, "a"), (7.0, "a"), (99.0, "a"), (0.3, None), (None, "a")], "v double, kb string")
    seen = metrics.observed(rows, "rag_retrieval_duration_seconds", F.col("v"), mode=F.lit("hybrid"), kb_id=F.col("kb"))
    seen = seen.unionByName(metrics.observed(rows, "rag_indexing_total", kb_id=F.col("kb")))
    out = {}
    for r in metrics.exposed(seen).collect():
        out.setdefault((r["metric"], r["labels"]), {})[r["le"]] = (r["n"], round(r["total"], 6))
    own = out["rag_retrieval_duration_seconds", 'mode="hybrid",kb_id="a"']
    assert own == {0.01: (1, 106.03), **dict.fromkeys([0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0], (2, 106.03)), 10.0: (3, 106.03), None: (4, 106.03)}
    assert out["rag_retrieval_duration_seconds", 'mode="hybrid",kb_id=""'][0.25][0] == 0 and out["rag_retrieval_duration_seconds", 'mode="hybrid",kb_id=""'][0.5][0] == 1
    assert out["rag_indexing_total", 'kb_id="a"'] == {None: (5, 5.0)}
    assert metrics.exposed(seen.limit(0)).collect() == []


def test_wrong_labels_are_refused(spark):
    rows = spark.range(1)
    with pytest.raises(ValueError):
        metrics.observed(rows, "rag_indexing_total", mode=F.lit("x"))
    with pytest.raises(ValueError):
        metrics.observed(rows, "rag_chunks_returned", mode=F.lit("x"))
    with pytest.raises(ValueError):
        metrics.observed(rows, "rag_indexing_total", F.lit(1), kb_id=F.lit("x"))
