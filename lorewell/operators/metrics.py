"""Counters and histograms of retrieval and indexing, from a table of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of metrics, their labels, and the upper bounds of a histogram's buckets.
HISTOGRAMS = {
    "rag_retrieval_duration_seconds": (["mode", "kb_id"], [0.01, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10]),
    "rag_rerank_duration_seconds": (["model"], [0.01, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5]),
    "rag_embedding_duration_seconds": (["model"], [0.01, 0.05, 0.1, 0.25, 0.5, 1, 2.5]),
    "rag_chunks_returned": (["mode"], [1, 5, 10, 20, 50, 100]),
    "rag_indexing_duration_seconds": (["kb_id", "status"], [1, 5, 10, 30, 60, 120, 300, 600]),
    "rag_chunks_indexed": (["kb_id"], [1, 5, 10, 20, 50, 100, 200, 500]),
}
COUNTERS = {
    "rag_retrieval_total": ["mode", "kb_id"],
    "rag_retrieval_errors_total": ["mode", "kb_id", "error_type"],
    "rag_indexing_total": ["kb_id"],
    "rag_indexing_errors_total": ["kb_id", "error_type"],
}


def observed(rows: DataFrame, metric: str, value: Column | None = None, **labels: Column) -> DataFrame:
    """metric, labels, value: an observation of a histogram, or a step of a counter, for each row; all labels of the metric have to be given."""
    names = HISTOGRAMS[metric][0] if metric in HISTOGRAMS else COUNTERS[metric]
    if set(names) != set(labels) or (value is None) == (metric in HISTOGRAMS):
        raise ValueError(f"{metric} has labels {names}{' and a value' if metric in HISTOGRAMS else ''}")
    shown = F.concat_ws(",", *[F.concat(F.lit(f'{n}="'), F.coalesce(labels[n].cast("string"), F.lit("")), F.lit('"')) for n in names])
    return rows.select(F.lit(metric).alias("metric"), shown.alias("labels"), (F.lit(1.0) if value is None else value).cast("double").alias("value"))


def exposed(observations: DataFrame) -> DataFrame:
    """metric, labels, le, n, total: for histograms the observations up to each bound (null: all), for counters their sum alone.

    An observation falls into one bucket, so that what is shuffled is a count per bucket; bounds are added up afterwards over a metric's few buckets.
    """
    bounds = F.create_map(*[x for name, (_, b) in HISTOGRAMS.items() for x in (F.lit(name), F.array(*[F.lit(float(v)) for v in b]))])
    own = F.col("bounds")
    place = F.when(own.isNotNull(), F.size(F.filter(own, lambda b: F.col("value") > b))).otherwise(0)
    df = observations.where("value is not null").withColumn("bounds", F.try_element_at(bounds, F.col("metric")))
    df = df.groupBy("metric", "labels", place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    whole = df.groupBy("metric", "labels").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("by"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    bounds_of = F.try_element_at(bounds, F.col("metric"))
    none = F.array(F.lit(None).cast("double"))
    rows = whole.select("metric", "labels", "by", "n", "total", F.posexplode(F.when(bounds_of.isNull(), none).otherwise(F.concat(bounds_of, none))).alias("i", "le"))
    upto = F.aggregate(F.map_keys("by"), F.lit(0).cast("long"), lambda s, k: s + F.when(k <= F.col("i"), F.try_element_at("by", k)).otherwise(0))
    return rows.select("metric", "labels", "le", F.when(F.col("le").isNull(), F.col("n")).otherwise(upto).alias("n"), "total")
