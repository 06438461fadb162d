"""Lists of scored hits (query_id, id, score) made one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.sources.scratch import kept

#: hits up to which they are sent to every executor
BROADCAST_HITS = 100_000


def summed(*hits: DataFrame) -> DataFrame:
    """Scores added; a hit that a list lacks has score 0 in it. One aggregation, no join."""
    every = hits[0].select("query_id", "id", "score")
    for more in hits[1:]:
        every = every.unionByName(more.select("query_id", "id", "score"))
    return every.groupBy("query_id", "id").agg(F.sum("score").alias("score"))


def reciprocal_ranks(*hits: DataFrame, k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return summed(*[h.select("query_id", "id", (1 / (k + F.row_number().over(w))).alias("score")) for h in hits])


def weighted(*hits: tuple[DataFrame, float]) -> DataFrame:
    """Scores scaled to each query's best, weighted and added."""
    w = Window.partitionBy("query_id")
    best = lambda: F.nullif(F.max("score").over(w), F.lit(0.0))
    return summed(*[h.select("query_id", "id", F.coalesce(F.col("score") / best() * share, F.lit(0.0)).alias("score")) for h, share in hits])


def by_position(hits: DataFrame, results: DataFrame) -> DataFrame:
    """query_id, id, score of ``results`` (query_id, index, score), where index is a hit's place (``rank`` from 1) less one."""
    places = hits.select("query_id", "id", (F.col("rank") - 1).alias("index"))
    return results.select("query_id", "index", "score").join(places, ["query_id", "index"]).select("query_id", "id", "score")


def reranked(hits: DataFrame, contents: DataFrame, queries: DataFrame, score, id_col: str = "id") -> DataFrame:
    """Hits with ``score(query, content)``, an expression or pandas UDF, in place of theirs.

    Hits are written and counted first: as many as are few enough are sent to the contents, so no text is shuffled.
    """
    hits = kept(hits.select("query_id", "id"), "hits")
    near = F.broadcast if hits.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS else (lambda df: df)
    both = near(hits).join(contents.select(F.col(id_col).alias("id"), "content"), "id").join(queries.select("query_id", "query"), "query_id")
    return both.select("query_id", "id", score(F.col("query"), F.col("content")).alias("score"))
