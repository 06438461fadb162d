"""Retrieval: candidates by mode, reranking, threshold and top-k, for many queries in one job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import fusion
from lorewell.operators.lexical import threshold_top_k, top_k
from lorewell.operators.text_index import TextIndex
from lorewell.operators.text_scan import TextScan
from lorewell.operators.vector import knn
from lorewell.sources.scratch import kept

OVERFETCH = 3


def shared_terms(query: Column, content: Column) -> Column:
    """A reranker without a model: share of the query's terms that the chunk holds."""
    asked = F.array_distinct(T.tokens(query))
    return F.coalesce(F.size(F.array_intersect(asked, T.tokens(content))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    mode: str = "hybrid",
    k: int = 10,
    least: float = 0.6,
    rerank: Callable[[Column, Column], Column] = shared_terms,
    doc_ids: Sequence[object] | None = None,
    near: Callable[[DataFrame, int], DataFrame] | None = None,
    text: TextIndex | None = None,
) -> DataFrame:
    """query_id, id, score, rank. ``chunks``: id, content, embedding; ``queries``: query_id, query, query_vector.

    Unknown modes are hybrid: the scores of full text and of the nearest vectors are added. ``vector`` also
    reads the text, ``fulltext`` no vector. Three times ``k`` candidates are reranked; those of a score of
    ``least`` or more stay, the ``k`` best of them. ``doc_ids`` narrows the hits; statistics span all chunks.

    Neighbours that are not among the best hits of full text have their texts scored as well: with them, the best candidates
    are those of all scores. ``near``, such as ``VectorIndex.search``, answers (queries, number of hits) from a stored index in place of a
    scan; so does ``text``. Stored indexes hold all chunks, so they can't be narrowed.
    """
    if k <= 0:
        raise ValueError("k has to be above 0")
    if doc_ids and (near or text):
        raise ValueError("a stored index can't be narrowed to documents")
    among = F.col("doc_id").isin(list(doc_ids)) if doc_ids else None
    pool = chunks if among is None else chunks.where(among)
    scan = None if text else TextScan(chunks, queries, among=among)
    found = text.search(queries, k * OVERFETCH).drop("rank") if text else scan.search(k * OVERFETCH).drop("rank")
    if mode != "fulltext":
        close = near(queries, k * OVERFETCH) if near else knn(pool, queries, k * OVERFETCH, "id", "embedding")
        close, found = kept(close, "nearest"), kept(found, "found")  # a row a query and hit; both are read twice
        others = close.select("query_id", "id").join(found, ["query_id", "id"], "left_anti")
        more = text.scored(queries, others.join(chunks.select("id", "content"), "id")) if text else scan.scored(others)
        found = found.unionByName(more)
        found = fusion.summed(found, close)
    candidates = top_k(found, k * OVERFETCH)
    return threshold_top_k(fusion.reranked(candidates, pool, queries, rerank), least, k)


def retrieve_bases(
    chunks: DataFrame, queries: DataFrame, bases: Sequence[object], mode: str = "hybrid", k: int = 10, least: float = 0.6, rerank: Callable[[Column, Column], Column] = shared_terms
) -> DataFrame:
    """kb_id, query_id, id, score, rank: ``retrieve`` in each of ``bases``, all in one job; ``chunks`` has kb_ids.

    Text is scored once for all bases, and statistics span the whole index.
    """
    if k <= 0:
        raise ValueError("k has to be above 0")
    wanted = F.array(*[F.lit(b) for b in bases])
    held = chunks.select("*", F.explode(F.array_distinct(F.array_intersect("kb_ids", wanted))).alias("kb_id"))
    both = lambda df: df.withColumn("query_id", F.struct("kb_id", F.col("query_id").alias("q"))).drop("kb_id")
    scan = TextScan(chunks, queries, groups=F.array_distinct(F.array_intersect("kb_ids", wanted)))
    found = both(scan.search(k * OVERFETCH).withColumnRenamed("group", "kb_id")).select("query_id", "id", "score")
    each = queries.select("*", F.explode(wanted).alias("kb_id"))
    if mode != "fulltext":
        near = kept(knn(held, each, k * OVERFETCH, "id", "embedding", same=("kb_id", "kb_id"), with_same=True), "nearest")
        found = kept(found, "found")
        others = both(near).select("query_id", "id").join(found, ["query_id", "id"], "left_anti")
        more = both(scan.scored(others.select(F.col("query_id.q").alias("query_id"), F.col("query_id.kb_id").alias("kb_id"), "id")))
        found = fusion.summed(found.unionByName(more), both(near).select("query_id", "id", "score"))
    candidates = top_k(found, k * OVERFETCH)
    ranked = threshold_top_k(fusion.reranked(candidates, chunks, both(each), rerank), least, k)
    return ranked.select("query_id.kb_id", F.col("query_id.q").alias("query_id"), "id", "score", "rank")
