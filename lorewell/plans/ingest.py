"""Documents to scored, indexed chunks, and chunks to a graph."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import graph, quality, resolution, split
from lorewell.plans.embedding import embedded


def _records(rows: DataFrame, key: Column, content: Column, kb_id: Column, now: Column, more: list[str]) -> DataFrame:
    own = [c for c in more if c in rows.columns]
    first = F.row_number().over(Window.partitionBy("id").orderBy("chunk_index"))
    found = rows.select(
        key.alias("id"), F.col("doc_id").cast("string").alias("doc_id"), kb_id.alias("kb_id"), F.array(kb_id).alias("kb_ids"), content.alias("content"),
        now.cast("double").alias("create_timestamp_flt"), F.lit(1).alias("available_int"), "chunk_index", *own,
    )
    return found.withColumn("_n", first).where("_n = 1").drop("_n")


def chunk_records(chunks: DataFrame, kb_id: Column, now: Column) -> DataFrame:
    """Index records of content chunks, with their scores where they have some; equal chunks of a document have one id, and the first of them is kept.

    ``kb_id`` is the partition that ``put_chunks`` and ``cascade_delete`` work on, ``kb_ids`` what searches filter by.
    """
    return _records(chunks, T.chunk_id(F.col("content"), F.col("doc_id")), F.col("content"), kb_id, now, quality.SCORES)


def question_records(chunks: DataFrame, kb_id: Column, now: Column, qa_col: str = "qa_pairs") -> DataFrame:
    """Index records of the questions of chunks; they have no scores."""
    df = chunks.select("doc_id", "chunk_index", F.explode(qa_col).alias("x"))
    content = F.concat(F.lit("Question: "), F.col("x.question"), F.lit("\nAnswer: "), F.col("x.answer"))
    key = T.chunk_id(F.concat("x.question", "x.answer"), F.col("doc_id"), "qa")
    return _records(df, key, content, kb_id, now, [])


def ingest(docs: DataFrame, path_col: str, kb_id: Column, now: Column, size: int = 500, overlap: int = 0, ask: Callable[[Column], Column] | None = None, embed: Callable[[Column], Column] | None = None, model: Callable[[list[str]], Sequence[Sequence[float]]] | None = None) -> DataFrame:
    """Split, score, ask where questions are wanted, score again, and build index records; ``ask`` and ``embed`` are expressions or pandas UDFs.

    ``model`` takes lists of texts instead, in batches with a deadline: see ``embedding.embedded``.

    Only the questions of a chunk change its score, so both rounds of scoring are one: what was asked is
    known before the scores are taken, and a chunk that nothing is asked of has the score of the first round.
    """
    chunks = split.split_documents(docs, path_col, size=size, overlap=overlap)
    chunks = chunks.withColumn("qa_pairs", F.array().cast(quality.QA))
    if ask:
        chunks = quality.with_questions(chunks, ask)
    chunks = quality.scored(chunks, qa_col="qa_pairs")
    records = chunk_records(chunks, kb_id, now).unionByName(question_records(chunks, kb_id, now), allowMissingColumns=True)
    if model:
        return embedded(records, model)
    return records.withColumn("content_vector", embed(F.col("content"))) if embed else records


def build_graph(chunks: DataFrame, extract: Callable[[Column, Column], Column], rounds: int = 3, resolve: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) merged over all chunks (chunk_id, chunk_index, content), on request with alike names made one."""
    parsed = graph.records(graph.gleaned(chunks, extract, rounds=rounds))
    found, linked = graph.entities(parsed), graph.relations(parsed)
    if not resolve:
        return graph.merged_entities(found), graph.merged_relations(linked)
    names = found.select("name").unionByName(linked.select(F.explode(F.array("src_id", "dst_id")).alias("name")))
    names = resolution.resolved(names)
    return resolution.resolved_entities(found, names), resolution.resolved_relations(linked, names)
