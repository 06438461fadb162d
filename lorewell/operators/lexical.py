"""Full-text retrieval: postings and BM25 over chunks, for any number of queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.sources.scratch import shared_path

K1, B = 1.2, 0.75
#: query terms up to which they are sent to every executor; beyond, Spark joins by shuffle
BROADCAST_TERMS = 100_000
#: terms that chunks are counted by
MARKS = 256


def postings(chunks: DataFrame, id_col: str = "chunk_id", content_col: str = "content") -> DataFrame:
    """term, id, tf, length: the inverted index as a table. Terms are counted inside their row's task first."""
    df = chunks.select(F.col(id_col).alias("id"), T.tokens(F.col(content_col)).alias("t"))
    df = df.select("id", F.size("t").alias("length"), F.explode_outer("t").alias("term")).where("term is not null")  # outer: see ``split.exploded``
    return df.groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf")).select("term", "id", "tf", "length")


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """query_id, term, times."""
    df = queries.select(F.col(id_col).alias("query_id"), F.explode(T.tokens(F.col(text_col))).alias("term"))
    return df.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def bm25(
    chunks: DataFrame, queries: DataFrame, id_col: str = "chunk_id", content_col: str = "content", query_id: str = "query_id", query_text: str = "query", among: Column | None = None
) -> DataFrame:
    """query_id, id, score (to six places, so that ties are ties) of every chunk that shares a term with a query.

    Statistics span all chunks, also where only those that ``among`` is true for are wanted. Chunks are
    cut into tokens once: the terms of the queries are joined before anything is shuffled, with a mark
    that stands for the chunk itself, and what is left is written once and read for every count. The marks are ``MARKS`` terms that no
    token can be, so that where the join is a shuffle no task gets a row of every chunk.

    Only chunks that share a term are hits: where fewer than are wanted do, the list isn't filled up with others at score 0.
    """
    terms = query_terms(queries, query_id, query_text)
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    near = F.broadcast if few else (lambda df: df)
    wanted = terms.select("term").distinct()
    mark = lambda i: F.concat(F.lit("\x00"), i.cast("string"))
    wanted = wanted.unionByName(wanted.sparkSession.range(MARKS).select(mark(F.col("id")).alias("term")))
    wants = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    tokens = chunks.select(F.col(id_col).alias("id"), wants.alias("wanted"), T.tokens(F.col(content_col)).alias("t"))
    tokens = tokens.select("id", "wanted", F.size("t").alias("length"), F.explode(F.array_append("t", mark(F.pmod(F.xxhash64("id"), F.lit(MARKS))))).alias("term"))
    tf = tokens.join(near(wanted), "term").groupBy("term", "id", "wanted", "length").agg(F.count(F.lit(1)).alias("tf"))
    path = shared_path(chunks.sparkSession, "terms")
    tf.write.parquet(path)
    tf = chunks.sparkSession.read.schema(tf.schema).parquet(path)
    chunk = F.startswith("term", F.lit("\x00"))
    size = tf.where(chunk).agg(F.sum("tf").alias("n"), (F.sum(F.col("length") * F.col("tf")) / F.sum("tf")).alias("mean"))
    tf = tf.where(~chunk)
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hits = tf.where("wanted").join(near(df), "term").join(near(terms), "term").crossJoin(F.broadcast(size))  # size: one row
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return hits.groupBy("query_id", "id").agg(F.round(F.sum(F.col("times") * idf * weight), 6).alias("score"))


def top_k(scores: DataFrame, k: int, by: str | list[str] = "query_id", id_col: str = "id", score_col: str = "score") -> DataFrame:
    """The ``k`` best of each query with their rank; ids break ties. Tasks keep k rows of a query before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(score_col), id_col)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def threshold_top_k(scores: DataFrame, least: float, k: int, by: str = "query_id") -> DataFrame:
    return top_k(scores.where(F.col("score") >= least), k, by)


def matches(content: Column, keyword: str) -> Column:
    """Whether a chunk holds any token of ``keyword``; everything matches an empty one."""
    wanted = T.tokens(F.lit(keyword))
    return (F.size(wanted) == 0) | F.arrays_overlap(T.tokens(content), wanted)
