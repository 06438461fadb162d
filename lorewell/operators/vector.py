"""Exact nearest neighbours by cosine, for a stated set of queries against all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.operators.lexical import top_k
from lorewell.sources.scratch import shared_path

#: numbers (queries x dimensions) that are sent to the executors at once
BLOCK = 4_000_000
#: scores that a task holds at once
SCORES = 1_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Of length 1; null for a vector without direction."""
    v = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def first_of(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first of each group by score from the highest, then by id; in order of groups."""
    order = np.lexsort((pd.factorize(ids, sort=True)[0] if ids.dtype == object else ids, -scores, groups))
    own = groups[order]
    begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, np.int64)
    place = np.arange(len(own)) - np.repeat(begins, np.diff(np.r_[begins, len(own)]))
    return order[place < k]


class Best:
    """The ``k`` best of each query so far; smaller ids win ties.

    Of a step of scores only those go on that reach the k-th of the step and the k-th so far, in arrays
    of numbers, so memory is bounded by queries x k and one step.
    """

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.queries = k, queries
        self.least = np.full(queries, -np.inf)
        self.parts, self.rows = [], 0

    def keep(self, ids: np.ndarray, s: np.ndarray) -> None:
        """Scores of a step, by id and query; -inf is none."""
        least = np.maximum(self.least, np.partition(s, len(s) - self.k, axis=0)[len(s) - self.k]) if len(s) > self.k else self.least
        row, q = np.nonzero((s >= least) & (s > -np.inf))
        self.parts.append((q.astype(np.int32), ids[row], s[row, q]))
        self.rows += len(q)
        if self.rows > 4 * self.k * self.queries:
            self.trim()

    def trim(self) -> None:
        if not self.parts:
            return
        q, ids, scores = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        best = first_of(q, scores, ids, self.k)
        q, ids, scores = q[best], ids[best], scores[best]
        n = np.bincount(q, minlength=self.queries)
        last = np.cumsum(n) - 1
        full = n >= self.k
        self.least[full] = scores[last[full]]
        self.parts, self.rows = [(q, ids, scores)], len(q)


class Nearest(Best):
    """The nearest vectors; a step is at most ``SCORES`` scores."""

    def __init__(self, asked: pd.DataFrame, k: int) -> None:
        super().__init__(len(asked), k)
        self.wants = asked["want"].to_numpy() if "want" in asked else None
        self.ids = asked["query_id"].to_numpy()
        self.unit = np.stack(asked["v"].to_numpy()).astype(np.float64)

    def add(self, ids: np.ndarray, vectors: np.ndarray, have: np.ndarray | None) -> None:
        step = max(1, SCORES // len(self.ids))
        for at in range(0, len(ids), step):
            s = np.round((1 + vectors[at : at + step] @ self.unit.T) / 2, 6)
            s[np.isnan(s)] = -np.inf
            if self.wants is not None:
                s[have[at : at + step, None] != self.wants[None, :]] = -np.inf
            self.keep(ids[at : at + step], s)


def _best(rows: DataFrame, asked: pd.DataFrame, k: int, d: int, schema: str) -> DataFrame:
    """Each task's ``k`` best of every query of one block; vectors are multiplied in batches."""
    shared = rows.sparkSession.sparkContext.broadcast(asked)  # a block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = Nearest(shared.value, k), None
        for batch in batches:
            if batch.num_rows:
                kind = batch.schema.field(0).type
                u = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                best.add(batch.column(0).to_numpy(zero_copy_only=False), u, batch.column(2).to_numpy(zero_copy_only=False) if batch.num_columns > 2 else None)
        best.trim()
        if best.rows:
            q, ids, scores = best.parts[0]
            own = pd.DataFrame({"query_id": best.ids[q], **({"want": best.wants[q]} if best.wants is not None else {}), "score": scores})
            found = pa.RecordBatch.from_pandas(own, preserve_index=False)
            yield found.add_column(found.num_columns - 1, "id", pa.array(ids, kind, from_pandas=True))

    return rows.mapInArrow(run, schema)


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector", same: tuple[str, str] | None = None, with_same: bool = False) -> DataFrame:
    """query_id, id, score = (1 + cosine) / 2 to six places, rank.

    Queries are sent out in blocks of at most ``BLOCK`` numbers, one scan of the vectors a block; a task
    multiplies batches and keeps the ``k`` best per query, so no pair of vectors is a row. ``same``: columns of
    vectors and of queries that must be equal (a knowledge base); ``with_same`` returns it too. Vectors of another length, null ones and
    zero ones are no neighbours; null ids of queries are queries of their own.
    """
    own = [F.col(query_id).alias("query_id"), unit(F.col(query_vector)).alias("v"), *([F.col(same[1]).alias("want")] if same else [])]
    asked = queries.select(*own).where("v is not null").withColumn("d", F.size("v"))
    rows = vectors.select(F.col(id_col).alias("id"), unit(F.col(vector_col)).alias("u"), *([F.col(same[0]).alias("have")] if same else [])).where("u is not null")
    kinds = dict(asked.dtypes)
    schema = f"query_id {kinds['query_id']}, {f'want {kinds["want"]}, ' if same else ''}id {dict(rows.dtypes)['id']}, score double"
    spark = vectors.sparkSession
    found = spark.createDataFrame([], schema)
    shapes = {r["d"]: max(1, -(-r["n"] * r["d"] // BLOCK)) for r in asked.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per length of vectors
    path = shared_path(spark, "nearest") if sum(shapes.values()) > 1 else None
    for d, n in shapes.items():
        block = F.pmod(F.xxhash64("query_id"), F.lit(n))
        for i in range(n):
            some = asked.where((F.col("d") == d) & (block == i)).drop("d").toPandas()
            if not len(some):
                continue
            best = _best(rows.where(F.size("u") == d), some, k, d, schema)
            if path:  # a block is done before the next one is read, so the driver holds one
                best.write.mode("append").parquet(path)
                found = spark.read.schema(schema).parquet(path)
            else:
                found = best
    if not same:
        return top_k(found, k)
    found = top_k(found, k, ["query_id", "want"])
    return found.withColumnRenamed("want", same[1]) if with_same else found.drop("want")
