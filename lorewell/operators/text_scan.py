"""The best chunks of each query by BM25, from a scan of all chunks: scores are taken inside tasks.

Chunks are cut into tokens once; a task counts the terms of the queries in each chunk and writes a narrow row
per chunk, with terms as numbers. Statistics are read from that table. A second pass over it multiplies
counts with the terms' gains, a bounded matrix at a time, and keeps the ``k`` best of each query, so neither tokens nor
pairs of a query and a chunk are rows of a shuffle. Scores are those of ``lexical.bm25``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators.lexical import B, BROADCAST_TERMS, K1, bm25, query_terms, top_k
from lorewell.operators.vector import SCORES, Best
from lorewell.sources.scratch import kept

#: tokens in a row that is handed to Python, and numbers of a matrix of queries and terms
PART, NUMBERS = 256, 4_000_000


class TextScan:
    """Full text of ``chunks`` for ``queries``; ids name one chunk each.

    ``among`` narrows the hits, not the statistics. ``groups``, an array column, makes each of its values a list of hits of its
    own, and chunks without any no hits. Beyond ``BROADCAST_TERMS`` terms of queries, all scores are joined and written instead.
    """

    def __init__(
        self, chunks: DataFrame, queries: DataFrame, id_col: str = "id", content_col: str = "content", query_id: str = "query_id", query_text: str = "query", among: Column | None = None, groups: Column | None = None
    ) -> None:
        self.spark, self.groups = chunks.sparkSession, groups is not None
        terms = kept(query_terms(queries, query_id, query_text), "asked")
        rows = chunks.select(F.col(id_col).alias("id"), F.col(content_col).alias("content"), F.coalesce(F.lit(True) if among is None else among, F.lit(False)).alias("wanted"), *([groups.alias("groups")] if self.groups else []))
        self.every = None
        if terms.limit(BROADCAST_TERMS + 1).count() > BROADCAST_TERMS:
            hit = F.size("groups") > 0 if self.groups else F.col("wanted")
            self.every = kept(bm25(rows, queries, "id", "content", query_id, query_text, among=hit), "scores")
            self.held = rows.select("id", F.explode("groups").alias("group")) if self.groups else None
            return
        asked = terms.toArrow()  # at most BROADCAST_TERMS rows
        column = lambda name: asked.column(name).combine_chunks()
        names = pc.unique(column("term")).drop_null()
        self.names, self.query_kind = names, terms.schema["query_id"].dataType
        own = column("query_id").dictionary_encode("encode")
        self.queries, self.q = own.dictionary, own.indices.to_numpy(zero_copy_only=False)
        self.term, times = pc.index_in(column("term"), value_set=names).to_numpy(zero_copy_only=False), column("times").to_numpy(zero_copy_only=False)
        self.table = kept(_counted(rows, names), "chunk-terms")
        size = self.table.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
        df = self.table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()  # a row a term
        n, counts = size["n"], np.zeros(len(names))
        counts[df.column("term").to_numpy()] = df.column("df").to_numpy()
        self.mean = size["mean"] or 1.0  # without a token nothing is scored
        self.gain = times * np.log1p((n - counts + 0.5) / (counts + 0.5))[self.term]

    def search(self, k: int) -> DataFrame:
        """query_id, (group,) id, score, rank: the ``k`` best of each query (and group)."""
        by = ["query_id", "group"] if self.groups else ["query_id"]
        if self.every is not None:
            return top_k(self.every.join(self.held, "id").select(*by, "id", "score") if self.groups else self.every, k, by)
        rows = self.table.select("id", "length", "terms", "counts", F.explode("groups").alias("group")) if self.groups else self.table.where("wanted").select("id", "length", "terms", "counts")
        kind, group = rows.schema["id"].dataType.simpleString(), rows.schema["group"].dataType.simpleString() if self.groups else None
        shared = self.spark.sparkContext.broadcast((self.queries, _blocks(self.q, self.term, self.gain, len(self.queries)), len(self.names), self.mean))
        schema = f"query_id {self.query_kind.simpleString()}, {f'`group` {group}, ' if group else ''}id {kind}, score double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries, blocks, words, mean = shared.value
            best, kinds = {}, None
            for batch in batches:
                kinds = batch.schema
                own = batch.column(4).to_pylist() if group else [None] * batch.num_rows
                for g in dict.fromkeys(own):
                    some = batch.filter(pa.array([x == g for x in own])) if group else batch
                    lists = best.setdefault(g, [Best(len(b[0]), k) for b in blocks])
                    _score(some, blocks, words, mean, lists)
            for g, lists in best.items():
                for (numbers, _, _), found in zip(blocks, lists, strict=True):
                    found.trim()
                    if found.rows:
                        q, ids, scores = found.parts[0]
                        ids = pa.array(ids, kinds.field(0).type, from_pandas=True)
                        groups = {"group": pa.array([g] * len(q), kinds.field(4).type)} if group else {}
                        yield pa.RecordBatch.from_pydict({"query_id": queries.take(pa.array(numbers[q])), **groups, "id": ids, "score": pa.array(scores)})

        return top_k(rows.mapInArrow(run, schema), k, by)

    def scored(self, hits: DataFrame) -> DataFrame:
        """``hits`` (query_id, id, and what else is in them) with their score; those that share no term have none."""
        if self.every is not None:
            return hits.join(self.every, ["query_id", "id"])
        own = pa.table({"query_id": self.queries.take(pa.array(self.q)), "term": pa.array(self.term, pa.int32()), "gain": self.gain})
        gains = self.spark.createDataFrame(own)
        near = F.broadcast if hits.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else (lambda df: df)
        both = self.table.select("id", "length", "terms", "counts").join(near(hits), "id").select(*hits.columns, "length", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(*hits.columns, "length", F.col("x.terms").alias("term"), F.col("x.counts").alias("tf"))
        weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(self.mean))))
        return both.join(F.broadcast(gains), ["query_id", "term"]).groupBy(*hits.columns).agg(F.round(F.sum(F.col("gain") * weight), 6).alias("score"))


def _counted(rows: DataFrame, names: pa.Array) -> DataFrame:
    """``rows`` with length, terms (numbers in ``names``) and counts in place of content; nothing is shuffled.

    Tokens go to Python by ``PART`` in a row, so that a batch is bounded however long a chunk is.
    """
    more = [c for c in rows.columns if c != "content"]
    cut = rows.select(*more, T.tokens(F.col("content")).alias("t")).select(*more, F.size("t").alias("length"), "t")
    places = F.sequence(F.lit(0), F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / PART).cast("int"))
    parts = F.transform(places, lambda i: F.slice("t", i * PART + 1, F.lit(PART)))
    cut = cut.select(*more, "length", F.posexplode_outer(parts).alias("part", "t"))
    shared = rows.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, head, held = shared.value, None, np.empty(0, np.int64)  # the last chunk may go on in the next batch

        def written(heads: pa.Table, chunk: np.ndarray, term: np.ndarray, tf: np.ndarray) -> pa.Table:
            ends = pa.array(np.searchsorted(chunk, np.arange(heads.num_rows + 1)), pa.int32())
            heads = heads.append_column("terms", pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())))
            return heads.append_column("counts", pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())))

        for batch in batches:
            if not batch.num_rows:
                continue
            begins = batch.column(len(more) + 1).to_numpy() == 0
            tokens = batch.column(len(more) + 2)
            found = pc.index_in(tokens.flatten(), value_set=words)
            hit = pc.is_valid(found).to_numpy(zero_copy_only=False)
            chunk = np.repeat(np.cumsum(begins), pc.list_value_length(tokens).to_numpy())[hit]
            key = np.concatenate([held, chunk * len(words) + found.drop_null().to_numpy().astype(np.int64)])
            key, tf = np.unique(key, return_counts=True)
            chunk, term = key // max(1, len(words)), key % max(1, len(words))
            fresh = pa.Table.from_batches([batch.select(list(range(len(more) + 1)))]).filter(pa.array(begins))
            if head is None:
                chunk, heads = chunk - 1, fresh
            else:
                heads = pa.concat_tables([head, fresh])
            last = heads.num_rows - 1
            done = chunk < last
            yield from written(heads.slice(0, last), chunk[done], term[done], tf[done]).combine_chunks().to_batches()
            head, held = heads.slice(last), np.repeat(term[~done], tf[~done])
        if head is not None:
            term, tf = np.unique(held, return_counts=True)
            yield from written(head, np.zeros(len(term), np.int64), term, tf).combine_chunks().to_batches()

    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in more)
    return cut.mapInArrow(run, f"{kinds}length int, terms array<int>, counts array<int>")


def _blocks(q: np.ndarray, term: np.ndarray, gain: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of queries, their terms, gains by term and query) of at most ``NUMBERS`` gains each, or of one query."""
    order = np.argsort(q, kind="stable")
    q, term, gain = q[order], term[order], gain[order]
    ends = np.searchsorted(q, np.arange(n + 1))
    out, at = [], 0
    while at < n:
        size = n - at
        while True:
            mine = slice(ends[at], ends[at + size])
            own = np.unique(term[mine])
            if size == 1 or size * len(own) <= NUMBERS:
                break
            size = max(1, size // 2)
        table = np.zeros((len(own), size))
        table[np.searchsorted(own, term[mine]), q[mine] - at] = gain[mine]
        out.append((np.arange(at, at + size), own, table))
        at += size
    return out


def _score(batch: pa.RecordBatch, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], words: int, mean: float, lists: list[Best]) -> None:
    """Adds the chunks (id, length, terms, counts) of a batch to the best of each query."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    n = pc.list_value_length(batch.column(2)).to_numpy()
    ends = np.r_[0, np.cumsum(n)]
    row, term, tf = np.repeat(np.arange(len(n)), n), batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * batch.column(1).to_numpy()[row] / mean))
    for (_, own, gains), best in zip(blocks, lists, strict=True):
        place = np.full(words, -1)
        place[own] = np.arange(len(own))
        step = max(1, SCORES // max(gains.shape))
        for at in range(0, len(n), step):
            some = slice(ends[at], ends[min(at + step, len(n))])
            col = place[term[some]]
            held = col >= 0
            counts = np.zeros((min(step, len(n) - at), len(own)))
            counts[row[some][held] - at, col[held]] = weight[some][held]
            scores = counts @ gains
            best.keep(ids[at : at + step], np.where(scores > 0, np.round(scores, 6), -np.inf))
