"""Approximate nearest neighbours by inner product: cross-polytope hashing with many probes, re-ranked exactly.

A vector is turned by pseudo-rotations (three rounds of random signs and a fast Hadamard transform) and falls
into the cell of the nearest signed axis; each of ``tables`` tables has rotations of its own, and with many rows a cell
is the combination of several rotations. A query probes the cells of its nearest axes in each table. So that the largest inner
product is the nearest direction also where lengths differ, vectors get one more component that
makes all of them as long as the longest; queries get 0 there.

How many cells are probed is measured, not set: up to ``sample`` queries (those with the least hash
of their id; a bounded, documented sample) are compared with every row, and the probes are the fewest that find ``recall`` of their true
neighbours. All rows are in every table, so with all cells probed the search is exact, and data without any structure
cost more probes, never recall.

Queries and rows meet in a cell's task, sorted so that the queries come first; rows are streamed past
them in batches and each task keeps the k best of a query, so no pair of query and row is a row.
Cells with very many rows are split over tasks, and so are cells with very many queries. Of equal vectors only the k + 1 smallest ids can be
among k neighbours, so a vector with very many copies goes no further than that. Scores are sums of products in double precision, the
same for equal vectors wherever they are computed.

A query whose cells hold fewer than k candidates, though there are more, is compared with every row, in blocks of such queries.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor
do rows without an id; only vectors of one length are compared; rows of one id are neighbours of their own
as far as their scores differ, are answered together as queries, and none is a neighbour of its own id; fewer than k
candidates are all returned; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm.scratch import Scratch

#: mean rows of a cell up to which a cell is one rotation's axis
CELL = 16_384
#: bits of a key below the vector's length
KEY_BITS = 44
#: numbers of a block's queries, scores held at once, probes of a table where cells combine rotations
QUERY_NUMBERS, SCORES, MOST_PROBES = 2_000_000, 4_000_000, 1024
#: queries whose neighbours a task holds before it hands them on
HELD = 50_000


class Space(NamedTuple):
    """How vectors of one length are hashed."""

    d: int
    rows: int
    longest: float
    tables: int
    combined: int
    probes: int

    @property
    def axes(self) -> int:
        return 1 << math.ceil(math.log2(self.d + 1))

    def lifted(self, v: np.ndarray, query: bool) -> np.ndarray:
        """Unit vectors with the added component, padded to a power of two."""
        out = np.zeros((len(v), self.axes))
        if query:
            top = np.abs(v).max(axis=1, keepdims=True)
            v = v / top
            out[:, : self.d] = v / np.linalg.norm(v, axis=1, keepdims=True)
        else:
            out[:, : self.d] = v / self.longest
            out[:, self.d] = np.sqrt(np.maximum(0.0, 1.0 - (out[:, : self.d] ** 2).sum(axis=1)))
        return out

    def turned(self, x: np.ndarray, table: int, part: int) -> np.ndarray:
        """One pseudo-rotation."""
        signs = np.random.default_rng((self.d, table, part)).choice((-1.0, 1.0), (3, self.axes))
        for s in signs:
            x = hadamard(x * s)
        return x

    def cells(self, v: np.ndarray) -> np.ndarray:
        """The key of each vector's cell in every table."""
        x, n = self.lifted(v, False), 2 * self.axes
        out = np.empty((len(v), self.tables), np.int64)
        for t in range(self.tables):
            code = np.zeros(len(v), np.int64)
            for p in range(self.combined):
                y = self.turned(x, t, p)
                at = np.abs(y).argmax(axis=1)
                code = code * n + at + self.axes * (y[np.arange(len(v)), at] < 0)
            out[:, t] = (self.d << KEY_BITS) + t * n**self.combined + code
        return out

    def probed(self, v: np.ndarray, probes: int) -> np.ndarray:
        """Keys of the ``probes`` nearest cells of each query in every table, nearest first: (queries, tables, probes)."""
        x, n = self.lifted(v, True), 2 * self.axes
        out = []
        for t in range(self.tables):
            codes, costs = np.zeros((len(v), 1), np.int64), np.zeros((len(v), 1))
            for p in range(self.combined):
                y = self.turned(x, t, p)
                y = np.concatenate([y, -y], axis=1)
                near = np.argsort(-y, axis=1, kind="stable")[:, : min(probes, n)]
                far = (y.max(axis=1, keepdims=True) - np.take_along_axis(y, near, 1)) ** 2
                costs = (costs[:, :, None] + far[:, None, :]).reshape(len(v), -1)
                codes = (codes[:, :, None] * n + near[:, None, :]).reshape(len(v), -1)
                best = np.argsort(costs, axis=1, kind="stable")[:, :probes]
                codes, costs = np.take_along_axis(codes, best, 1), np.take_along_axis(costs, best, 1)
            out.append((self.d << KEY_BITS) + t * n**self.combined + codes)
        return np.stack(out, axis=1)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, as an isometry."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def _matrices(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and vectors (in double precision) of the rows of each length."""
    offsets = np.asarray(column.offsets)
    lengths, flat = np.diff(offsets), column.flatten().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        starts = offsets[at] - offsets[0]
        yield int(d), at, flat[starts[:, None] + np.arange(d)].astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row; equal rows give equal bits."""
    return (a * b).sum(axis=1)


class Nearest:
    """The ``k`` best ids of each query so far; smaller ids win ties. Memory is bounded by queries x k and a batch."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.queries, self.least = np.empty(0, np.int64), np.empty(0)
        self.q, self.ids, self.scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        self.n = 0

    def places(self, ids: np.ndarray) -> np.ndarray:
        out = np.array([self.place.setdefault(i, len(self.place)) for i in ids.tolist()], np.int64)
        more = len(self.place) - len(self.least)
        if more:
            self.least = np.r_[self.least, np.full(more, -np.inf)]
            self.queries = np.r_[self.queries, np.zeros(more, np.int64)]
        self.queries[out] = ids
        return out

    def add(self, places: np.ndarray, asked: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Rows against the queries at ``places``; only pairs that may count are scored anew by ``products``."""
        length = np.abs(asked).max(initial=0) * np.abs(vectors).max(initial=0) * asked.shape[1]
        step = max(1, SCORES // len(asked))
        for at in range(0, len(ids), step):
            some, own = vectors[at : at + step], ids[at : at + step]
            rough = some @ asked.T
            fit = rough >= (self.least[places] - 1e-12 * length)[None, :]
            fit &= own[:, None] != self.queries[places][None, :]
            if fit.sum(axis=0).max(initial=0) > self.k:  # beyond the k best of a slice only what ties with them
                kth = np.partition(np.where(fit, rough, -np.inf), -self.k, axis=0)[-self.k] if len(some) >= self.k else np.full(len(asked), -np.inf)
                fit &= rough >= (kth - 1e-12 * length)[None, :]
            row, q = np.nonzero(fit)
            for i in range(0, len(row), step):
                r, c = row[i : i + step], q[i : i + step]
                s = products(some[r], asked[c])
                self.q.append(places[c])
                self.ids.append(own[r])
                self.scores.append(s)
                self.n += len(r)
            if self.n > 4 * self.k * max(1000, len(self.place)):
                self.trim()

    def trim(self) -> None:
        q, ids, scores = (np.concatenate(x) for x in (self.q, self.ids, self.scores))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        # found in several tables: equal bits, so repeats are neighbours
        new = np.r_[True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])] if len(q) else np.empty(0, bool)
        q, ids, scores = q[new], ids[new], scores[new]
        first = np.searchsorted(q, q)
        rank = np.arange(len(q)) - first
        full = rank == self.k - 1
        self.least[q[full]] = scores[full]
        keep = rank < self.k
        self.q, self.ids, self.scores = [q[keep]], [ids[keep]], [scores[keep]]
        self.n = int(keep.sum())

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is held, as query, id, score; forgets it."""
        self.trim()
        out = self.queries[self.q[0]], self.ids[0], self.scores[0]
        self.clear()
        return out


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, d, v of the rows that take part."""
    single = dict(df.dtypes)[vector_col] == "array<float>"
    df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    some = F.exists("v", lambda x: x != 0)
    return df.where("id is not null and v is not null").where(~F.coalesce(odd, F.lit(True)) & F.coalesce(some, F.lit(False))).select("id", F.size("v").alias("d"), "v")


def _length(v: str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _with_cells(rows: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """With the keys of the cells of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list = [None] * batch.num_rows
            for d, at, v in _matrices(batch.column(2)):
                for i, c in zip(at.tolist(), spaces[d].cells(v), strict=True):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], names=["id", "d", "v", "cells"])

    return rows.mapInArrow(run, f"id long, d int, v {dict(rows.dtypes)['v']}, cells array<long>")


def _with_probes(asked: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """id, v and key: a row for each cell that a query probes, cut from its batch in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                probes: list = [np.empty(0, np.int64)] * part.num_rows
                for d, where, v in _matrices(part.column(2)):
                    if d in spaces:
                        for i, c in zip(where.tolist(), spaces[d].probed(v, spaces[d].probes), strict=True):
                            probes[i] = c.ravel()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(probes, pa.list_(pa.int64()))], names=["id", "v", "cells"])

    return asked.mapInArrow(run, f"id long, v {dict(asked.dtypes)['v']}, cells array<long>")


def _complete(found: DataFrame, index: DataFrame, asked: DataFrame, spaces: dict[int, Space], k: int, scratch: Scratch) -> DataFrame:
    """``found`` with the neighbours of queries that found fewer than there are, from all rows."""
    there = F.create_map(*[F.lit(x) for d, s in spaces.items() for x in (d, s.rows)]) if spaces else F.create_map().cast("map<int,int>")
    n = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    wanted = F.least(F.lit(k), F.try_element_at(there, F.col("d")) - 1)
    short = scratch.keep(asked.join(n, "id", "left").where(F.coalesce("n", F.lit(0)) < wanted).select("id", "v", "d"), "short")
    numbers = short.agg(F.sum("d")).first()[0]
    if not numbers:
        return found
    blocks, path = -(-numbers // QUERY_NUMBERS), scratch.path("rest")
    for b in range(blocks):
        part = [(r["id"], r["v"]) for r in short.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()]
        if part:
            exact(index, part, k).select("query_id", "id", "score", "rank").write.mode("append").parquet(path)
    rest = index.sparkSession.read.schema(found.schema).parquet(path)
    return found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").select(*found.columns).unionByName(rest)


def exact(index: DataFrame, asked: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """query_id, id, score, rank, cells: the true neighbours of a bounded list of queries, by one scan of all rows."""
    blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(v) for _, v in asked}:
        blocks[d] = np.array([i for i, v in asked if len(v) == d], np.int64), np.array([v for _, v in asked if len(v) == d], np.float64)
    shared = index.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, cells = {d: Nearest(k) for d in shared.value}, {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for d, at, v in _matrices(batch.column(2)):
                if d in shared.value:
                    held = best[d]
                    held.add(held.places(shared.value[d][0]), shared.value[d][1], ids[at], v)
                    held.trim()
            left = set(np.concatenate([h.ids[0] for h in best.values()]).tolist())
            own = {i: n for n, i in enumerate(ids.tolist()) if i in left}
            cells = {i: c for i, c in cells.items() if i in left} | {i: batch.column(3)[n].as_py() for i, n in own.items() if i not in cells}
        for held in best.values():
            q, ids, scores = held.taken()
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids), pa.array(scores), pa.array([cells[i] for i in ids.tolist()], pa.list_(pa.int64()))], names=["query_id", "id", "score", "cells"])

    found = index.select("id", "d", "v", "cells").mapInArrow(run, "query_id long, id long, score double, cells array<long>")
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; hits of several tasks are counted once."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.dense_rank().over(by)).where(F.col("rank") <= k).dropDuplicates(["query_id", "rank"])


def measured(index: DataFrame, asked: DataFrame, space: Space, k: int, sample: int, recall: float) -> tuple[int | None, float]:
    """The fewest probes that find ``recall`` of the true neighbours of sampled queries, None if there are none; and what they find."""
    some = asked.where(F.col("d") == space.d).orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "v").distinct().collect()
    if not some:
        return 1, 1.0
    most = min(2 * space.axes, MOST_PROBES) if space.combined == 1 else MOST_PROBES
    true: dict[int, list] = {}
    for r in exact(index.where(F.col("d") == space.d), [(r["id"], r["v"]) for r in some], k).select("query_id", "cells").collect():
        true.setdefault(r["query_id"], []).append(r["cells"])
    depths = []
    for at in range(0, len(some), 16):
        part = some[at : at + 16]
        for r, keys in zip(part, space.probed(np.array([r["v"] for r in part], np.float64), most), strict=True):
            place = [{c: i for i, c in enumerate(row.tolist())} for row in keys]
            depths += [min(p.get(c, most) for p, c in zip(place, cells, strict=True)) for cells in true.get(r["id"], [])]
    depths = np.sort(depths)
    if not len(depths):
        return 1, 1.0
    last = depths[math.ceil(recall * len(depths)) - 1]
    probes = int(last) + 1 if last < most else None
    return probes, float(np.mean(depths < (probes or most)))


def spaces_of(rows: DataFrame, tables: int) -> dict[int, Space]:
    """A space for each length of vectors; the more rows, the more rotations make a cell."""
    out = {}
    for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max(_length("v")).alias("longest")).collect():
        space = Space(r["d"], r["n"], min(r["longest"], np.finfo(float).max), tables, 1, 1)
        cells, combined = 2 * space.axes, 1
        while r["n"] > CELL * cells**combined and tables * cells ** (combined + 1) < 1 << KEY_BITS:
            combined += 1
        out[r["d"]] = space._replace(combined=combined)
    return out


def built(rows: DataFrame, asked: DataFrame, scratch: Scratch, k: int, tables: int, sample: int, recall: float) -> tuple[DataFrame, dict[int, Space], dict[int, float]]:
    """The index (id, d, v, cells) as a table, its spaces with their probes, and the recall measured for each.

    Where not even ``MOST_PROBES`` probes of combined cells reach ``recall``, a cell is made of one rotation less; at one, all cells can be probed.
    """
    spaces, found, n = spaces_of(rows, tables), {}, 0
    copies = Window.partitionBy("v").orderBy("id")
    rows = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    index = scratch.keep(_with_cells(rows, spaces), "index0")
    for d in spaces:
        while d not in found:
            probes, reached = measured(index, asked, spaces[d], k, sample, recall)
            if probes is None and spaces[d].combined == 1:
                probes = 2 * spaces[d].axes
            if probes:
                found[d], spaces[d] = reached, spaces[d]._replace(probes=probes)
            else:
                spaces[d] = spaces[d]._replace(combined=spaces[d].combined - 1)
                n += 1
                index = scratch.keep(_with_cells(index.drop("cells"), spaces), f"index{n}")
                scratch.drop(f"index{n - 1}")
    return index, spaces, found


def _split(base: DataFrame, probes: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (kind 1) and queries (kind 0) by key, salt and chunk: cells with many rows in salts, with many queries in chunks."""
    base = base.select("id", "v", F.explode("cells").alias("key"))
    probes = probes.select("id", "v", F.explode("cells").alias("key"))
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = base.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("q"))
    counts = counts.unionByName(probes.groupBy("key").agg(F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("q"), F.max(F.size("v")).alias("d")), allowMissingColumns=True)
    counts = scratch.keep(counts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.max("d").alias("d")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # hot cells are few: no more than 4 a partition by rows, and 1 for each block of queries
    rows = max(4096, -(-total // (4 * parts)))
    hot = counts.select("key", F.ceil(F.col("n") / rows).cast("int").alias("salts"), F.ceil(F.col("q") * F.col("d") / QUERY_NUMBERS).cast("int").alias("chunks"))
    hot = scratch.keep(hot.where("salts > 1 or chunks > 1"), "hot")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)) - 1))
    one = lambda n: F.pmod(F.xxhash64("id"), F.greatest(F.coalesce(n, F.lit(1)), F.lit(1))).cast("int")
    base, probes = base.join(hot, "key", "left"), probes.join(hot, "key", "left")
    rows_ = base.select("key", one(F.col("salts")).alias("salt"), each(F.col("chunks")).alias("chunk"), F.lit(1).alias("kind"), "id", "v")
    asked = probes.select("key", each(F.col("salts")).alias("salt"), one(F.col("chunks")).alias("chunk"), F.lit(0).alias("kind"), "id", "v")
    return rows_.unionByName(asked).repartition(parts, "key", "salt", "chunk").sortWithinPartitions("key", "salt", "chunk", "kind")


def _met(dealt: DataFrame, k: int) -> DataFrame:
    """query_id, id, score: each task's k best of the queries of its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, group, asked, places, block = Nearest(k), None, [], None, None
        for batch in batches:
            marks = [batch.column(i).to_numpy() for i in range(4)]
            ids, offsets = batch.column(4).to_numpy(), np.asarray(batch.column(5).offsets)
            flat = batch.column(5).flatten().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                here, kind = tuple(m[a] for m in marks[:3]), marks[3][a]
                v = flat[offsets[a] - offsets[0] : offsets[b] - offsets[0]].reshape(b - a, -1).astype(np.float64)
                if here != group:
                    group, asked, block = here, [], None
                    if len(best.place) > HELD:
                        yield table(best)
                if kind == 0:
                    asked.append((ids[a:b], v))
                elif asked:
                    if block is None:
                        places, block = best.places(np.concatenate([x for x, _ in asked])), np.concatenate([x for _, x in asked])
                    best.add(places, block, ids[a:b], v)
        yield table(best)

    def table(best: Nearest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in best.taken()], names=["query_id", "id", "score"])

    return dealt.mapInArrow(run, "query_id long, id long, score double")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 8, sample: int = 200, recall: float = 0.95
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query (rows with the same columns), its own id left out.

    ``sample`` queries a length are compared with all rows to set the probes, so that ``recall`` of their true neighbours are found.
    """
    scratch = Scratch(vectors.sparkSession, "ann")
    rows, asked = _valid(vectors, id_col, vector_col), _valid(queries, id_col, vector_col)
    index, spaces, _ = built(rows, asked, scratch, k, tables, sample, recall)
    probes = scratch.keep(_with_probes(asked, spaces), "probes")
    found = scratch.keep(_ranked(_met(_split(index, probes, scratch), k), k), "found")
    found = _complete(found, index, asked, spaces, k, scratch)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
