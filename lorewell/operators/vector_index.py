"""An inverted-file index of vectors as tables: built once, added to, searched by lists and re-ranked exactly.

Tables below the index's path, all but the small ones sorted by list, so that a filter on lists skips what a search doesn't probe:

* ``lists`` (list, centroid, n): centroids of unit vectors by k-means over a bounded sample;
* ``words`` (part, word, vector): codebooks of the product quantiser, for what a vector differs from its centroid;
* ``codes`` (list, id, code): every vector in a byte per ``PART`` components; ``vectors`` (list, id, v): the vectors;
* ``gone`` (id, batch): ids that were removed, and the last batch the removal is good for;
* ``about``: one row of figures, among them how many lists a search has to probe for the recall that was asked for.

Each table holds batches side by side: a batch that is added is assigned to the centroids that are there and
written as files of its own. No list, and no batch, is held in one task whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators.lexical import top_k
from lorewell.operators.vector import dot, first_of, knn, unit
from lorewell.sources.scratch import shared_path

#: components of a code's byte, and words of a codebook
PART, WORDS = 4, 256
#: lists at most; numbers of the sample that centroids and codebooks are fitted on; rounds of k-means
MOST_LISTS, SAMPLE_NUMBERS, ROUNDS = 4096, 16_000_000, 10
#: queries that are compared with all rows to set the number of lists to probe
MEASURED = 100
#: rows of a list that one task reads, and scores a task holds at once
LIST_ROWS, SCORES = 500_000, 1_000_000
#: numbers of the tables of distances to words that a task holds at once
TABLE = 4_000_000
#: candidates up to which they are sent to every executor instead of shuffling vectors
BROADCAST_CANDIDATES = 1_000_000


def kmeans(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's centroids, begun at rows spread evenly over ``rows``; empty ones move to the rows farthest off."""
    k = min(k, len(rows))
    centres = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own, far = nearest_row(rows, centres)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        centres[empty] = rows[np.argsort(-far, kind="stable")[: len(empty)]]
    return centres


def nearest_row(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and its squared distance less the row's own square."""
    own, far, length = np.empty(len(rows), np.int64), np.empty(len(rows)), (centres**2).sum(axis=1)
    step = max(1, SCORES // len(centres))
    for at in range(0, len(rows), step):
        d = length[None, :] - 2 * rows[at : at + step] @ centres.T
        own[at : at + step] = d.argmin(axis=1)
        far[at : at + step] = d.min(axis=1)
    return own, far + (rows**2).sum(axis=1)


def _parts(rows: np.ndarray) -> np.ndarray:
    """(rows, parts, PART), padded with zeros."""
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % PART))).reshape(len(rows), -1, PART)


def encoded(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The nearest word of each part of each row."""
    cut = _parts(rows)
    return np.stack([nearest_row(cut[:, p], words[p])[0] for p in range(cut.shape[1])], axis=1).astype(np.uint8)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (as it is), u (unit vector) of the vectors that have a direction."""
    df = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), unit(F.col(vector_col)).alias("u"))
    return df.where(F.col("u").isNotNull() & ~F.exists("u", lambda x: x.isNull() | F.isnan(x)))


class VectorIndex:
    """Reads and writes the tables of an index below ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def about(self) -> dict:
        return self.table("about").first().asDict()

    @classmethod
    def build(cls, vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding", lists: int | None = None, recall: float = 0.95, k: int = 10) -> VectorIndex:
        """Fits centroids and codebooks, writes all vectors and measures how many lists find ``recall`` of the ``k`` nearest.

        All vectors of an index have one length, the most frequent one; others aren't indexed.
        """
        spark, rows = vectors.sparkSession, _rows(vectors, id_col, vector_col)
        shape = rows.groupBy(F.size("u").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
        if shape is None:
            raise ValueError("there are no vectors to index")
        d, n = shape["d"], shape["n"]
        index, rows = cls(spark, path), rows.where(F.size("u") == d)
        lists = min(lists or int(np.ceil(np.sqrt(n))), MOST_LISTS, n)
        few = min(max(10_000, 32 * lists), SAMPLE_NUMBERS // d)
        sample = rows.select("u", F.xxhash64("id").alias("h")).orderBy("h").limit(few).select("u")

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            u = np.concatenate([_matrix(b.column(0), d) for b in batches])
            centres = kmeans(u, lists)
            rest = _parts(u - centres[nearest_row(u, centres)[0]])
            words = [kmeans(rest[: 64 * WORDS, p], WORDS) for p in range(rest.shape[1])]
            names = ["kind", "number", "vector"]
            for kind, found in (("list", centres), *((f"part{p}", w) for p, w in enumerate(words))):
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(found)), pa.array(range(len(found)), pa.int32()), pa.array(list(found), pa.list_(pa.float64()))], names=names)

        fitted = shared_path(spark, "fitted")
        sample.repartition(1).mapInArrow(fit, "kind string, number int, vector array<double>").write.parquet(fitted)
        model = spark.read.parquet(fitted)
        model.where("kind = 'list'").select(F.col("number").alias("list"), F.col("vector").alias("centroid")).coalesce(1).write.parquet(f"{index.path}/lists")
        model.where("kind <> 'list'").select(F.substring("kind", 5, 9).cast("int").alias("part"), F.col("number").alias("word"), "vector").coalesce(1).write.parquet(f"{index.path}/words")
        index._write(rows, 0)
        spark.createDataFrame([(d, n, lists, lists, 0.0, 0)], "d int, n long, lists int, probes int, recall double, batch int").coalesce(1).write.parquet(f"{index.path}/about")
        probes, reached = index._measured(k, recall)
        spark.createDataFrame([(d, n, lists, probes, reached, 0)], "d int, n long, lists int, probes int, recall double, batch int").coalesce(1).write.mode("overwrite").parquet(f"{index.path}/about")
        return index

    def add(self, vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> None:
        """Writes a batch beside those that are there, an id's vector in place of an earlier one; nothing is read or written anew but ids."""
        about = self.about()
        rows = _rows(vectors, id_col, vector_col).where(F.size("u") == about["d"])
        batch = about["batch"] + 1
        self._remove(rows.select("id"), batch - 1)
        self._write(rows, batch)
        about |= {"batch": batch, "n": self.table("codes").count()}
        self.spark.createDataFrame([tuple(about.values())], "d int, n long, lists int, probes int, recall double, batch int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/about")

    def remove(self, ids: DataFrame, id_col: str = "id") -> None:
        """Ids that searches leave out from now on; a vector that is added under such an id later is found."""
        self._remove(ids.select(F.col(id_col).alias("id")), self.about()["batch"])

    def _remove(self, ids: DataFrame, batch: int) -> None:
        ids.select("id", F.lit(batch).alias("batch")).write.mode("append").parquet(f"{self.path}/gone")

    def _gone(self) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/gone")
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.table("gone").groupBy("id").agg(F.max("batch").alias("last")) if there else None

    def _model(self) -> tuple[np.ndarray, np.ndarray]:
        """Centroids and codebooks: at most ``MOST_LISTS`` + ``WORDS`` vectors."""
        lists = np.array([r["centroid"] for r in self.table("lists").orderBy("list").collect()])
        found = self.table("words").orderBy("part", "word").toPandas()
        parts = [np.stack(g["vector"].to_numpy()) for _, g in found.groupby("part")]
        return lists, np.stack(parts)

    def _write(self, rows: DataFrame, batch: int) -> None:
        """Assigns and encodes ``rows`` and writes them in order of their lists."""
        d = len(self.table("lists").first()["centroid"])
        shared = self.spark.sparkContext.broadcast(self._model())
        kinds = dict(rows.dtypes)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, words = shared.value
            for part in batches:
                u = _matrix(part.column(2), d)
                own = nearest_row(u, centres)[0]
                code = encoded(u - centres[own], words)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "v", "list", "code"])

        found = rows.select("id", "v", "u").mapInArrow(assign, f"id {kinds['id']}, v {kinds['v']}, list int, code binary").withColumn("batch", F.lit(batch))
        kept = shared_path(self.spark, "assigned")
        found.write.parquet(kept)
        found = self.spark.read.parquet(kept)
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        for name, columns in (("codes", ["list", "id", "code", "batch"]), ("vectors", ["list", "id", "v", "batch"])):
            # ranges of (list, id), so a list of any size is cut into as many tasks as it needs
            found.select(*columns).repartitionByRange(parts, "list", "id").sortWithinPartitions("list", "id").write.mode("append").parquet(f"{self.path}/{name}")

    def _measured(self, k: int, recall: float) -> tuple[int, float]:
        """The fewest lists that hold ``recall`` of the ``k`` nearest of ``MEASURED`` vectors, compared with all; and what they hold."""
        vectors = self.table("vectors")
        some = vectors.orderBy(F.xxhash64("id")).limit(MEASURED).select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
        some = self.spark.createDataFrame(some.collect(), some.schema)
        true = knn(vectors, some, k, "id", "v").join(vectors.select("id", "list"), "id").select("query_id", "list").collect()
        centres, _ = self._model()
        asked = {r["query_id"]: np.array(r["query_vector"], np.float64) for r in some.collect()}
        order = {q: np.argsort(np.argsort((centres**2).sum(axis=1) - 2 * centres @ (v / np.linalg.norm(v)), kind="stable"), kind="stable") for q, v in asked.items()}
        places = np.sort([order[r["query_id"]][r["list"]] for r in true])
        probes = int(places[int(np.ceil(recall * len(places))) - 1]) + 1
        return probes, float((places < probes).mean())

    def search(self, queries: DataFrame, k: int = 10, candidates: int | None = None, probes: int | None = None, query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
        """query_id, id, score = (1 + cosine) / 2 to six places, rank: of ``candidates`` by code (10 x k), the ``k`` best by their vectors."""
        found = self.candidates(queries, candidates or 10 * k, probes, query_id, query_vector)
        path = shared_path(self.spark, "candidates")
        found.write.parquet(path)
        found = self.spark.read.schema(found.schema).parquet(path)
        few = found.limit(BROADCAST_CANDIDATES + 1).count() <= BROADCAST_CANDIDATES
        lists = [r["list"] for r in found.select("list").distinct().collect()]  # at most MOST_LISTS
        near = F.broadcast if few else (lambda df: df)
        rows = self.table("vectors").where(F.col("list").isin(lists)).select("list", "id", "batch", unit(F.col("v")).alias("u"))
        asked = queries.select(F.col(query_id).alias("query_id"), unit(F.col(query_vector)).alias("q"))
        both = rows.join(near(found.select("query_id", "list", "id", "batch")), ["list", "id", "batch"]).join(asked, "query_id")
        return top_k(both.select("query_id", "id", F.round((1 + dot(F.col("u"), F.col("q"))) / 2, 6).alias("score")), k)

    def candidates(self, queries: DataFrame, n: int, probes: int | None = None, query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
        """query_id, list, id, batch, score, rank: the ``n`` best of each query by their codes, from the lists nearest to it."""
        about, shared = self.about(), self.spark.sparkContext.broadcast(self._model())
        d, probes = about["d"], min(probes or about["probes"], about["lists"])
        asked = queries.select(F.col(query_id).alias("query_id"), unit(F.col(query_vector)).alias("u")).where(F.size("u") == d)
        kinds, codes = dict(asked.dtypes), self.table("codes")

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, _ = shared.value
            for part in batches:
                if part.num_rows:
                    far = (centres**2).sum(axis=1)[None, :] - 2 * _matrix(part.column(1), d) @ centres.T
                    near = np.argsort(far, axis=1, kind="stable")[:, :probes].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(near), pa.list_(pa.int32()))], names=["query_id", "u", "lists"])

        wanted = asked.mapInArrow(probe, f"query_id {kinds['query_id']}, u array<double>, lists array<int>")
        wanted = wanted.select("query_id", "u", F.explode("lists").alias("list"))
        sizes = {r["list"]: r["n"] for r in codes.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number a list
        big = {number: -(-n_ // LIST_ROWS) for number, n_ in sizes.items() if n_ > LIST_ROWS}
        salts = F.coalesce(F.create_map(*[F.lit(x) for kv in big.items() for x in kv])[F.col("list")], F.lit(1)) if big else F.lit(1)
        rows = codes.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int"))
        gone = self._gone()
        if gone is not None:
            rows = rows.join(gone, "id", "left").where(F.coalesce(F.col("batch") > F.col("last"), F.lit(True))).drop("last")
        no = lambda kind: F.lit(None).cast(kind)
        rows = rows.select("list", "salt", F.lit(1).alias("kind"), no(kinds["query_id"]).alias("query_id"), no("array<double>").alias("u"), "id", "code", "batch")
        wanted = wanted.select("list", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), "query_id", "u", no(dict(codes.dtypes)["id"]).alias("id"), no("binary").alias("code"), F.lit(0).alias("batch"))
        dealt = rows.unionByName(wanted).repartition("list", "salt").sortWithinPartitions("list", "salt", "kind")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, words = shared.value
            best, group, asked, held, types = Best(n), None, [], None, None
            for part in batches:
                types = [part.schema.field(i).type for i in (3, 0, 5, 7)] + [pa.float64()]
                lists, salt, kind = (part.column(i).to_numpy() for i in range(3))
                cuts = np.flatnonzero((lists[1:] != lists[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), part.num_rows], strict=True):
                    if a == b:
                        continue
                    if (lists[a], salt[a]) != group:
                        group, asked, held = (lists[a], salt[a]), [], None
                    if kind[a] == 0:
                        asked.append((part.column(3).slice(a, b - a).to_pylist(), _matrix(part.column(4).slice(a, b - a), d)))
                    elif asked:
                        if held is None:
                            held = best.places([q for x, _ in asked for q in x]), np.concatenate([x for _, x in asked])
                        code = np.frombuffer(b"".join(part.column(6).slice(a, b - a).to_pylist()), np.uint8).reshape(b - a, -1)
                        ids, batch = part.column(5).slice(a, b - a).to_numpy(zero_copy_only=False), part.column(7).slice(a, b - a).to_numpy()
                        step = max(1, TABLE // words[..., 0].size)
                        for at in range(0, len(held[0]), step):
                            u = held[1][at : at + step]
                            best.add(held[0][at : at + step], u @ centres[lists[a]], np.einsum("qps,pws->qpw", _parts(u), words), code, int(lists[a]), ids, batch)
            if types:
                yield best.taken(types)

        schema = f"query_id {kinds['query_id']}, list int, id {dict(codes.dtypes)['id']}, batch int, score double"
        return top_k(dealt.mapInArrow(meet, schema), n)


class Best:
    """The ``n`` best codes of each query that a task has seen, as arrays; memory is bounded by queries x n and a step of ``SCORES``."""

    def __init__(self, n: int) -> None:
        self.n, self.place, self.least, self.held, self.rows = n, {}, np.empty(0), [], 0

    def places(self, names: list) -> np.ndarray:
        out = np.array([self.place.setdefault(x, len(self.place)) for x in names], np.int32)
        self.least = np.r_[self.least, np.full(len(self.place) - len(self.least), -np.inf)]
        return out

    def add(self, places: np.ndarray, base: np.ndarray, table: np.ndarray, code: np.ndarray, number: int, ids: np.ndarray, batch: np.ndarray) -> None:
        step = max(1, SCORES // len(places))
        for at in range(0, len(code), step):
            some = code[at : at + step]
            scores = np.repeat(base[:, None], len(some), axis=1)
            for p in range(some.shape[1]):
                scores += table[:, p, some[:, p]]
            scores = np.round(scores, 9)  # equal codes are equal whatever the order of sums
            least = self.least[places]
            if len(some) > self.n:
                least = np.maximum(least, np.partition(scores, len(some) - self.n, axis=1)[:, len(some) - self.n])
            q, row = np.nonzero(scores >= least[:, None])
            self.held.append((places[q], np.full(len(q), number, np.int32), ids[at : at + step][row], batch[at : at + step][row], scores[q, row]))
            self.rows += len(q)
            if self.rows > max(SCORES, 2 * self.n * len(self.place)):
                self.trim()

    def trim(self) -> None:
        if not self.held:
            return
        every = [np.concatenate(x) for x in zip(*self.held, strict=True)]
        best = first_of(every[0], every[4], every[2], self.n)
        every = [x[best] for x in every]
        n = np.bincount(every[0], minlength=len(self.place))
        last, full = np.cumsum(n) - 1, n >= self.n
        self.least[full] = every[4][last[full]]
        self.held, self.rows = [tuple(every)], len(best)

    def taken(self, types: list[pa.DataType]) -> pa.RecordBatch:
        self.trim()
        names = ["query_id", "list", "id", "batch", "score"]
        if not self.held:
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names=names)
        q, *others = self.held[0]
        own = [pa.array(list(self.place), types[0]).take(pa.array(q)), *[pa.array(x, t, from_pandas=True) for x, t in zip(others, types[1:], strict=True)]]
        return pa.RecordBatch.from_arrays(own, names=names)
