"""A stored full-text index: postings in blocks with their bounds, batches added beside, merged in levels.

Below the index's path stand segments and a versioned manifest of them. A segment deals its chunks into ranges of about
``block`` chunks by a hash of their id, and holds for every (term, range) one row: the ids, counts and lengths of the chunks, how
many they are, the largest count and the least length; the row without a term holds all chunks of the range. A file has
whole ranges, and its rows are sorted by term, so a search reads those of its terms.

A search reads the figures of its terms' blocks first. What a term can add to a score in a block is bounded by
the largest count and the least length, so the sum over a query's terms bounds every chunk of a range.
The ranges of the highest bounds are scored, and then only those whose bound reaches the k-th
score found. All scores are those of ``lexical.bm25`` over the same chunks.

A batch's texts are shuffled once, by range, and cut there, so neither tokens nor postings are rows of a shuffle; a search shuffles
blocks as they are. A batch is a new segment of level 0; ``FAN`` segments of a level are merged into one of the next, so a chunk is
rewritten as often as there are levels. Removed ids are a table; their chunks are left out of every result at once and of
the statistics when their segment is merged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators.lexical import B, BROADCAST_TERMS, K1, query_terms, top_k
from lorewell.operators.vector import first_of
from lorewell.sources.scratch import kept, shared_path

#: chunks of a range, segments of a level that are merged, and ranges of a query that are scored first
BLOCK, FAN, FIRST = 256, 4, 4
#: terms that are named in the filter of the scan
NAMED_TERMS = 10_000
#: numbers of a matrix of queries and terms, or queries and chunks, that a task holds at once
NUMBERS = 4_000_000
MANIFEST = "segment string, level int, batch int, ranges int, chunks long, tokens long"
#: tokens in a row that is handed to Python
PART = 256
#: ranges that are sent to every executor
BROADCAST_RANGES = 100_000


class TextIndex:
    """Reads and writes an index below ``path``; ``create`` makes an empty one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, block: int = BLOCK, fan: int = FAN) -> TextIndex:
        index = cls(spark, path)
        spark.createDataFrame([(block, fan)], "block int, fan int").coalesce(1).write.parquet(f"{index.path}/about")
        index._publish([], 0)
        return index

    # what is there

    def _folder(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self) -> tuple[list[dict], int]:
        """The segments of the last version, and its number. A version is written whole before it counts."""
        at, files = self._folder("manifest")
        version = max(int(s.getPath().getName().split("=")[1]) for s in files.listStatus(at) if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/version={version}").collect()
        return [r.asDict() for r in rows], version

    def _publish(self, segments: list[dict], version: int) -> None:
        rows = [tuple(s[c] for c in ("segment", "level", "batch", "ranges", "chunks", "tokens")) for s in segments]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/version={version}")

    def segments(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(s.values()) for s in self._manifest()[0]], MANIFEST)

    def _gone(self) -> DataFrame | None:
        """id, last: removed ids, and the last batch that the removal holds for."""
        at, files = self._folder("gone")
        return self.spark.read.parquet(f"{self.path}/gone").groupBy("id").agg(F.max("batch").alias("last")) if files.exists(at) else None

    def _read(self, segments: list[dict]) -> DataFrame:
        """Blocks of segments, with the segment's place in the list and its batch."""
        df = None
        for i, s in enumerate(segments):
            one = self.spark.read.parquet(f"{self.path}/segments/{s['segment']}/blocks").withColumns({"segment": F.lit(i), "batch": F.lit(s["batch"])})
            df = one if df is None else df.unionByName(one)
        return df

    # writing

    def add(self, chunks: DataFrame, id_col: str = "id", content_col: str = "content") -> None:
        """A batch, in place of chunks of the same ids; segments are merged where ``fan`` of a level have come together.

        Of rows that share an id within a batch, one is kept.
        """
        segments, version = self._manifest()
        batch = max([s["batch"] for s in segments], default=0) + 1
        rows = chunks.select(F.col(id_col).alias("id"), F.coalesce(F.col(content_col).cast("string"), F.lit("")).alias("content")).where("id is not null")
        if segments:
            held = self._read(segments).where("term is null").select(F.explode("ids").alias("id"))
            again = rows.select("id").join(held, "id", "left_semi").distinct()
            again.withColumn("batch", F.lit(batch - 1)).write.mode("append").parquet(f"{self.path}/gone")
        ranges, parts = self._ranges(rows.count()), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        kind = rows.schema["id"].dataType.simpleString()
        dealt = rows.withColumn("range", _range(ranges)).repartition(parts, "range").sortWithinPartitions("range", "id", F.desc("content"))
        cut = dealt.select("range", "id", T.tokens(F.col("content")).alias("t")).select("range", "id", F.size("t").alias("length"), "t")
        places = F.sequence(F.lit(0), F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / PART).cast("int"))
        cut = cut.select("range", "id", "length", F.posexplode_outer(F.transform(places, lambda i: F.slice("t", i * PART + 1, F.lit(PART)))).alias("part", "t"))
        blocks = cut.mapInArrow(lambda batches: map(_counted, _groups(batches, 1)), _blocks_schema(kind))
        segments.append(self._write(blocks, ranges, 0, batch))
        self._publish(segments, version + 1)
        self._merge()

    def remove(self, ids: DataFrame, id_col: str = "id") -> None:
        """Ids that no search finds from now on, until they are added again."""
        batch = max([s["batch"] for s in self._manifest()[0]], default=0)
        ids.select(F.col(id_col).alias("id"), F.lit(batch).alias("batch")).write.mode("append").parquet(f"{self.path}/gone")

    def _ranges(self, chunks: int) -> int:
        block = self.spark.read.parquet(f"{self.path}/about").first()["block"]
        return max(1, -(-chunks // block))

    def _write(self, blocks: DataFrame, ranges: int, level: int, batch: int) -> dict:
        """A segment from its blocks, whose ranges are whole in a task."""
        name = uuid.uuid4().hex
        blocks.sortWithinPartitions("term", "range").write.parquet(f"{self.path}/segments/{name}/blocks")
        own = self.spark.read.parquet(f"{self.path}/segments/{name}/blocks").where("term is null")
        tokens = F.aggregate("lengths", F.lit(0).cast("long"), lambda acc, x: acc + x)
        size = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens")).first()
        return {"segment": name, "level": level, "batch": batch, "ranges": ranges, **size.asDict()}

    def compact(self) -> None:
        """All segments in one, without removed chunks."""
        segments, version = self._manifest()
        if segments:
            self._join(segments, segments, version)

    def _merge(self) -> None:
        """Merges the lowest level that is full, until none is; only the segments of that level are read and written."""
        fan = self.spark.read.parquet(f"{self.path}/about").first()["fan"]
        while True:
            segments, version = self._manifest()
            full = [lv for lv in sorted({s["level"] for s in segments}) if sum(s["level"] == lv for s in segments) >= fan]
            if not full:
                return
            self._join([s for s in segments if s["level"] == full[0]], segments, version)

    def _join(self, old: list[dict], segments: list[dict], version: int) -> None:
        """One segment of the next level in place of ``old``; what was removed since goes."""
        ranges, parts = self._ranges(sum(s["chunks"] for s in old)), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = self._read(old).select("term", "batch", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("e")).select("term", F.col("e.ids").alias("id"), F.col("e.tfs").alias("tf"), F.col("e.lengths").alias("length"), "batch")
        kind, gone = rows.schema["id"].dataType.simpleString(), self._gone()
        if gone is not None:
            rows = rows.unionByName(gone.select(F.lit(None).cast("string").alias("term"), F.col("id").cast(kind).alias("id"), F.lit(-1).alias("tf"), F.lit(0).alias("length"), F.col("last").alias("batch")))
        dealt = rows.select(_range(ranges).alias("range"), "*").repartition(parts, "range").sortWithinPartitions("range")
        blocks = dealt.mapInArrow(lambda batches: (b for b in map(_joined, _groups(batches, 1)) if b is not None), _blocks_schema(kind))
        merged = self._write(blocks, ranges, max(s["level"] for s in old) + 1, max(s["batch"] for s in old))
        self._publish([s for s in segments if s not in old] + [merged], version + 1)
        for s in old:
            at, files = self._folder(f"segments/{s['segment']}")
            files.delete(at, True)

    # searching

    def _bounds(self, queries: DataFrame, query_id: str, query_text: str) -> tuple[DataFrame, DataFrame] | None:
        """(blocks of the queries' terms; query_id, segment, range, bound with the terms' idf and times): what can be said without reading an entry."""
        segments, _ = self._manifest()
        if not segments:
            return None
        terms = query_terms(queries, query_id, query_text)
        path = shared_path(self.spark, "asked")
        terms.write.parquet(path)
        terms = self.spark.read.schema(terms.schema).parquet(path)
        wanted = terms.select("term").distinct()
        named = [r["term"] for r in wanted.limit(NAMED_TERMS + 1).collect()]
        few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        near = F.broadcast if few else (lambda df: df)
        blocks = self._read(segments)
        blocks = blocks.where(F.col("term").isin(named)) if len(named) <= NAMED_TERMS else blocks.join(near(wanted), "term", "left_semi")
        total, tokens = sum(s["chunks"] for s in segments), sum(s["tokens"] for s in segments)
        heads = blocks.select("segment", "range", "term", "n", "most", "least").join(near(terms), "term")
        df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log1p((F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        heads = heads.join(near(df), "term").withColumns({"gain": F.col("times") * idf, "mean": F.lit(tokens / total)})
        heads = heads.withColumn("most_gain", F.col("gain") * _weight(F.col("most"), F.col("least"), F.col("mean")))
        path = shared_path(self.spark, "bounds")
        heads.select("query_id", "segment", "range", "term", "n", "gain", "mean", "most_gain").write.parquet(path)
        return blocks, self.spark.read.parquet(path)

    def _scores(self, blocks: DataFrame, heads: DataFrame, k: int, among: DataFrame | None = None, gains: DataFrame | None = None) -> DataFrame:
        """query_id, id, score of the chunks in the ranges that ``among`` (of ``heads``, if not given) names: at least the ``k`` best of each query.

        All postings of a chunk in a segment are in one range, so a range is scored whole in one task: its blocks are shuffled
        as they are, however many queries have their terms, beside the ids that were removed from it. What the terms add (``gains``)
        is sent to every executor where there are ``BROADCAST_TERMS`` at most, and dealt to the ranges otherwise. Of a range and a
        query no more than ``k`` rows leave the task.
        """
        keys, kind, query_kind = ["segment", "range"], blocks.schema["ids"].dataType.elementType.simpleString(), dict(heads.dtypes)["query_id"]
        among = heads.select("query_id", *keys).distinct() if among is None else among
        gains = _gains(heads) if gains is None else gains
        few = gains.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        told = self.spark.sparkContext.broadcast(gains.toArrow().combine_chunks()) if few else None
        asked = among.select(*keys).distinct()
        near = F.broadcast if asked.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES else (lambda df: df)
        kinds = {"kind": "int", "term": "string", "batch": "int", "ids": f"array<{kind}>", "tfs": "array<int>", "lengths": "array<int>", "query_id": query_kind, "gain": "double", "mean": "double"}
        row = lambda df, **known: df.select(*keys, *[known.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
        own = lambda *names: {c: F.col(c) for c in names}
        dealt = row(blocks.join(near(asked), keys, "left_semi"), kind=F.lit(1), **own("term", "batch", "ids", "tfs", "lengths"))
        wanted = row(among, kind=F.lit(0), **own("query_id")) if few else row(heads.join(among, ["query_id", *keys]), kind=F.lit(0), **own("term", "query_id", "gain", "mean"))
        dealt = dealt.unionByName(wanted)
        segments, gone = self._manifest()[0], self._gone()
        for i, s in enumerate(segments if gone is not None else []):
            some = gone.where(F.col("last") >= s["batch"]).select(F.col("id").cast(kind).alias("id"), "last").select(F.lit(i).alias("segment"), _range(s["ranges"]).alias("range"), "id", "last")
            dealt = dealt.unionByName(row(some.join(near(asked), keys, "left_semi"), kind=F.lit(2), ids=F.array("id"), batch=F.col("last")))
        dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
        return dealt.mapInArrow(lambda batches: (b for rows in _groups(batches, 2) for b in scored_range(rows, k, told.value if told else None)), f"query_id {query_kind}, id {kind}, score double")

    def _chosen(self, blocks: DataFrame, heads: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(scores of the first ranges; query_id, segment, range of the first, and of the others that may still count; gains)."""
        ranges = heads.groupBy("query_id", "segment", "range").agg(F.sum("most_gain").alias("bound"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "range"))
        path = shared_path(self.spark, "ranges")
        ranges.withColumn("place", place).write.parquet(path)
        ranges = self.spark.read.parquet(path)
        keys = ["query_id", "segment", "range"]
        first, gains = ranges.where(F.col("place") <= FIRST).select(*keys), kept(_gains(heads), "gains")
        path = shared_path(self.spark, "first")
        self._scores(blocks, heads, k, first, gains).write.parquet(path)
        scores = self.spark.read.parquet(path)
        least = top_k(scores, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        later = ranges.where(F.col("place") > FIRST).join(least, "query_id", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - 1e-5)  # scores are rounded
        return scores, first, later.select(*keys), gains

    def search(self, queries: DataFrame, k: int = 10, query_id: str = "query_id", query_text: str = "query") -> DataFrame:
        """query_id, id, score, rank: as ``top_k`` of ``bm25`` over the chunks that were added and not removed."""
        found = self._bounds(queries, query_id, query_text)
        if found is None:
            kind = dict(queries.dtypes)[query_id]
            return self.spark.createDataFrame([], f"query_id {kind}, id string, score double, rank int")
        scores, _, later, gains = self._chosen(*found, k)
        return top_k(scores.unionByName(self._scores(*found, k, later, gains)), k)

    def scored(self, queries: DataFrame, hits: DataFrame, query_id: str = "query_id", query_text: str = "query") -> DataFrame:
        """query_id, id, score of given ``hits`` (query_id, id, content), by the index's statistics; those that share no term have none."""
        found = self._bounds(queries, query_id, query_text)
        if found is None:
            return hits.select("query_id", "id", F.lit(0.0).alias("score")).limit(0)
        gains = _gains(found[1])
        words = hits.select("query_id", "id", T.tokens(F.col("content")).alias("t"))
        words = words.select("query_id", "id", F.size("t").alias("length"), F.explode_outer("t").alias("term")).where("term is not null")
        tf = words.groupBy("query_id", "id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
        part = F.col("gain") * _weight(F.col("tf"), F.col("length"), F.col("mean"))
        return tf.join(gains, ["query_id", "term"]).groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))

    def reads(self, queries: DataFrame, k: int, query_id: str = "query_id", query_text: str = "query") -> DataFrame:
        """postings, read: entries that the queries' terms have, and those that a search for ``k`` reads. A row."""
        blocks, heads = self._bounds(queries, query_id, query_text)
        _, first, later, _ = self._chosen(blocks, heads, k)
        every = heads.agg(F.sum("n").alias("postings"))
        return every.crossJoin(heads.join(first.unionByName(later), ["query_id", "segment", "range"]).agg(F.sum("n").alias("read")))  # a row each


def _weight(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _gains(heads: DataFrame) -> DataFrame:
    """query_id, term, gain, mean: what a term adds to a query's scores, without a chunk's weight."""
    return heads.select("query_id", "term", "gain", "mean").distinct()


def _range(ranges: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int")


def _blocks_schema(kind: str) -> str:
    return f"term string, range int, ids array<{kind}>, tfs array<int>, lengths array<int>, n long, most int, least int"


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of one group each, by the first ``keys`` columns (numbers), of batches in their order."""
    group, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        numbers = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        cuts = np.flatnonzero((numbers[:, 1:] != numbers[:, :-1]).any(axis=0)) + 1
        for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            own = tuple(numbers[:, at].tolist())
            if own != group and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            group = own
            held.append(batch.slice(at, end - at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(rows: pa.Table, name: str) -> pa.Array:
    """A column as one array."""
    found = rows.column(name)
    return found.chunk(0) if found.num_chunks == 1 else found.combine_chunks()


def _packed(number: int, names: pa.Array, term: np.ndarray, ids: pa.Array, tf: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """The blocks of one range from its postings, in order of ``term`` (places in ``names``, -1 for the chunks themselves)."""
    begins = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    ends = pa.array(np.r_[begins, len(term)], pa.int32())
    lists = [pa.ListArray.from_arrays(ends, x) for x in (ids, pa.array(tf, pa.int32()), pa.array(length, pa.int32()))]
    first = term[begins]
    named = names.cast(pa.string()).take(pa.array(np.maximum(first, 0), mask=first < 0)) if len(names) else pa.nulls(len(first), pa.string())
    n, most, least = np.diff(np.r_[begins, len(term)]), np.maximum.reduceat(tf, begins), np.minimum.reduceat(length, begins)
    columns = [named, pa.array(np.full(len(first), number), pa.int32()), *lists, pa.array(n, pa.int64()), pa.array(most, pa.int32()), pa.array(least, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["term", "range", "ids", "tfs", "lengths", "n", "most", "least"])


def _counted(rows: pa.Table) -> pa.RecordBatch:
    """Blocks of one range from the tokens of its chunks (range, id, length, part, t), by id; of repeated ids the first counts."""
    begins = np.flatnonzero(_column(rows, "part").to_numpy() == 0)
    heads = rows.select(["id", "length"]).take(pa.array(begins))
    ids, length = _column(heads, "id"), _column(heads, "length").to_numpy()
    code = ids.dictionary_encode().indices.to_numpy()
    fresh = np.r_[True, code[1:] != code[:-1]]
    tokens = _column(rows, "t")
    words = tokens.flatten().dictionary_encode()
    chunk = np.repeat(np.searchsorted(begins, np.arange(rows.num_rows), "right") - 1, pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())
    held = fresh[chunk]
    key, tf = np.unique(words.indices.to_numpy()[held].astype(np.int64) * len(begins) + chunk[held], return_counts=True)
    own = np.flatnonzero(fresh)
    term, chunk, tf = np.r_[np.full(len(own), -1), key // len(begins)], np.r_[own, key % len(begins)], np.r_[np.zeros(len(own), np.int64), tf]
    return _packed(rows.column("range")[0].as_py(), words.dictionary, term, ids.take(pa.array(chunk)), tf, length[chunk])


def _joined(rows: pa.Table) -> pa.RecordBatch | None:
    """Blocks of one range from postings (range, term, id, tf, length, batch), without those that were removed after their batch (rows of tf -1)."""
    ids, tf, batch = _column(rows, "id").dictionary_encode(), _column(rows, "tf").to_numpy(), _column(rows, "batch").to_numpy()
    code = ids.indices.to_numpy()
    last = np.full(len(ids.dictionary), np.iinfo(np.int64).min)
    np.maximum.at(last, code[tf < 0], batch[tf < 0])
    held = np.flatnonzero((tf >= 0) & (batch > last[code]))
    if not len(held):
        return None
    words = _column(rows, "term").dictionary_encode()
    term = pc.fill_null(words.indices, -1).to_numpy()[held]
    place = np.empty(len(ids.dictionary), np.int64)
    place[pc.sort_indices(ids.dictionary).to_numpy()] = np.arange(len(place))
    order = np.lexsort((place[code[held]], term))
    held, term = held[order], term[order]
    return _packed(rows.column("range")[0].as_py(), words.dictionary, term, _column(rows, "id").take(pa.array(held)), tf[held], _column(rows, "length").to_numpy()[held])


def scored_range(rows: pa.Table, k: int, gains: pa.Table | None = None) -> Iterator[pa.RecordBatch]:
    """The ``k`` best chunks of each query in one range, from rows of the queries (kind 0), blocks (kind 1) and removed ids (kind 2).

    Rows of kind 0 name a query each where ``gains`` has the terms of all queries, and otherwise a query's term with its gain.
    """
    kind = _column(rows, "kind").to_numpy()
    wanted, blocks, gone = (rows.take(pa.array(np.flatnonzero(kind == i))) for i in range(3))
    if not wanted.num_rows or not blocks.num_rows:
        return
    if gains is not None:
        wanted = gains.filter(pc.is_in(_column(gains, "query_id"), value_set=_column(wanted, "query_id")))
    n = pc.list_value_length(_column(blocks, "ids")).to_numpy()
    flat = lambda name: _column(blocks, name).flatten()
    terms, ids, tf, length = _column(blocks, "term").dictionary_encode(), flat("ids").dictionary_encode(), flat("tfs").to_numpy(), flat("lengths").to_numpy()
    term, chunk = np.repeat(terms.indices.to_numpy(), n), ids.indices.to_numpy()
    queries = _column(wanted, "query_id").dictionary_encode("encode")
    own = pc.index_in(_column(wanted, "term"), value_set=terms.dictionary)
    held = pc.is_valid(own).to_numpy(zero_copy_only=False)
    own, q = pc.fill_null(own, 0).to_numpy()[held], queries.indices.to_numpy()[held]
    gain, mean = _column(wanted, "gain").to_numpy()[held], _column(wanted, "mean").to_numpy()[0]
    weights = np.zeros((len(terms.dictionary), len(ids.dictionary)))
    weights[term, chunk] = _weight(tf, length, mean)
    if gone.num_rows:  # of the segment's batch or a later one
        place = pc.index_in(_column(gone, "ids").flatten(), value_set=ids.dictionary).drop_null().to_numpy()
        weights[:, place] = 0
    step = max(1, NUMBERS // max(weights.shape))
    order = ids.dictionary.to_numpy(zero_copy_only=False)
    for at in range(0, len(queries.dictionary), step):
        some = (q >= at) & (q < at + step)
        gains = np.zeros((min(step, len(queries.dictionary) - at), len(weights)))
        gains[q[some] - at, own[some]] = gain[some]
        scores = gains @ weights
        hit, chunk = np.nonzero(scores > 0)
        score = np.round(scores[hit, chunk], 6)
        best = first_of(hit, score, order[chunk], k)
        yield pa.RecordBatch.from_arrays([queries.dictionary.take(pa.array(hit[best] + at)), ids.dictionary.take(pa.array(chunk[best])), pa.array(score[best])], names=["query_id", "id", "score"])
