"""Removal of byte strings that occur more than once, by a logarithmic family of suffix arrays.

A byte goes when a string of ``length`` bytes that covers it starts at another place too, in this
document or any other. Matches never cross documents; strings are judged on the input.

1. Every string of ``length`` bytes names one of its grams, the one of least hash; equal strings name
   equal grams at equal offsets. Strings next to each other that name the same place form a
   context. A gram named at one place only has no repeated string: its context is left out.
2. The other contexts are counted by their 128-bit hash; those that occur twice or more are repeated
   as a whole. Bytes are fetched once per context, and only where a gram has different contexts.
3. Different contexts of one gram meet in a task, whose suffixes (cut at ``length`` bytes) pass through an
   index family: each batch gets a suffix array, is merge-scanned against the arrays of all levels,
   and levels of equal size merge, so sizes grow geometrically. Tasks are dealt a bounded number of suffixes.
4. A gram whose contexts hold more than ``per_gram`` strings doesn't fit into one task's index: what it has may be
   a third of all rows. Its contexts are cut into blocks of strings by the gram's offset; blocks are counted by their
   128-bit hash, combined before the shuffle, and only strings of blocks that occur once, a few at either edge of
   a common passage, are counted one by one. Both ways find the same strings.
5. Repeated strings become intervals of their documents; their union is cut out.

Rows are numbered once, in a table that the later steps read, so no hash stands for a document.

Defined results: null is an empty text; texts shorter than ``length`` lose nothing; rows that repeat id
and text are documents of their own, each loses what the other holds; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.scratch import Scratch
from lorewell.llm.shingles import MIX, mixed

GRAM = 100
BLOCK = 1 << 20
PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the ``size`` bytes from each place, by doubling."""
    base, h, span, out, covered = MIX[1], data.astype(np.uint64) + np.uint64(1), 1, None, 0
    rest = size
    while rest:
        if rest & 1:
            tail = h[covered:]
            out = tail if out is None else out[: len(tail)] * base + tail[: len(out)]
            covered += span
        rest >>= 1
        if rest:
            h = h[:-span] * base + h[span:]
            with np.errstate(over="ignore"):  # numbers of 64 bits wrap around
                base, span = base * base, 2 * span
    return mixed(out[: len(data) - size + 1])


def least_places(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each ``width`` keys in a row, from minima of blocks."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Contexts of texts that lie one after another in ``data``: gram hash, first string, strings, offset of the gram.

    ``ends``: where the text that holds a byte ends.
    """
    hashes = gram_hashes(data, gram)
    places = np.arange(len(hashes), dtype=np.uint64)
    least = least_places((hashes & ~PLACE) | places, length - gram + 1) & PLACE
    starts = np.flatnonzero(np.arange(len(least)) + length <= ends[: len(least)])
    named = least[starts].astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(named) != 0) | (np.diff(starts) != 1)
    first = np.flatnonzero(new)
    a = starts[first]
    return hashes[named[first]], a, np.diff(np.append(first, len(starts))), named[first] - a


class SuffixLevels:
    """Suffix arrays of suffixes cut at a fixed length, in levels of geometric size."""

    def __init__(self, length: int) -> None:
        self.kind = np.dtype(f"S{length}")
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.repeated = np.zeros(0, bool)

    def add(self, suffixes: np.ndarray) -> None:
        """``suffixes``: a row of bytes each. Marks every suffix that equals another, old or new."""
        keys = np.ascontiguousarray(suffixes).view(self.kind).ravel()
        first = len(self.repeated)
        self.repeated = np.concatenate([self.repeated, np.zeros(len(keys), bool)])
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], order + first
        same = np.flatnonzero(keys[1:] == keys[:-1])
        self.repeated[ids[same]] = self.repeated[ids[same + 1]] = True
        for old, old_ids in self.levels:  # merge-scan
            at = np.searchsorted(old, keys)
            hit = at < len(old)
            hit[hit] = old[at[hit]] == keys[hit]
            self.repeated[ids[hit]] = self.repeated[old_ids[at[hit]]] = True
        while self.levels and len(self.levels[-1][0]) <= len(keys):  # equal sizes merge
            old, old_ids = self.levels.pop()
            keys, ids = np.concatenate([old, keys]), np.concatenate([old_ids, ids])
            order = np.argsort(keys, kind="stable")  # two runs in order
            keys, ids = keys[order], ids[order]
        self.levels.append((keys, ids))


def runs(marks: np.ndarray) -> list[list[int]]:
    """[first, last] of each run of True."""
    edges = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1], axis=1).tolist()


def _sample(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(seed, doc, loc) of every context; loc packs first string, number of strings and the gram's offset."""

    def some(keys: list[int], texts: list[bytes]) -> pa.RecordBatch | None:
        sizes = np.array([len(t) for t in texts])
        ends = np.repeat(np.cumsum(sizes), sizes)
        data = np.frombuffer(b"".join(texts), np.uint8)
        seeds, a, n, o = contexts(data, ends, length, gram)
        owner = np.searchsorted(np.cumsum(sizes), a, side="right")
        local = a - (np.cumsum(sizes) - sizes)[owner]
        return seeds, np.array(keys)[owner], local, n, o

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(keys, texts, shift):
            seeds, doc, a, n, o = some(keys, texts)
            loc = ((a + shift) << 16) | (n << 8) | o
            return pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(doc, pa.int64()), pa.array(loc, pa.int64())], ["seed", "doc", "loc"])

        for batch in batches:
            keys, texts, held = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if len(text) < length:
                    continue
                if len(text) > BLOCK:  # blocks that share length - 1 bytes hold every string once
                    for at in range(0, len(text) - length + 1, BLOCK):
                        yield emit([key], [text[at : at + BLOCK + length - 1]], at)
                    continue
                keys.append(key)
                texts.append(text)
                held += len(text)
                if held >= BLOCK:
                    yield emit(keys, texts, 0)
                    keys, texts, held = [], [], 0
            if texts:
                yield emit(keys, texts, 0)

    return rows.mapInArrow(run, "seed long, doc long, loc long")


def _packed(out: list[tuple], names: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), names.values(), strict=True)], list(names))


def _places(likely: DataFrame, length: int) -> DataFrame:
    """Every marked context by its hash and where it stands; its bytes stay where they are."""
    names = {"seed": pa.int64(), "cid": pa.binary(), "n": pa.int32(), "o": pa.int32(), "doc": pa.int64(), "a": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, marks in zip(*(batch.column(i) for i in range(3)), strict=True):
                doc, text = doc.as_py(), text.as_py()
                for seed, loc in zip(marks.values.field(0).to_pylist(), marks.values.field(1).to_pylist(), strict=True):
                    a, n, o = loc >> 16, loc >> 8 & 255, loc & 255
                    out.append((seed, xxhash.xxh3_128_digest(text[a : a + n - 1 + length], seed=o), n, o, doc, a))
                if len(out) >= 20_000:
                    yield _packed(out, names)
                    out = []
            if out:
                yield _packed(out, names)

    return likely.mapInArrow(run, "seed long, cid binary, n int, o int, doc long, a long")


def _bytes(wanted: DataFrame, length: int) -> DataFrame:
    """The contexts themselves, from (text, of: array of (seed, cid, n, o, m, a))."""
    names = {"seed": pa.int64(), "cid": pa.binary(), "n": pa.int32(), "o": pa.int32(), "m": pa.int64(), "ctx": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, of in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                for seed, cid, n, o, m, a in zip(*(of.values.field(i).to_pylist() for i in range(6)), strict=True):
                    out.append((seed, cid, n, o, m, text[a : a + n - 1 + length]))
                if len(out) >= 20_000:
                    yield _packed(out, names)
                    out = []
            if out:
                yield _packed(out, names)

    return wanted.mapInArrow(run, "seed long, cid binary, n int, o int, m long, ctx binary")


def _indexed(groups: DataFrame, length: int, batch_rows: int = 512) -> DataFrame:
    """(cid, s, e): runs of repeated strings of contexts, from the index family of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, cids, counts = SuffixLevels(length), [], []
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                some = batch.slice(at, batch_rows)
                ctx, n = some.column(1).to_pylist(), np.array(some.column(2).to_pylist())
                data = np.frombuffer(b"".join(ctx), np.uint8)
                begin = np.concatenate([[0], np.cumsum([len(c) for c in ctx])[:-1]])
                starts = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
                levels.add(np.lib.stride_tricks.sliding_window_view(data, length)[starts])
                cids += some.column(0).to_pylist()
                counts += n.tolist()
        out, at = [], 0
        for cid, n in zip(cids, counts, strict=True):
            out += [(cid, s, e) for s, e in runs(levels.repeated[at : at + n])]
            at += n
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int32(), pa.int32()), strict=True)], ["cid", "s", "e"])

    return groups.mapInArrow(run, "cid binary, s int, e int")


def _blocks(groups: DataFrame, length: int, offsets: int = 8) -> DataFrame:
    """(h, cid, s, e): strings s to e of the contexts that have the gram at ``offsets`` places next to each other."""
    names = {"h": pa.binary(), "cid": pa.binary(), "s": pa.int32(), "e": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                for cid, ctx, n, o in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True):
                    s = 0
                    while s < n:  # string s has the gram at o - s
                        e = min(n - 1, s + (o - s) % offsets)
                        out.append((xxhash.xxh3_128_digest(ctx[s : e + length], seed=o - s), cid, s, e))
                        s = e + 1
                yield _packed(out, names)

    return groups.select("cid", "ctx", "n", "o").mapInArrow(run, "h binary, cid binary, s int, e int")


def _strings(groups: DataFrame, length: int) -> DataFrame:
    """(h, cid, s, c): every string of some blocks of contexts by its hash, from (cid, ctx, of: array of (s, e, c))."""
    names = {"h": pa.binary(), "cid": pa.binary(), "s": pa.int32(), "c": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True)
                yield _packed([(xxhash.xxh3_128_digest(ctx[s : s + length]), cid, s, x["c"]) for cid, ctx, of in rows for x in of for s in range(x["s"], x["e"] + 1)], names)

    return groups.select("cid", "ctx", "of").mapInArrow(run, "h binary, cid binary, s int, c long")


def _crowded(groups: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(cid, s, e): runs of repeated strings of contexts (cid, ctx, n, o), however many share a gram."""
    blocks = scratch.keep(_blocks(groups, length), "blocks")
    counts = scratch.keep(blocks.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("cid", "s", "e")).alias("x")), "counts")
    again = blocks.join(counts.where("c > 1").select("h"), "h", "left_semi").select("cid", "s", "e")
    # one block of each kind; what is not alone counts as repeated already
    some = counts.groupBy("x.cid").agg(F.collect_list(F.struct("x.s", "x.e", "c")).alias("of"))
    strings = scratch.keep(_strings(groups.join(some, "cid"), length), "strings")
    twice = strings.groupBy("h").agg(F.sum("c").alias("c")).where("c > 1").select("h")
    alone = strings.where("c = 1").join(twice, "h", "left_semi").select("cid", "s", F.col("s").alias("e"))
    return again.unionByName(alone)


def _cut(touched: DataFrame) -> DataFrame:
    """doc, n_removed, n_spans, kept_sha256 and kept (the bytes left) of documents with intervals [s, e)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for row in batch.slice(at, 256).to_pylist():
                    kept, spans, last = [], 0, 0
                    for s, e in sorted((x["s"], x["e"]) for x in row["cuts"]):
                        if s > last or not spans:
                            kept.append(row["text"][last:s])
                            spans += 1
                        last = max(last, e)
                    left = b"".join([*kept, row["text"][last:]])
                    out.append((row["doc"], len(row["text"]) - len(left), spans, hashlib.sha256(left).hexdigest(), left))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)],
                    ["doc", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return touched.mapInArrow(run, "doc long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = GRAM, per_gram: int = 125_000, per_task: int = 250_000) -> tuple[DataFrame, DataFrame]:
    """(documents, cuts).

    documents: doc_id, doc (the row's number), n_bytes and sha256 of every row; cuts: doc, n_removed,
    n_spans, kept_sha256 and kept of documents that lose bytes. ``per_gram``: strings of a gram's
    contexts that are indexed by one task; ``per_task``: strings a task indexes, but for its last gram's.
    """
    if not 0 < gram <= length < gram + 255:
        raise ValueError("a gram is shorter than a string, by less than 255 bytes")
    scratch = Scratch(docs.sparkSession, "suffix")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("doc", F.monotonically_increasing_id())
    rows = scratch.keep(rows, "rows")
    samples = scratch.keep(_sample(rows.select("doc", "text"), length, gram), "samples")
    twice = samples.groupBy("seed").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("seed")
    marks = samples.join(twice, "seed", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("seed", "loc")).alias("marks"))
    likely = scratch.keep(rows.select("doc", "text").join(marks, "doc"), "likely")
    scratch.drop("samples")
    places = scratch.keep(_places(likely, length), "places")

    distinct = places.groupBy("cid", "seed", "n", "o").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "a")).alias("at"))
    distinct = scratch.keep(distinct, "contexts")
    grams = distinct.groupBy("seed").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("m")).where("k > 1")
    grams = scratch.keep(grams, "grams")
    total = grams.where(F.col("m") <= per_gram).agg(F.sum("m")).first()[0] or 0
    # bytes are fetched once per context, and only where a gram has different contexts
    wanted = distinct.join(grams.select("seed", "m"), "seed")
    wanted = wanted.groupBy("at.doc").agg(F.collect_list(F.struct("seed", "cid", "n", "o", "m", "at.a")).alias("of"))
    differ = scratch.keep(_bytes(likely.select("doc", "text").join(wanted, "doc").select("text", "of"), length), "differ")
    shared = differ.where(F.col("m") <= per_gram).repartition(max(1, -(-total // per_task)), "seed").select("cid", "ctx", "n")
    crowded = _crowded(differ.where(F.col("m") > per_gram).select("cid", "ctx", "n", "o"), length, scratch)
    whole = distinct.where("c > 1").select("cid", F.lit(0).alias("s"), (F.col("n") - 1).alias("e"))
    found = scratch.keep(_indexed(shared, length).unionByName(crowded).unionByName(whole), "found")
    scratch.drop("differ", "blocks", "counts", "strings", "contexts", "grams")

    cuts = places.select("cid", "doc", "a").join(found, "cid").groupBy("doc").agg(F.collect_set(F.struct((F.col("a") + F.col("s")).alias("s"), (F.col("a") + F.col("e") + length).alias("e"))).alias("cuts"))
    lost = _cut(likely.select("doc", "text").join(cuts, "doc").select("doc", "text", "cuts"))
    plain = rows.select("doc_id", "doc", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"))
    return plain, lost


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    plain, lost = repeated_strings(docs, id_col, text_col, length)
    out = plain.join(lost.drop("kept"), "doc", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))
