"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A shingle hash is first permuted by one permutation, then its place is shifted circularly by 0,
1, 2, ... steps before a second permutation; the least value for each shift is a coordinate of the
signature. Two permutations of 2^32 places so give all coordinates, with no table of seeds.

Texts with the same shingle set are one class and are compared once. Classes that share a band
meet in a bucket, and no bucket is expanded into pairs:

1. Every class is compared with its buckets' hubs. The hub is the member that meets most classes over
   all its buckets, so one group of copies shares few hubs and a class has few pairs.
2. Links merge classes into components. Only buckets that still hold several are open.
3. Classes of open buckets meet through their rarest shingles: those of one component alone come
   first, as they can't be shared across components, then the others by frequency. A link
   needs a common shingle at a place that leaves room for the overlap it asks for. So an outlier of a
   crowded group, rich in shingles of its own, gets no pairs, and no link is lost.

Step 3 compares all classes of open buckets, not only those that share one. A pair that is never
compared lies inside one component already, so components are those of all links between candidates.

Bound: letters of one form, with an eighth to a fifth of shingles of their own, may be compared pairwise inside step 3's
join, where no pair becomes a row; 32,000 such letters took 78 s where 8,000 took 19 s.

With bands of 8 coordinates, 50 bands miss a pair of similarity 0.8 with probability 1e-4.

Defined results: texts that are null or have no words have an empty set and are linked with
nothing; shorter texts than a shingle are one shingle; rows of one id are one node; a null id has
a null component and is kept; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm.components import connected_components
from lorewell.llm.scratch import Scratch
from lorewell.llm.shingles import WordHashes, as_bytes, mixed, shingle_set

STEP = np.uint32(0x9E3779B1)
SECOND = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
COLUMNS = 1024


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash coordinates of a non-empty set of 64-bit shingle hashes."""
    first = (mixed(shingles) >> np.uint64(32)).astype(np.uint32)  # place under the first permutation
    shifts = (np.arange(size, dtype=np.uint32) * STEP)[:, None]
    out = np.full(size, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(first), COLUMNS):  # blocks that stay in cache
        x = first[None, at : at + COLUMNS] + shifts
        x *= SECOND[0]  # the second permutation
        x ^= x >> np.uint32(15)
        x *= SECOND[1]
        np.minimum(out, x.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key a band; equal coordinates in different bands give different keys."""
    rows = sig.reshape(bands, -1).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in rows.T:
        key = mixed(key * np.uint64(0x100000001B3) + column)
    return key.astype(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole set) and band keys of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in as_bytes(batch.column(1)):
                s = shingle_set(text, k, hashes)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(signature(s, bands * rows), bands) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, bands array<long>")


def _sets(docs: DataFrame, id_col: str, text_col: str, k: int, wanted: DataFrame) -> DataFrame:
    """id and full shingle set of the documents in ``wanted`` (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(text, k, hashes).astype(np.int64) for text in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(wanted, "id", "left_semi")
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, shingles array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, per_task: int = 2000) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``percent`` / 100 or more.

    A class with very many pairs is no hot key: its set is repeated for every ``per_task`` of them.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(per_task)).alias("salts"))
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")).join(salts, "a")
    a = a.select("a", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    salted = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt"))
    both = salted.join(b, "b").join(a, ["a", "salt"])
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("all"))
    return both.where(F.lit(100) * F.col("n") >= F.lit(percent) * (F.col("all") - F.col("n"))).select("a", "b")


def _close(n: str, m: str, percent: int) -> Column:
    """Sets of sizes too different can't be that similar."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _across(groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, from ``groups`` (id, component, shingles).

    Sets of sizes n and m are linked only if they share o = percent / (100 + percent) * (n + m) shingles;
    so the first of their common ones, in any order that all sets share, has o - 1 others behind it in both.
    """
    words = groups.select("id", F.col("component").alias("c"), F.size("shingles").alias("n"), F.explode("shingles").alias("t"))
    rank = words.groupBy("t").agg(F.count(F.lit(1)).alias("f"), F.min("c").alias("l"), F.max("c").alias("h")).where("l <> h").select("t", "f")
    shared = words.join(rank, "t").groupBy("id", "c", "n").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("s"))
    # places before the first shared shingle are taken by those of one component alone
    first = F.col("n") - F.size("s")
    most = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100).cast("int") + 1
    prefix = shared.where(most > first).select("id", "c", "n", first.alias("at"), F.posexplode(F.slice("s", F.lit(1), most - first)).alias("i", "x"))
    prefix = prefix.select(F.col("x.t").alias("t"), "id", "c", "n", (F.col("n") - F.col("at") - F.col("i")).alias("room"))
    # one side of a pair lies outside the component that holds most of a shingle's sets
    major = prefix.groupBy("t", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("t").agg(F.count(F.lit(1)).alias("cs"), F.max_by("c", F.struct("k", "c")).alias("major"))
    minor = prefix.join(major.where("cs > 1"), "t").where(F.col("c") != F.col("major"))
    minor = minor.select("t", F.col("id").alias("a"), F.col("c").alias("ac"), F.col("n").alias("an"), F.col("room").alias("ar"), "major")
    rest = prefix.select("t", F.col("id").alias("b"), F.col("c").alias("bc"), F.col("n").alias("bn"), F.col("room").alias("br"))
    pairs = minor.join(rest, "t").where(
        (F.col("ac") != F.col("bc"))
        & ((F.col("bc") == F.col("major")) | (F.col("a") < F.col("b")))
        & _close("an", "bn", percent)
        & ((100 + percent) * F.least("ar", "br") >= percent * (F.col("an") + F.col("bn")))
    )
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 80,
    bands: int = 50,
    rows: int = 8,
) -> DataFrame:
    """Per row: doc_id, n_shingles, class_id (same set), component_id (linked classes) and kept."""
    scratch = Scratch(docs.sparkSession, "minhash")
    table = scratch.keep(signatures(docs, id_col, text_col, k, bands, rows), "signatures")
    fit = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = table.where(fit).groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("id"), F.min_by("bands", "doc_id").alias("bands"))
    classes = scratch.keep(classes, "classes")

    members = classes.select(F.explode("bands").alias("bucket"), "id", F.col("n_shingles").alias("n"))
    crowds = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = scratch.keep(members.join(crowds, "bucket"), "members")
    meets = members.groupBy("id").agg(F.sum("c").alias("meets"))
    hubs = members.join(meets, "id").groupBy("bucket").agg(F.max(F.struct("meets", F.xxhash64("id").alias("o"), "id", "n")).alias("hub"))
    star = members.join(hubs, "bucket").where((F.col("id") != F.col("hub.id")) & _close("n", "hub.n", percent))
    star = star.select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()

    sets = scratch.keep(_sets(docs, id_col, text_col, k, members.select("id").distinct()), "sets")
    links = scratch.keep(_linked(scratch.keep(star, "star"), sets, percent), "links")
    found = connected_components(links, scratch, "first")

    named = members.join(found.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    named = scratch.keep(named, "named")
    open_ = named.groupBy("bucket").agg(F.min("component").alias("l"), F.max("component").alias("h")).where("l <> h").select("bucket")
    open_ = named.join(open_, "bucket", "left_semi").select("id", "component").distinct()
    more = scratch.keep(_linked(scratch.keep(_across(open_.join(sets, "id"), percent), "across"), sets, percent), "more")
    if not more.isEmpty():
        found = connected_components(links.unionByName(more), scratch, "all")

    at = classes.select("digest", "n_shingles", F.col("id").alias("class_id"))
    at = at.join(found.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    at = scratch.keep(at, "membership")
    scratch.drop("sets", "members", "named", "star", "across", "classes")
    out = table.select("doc_id", "n_shingles", "digest").join(at, ["digest", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
