"""The prefix trie of conversations, its totals found by peeling leaves.

A node is a distinct sequence of first turns. Its key is the depth and a running sum, in four parts of
32 bits, of the hashes of (place, role, text) of its turns; as a running sum it needs no conversation in one task: turns are
sorted over ranges of (conversation, place), summed inside a range, and a conversation that crosses
ranges gets the sums of its earlier ones. A text is hashed where it is read and never shuffled.

Totals of subtrees travel by messages. The unit that is peeled is a run: the nodes of one smallest
member, which lie below each other on its path. A run holds a counter of the runs that hang from it;
those whose counter is 0 are complete and send their leaves and savings to the node they hang from,
whose run lowers its counter by the number of messages, until only the root's run is left and
complete. Messages are added up before they are shuffled, so a node with very many children is no
hot group. A round takes off every complete run, so rounds are as many as runs hang below each other,
however long the conversations. A node with one member has one leaf and saves nothing below it, so
only shared nodes take part. Inside a run a running sum from the deepest node up gives every node's totals.

Defined results: rows without a conv_id take no part; turns of equal number are in the order of
their hashes, and equal rows are turns of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm.scratch import Scratch

#: conversations of one base, and the most turns that they take from it
FAMILY, MOST_HEAD = 5, 8
#: ids in a piece of a node's list of ends
PIECE = 1000
SUMS = ("k0", "k1", "k2", "k3")
KEY = ("depth", *SUMS)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, key: str, order: list[Column], scratch: Scratch, name: str, **values: Column) -> DataFrame:
    """``df`` with running sums of ``values`` over the rows of a key; a key may be in many ranges, and so in many tasks."""
    own = df.withColumns({f"_{n}": v for n, v in values.items()})
    dealt = own.repartitionByRange(_parts(df), key, *order).withColumn("_range", F.spark_partition_id())
    dealt = scratch.keep(dealt, name)
    inside = Window.partitionBy(key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = dealt.groupBy(key, "_range").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in values])
    before = whole.select(key, "_range", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in values])
    local = dealt.select(*df.columns, "_range", *[F.sum(f"_{n}").over(inside).alias(f"_{n}") for n in values])
    both = local.join(before, [key, "_range"])
    return both.select(*df.columns, *[(F.col(f"_{n}") + F.col(f"_before_{n}")).alias(n) for n in values])


def numbered_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, digest (of role and text), n_bytes (of the text), pos from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    order = [F.asc_nulls_first("turn"), F.asc("digest")]
    return running(scratch.keep(turns, "read"), "conv_id", order, scratch, "turns", pos=F.lit(1).cast("long")).drop("turn")


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length), and their turns (conv_id, depth, digest, n_bytes, last): the first turns of their base, then their own."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(MOST_HEAD + 1))
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    lengths = lengths.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    of_base = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = lengths.join(of_base, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = convs.select("conv_id", "base", "n", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    convs = scratch.keep(convs, "convs")
    first = turns.where(F.col("pos") <= MOST_HEAD).withColumnRenamed("conv_id", "base")
    heads = first.join(convs, "base").where(F.col("pos") <= F.col("h"))
    heads = heads.select("conv_id", F.col("pos").alias("depth"), "digest", "n_bytes", (F.col("pos") == F.col("length")).alias("last"))
    tails = turns.where(F.col("pos") > h).join(convs, "conv_id")
    depth = F.col("pos") - F.col("h") + F.col("head")
    tails = tails.select("conv_id", depth.alias("depth"), "digest", "n_bytes", (depth == F.col("length")).alias("last"))
    return convs.select("conv_id", "length"), scratch.keep(heads.unionByName(tails), "rebuilt")


def visits(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, depth, key sums of the node and of its parent (p0 to p3), n_bytes, last: a row for each node on a conversation's path."""
    placed = F.sha2(F.concat(F.col("depth").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("digest")), 256)
    parts = {f"v{i}": F.conv(F.substring(placed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)}
    df = rows.withColumns(parts).drop("digest")
    df = running(df, "conv_id", [F.asc("depth")], scratch, "placed", **{f"k{i}": F.col(f"v{i}") for i in range(4)})
    df = df.withColumns({f"p{i}": F.col(f"k{i}") - F.col(f"v{i}") for i in range(4)})
    return scratch.keep(df.drop("v0", "v1", "v2", "v3"), "visits")


def trie_nodes(convs: DataFrame, path: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes by key: conv_id, n_convs, n_children, n_single (children of one member), parent_conv_id, saves."""
    found = path.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"), *[F.max(f"p{i}").alias(f"p{i}") for i in range(4)])
    no = {c: F.lit(0).cast("long") for c in (*KEY, "n_bytes", "p0", "p1", "p2", "p3")}
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").withColumns(no)
    found = scratch.keep(found.unionByName(root), "nodes")
    up = [(F.col("depth") - 1).alias("depth"), *[F.col(f"p{i}").alias(f"k{i}") for i in range(4)]]
    children = found.where("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("n_single"))
    of = found.select(F.col("depth").alias("_d"), *[F.col(k).alias(f"_{k}") for k in SUMS], F.col("conv_id").alias("parent_conv_id"))
    same = (F.col("depth") == F.col("_d") + 1) & (F.col("p0") == F.col("_k0")) & (F.col("p1") == F.col("_k1")) & (F.col("p2") == F.col("_k2")) & (F.col("p3") == F.col("_k3"))
    # the root, from which very many nodes may hang, is one row
    top = found.where("depth <= 1").crossJoin(F.broadcast(of.where("_d = 0").select("parent_conv_id")))
    top = top.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("parent_conv_id")))
    deep = found.where("depth > 1").join(of.where("_d > 0"), same).select(*found.columns, "parent_conv_id")
    every = top.unionByName(deep).join(children, list(KEY), "left").fillna(0, ["n_children", "n_single"])
    every = every.withColumn("saves", (F.col("n_convs") - 1) * F.col("n_bytes"))
    return scratch.keep(every.drop("n_bytes", "p0", "p1", "p2", "p3"), "tree")


def peeled(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens of the shared nodes, by messages from complete runs to those they hang from."""
    shared = nodes.where("n_convs > 1").withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_single")))
    shared = shared.select("conv_id", "depth", "parent_conv_id", "leaves", "saves")
    tops = shared.where("parent_conv_id is null or parent_conv_id <> conv_id").select("conv_id", F.col("parent_conv_id").alias("parent"), (F.col("depth") - 1).alias("at"))
    runs = shared.groupBy("conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saves").alias("saves")).join(tops, "conv_id")
    hanging = tops.where("parent is not null").groupBy(F.col("parent").alias("conv_id")).agg(F.count(F.lit(1)).alias("open"))
    runs = runs.join(hanging, "conv_id", "left").fillna(0, ["open"])
    runs, k, sent = scratch.keep(runs, "runs0"), 0, []
    while not runs.isEmpty():
        sent.append(scratch.keep(runs.where("open = 0 and parent is not null").groupBy("parent", "at").agg(F.count(F.lit(1)).alias("n"), F.sum("leaves").alias("leaves"), F.sum("saves").alias("saves")), f"sent{k}"))
        got = sent[-1].groupBy(F.col("parent").alias("conv_id")).agg(F.sum("n").alias("_n"), F.sum("leaves").alias("_leaves"), F.sum("saves").alias("_saves"))
        left = runs.where("open > 0").join(got, "conv_id", "left").fillna(0, ["_n", "_leaves", "_saves"])
        left = left.select("conv_id", (F.col("leaves") + F.col("_leaves")).alias("leaves"), (F.col("saves") + F.col("_saves")).alias("saves"), "parent", "at", (F.col("open") - F.col("_n")).alias("open"))
        runs = scratch.keep(left, f"runs{k + 1}")
        scratch.drop(f"runs{k}")
        k += 1
    totals = shared.select("conv_id", "depth", "leaves", "saves")
    for messages in sent:
        totals = totals.unionByName(messages.select(F.col("parent").alias("conv_id"), F.col("at").alias("depth"), "leaves", "saves"))
    totals = totals.groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saves").alias("saves"))
    return running(totals, "conv_id", [F.desc("depth")], scratch, "totals", n_leaves=F.col("leaves"), saved_tokens=F.col("saves")).drop("leaves", "saves")


def _digests(pieces: DataFrame) -> DataFrame:
    """SHA-256 of the pieces of each node, in their order; a task holds one piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()
        for batch in batches:
            out = []
            for *own, ids in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if own != key:
                    out += [(*key, digest.hexdigest())] if key else []
                    key, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield table(out)
        yield table([(*key, digest.hexdigest())] if key else [])

    def table(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 5 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[*KEY, "ends_sha256"])

    return pieces.select(*KEY, "ids").mapInArrow(run, f"{', '.join(f'{k} long' for k in KEY)}, ends_sha256 string")


def ends(convs: DataFrame, path: DataFrame, scratch: Scratch) -> DataFrame:
    """Key, ends_sha256 of the nodes where conversations end.

    Ids are sorted over ranges and joined in pieces of ``PIECE``, so that the one task that has to hash a node's list in order reads few rows.
    """
    at_root = convs.where("length = 0").select(*[F.lit(0).cast("long").alias(k) for k in KEY], "conv_id")
    rows = scratch.keep(path.where("last").select(*KEY, "conv_id").unionByName(at_root), "ends")
    dealt = rows.repartitionByRange(_parts(rows), *KEY, "conv_id").withColumn("_range", F.spark_partition_id())
    dealt = scratch.keep(dealt, "ends_in_order")
    number = F.row_number().over(Window.partitionBy(*KEY, "_range").orderBy("conv_id")) - 1
    pieces = dealt.withColumn("piece", F.floor(number / PIECE)).groupBy(*KEY, "_range", "piece").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))
    return _digests(pieces.repartition(_parts(rows), *KEY).sortWithinPartitions(*KEY, "_range", "piece"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row per node."""
    scratch = Scratch(conversations.sparkSession, "trie")
    convs, rows = rebuilt(scratch.keep(numbered_turns(conversations, scratch), "numbered"), scratch)
    path = visits(rows, scratch)
    scratch.drop("read", "turns", "numbered", "rebuilt", "placed")
    nodes = trie_nodes(convs, path, scratch)
    totals = peeled(nodes, scratch)
    every = nodes.join(ends(convs, path, scratch), list(KEY), "left")
    # the totals of shared nodes are joined by owner and depth; all others are known
    alone = every.where("n_convs = 1").withColumns({"n_leaves": F.lit(1).cast("long"), "saved_tokens": F.lit(0).cast("long")})
    shared = every.where("n_convs > 1").join(totals, ["conv_id", "depth"])
    none = hashlib.sha256(b"").hexdigest()
    own = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return alone.unionByName(shared).select(*own, F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos, k, n_bytes
  FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS n_bytes FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, count(*) AS n,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda s, x: list_reduce([xor(s, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT) % 9 AS h
  FROM t GROUP BY conv_id
), r AS (
  SELECT c.conv_id, t.pos AS depth, k, n_bytes FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)), k, n_bytes FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN c b ON b.conv_id = c.base
), o AS (
  SELECT conv_id, depth, n_bytes, sha256(string_agg(k, ',') OVER w) AS key, depth = max(depth) OVER (PARTITION BY conv_id) AS last
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
  UNION ALL
  SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM r) FROM c
), n AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n_bytes) AS saves,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM o GROUP BY depth, key
), p AS (
  SELECT n.*, po.key AS parent_key FROM n LEFT JOIN o po ON po.conv_id = n.conv_id AND po.depth = n.depth - 1
), k AS (
  SELECT depth - 1 AS depth, parent_key AS key, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY ALL
), f AS (
  SELECT p.*, pn.conv_id AS parent_conv_id, coalesce(n_children, 0) AS n_children
  FROM p LEFT JOIN k USING (depth, key) LEFT JOIN n pn ON pn.depth = p.depth - 1 AND pn.key = p.parent_key
), s AS (
  SELECT o.depth, o.key, count_if(u.n_children = 0) AS n_leaves, sum(u.saves) AS saved_tokens
  FROM o JOIN f u ON u.conv_id = o.conv_id AND u.depth >= o.depth GROUP BY ALL
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM f JOIN s USING (depth, key)
"""
