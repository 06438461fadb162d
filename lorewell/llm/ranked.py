"""Ranked full-text search by best-first descent of trees of largest scores.

The documents are cut into ranges of consecutive rows. Over each range stands a tree: its leaves
are documents, a node spans ``FAN`` nodes of the level below, and for every term a node holds the
largest score that the term reaches in one of its documents. The sum of an item's terms at a node
bounds the score of each document below it. A search opens the node with the highest bound first and
ends when no bound reaches the item's k-th best score so far. Nodes whose bound equals that score
are opened as well, as they may hold a document of that score with a smaller id.

The corpus is read once: tokens are counted in their document's task, and a narrow table (doc_id,
length, terms of the items with their counts) is written. Frequencies come from that table, and a
second job builds the trees of a range inside a task, searches them for all items and carries the
k best of every item from range to range, so later ranges are mostly cut off at their roots. No
posting is shuffled but for the counts of terms, and no pair of item and document is a row.

Items are sent out in blocks of at most ``ITEM_BYTES`` of text, one scan of the documents a block; their
number does not depend on the documents.

Defined results: a text that is null or without terms matches nothing and counts in no
statistic; rows of one doc_id are documents of their own; rows of one item_id are items of their
own with the same id, each with its own ranks; null ids are kept and come last among equal scores;
an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm.scratch import Scratch
from lorewell.llm.shingles import as_bytes

#: text of items that is sent to the executors at once
ITEM_BYTES = 4 << 20
#: nodes below a node, and levels of nodes over the documents of a range
FAN, LEVELS = 16, 3
#: documents and postings of a range
RANGE, POSTINGS = FAN**LEVELS, 2_000_000
#: nodes of one level that are opened at once, best first
OPENED = 16
#: bytes of a text that are cut into terms at once
PIECE = 1 << 20
#: letters of A-Z in lower case; ASCII characters that are neither letter nor digit become blanks; all other bytes stay
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists of bounded size."""
    plain = (text or b"").translate(TERMS)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs of those in ``vocabulary``; no shuffle."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lengths, terms, tfs = [], [], []
            for text in as_bytes(batch.column(1)):
                n, found = 0, []
                for words in terms_of(text):
                    n += len(words)
                    found.append(np.array([known[w] for w in words if w in known], np.int32))
                t, tf = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int32), np.empty(0, np.int64))
                lengths.append(n)
                terms.append(t)
                tfs.append(tf)
            columns = [batch.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, n long, terms array<int>, tfs array<long>")


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers from each ``low`` up to its ``high``, one after the other."""
    n = high - low
    return np.repeat(high - np.cumsum(n), n) + np.arange(n.sum())


class Tree:
    """Largest scores by term over the nodes of a range of documents, level by level; sparse, so no larger than the postings."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, scores: np.ndarray) -> None:
        order = np.lexsort((docs, terms))
        node, terms, scores = docs[order].astype(np.int64), terms[order].astype(np.int64), scores[order]
        self.keys, self.most = [], []
        for level in range(LEVELS + 1):
            key = (terms << 32) | node
            if level:
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
                key, terms, node = key[first], terms[first], node[first]
                scores = np.maximum.reduceat(scores, first) if len(first) else scores
            self.keys.append(key)
            self.most.append(scores)
            node = node // FAN

    def below(self, level: int, nodes: np.ndarray, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of ``level`` under ``nodes`` of the level above that hold a term, with their sums."""
        key = self.keys[level]
        low = np.searchsorted(key, ((terms[:, None] << 32) | (nodes * FAN)[None, :]).ravel())
        high = np.searchsorted(key, ((terms[:, None] << 32) | (nodes * FAN + FAN)[None, :]).ravel())
        at = _ranges(low, high)
        child = key[at] & 0xFFFFFFFF
        value = self.most[level][at] * np.repeat(np.repeat(times, len(nodes)), high - low)
        sums = np.zeros(FAN ** (LEVELS - level), np.int64)
        np.add.at(sums, child, value)
        found = np.unique(child)
        return found, sums[found]

    def roots(self, terms: np.ndarray, times: np.ndarray) -> int:
        """The bound of the whole range."""
        key = self.keys[LEVELS]
        at = np.searchsorted(key, terms << 32)
        held = at < len(key)
        held[held] = key[at[held]] == terms[held] << 32
        return int((self.most[LEVELS][at[held]] * times[held]).sum())


class Best:
    """The ``k`` best documents of an item so far."""

    def __init__(self, k: int) -> None:
        self.k, self.held, self.least = k, [], 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.held += [(-int(s), d is None, 0 if d is None else d, d) for s, d in zip(scores, ids, strict=True)]
        self.held = heapq.nsmallest(self.k, self.held)
        if len(self.held) == self.k:
            self.least = max(1, -self.held[-1][0])


def search(tree: Tree, ids: pa.Array, terms: np.ndarray, times: np.ndarray, best: Best) -> int:
    """Best first: opens nodes while a bound reaches the least score that counts. The number of documents scored."""
    bound, scored = tree.roots(terms, times), 0
    open_ = [(-bound, LEVELS, 0)] if bound >= best.least else []
    while open_ and -open_[0][0] >= best.least:
        level = open_[0][1]
        nodes = []
        while open_ and len(nodes) < OPENED and open_[0][1] == level and -open_[0][0] >= best.least:
            nodes.append(heapq.heappop(open_)[2])
        found, sums = tree.below(level - 1, np.sort(np.array(nodes, np.int64)), terms, times)
        reach = sums >= best.least
        found, sums = found[reach], sums[reach]
        if level == 1:
            scored += len(found)
            if len(sums) > best.k:  # of equal scores, all that may count
                reach = sums >= np.partition(sums, -best.k)[-best.k]
                found, sums = found[reach], sums[reach]
            best.add(sums, ids.take(pa.array(found)).to_pylist())
        else:
            for s, n in zip(sums.tolist(), found.tolist(), strict=True):
                heapq.heappush(open_, (-s, level - 1, n))
    return scored


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of at most ``RANGE`` documents and, beyond a single one, ``POSTINGS`` postings."""
    for batch in batches:
        ends = np.asarray(batch.column(2).offsets)[1:] - batch.column(2).offsets[0].as_py()
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = int(np.searchsorted(ends, before + POSTINGS, side="right"))
            end = min(max(end, at + 1), at + RANGE, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def _search_block(docs: DataFrame, items: list[tuple], scratch: Scratch, k: int, id_col: str, text_col: str, kind: str) -> DataFrame:
    """item, item_id, doc_id, score: each task's ``k`` best of every item."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    asked = []
    for i, (item_id, text) in enumerate(items):
        words = [vocabulary.setdefault(w, len(vocabulary)) for part in terms_of(text.encode()) for w in part]
        asked.append((i, item_id, *np.unique(np.array(words, np.int64), return_counts=True)))
    name = f"counted{len(items)}-{asked[0][0]}"
    rows = scratch.keep(counted(docs, vocabulary, id_col, text_col), name)
    total = rows.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"]
    weights = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():  # as many as the items have terms
        weights[r["term"]] = weight(n_docs, r["df"])
    shared = spark.sparkContext.broadcast((weights, [(i, t, c) for i, _, t, c in asked]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items = shared.value
        best = [Best(k) for _ in items]
        for part in _cut(batches):
            n = part.column(1).to_numpy()
            terms, tf = (part.column(i).flatten().to_numpy() for i in (2, 3))
            at = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(part.column(2).offsets)))
            m = 25 + (75 * n * n_docs) // max(n_terms, 1)
            tree = Tree(at, terms, weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at])))
            for (_, t, times), held in zip(items, best, strict=True):
                search(tree, part.column(0), t, times, held)
        out = [(i, h[3], -h[0]) for (i, _, _), held in zip(items, best, strict=True) for h in held.held]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], part.column(0).type), pa.array([r[2] for r in out], pa.int64())], names=["item", "doc_id", "score"])

    return rows.where("size(terms) > 0").mapInArrow(run, f"item int, doc_id {dict(rows.dtypes)['doc_id']}, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item with a score above 0; ids break ties."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    kinds = {"item_id": dict(asked.dtypes)["item_id"], "doc_id": dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]}
    scratch = Scratch(spark, "ranked")
    n_bytes = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-n_bytes // ITEM_BYTES)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = spark.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id {kinds['doc_id']}, score long")
    for b in range(blocks):
        block = [(r["item_id"], r["text"]) for r in asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        if not block:
            continue
        hits = _search_block(docs, block, scratch, k, id_col, text_col, kinds["doc_id"])
        hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"item int, item_id {kinds['item_id']}")
        hits = hits.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        found = found.unionByName(hits)
    return found


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms FROM documents
), s AS (
  SELECT count(*)::BIGINT AS nd, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0
), p AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), s
), q AS (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark)
  GROUP BY ALL
), h AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM h WHERE score > 0
)
SELECT * FROM r WHERE rank <= 10
"""
