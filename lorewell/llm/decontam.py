"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A test item is found in a document when at least ``percent`` of the item's distinct word shingles
occur in the document, wherever it stands in however long a text. Containment is asymmetric, so the
short side is sketched: items are partitioned by size (powers of two) and keep the least hashes of
their shingles. The sketch length of a partition follows from its upper size bound, so that an
item with enough containment must share a sketch value: the search loses nothing, where
signatures of whole documents, hundreds of times larger than an item, nearly always would.
Documents probe the sketches with every shingle; candidates are verified on the words themselves.

Words are runs of letters and digits in lower case, so punctuation and line breaks don't matter.

Defined results: a text of fewer words than a shingle is one shingle; documents are also probed with windows
of the lengths that such items have, so they are found anywhere; null or wordless items and documents match nothing; rows of one id
are one document (or item) with all their shingles; null ids are never reported; empty tables give
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm.scratch import Scratch

#: sketch rows (16 bytes each) up to which the sketches are sent to every executor; beyond, Spark joins by shuffle
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _windows(words_col: str, k: int) -> Column:
    w = F.col(words_col)
    return F.slice(w, F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(0)))


def shingle_texts(words_col: str, k: int) -> Column:
    """Distinct shingles as text."""
    each = F.transform(_windows(words_col, k), lambda _, i: F.array_join(F.slice(F.col(words_col), i + 1, k), " "))
    return F.when(F.size(words_col) >= k, F.array_distinct(each)).when(F.size(words_col) > 0, F.array(F.array_join(words_col, " ")))


def shingle_hashes(words_col: str, k: int) -> Column:
    """Hashes of the shingles in order; the same for equal words."""
    w = F.col(words_col)
    each = F.transform(_windows(words_col, k), lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)]))
    return F.when(F.size(w) >= k, each).when(F.size(w) > 0, F.array(F.aggregate(w, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x))))


def short_windows(words_col: str, n: int, hashed: bool) -> Column:
    """Every run of ``n`` words, as the one shingle of a text of ``n`` words: its hash or its text."""
    w = F.col(words_col)
    run = lambda i: F.slice(w, i + 1, n)
    one = (lambda _, i: F.aggregate(run(i), F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x))) if hashed else (lambda _, i: F.array_join(run(i), " "))
    return F.transform(_windows(words_col, n), one)


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document and item found: doc_id, item_id, n_item, n_shared and containment."""
    scratch = Scratch(docs.sparkSession, "decontam")
    own = items.select(F.col(item_col).alias("item_id"), words(F.col(item_text)).alias("w")).where("item_id is not null")
    short = sorted(r["n"] for r in own.select(F.size("w").alias("n")).where(F.col("n").between(1, k - 1)).distinct().collect())
    own = own.select("item_id", F.explode(F.arrays_zip(shingle_texts("w", k).alias("s"), F.array_distinct(shingle_hashes("w", k)).alias("h"))).alias("x"))
    own = scratch.keep(own.select("item_id", "x.s", "x.h").distinct(), "items")
    sizes = own.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"), F.sort_array(F.collect_set("h")).alias("h"))
    bound = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n_item"))))  # of the item's size partition
    length = F.floor(bound * (100 - percent) / 100 + 1e-9).cast("int") + 1
    sizes = scratch.keep(sizes.select("item_id", "n_item", F.explode(F.slice("h", F.lit(1), length)).alias("h")), "sketches")
    n_sketch, n_items = sizes.count(), own.count()

    narrow = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w")).where("doc_id is not null")
    probes = narrow.select("doc_id", F.explode(F.concat(shingle_hashes("w", k), *[short_windows("w", n, True) for n in short])).alias("h"))
    candidates = scratch.keep(probes.join(_few(sizes.select("item_id", "h"), n_sketch), "h").select("doc_id", "item_id").distinct(), "candidates")

    likely = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    likely = likely.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(F.concat(shingle_texts("w", k), *[short_windows("w", n, False) for n in short])).alias("s"))
    shared = likely.join(_few(own.select("item_id", "s"), n_items), "s").join(candidates, ["doc_id", "item_id"], "left_semi")
    shared = shared.groupBy("doc_id", "item_id").agg(F.count_distinct("s").alias("n_shared"))
    totals = sizes.select("item_id", "n_item").distinct()
    found = shared.join(totals, "item_id").where(F.lit(100) * F.col("n_shared") >= F.lit(percent) * F.col("n_item"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d
), its AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM i
), short AS (
  SELECT DISTINCT len(w) AS n FROM i WHERE len(w) BETWEEN 1 AND 4
), dss AS (
  SELECT * FROM ds UNION SELECT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda p: array_to_string(w[p:p + n - 1], ' '))) FROM d, short
), n AS (
  SELECT item_id, count(*) AS n_item FROM its GROUP BY item_id
), m AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM dss JOIN its USING (s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_item, n_shared, round(n_shared / n_item, 6) AS containment
FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""
