"""From raw documents to packed token rows: five operators, each stage a written table.

Order: toxic documents go; one document of each group of near-duplicates stays; documents that
hold a benchmark item go; sources are mixed to their target weights by repeating documents; what
is left becomes packed token ids. A stage reads the table its predecessor wrote, so lost
executors cost the stage at hand only.

Defined results: rows with a null or wordless text are clean, no duplicates and of size 0, so each stays until
packing, where it has no tokens; rows with a null id are documents like others, and come last among copies; rows
that share an id but not a text are told apart, rows that are equal in all are copies of each other;
an empty table gives an empty table. Extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.llm import decontam, minhash, mixing, packing, toxicity
from lorewell.llm.queries import TOKENIZERS
from lorewell.llm.scratch import Scratch

#: Rules vote, models are fitted and rows are drawn: SQL can't express run(); tests hold it against brute force.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row as ``doc``, beside a 128-bit hash of all of it: equal rows share a key, null ids don't."""
    names = [f"`{c}`" for c in docs.columns]
    key = F.struct(F.xxhash64(*names).alias("a"), F.xxhash64(F.lit(1), *names).alias("b"))
    return docs.select(F.struct(*names).alias("doc"), key.alias("key"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted label is 0. The model learns from labelled rows outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels.where(~held_out)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least id of each component of five-word shingle sets of similarity 0.8 or more, null ids last.

    Rows are told apart by all they hold, so rows that share an id but not a text are documents of their own.
    """
    rows = _keyed(docs).select("doc", F.struct(F.col("doc.doc_id").isNull().alias("unnamed"), F.col("doc.doc_id").alias("id"), "key").alias("key"))
    found = minhash.near_duplicates(rows.select("key", F.col("doc.text").alias("text")), id_col="key").where("kept")
    kept = found.groupBy(F.col("doc_id").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("size"))
    rows = rows.join(kept, "key")
    once = (F.col("n") == 1) | (F.col("size") == 0)  # rows without words are no copies of each other
    return rows.where(once).select("doc.*").unionByName(rows.where(~once).dropDuplicates(["key"]).select("doc.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _keyed(docs)
    texts = rows.select("key", F.col("doc.text").alias("text"))
    found = decontam.contaminated(texts, items, id_col="key").select(F.col("doc_id").alias("key")).distinct()
    return rows.join(found, "key", "left_anti").select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for, none more than twice."""
    rows = _keyed(docs)
    narrow = rows.select("key", F.col("doc.text").alias("text"), F.col("doc.source").alias("source"))
    taken = mixing.mix_sources(narrow, id_col="key").groupBy(F.col("doc_id").alias("key"))
    taken = taken.agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
    # equal rows share their copies evenly
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key")) - 1
    own = F.floor((F.col("copies") + nth) / F.col("rows")).cast("int")
    each = rows.join(taken, "key").select("doc", own.alias("own")).where("own > 0")
    return each.select("doc", F.explode(F.sequence(F.lit(1), "own"))).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of 2048 token ids."""
    return packing.pack_documents(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; the last one's rows."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
