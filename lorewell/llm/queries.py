"""The operators over their whole tables, with production parameters, as named queries."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: folder of the public vocabulary files, on the driver
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(parts: int, of: int):
    """The rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == of, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm import toxicity

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~_fold(4, 2)))
    return toxicity.score(docs, model).select("doc_id", _fold(4, 2).alias("held_out"), "score", "predicted")


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.decontam import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=4).select("doc_id", "n_shingles", "component_id", "kept")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.lm_score import pseudo_likelihood

    return pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm import warc
    from lorewell.llm.scratch import Scratch

    archives = Scratch(spark, "warc").path("archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), archives)
    return warc.read_archives(spark, archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm import langid

    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~_fold(3, 1)))
    return langid.identify(docs, model).select("doc_id", _fold(3, 1).alias("held_out"), "lang_pred", "score", "n_spans")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.quality import quality_verdicts

    return quality_verdicts(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def op11_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.ann import nearest

    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.ranked import ranked_search

    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.trie import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    from lorewell.llm import decontam, ranked, trie

    return {"op1_decontam": decontam.ORACLE_SQL, "op8_warc": WARC_SQL, "op12_ranked": ranked.ORACLE_SQL, "op13_trie": trie.ORACLE_SQL}


WARC_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to, true AS verified
FROM m
"""
