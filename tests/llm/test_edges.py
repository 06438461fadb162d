"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from lorewell.llm import decontam, langid, lm_score, minhash, mixing, packing, quality, suffix_dedup, toxicity, warc

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, copies int, bands string, word string, bucket long, a string, h string, kept boolean, refers_to long"
EXTRA = (0.5, 3, "b", "w", 1, "a", "h", False, 4)
LONG = "the quick brown fox jumps over lazy dogs " * 6000
ROWS = [
    (1, "plain words of a short text", "en", "s", 1), (1, "plain words of a short text", "en", "s", 1), (2, "plain words of a short text", "en", None, 1),
    (3, None, "en", "s", None), (4, "", None, "t", 0), (None, "a text without an id but with words enough", "en", "s", 1), (None, None, None, None, None), (5, LONG, "en", "s", 9), (6, " \n\t ", "de", "t", 3),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([r + EXTRA for r in ROWS], SCHEMA)


def operators(spark, docs):
    labels = spark.createDataFrame([(1, 0), (5, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "plain words of a short text"), (1, "plain words of a short text"), (None, "x"), (2, None), (3, "")], "item_id long, text string")
    yield "toxicity", toxicity.score(docs, toxicity.fit(docs, labels)), True
    yield "decontam", decontam.contaminated(docs, items), False
    yield "packing", packing.pack_documents(docs, VOCABULARY), False
    yield "mixing", mixing.mix_sources(docs), True
    yield "suffix", suffix_dedup.remove_repeats(docs), True
    yield "minhash", minhash.near_duplicates(docs), True
    yield "lm", lm_score.pseudo_likelihood(docs), True
    yield "langid", langid.identify(docs, langid.fit(docs)), True
    yield "quality", quality.quality_verdicts(docs), True


def test_every_operator_takes_odd_rows(spark, docs):
    for name, df, each in operators(spark, docs):
        rows = df.collect()
        assert not each or len(rows) == len(ROWS), name


def test_every_operator_takes_an_empty_table(spark, docs):
    for name, df, _ in operators(spark, docs.limit(0)):
        assert df.collect() == [], name


def test_odd_rows_have_their_results(spark, docs):
    found = {(r["doc_id"], r["n_shingles"]): r for r in minhash.near_duplicates(docs).collect()}
    assert found[2, 2]["component_id"] == 1 and not found[2, 2]["kept"] and found[3, 0]["kept"] and found[None, 5]["component_id"] is None and found[None, 5]["kept"]
    hits = {(r["doc_id"], r["item_id"], r["n_item"]) for r in decontam.contaminated(docs, spark.createDataFrame([(1, "plain words of a short text"), (2, None)], "item_id long, text string")).collect()}
    assert hits == {(1, 1, 2), (2, 1, 2)}
    cut = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert cut[5]["n_removed"] == cut[5]["n_bytes"] == len(LONG) and cut[3]["n_bytes"] == 0 and cut[1]["n_removed"] == 0
    lang = [r["lang_pred"] for r in langid.identify(docs.where("doc_id in (3, 4, 6)"), langid.fit(docs)).collect()]
    assert lang == ["und"] * 3


def test_warc_takes_odd_rows(spark, tmp_path):
    big = "x" * 2000
    pages = spark.createDataFrame([(1, None, big, 1), (1, None, big, 1), (None, "u", big, 2), (2, "u", None, 3), (3, "u", "", 4)], "page_id long, url string, html string, digest int")
    warc.write_archives(pages, f"file://{tmp_path}/a")
    rows = warc.read_archives(spark, f"file://{tmp_path}/a").collect()
    assert len(rows) == 5 and all(r["verified"] and r["record_type"] == "response" for r in rows)
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/b")
    assert warc.read_archives(spark, f"file://{tmp_path}/b").collect() == []


def test_stages_take_odd_and_no_rows(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some other words than those of the documents")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, docs.limit(0)):
        now = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
            now = spark.createDataFrame(out.collect(), out.schema)
            if name == "near_duplicates" and rows is docs:
                assert sorted((r["doc_id"] for r in now.collect()), key=str) == [1, 3, 4, 5, 6, None, None]
        assert rows is docs or now.isEmpty()
    assert F is not None
