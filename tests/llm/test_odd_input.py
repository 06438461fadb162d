"""Very long words, ids of any type, files of bounded size and popular payloads."""

import zlib
from pathlib import Path

import numpy as np
import pytest

from lorewell.llm import decontam, langid, lm_score, minhash, mixing, packing, quality, suffix_dedup, toxicity, warc

LONG = "wörd" * 750_000  # one word of three million characters
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_checksums_of_grams_are_those_of_their_bytes():
    word = "<größe日本𝔘nix-straße" + "abc" * 5 + ">"
    for n in (3, 4, 5):
        want = sorted({zlib.crc32(word[i : i + n].encode()) for i in range(len(word) - n + 1)})
        assert toxicity.gram_checksums(word, n, at_once=7).tolist() == want
    assert toxicity.gram_checksums("ab", 3).tolist() == []


def test_long_words_have_the_buckets_of_short_ones(monkeypatch):
    words = ["straße", "x" * 50, "ab12" * 30, "日本語" * 9]
    short = [sorted(toxicity.subwords(w)) for w in words]
    monkeypatch.setattr(toxicity, "HELD_WORD", 4)
    assert [sorted(toxicity.subwords(w).tolist()) for w in words] == short


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"some plain words of text number {i} that say next to nothing at all", "en", "s", 1) for i in range(6)]
    return spark.createDataFrame([*rows, (6, LONG, "en", "s", 1), (7, LONG, "en", "t", 1), (8, "short " + LONG, "de", "t", 1)], DOCS)


def test_operators_take_very_long_words(spark, docs):
    labels = spark.createDataFrame([(0, 0), (1, 1), (6, 1), (8, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert scores[6] == scores[7] and all(0 <= s <= 1 for s in scores.values())
    kept = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert kept[7]["component_id"] == 6 and not kept[7]["kept"] and kept[8]["n_shingles"] == 1
    items = spark.createDataFrame([(1, LONG), (2, "text number 3 that say next")], "item_id long, text string")
    hits = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()}
    assert {(6, 1), (7, 1), (8, 1), (3, 2)} <= hits
    cut = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs.where("doc_id in (0, 6)")).collect()}
    assert cut[6]["n_removed"] == cut[6]["n_bytes"] == len(LONG.encode()) and cut[0]["n_removed"] == 0
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix_sources(docs).collect()}
    assert sizes[6] == 1 and sizes[8] == 2
    verdicts = {r["doc_id"]: r for r in quality.quality_verdicts(docs).collect()}
    assert verdicts[6]["n_words"] == 1 and verdicts[6]["word_chars"] == len(LONG) and verdicts[6]["base_failed"]
    langs = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert langs[6] == langs[7] and len(langs) == 9
    assert {r["doc_id"] for r in lm_score.pseudo_likelihood(docs).collect()} == set(range(9))


def test_packing_takes_a_very_long_word(spark, docs):
    rows = packing.pack_documents(docs.where("doc_id < 7").replace({LONG: LONG[:400_000]}, subset="text"), "/opt/tokenizers/byte_bpe_50k.tiktoken").collect()
    assert rows


@pytest.mark.parametrize("kind, ids", [("string", ["a b", "ä/§", "z", "", "b>"]), ("int", [1, 2, 3, 4, 5]), ("decimal(20,0)", [10**15 + i for i in range(5)])])
def test_archives_take_ids_of_any_type(spark, tmp_path, kind, ids):
    from decimal import Decimal

    own = [Decimal(i) for i in ids] if kind.startswith("decimal") else ids
    big = "x" * 1500
    pages = [(i, "u", big if n < 3 else "small") for n, i in enumerate(own)] + [(None, "u", big)]
    df = spark.createDataFrame(pages, f"page_id {kind}, url string, html string")
    path = f"file://{tmp_path}/a"
    warc.write_archives(df, path)
    rows = {r["page_id"]: r for r in warc.read_archives(spark, path, id_type=kind).collect()}
    last = max(own[:3])
    assert set(rows) == {*own, None} and all(r["verified"] for r in rows.values())
    assert {i: (rows[i]["record_type"], rows[i]["refers_to"]) for i in own} == {i: ("revisit", last) if n < 3 and i != last else ("response", None) for n, i in enumerate(own)}
    assert rows[None]["record_type"] == "response"


def test_no_file_is_larger_than_its_bound(spark, tmp_path):
    rng = np.random.default_rng(1)
    noise = lambda n: rng.integers(32, 127, n).astype(np.uint8).tobytes().decode()
    sizes = [200] * 300 + [60_000] * 5 + [400_000]  # a heavy tail
    df = spark.createDataFrame([(i, "u", noise(n)) for i, n in enumerate(sizes)], "page_id long, url string, html string").repartition(2)
    warc.write_archives(df, f"file://{tmp_path}/a", per_file=50, file_bytes=100_000)
    files = [p.read_bytes() for p in Path(tmp_path, "a").rglob("part-*")]
    assert len(files) > 7
    for data in files:
        records = [m for m in warc.members_of(data) if m]
        assert len(records) <= 50 and (len(data) <= 100_000 or len(records) == 1)
    assert warc.read_archives(spark, f"file://{tmp_path}/a").where("verified").count() == len(sizes)


def test_popular_payloads_meet_in_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "EQUAL", 7)
    df = spark.createDataFrame([(i, "u", "x" * 1200 if i % 3 else "y" * 1100) for i in range(120)] + [(500, "u", "z" * 1300)], "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/a")
    rows = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, f"file://{tmp_path}/a").collect()}
    assert rows == {i: ("response", None) if i in (117, 119, 500) else ("revisit", 119 if i % 3 else 117) for i in [*range(120), 500]}
