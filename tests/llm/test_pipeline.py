"""The pipeline's stages against brute force on a small corpus."""

import random

import numpy as np
import pytest

import corpus_pipeline

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "sa") for b in ("ran", "stel", "dor", "mik")]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, path = random.Random(12), tmp_path_factory.mktemp("corpus")
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    item = say(20)
    texts = {i: say(rng.randint(40, 90)) for i in range(150)}
    labels = []
    for i in range(0, 150, 2):
        texts[i] += " grumblefax zorgnaster" if i % 4 == 0 else ""
        labels.append((i, 1, int(i % 4 == 0)))
    for i in range(150, 160):
        texts[i] = texts[1] + " x" * (i % 2)
    for i in (161, 163):
        texts[i] = say(30) + " " + item + " " + say(30)
    rows = [(i, t, "en", "ab"[i % 2] if i % 5 else None, len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), texts


def test_each_stage_takes_effect(spark, corpus):
    path, texts = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    toxic = {i for i, t in texts.items() if "grumblefax" in t}
    assert ids(stages["toxicity"](spark, docs, path)) == sorted(set(texts) - toxic)
    assert ids(stages["near_duplicates"](spark, docs, path)) == sorted(set(texts) - set(range(150, 160)))
    assert ids(stages["decontamination"](spark, docs, path)) == sorted(set(texts) - {161, 163})
    mixed = ids(stages["mixing"](spark, docs, path))
    assert max(mixed.count(i) for i in set(mixed)) <= 2
    words = sum(len(texts[i].split()) for i in mixed)
    assert abs(words - 1.5 * sum(len(t.split()) for t in texts.values())) <= 3 * 95


def test_run_packs_what_is_left(spark, corpus):
    path, texts = corpus
    rows = corpus_pipeline.run(spark, path).collect()
    packed = {d for r in rows for d in r["doc_ids"]}
    assert packed and not any("grumblefax" in texts[d] for d in packed) and not packed & {161, 163} and len(packed & {1, *range(150, 160)}) <= 1
    assert all(len(np.frombuffer(bytes(r["input_ids"]), "<u2")) == 2048 for r in rows)


def test_rows_of_one_id_and_without_words_are_kept(spark):
    text = "one two three four five six seven eight"
    rows = [(1, None, "en", "a", 0), (1, text, "en", "a", 1), (2, text, "en", "b", 1), (None, text, "en", "a", 1), (3, "", "en", "b", 0), (4, text + " nine", "en", "a", 1), (5, None, "en", "lonely", 0), (6, "z y", "en", "b", 1), (6, "z y", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_duplicates"](spark, docs, "")
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    assert sorted(map(key, kept.collect())) == sorted([("1", "None"), ("1", text), ("3", ""), ("5", "None"), ("6", "z y")])
    many = spark.createDataFrame([(i, text if i % 2 else None, "en", "a" if i < 40 else "b", 0) for i in range(60)], docs.schema)
    mixed = stages["mixing"](spark, many, "").collect()
    assert sorted(r["doc_id"] for r in mixed if r["text"] is None) == list(range(0, 60, 2))
