"""The vector index against a scan of all vectors."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from lorewell.operators import vector
from lorewell.operators.vector import knn
from lorewell.operators.vector_index import VectorIndex, encoded, kmeans, nearest_row


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(25, 18))[rng.integers(0, 25, 1500)] + 0.3 * rng.normal(size=(1500, 18))
    return spark.createDataFrame([(f"c{i:04}", [float(x) for x in r]) for i, r in enumerate(v)], "id string, embedding array<float>").repartition(3).cache()


@pytest.fixture(scope="module")
def asked(rows):
    return rows.where("substring(id, 4, 2) = '00'").selectExpr("id AS query_id", "embedding AS query_vector")


def hits(df):
    return {(r["query_id"], r["id"], r["score"]) for r in df.collect()}


def state(path, name):
    return {(p.name, p.stat().st_mtime_ns) for p in Path(path, name).glob("*.parquet")}


def test_kmeans_and_codes():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, (50, 8)) for c in (-5, 0, 5)])
    centres = kmeans(x, 3)
    assert sorted(np.round(centres.mean(axis=1)).tolist()) == [-5, 0, 5]
    own, far = nearest_row(x, centres)
    assert np.allclose(far, ((x - centres[own]) ** 2).sum(axis=1), atol=1e-9)
    words = np.stack([kmeans(x[:, :4], 6), kmeans(x[:, 4:], 6)])
    code = encoded(x, words)
    assert code.shape == (150, 2) and all(((x[i, :4] - words[0]) ** 2).sum(axis=1).argmin() == code[i, 0] for i in range(150))


def test_index_finds_the_neighbours_of_a_scan(spark, rows, asked, tmp_path):
    index = VectorIndex.build(rows, str(tmp_path / "i"))
    true, found = hits(knn(rows, asked, 10)), hits(index.search(asked, 10))
    assert len(found & true) >= 0.9 * len(true) and len(found) == len(true)
    about = index.about()
    assert about["recall"] >= 0.95 and about["probes"] < about["lists"] / 2 and about["n"] == 1500
    assert index.candidates(asked, 30).count() == 30 * asked.count()  # of all vectors, those are compared


def test_batches_are_added_without_touching_earlier_ones(spark, rows, asked, tmp_path):
    path = str(tmp_path / "i")
    first, second = rows.where("id < 'c0700'"), rows.where("id >= 'c0600'")
    index = VectorIndex.build(first.where("id < 'c0600'").unionByName(first.where("id >= 'c0600'").selectExpr("id", "reverse(embedding) AS embedding")), path)
    before = {name: state(path, name) for name in ("lists", "words", "codes", "vectors")}
    index.add(second)
    for name, files in before.items():
        assert files <= state(path, name)
    assert state(path, "lists") == before["lists"] and len(state(path, "codes")) > len(before["codes"])
    true, found = hits(knn(rows, asked, 10)), hits(index.search(asked, 10))
    assert len(found & true) >= 0.85 * len(true)
    assert all(abs(s - 1) < 1e-6 for q, i, s in found if q == i)  # replaced vectors are the new ones


def test_removed_ids_are_not_found_until_added_again(spark, rows, asked, tmp_path):
    index = VectorIndex.build(rows, str(tmp_path / "i"), lists=4)
    gone = rows.where("id < 'c0500'")
    index.remove(gone)
    index.remove(gone)
    left = {i for _, i, _ in hits(index.search(asked, 10, probes=4))}
    assert min(left) >= "c0500"
    index.add(gone)
    assert hits(index.search(asked, 5, candidates=400, probes=4)) == hits(knn(rows, asked, 5))


def test_all_lists_and_candidates_give_the_scan(spark, rows, asked, tmp_path, monkeypatch):
    from lorewell.operators import vector_index

    monkeypatch.setattr(vector_index, "LIST_ROWS", 40)  # lists in several tasks
    index = VectorIndex.build(rows, str(tmp_path / "i"), lists=5)
    assert hits(index.search(asked, 10, candidates=1500, probes=5)) == hits(knn(rows, asked, 10))


def test_index_takes_odd_vectors(spark, tmp_path):
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [1.0, 0.0])], "id int, embedding array<double>")
    index = VectorIndex.build(odd, str(tmp_path / "i"), k=1)
    asked = odd.selectExpr("id AS query_id", "embedding AS query_vector").where("id in (1, 3, 5)")
    assert hits(index.search(asked, 3, probes=2)) == {(1, 1, 1.0), (1, 8, 1.0), (1, 2, 0.5)}
    with pytest.raises(ValueError):
        VectorIndex.build(odd.where("id = 3"), str(tmp_path / "none"))


def test_a_step_of_scores_keeps_the_best_of_each_query_only():
    """All scores of a step used to be held as rows of objects until the first trim."""
    rng = np.random.default_rng(5)
    asked, k = pd.DataFrame({"query_id": range(300), "v": list(rng.normal(size=(300, 8)))}), 5
    vectors, best, most = rng.normal(size=(9000, 8)), vector.Nearest(asked, 5), 0
    vectors[100:140] = vectors[7]  # ties go to the lower id
    vectors[50] = np.nan
    for at in range(0, 9000, 1000):
        best.add(np.arange(at, at + 1000), vectors[at : at + 1000], None)
        most = max(most, best.rows)
    best.trim()
    scores = np.round((1 + vectors @ np.stack(asked["v"].to_numpy()).T) / 2, 6)
    want = [(q, i, scores[i, q]) for q in range(300) for i in sorted(np.flatnonzero(~np.isnan(scores[:, q])), key=lambda i: (-scores[i, q], i))[:k]]  # noqa: B023
    q, ids, found = best.parts[0]
    assert list(zip(q, ids, found, strict=True)) == want
    assert most <= 5 * k * 300 + 300 * 50
