"""Nearest neighbours against brute force: recall, exact scores, copies, split cells and odd rows."""

import math

import numpy as np
import pytest

from lorewell.llm import ann
from lorewell.llm.scratch import Scratch


def table(spark, ids, vectors, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in zip(ids, vectors, strict=True)], f"vec_id long, embedding array<{kind}>, id int, v string").repartition(3)


def brute(ids, vectors, asked, k):
    """The k nearest ids and scores of each query."""
    e = np.array(vectors, np.float32).astype(np.float64)
    out = {}
    for q in asked:
        s = (e * e[list(ids).index(q)]).sum(axis=1)
        out[q] = sorted(((-x, i) for x, i in zip(s.tolist(), ids, strict=True) if i != q))[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def recall(got, want):
    return sum(len({i for _, i in got.get(q, [])} & {i for _, i in w}) for q, w in want.items()) / sum(len(w) for w in want.values())


def test_rotations_keep_lengths_and_probes_start_at_the_own_cell():
    rng = np.random.default_rng(1)
    space = ann.Space(20, 50, 1.0, 3, 2, 5)
    v = rng.normal(size=(50, 20))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    x = space.lifted(v, True)
    assert np.allclose(np.linalg.norm(space.turned(x, 1, 1), axis=1), 1) and np.allclose(space.turned(x, 0, 0) @ space.turned(x, 0, 0).T, x @ x.T)
    cells, probed = space.cells(v), space.probed(v, 64 * 64)
    assert (probed[:, :, 0] == cells).all()
    assert all(len(set(row.tolist())) == 64 * 64 for row in probed[0])  # all cells, each once


@pytest.mark.parametrize("spread", [0.2, 1.0])
def test_nearest_reaches_its_recall_with_exact_scores(spark, spread):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 24))
    vectors = (centres[rng.integers(0, 30, 3000)] + spread * rng.normal(size=(3000, 24))) * rng.uniform(0.5, 2, (3000, 1))  # lengths differ
    ids = list(range(3000))
    df = table(spark, ids, vectors)
    got, want = found(ann.nearest(df, df.where("vec_id % 20 = 0"), k=10)), brute(ids, vectors, ids[::20], 10)
    assert recall(got, want) >= 0.9 and all(len(x) == 10 for x in got.values())
    e = np.array(vectors, np.float32).astype(np.float64)
    assert all(-s == (e[q] * e[i]).sum() for q, hits in got.items() for s, i in hits)


def test_combined_rotations_and_split_cells_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(20, 8))[rng.integers(0, 20, 6000)] + 0.1 * rng.normal(size=(6000, 8))
    ids = list(range(6000))
    df, want = table(spark, ids, vectors), brute(ids, vectors, ids[::100], 5)
    monkeypatch.setattr(ann, "CELL", 10)
    monkeypatch.setattr(ann, "QUERY_NUMBERS", 16)
    monkeypatch.setattr(ann, "HELD", 3)
    rows = ann._valid(df, "vec_id", "embedding")
    asked = rows.where("id % 100 = 0")
    _, spaces, _ = ann.built(rows, asked, Scratch(spark, "test"), 5, 4, 50, 0.95)
    assert spaces[8].combined >= 2
    assert recall(found(ann.nearest(df, df.where("vec_id % 100 = 0"), k=5)), want) >= 0.9


def test_copies_and_ties_go_to_small_ids(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(600, 16))
    vectors[100:500] = vectors[100]  # very many copies
    ids = rng.permutation(600).tolist()
    df = table(spark, ids, vectors)
    asked = ids[90:130]
    got = found(ann.nearest(df, df.where(df.vec_id.isin(asked)), k=7, recall=1.0))
    assert got == brute(ids, vectors, asked, 7)


def test_nearest_takes_odd_rows(spark):
    nan, inf = math.nan, math.inf
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None, 12, 12]
    vectors = [[1, 0, 0], [0, 1, 0], None, [], [0, 0, 0], [1, None, 0], [nan, 1, 0], [inf, 0, 0], [1e30, 0, 1], [5, 5], [1, 1, 1], [2, 0, 0], [0, -3, 0]]
    df = table(spark, ids, vectors)
    got = found(ann.nearest(df, df, k=20))
    assert sorted(got) == [1, 2, 9, 12]
    assert [i for _, i in got[1]] == [9, 12, 2, 12] and got[2] == [(0.0, 1), (0.0, 9), (0.0, 12), (3.0, 12)]
    assert [i for _, i in got[12]][:2] == [9, 1]
    assert ann.nearest(df.limit(0), df.limit(0)).collect() == [] and ann.nearest(df, df.limit(0)).collect() == []
    doubles = table(spark, [1, 2, 3], [[1, 0.1], [1, 0.2], [0.1, 1]], "double")
    assert [i for _, i in found(ann.nearest(doubles, doubles, k=1))[1]] == [2]


def test_queries_whose_cells_hold_too_few_are_completed(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 12))
    ids = list(range(300))
    df, want = table(spark, ids, vectors), brute(ids, vectors, ids[::20], 250)
    monkeypatch.setattr(ann, "measured", lambda *a: (1, 1.0))  # far too few probes
    monkeypatch.setattr(ann, "QUERY_NUMBERS", 50)
    assert found(ann.nearest(df, df.where("vec_id % 20 = 0"), k=250)) == want
    few = df.where("vec_id < 9")
    assert found(ann.nearest(few, few, k=20)) == brute(ids[:9], vectors[:9], ids[:9], 20)
