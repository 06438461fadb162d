"""Words of toxicity's texts are scored together, as each alone."""

import random

import numpy as np
import pytest

from lorewell.llm import toxicity

TEXTS = ["The the. THE, don't anananana", "İß ß. été 日本語テキスト \U0001d504x\U0001d504\U0001d504", "-- ''", "a bb ccc dddd eeeee", "x" * 500 + " aa " + "-" * 300 + "b", "", None]


def test_words_scored_together_have_the_mean_of_their_subwords():
    weights = np.random.default_rng(1).normal(size=toxicity.BUCKETS)
    words = ["a", "bb", "ananananana", "été", "日本語テキスト", "x\U0001d504" * 9, "abc" * 60]
    want = [weights[toxicity.subwords(w)].mean() for w in words]
    assert toxicity.mean_weights(words, weights).tolist() == pytest.approx(want)


def test_no_word_is_cut_by_itself(monkeypatch):
    rng = random.Random(3)
    texts = TEXTS + [" ".join("".join(rng.choices("abcéß.,", k=rng.randint(1, 9))) for _ in range(50)) for _ in range(40)]
    weights = np.random.default_rng(2).normal(size=toxicity.BUCKETS)
    model = toxicity.ToxicityModel(weights, 0.1)
    want = [model.score(t, toxicity.WordScores(weights.tolist())) for t in texts]
    alone, real = [], toxicity.subwords
    monkeypatch.setattr(toxicity, "subwords", lambda token: alone.append(token) or real(token))
    assert list(model.scores(texts, toxicity.WordScores(weights.tolist(), limit=20), at_once=7)) == pytest.approx(want)
    assert {len(t) for t in alone} == {500, 301}  # only tokens that are not held as strings
