"""Ranked search against brute force, its pruning, and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from lorewell.llm import ranked

WORDS = ["ab", "cd", "Ef", "g1", "überall", "日本", "x", "yy", "zzz", "q9", "öl", "ton"]


def brute(texts, items, k=10):
    """(item_id, rank, doc_id, score) by the formula alone."""
    cut = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs = [(d, cut(t)) for d, t in texts]
    n_docs, length = sum(1 for _, w in docs if w), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item_id, text in items:
        scores = []
        for d, w in docs:
            tf, m = Counter(w), 25 + (75 * len(w) * n_docs) // max(length, 1)
            s = sum(weight[t] * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in cut(text) if tf[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item_id, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return out


def order(rows):
    return sorted(rows, key=lambda r: (str(r[0]), r[1], str(r[2])))


def test_search_gives_what_brute_force_gives(spark):
    rng = random.Random(3)
    texts = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(WORDS, weights=range(1, 13), k=rng.choice([1, 3, 8, 40])))) for i in range(400)]
    texts += [(1000 + i, t) for i, (_, t) in enumerate(texts[:60])]  # copies: equal scores
    items = [(i, " ".join(rng.choices(WORDS, k=n))) for i, n in enumerate([1, 2, 2, 5, 30])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = [tuple(r) for r in ranked.ranked_search(docs, spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert order(found) == order(brute(texts, items))


def test_search_leaves_low_nodes_unopened():
    rng = np.random.default_rng(1)
    n = 4096
    at, terms = np.repeat(np.arange(n), 2), np.tile([0, 1], n)
    scores = rng.integers(1, 100, 2 * n)
    scores[2 * 700 : 2 * 710] += 1000
    tree, best = ranked.Tree(at, terms, scores), ranked.Best(5)
    scored = ranked.search(tree, pa.array(range(n)), np.array([0, 1]), np.array([1, 2]), best)
    sums = scores[::2] + 2 * scores[1::2]
    assert [(-h[0], h[3]) for h in best.held] == sorted(((int(s), i) for i, s in enumerate(sums)), key=lambda x: (-x[0], x[1]))[:5]
    assert scored < n / 4


def test_equal_bounds_are_opened():
    n = 4096  # all scores equal: the smallest ids win, wherever they stand
    ids = np.random.default_rng(2).permutation(n)
    tree, best = ranked.Tree(np.arange(n), np.zeros(n, np.int64), np.full(n, 7)), ranked.Best(4)
    ranked.search(tree, pa.array(ids), np.array([0]), np.array([1]), best)
    assert [h[3] for h in best.held] == [0, 1, 2, 3]


def test_search_takes_odd_rows(spark):
    texts = [(1, "ab cd"), (1, "ab cd"), (2, None), (3, ""), (None, "AB"), (None, "AB"), (4, "ab " * 50_000 + "w" * 3_000_000), (5, "--")]
    items = [(7, "ab ab"), (7, "cd"), (None, "ab"), (8, None), (9, "nowhere")]
    docs = spark.createDataFrame([(*t, 1, 2) for t in texts], "doc_id long, text string, item int, score int")
    own = spark.createDataFrame(items, "item_id long, text string")
    assert order(tuple(r) for r in ranked.ranked_search(docs, own).collect()) == order(brute(texts, items))
    assert ranked.ranked_search(docs.limit(0), own).collect() == [] and ranked.ranked_search(docs, own.limit(0)).collect() == []


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    texts = [(i, " ".join(WORDS[i % 5 : i % 5 + 4])) for i in range(50)]
    items = [(i, WORDS[i] + " " + WORDS[i + 1]) for i in range(6)]
    monkeypatch.setattr(ranked, "ITEM_BYTES", 12)
    docs, own = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert order(tuple(r) for r in ranked.ranked_search(docs, own).collect()) == order(brute(texts, items))
