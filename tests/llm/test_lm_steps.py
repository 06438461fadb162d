"""Steps of the language model's network, taken by blocks of rows in the order of their targets."""

from collections import Counter

import numpy as np
import pytest

from lorewell.llm import lm_score


def brute(net, x, y):
    e, b, w, c, v, d = (p.astype(float) for p in net.parts(net.vector))
    out = []
    for around, u in zip(x, y, strict=True):
        h = np.maximum(sum(e[k][a] for k, a in enumerate(around)) + b, 0)
        g, m = divmod(int(u), net.per)
        for z, at in ((w @ h + c, g), (v[g] @ h + d[g], m)):
            out.append(z[at] - z.max() - np.log(np.exp(z - z.max()).sum()))
    return np.array(out).reshape(-1, 2).sum(axis=1)


@pytest.mark.parametrize("block", [3, 512])
def test_a_step_follows_the_gradient(monkeypatch, block):
    monkeypatch.setattr(lm_score, "BLOCK", block)
    rng = np.random.default_rng(4)
    lengths = np.array([5, 1, 9, 30])
    windows = lm_score.Windows(rng.integers(0, 20, 45).astype(np.int32), lengths, 20)
    net = lm_score.Network(20, width=3)
    net.vector = rng.normal(0, 0.5, len(net.vector))
    past, seen = np.full_like(net.vector, 1e-6), 0
    x, y = (np.concatenate(parts) for parts in zip(*windows.chunks(), strict=True))
    assert net.log_probs(x, y) == pytest.approx(brute(net, x, y))
    for row, at in windows.stretches(7):
        some = slice(seen, seen + len(at))
        g, before = net.gradient(x[some], y[some]), net.vector.copy()
        old = past.copy()
        net.descend(past, row, at, 0.1)
        assert past == pytest.approx(old + g * g)
        assert net.vector == pytest.approx(before - 0.1 * g / np.sqrt(old + g * g))
        seen += len(at)
    assert seen == 45


@pytest.mark.parametrize("sign", [1, -1])
def test_sums_that_floats_do_not_hold_are_shifted(sign):
    net, rng = lm_score.Network(12, width=3), np.random.default_rng(2)
    net.vector = rng.normal(0, 1, len(net.vector)).astype(np.float32)
    net.parts(net.vector)[5][:] += sign * 300
    net.parts(net.vector)[3][:] += sign * 300
    x, y = rng.integers(0, 13, (40, 4)), rng.integers(0, 12, 40)
    assert net.log_probs(x, y) == pytest.approx(brute(net, x, y), rel=1e-3, abs=1e-3)
    assert np.isfinite(net.gradient(x, y)).all()


def test_pieces_between_spaces_are_cut_into_words_once():
    (batch,) = lm_score._counted(Counter({"a-b": 3, "b": 2, "--": 1, "b_b": 1}))
    assert dict(zip(*batch.to_pydict().values(), strict=True)) == {"a": 3, "b": 7}
