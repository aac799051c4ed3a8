"""The trainer's sums over equal rows and its batch against plain formulas (op6_lm_scoring)."""

import numpy as np

from kestrel.llm import lm


def test_sums_over_runs_equal_a_loop():
    rng = np.random.default_rng(2)
    for idx in (rng.integers(0, 9, 400), rng.integers(0, 300, 400), np.repeat([3, 70000], [1, 30]), np.array([5]), np.zeros(0, np.int64)):
        val, times = rng.normal(size=(len(idx), 3)), np.ones(len(idx), np.int64)
        rows, g, n = lm._row_sums(idx, val, times)
        assert rows.tolist() == sorted(set(idx.tolist()))
        assert all(np.allclose(g[k], val[idx == r].sum(0)) and n[k] == (idx == r).sum() for k, r in enumerate(rows))
        if len(idx):
            order = np.argsort(idx, kind="stable")
            some = lm._sums(idx[order][::2], val[order][::2])
            merged = lm._merged((some[0], some[1].copy(), some[3]), lm._row_sums(idx, val, times))
            both = np.concatenate([idx[order][::2], idx]), np.concatenate([val[order][::2], val])
            assert sorted(merged[0].tolist()) == rows.tolist()
            assert all(np.allclose(merged[1][k], both[1][both[0] == r].sum(0)) and merged[2][k] == (both[0] == r).sum() for k, r in enumerate(merged[0]))


def test_log_sums_of_large_and_small_scores():
    s = np.array([[0.0, 1.0], [200.0, 100.0], [-200.0, -300.0]], np.float32)
    assert np.allclose(lm._log_sum(s.copy()), [np.log(1 + np.e), 200, -200])
    assert np.allclose(lm._log_sum(s[:1].copy()), [np.log(1 + np.e)])


def test_a_batch_moves_every_row_by_its_plain_gradient():
    """One batch with the noise it draws, token by token in 64 bits."""
    unigram = np.array([90, 60, 50, 40, 30, 20, 20, 10, 9, 8, 7, 6], np.int64)
    pick = np.random.default_rng(4)
    w, u, v = (pick.choice(12, 500, p=unigram / unigram.sum()) for _ in range(3))
    model = lm.LogBilinear.start(unigram)
    k, first, m0 = model.k, model.first, model.m.astype(float)
    noise = model.noise(unigram)
    cum, edge, mass, kinds, log_class, log_word = noise
    g2, touched = np.zeros(len(m0), np.float32), np.zeros(len(m0), np.int64)
    model.train(u, v, w, noise, np.random.default_rng(8), g2, touched)

    rng, grad, times = np.random.default_rng(8), np.zeros_like(m0), np.zeros(len(m0), np.int64)
    neg = np.minimum(np.searchsorted(edge[1:], rng.random(lm.NOISE) * edge[-1], "right"), len(mass) - 1)
    own = [c for c in np.unique(kinds[w]) if first[c + 1] - first[c] > 1]
    place = edge[own][:, None] + rng.random((len(own), lm.WORD_NOISE)) * mass[own][:, None]
    no = {c: np.clip(np.searchsorted(cum, place[j], "right"), first[c], first[c + 1] - 1) for j, c in enumerate(own)}
    for a, b, t in zip(u, v, w, strict=True):
        c = kinds[t]
        x = np.append(m0[a, :-1] * m0[-2, :-1] + m0[b, :-1] * m0[-1, :-1], 1)
        targets = [(2 * k + c, log_class[c], 1), *((2 * k + j, log_class[j], 0) for j in neg)]
        if c in no:
            targets += [(k + t, log_word[t], 1), *((k + j, log_word[j], 0) for j in no[c])]
        pull = np.zeros(len(x) - 1)
        for row, log_noise, real in targets:
            err = real - 1 / (1 + np.exp(-(x @ m0[row] - log_noise)))
            grad[row] += err * x
            times[row] += 1
            pull += err * m0[row, :-1]
        for row, other in ((a, -2), (b, -1)):
            grad[row, :-1] += pull * m0[other, :-1]
            grad[other, :-1] += pull * m0[row, :-1]
            times[row] += 1
            times[other] += 1
    square = (grad * grad).mean(1)
    want = m0 + (lm.RATE / np.sqrt(square + lm.SMOOTH))[:, None] * grad
    assert (touched == times).all()
    assert np.allclose(g2, square, rtol=1e-3, atol=1e-5)
    assert np.allclose(model.m, want, atol=1e-4)
