"""Fits over packed blocks: what passes read, and how many margins become rows (F8, F11, F13)."""

import numpy as np
import pytest

from kestrel.operators import svm as V
from kestrel.operators import svm_fit as W
from kestrel.operators import svm_train as T


def test_blocks_hold_the_rows_and_split_by_size(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_BYTES", 64)  # 4 rows of two values
    rows = [([float(i)] if i % 3 else [float(i), None], i % 2, -1) for i in range(50)] + [([], 1, 0)]
    df = spark.createDataFrame(rows, "x array<double>, c int, g int").coalesce(1)
    kinds = {"c": "i4", "g": "i4"}
    packed = W.packed(df, kinds)
    got = [(tuple(r), int(c), int(g)) for b in packed.toArrow().to_batches() for x, cs, gs in W.read_blocks(b, kinds, 3) for r, c, g in zip(x, cs, gs)]
    assert packed.count() == 13
    assert got == [((float(i), 0.0, 0.0), i % 2, -1) for i in range(50)] + [((0.0, 0.0, 0.0), 1, 0)]


@pytest.mark.parametrize("kind", ["nu_svc", "one_class"])
def test_few_margins_become_rows(spark, monkeypatch, kind):
    """Thresholds and pulls are those of a sort; a fraction of the margins goes through rows."""
    rng = np.random.default_rng(3)
    x, y = np.round(rng.normal(size=(600, 2)), 1), np.arange(600) % 2
    df = spark.createDataFrame([([float(a), float(b)], int(c)) for (a, b), c in zip(x, y)], "features array<double>, label int")
    job = T.prepare(df, kind, nu=0.5)
    seen, real = [], T.exact_quantiles
    monkeypatch.setattr(T, "exact_quantiles", lambda long, *a, **k: (seen.append(long.count()), real(long, *a, **k))[1])
    w = np.array([[0.4, -0.3]])
    got = T.offsets(job, w)
    assert job.data.count() < 60 and seen[0] < 60
    want, sides = np.zeros(2), [(y == 0, 1.0, 150.0, 600.0), (y == 1, -1.0, 150.0, 600.0)] if kind == "nu_svc" else [(y >= 0, 1.0, 300.0, 300.0)]
    for s, (on, sign, goal, size) in enumerate(sides):
        m = sign * (x[on] @ w.T)[:, 0]
        order = np.sort(m)
        low, up = order[int(goal) - 1], order[int(goal)]
        assert got.t[0, s] == pytest.approx((low + up) / 2, abs=1e-12)
        share = np.where(m < low, 1.0, np.where(m == low, (goal - (m < low).sum()) / (m == low).sum(), 0.0))
        want += sign * (share[:, None] * x[on]).sum(0) / size
    assert got.w[0] == pytest.approx(want, abs=1e-9)


def test_folds_of_platt_are_dealt_once(spark):
    """The training rows of a fold are read back, not dealt again."""
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 3)], 1 if i % 7 > 3 else -1) for i in range(70)], "rid long, features array<double>, label int")
    plans = []

    def fit(train):
        plans.append(train._jdf.queryExecution().toString())
        return W.csvc_fit(train, C=1.0)

    got = W.out_of_fold_decisions(df, fit)
    assert got.count() == 70 and len(plans) == 5 and not any("md5" in p for p in plans)


def test_scoring_and_maps_take_long_batches_in_runs(spark, monkeypatch):
    """No kernel matrix of a task holds a whole Arrow batch against all support vectors (F15)."""
    rng = np.random.default_rng(5)
    x, marks = rng.normal(size=(4000, 3)), rng.normal(size=(300, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>").coalesce(1)
    m = V.SvmModel("c_svc", "rbf", marks, rng.normal(size=(1, 300)), [0.1], labels=[0, 1], n_sv=[150, 150], gamma=0.5)
    want = V.kernel_matrix_np(m, x) @ m.pair_coefficients() - 0.1
    real = V.kernel_matrix_np

    def small(m, x, norms=None):
        if len(x) * m.l * 8 > 1 << 22:
            raise ValueError(f"{len(x)} rows against {m.l} support vectors at once")
        return real(m, x, norms)

    monkeypatch.setattr(V, "kernel_matrix_np", small)
    monkeypatch.setattr(T, "kernel_matrix_np", small)
    got = {r.id: r for r in V.score_arrow(df, m, with_decisions=True).collect()}
    assert np.allclose([got[i].dec[0] for i in range(4000)], want[:, 0], rtol=0, atol=1e-9)
    kmap = T.map_of_landmarks(marks, "rbf", gamma=0.5)
    phi = np.array([r.features for r in kmap.transform(df).orderBy("id").collect()])
    assert np.allclose(phi, real(kmap.base, x, (x * x).sum(1)) @ kmap.root, rtol=0, atol=1e-6)
