"""Primal fits and Platt scaling against brute force on tiny fixtures."""

import numpy as np
from pyspark.sql import functions as F

from kestrel.operators import svm_fit as W


def test_epsilon_svr_recovers_line(spark):
    xs = np.linspace(-1, 1, 41)
    df = spark.createDataFrame([([float(x)], float(2 * x + 1)) for x in xs], "features ARRAY<DOUBLE>, label DOUBLE")
    theta = W.primal_fit(df, "epsilon_svr", C=100.0, eps=0.01, max_iter=60, mus=(0.1, 0.01, 0.001))
    assert abs(theta[0] - 2) < 0.05 and abs(theta[1] - 1) < 0.05


def test_one_class_objective_beats_start(spark):
    rng = np.random.default_rng(0)
    pts = rng.normal(1.0, 0.2, size=(60, 2))
    df = spark.createDataFrame([([float(a), float(b)], 0.0) for a, b in pts], "features ARRAY<DOUBLE>, label DOUBLE")
    theta = W.primal_fit(df, "one_class", nu=0.5, max_iter=40, mus=(0.01,))

    def obj(th):
        w, rho = th[:2], th[2]
        return 0.5 * w @ w - rho + np.maximum(0, rho - pts @ w).sum() / (0.5 * len(pts))

    grid = [np.array([a, b, r]) for a in np.linspace(0, 1.5, 16) for b in np.linspace(0, 1.5, 16)
            for r in np.linspace(0, 2, 21)]
    best = min(obj(g) for g in grid)
    assert obj(theta) <= best + 1e-2


def test_platt_fit_separable_direction(spark):
    rows = [(float(f), 1 if f > 0 else -1) for f in np.linspace(-3, 3, 61)]
    df = spark.createDataFrame(rows, "dec DOUBLE, label INT")
    a, b = W.platt_fit(df)
    assert a < 0 and abs(b) < 0.5


def test_nu_feasibility(spark):
    cc = spark.createDataFrame([(0, 10), (1, 2), (2, 10)], "label INT, count LONG")
    got = {(r.label_i, r.label_j): r.feasible for r in W.nu_feasibility(cc, 0.5).collect()}
    assert got == {(0, 1): False, (0, 2): True, (1, 2): False}
