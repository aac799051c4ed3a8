"""Training jobs: quantiles, kernel maps, nu problems, probabilities, cross-validation, checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import svm as V
from kestrel.operators import svm_fit as W
from kestrel.operators import svm_train as T
from kestrel.operators.quantile import exact_quantiles


def blobs(spark, n=90, seed=0, spread=0.8):
    rng = np.random.default_rng(seed)
    centre = np.array([[0, 0], [3, 0], [0, 3]])
    rows = [(i, int(i % 3) + 5, [float(v) for v in centre[i % 3] + rng.normal(0, spread, 2)]) for i in range(n)]
    return spark.createDataFrame(rows, "rid long, label int, features array<double>").coalesce(1), rows


# ------------------------------------------------------------------------ quantiles
@pytest.mark.parametrize("buckets", [16, 512])
def test_quantiles_equal_sorted_running_weights(spark, buckets):
    rng = np.random.default_rng(buckets)
    rows = [(int(g), float(v), float(w)) for g, v, w in zip(rng.integers(0, 4, 300), rng.choice([0, 1, 1e-9, -5, 1e6, *rng.normal(0, 3, 40)], 300), rng.integers(0, 4, 300))]
    rows += [(9, 2.5, 1.0)] * 5 + [(None, 1.0, 2.0), (None, 4.0, 2.0), (0, None, 1.0), (0, float("nan"), 1.0), (0, 3.0, None)]
    df = spark.createDataFrame(rows, "g int, v double, w double")
    for share in (0.0, 0.5, 1.0) if buckets == 16 else (0.25,):
        got = {r.g: (r.lower, r.upper, r.below, r["at"]) for r in exact_quantiles(df, F.col("v"), share, ["g"], F.col("w"), buckets).collect()}
        want = {}
        for g in {r[0] for r in rows}:
            mine = sorted((v, w) for k, v, w in rows if k == g and v is not None and v == v and w)
            total, run, out = sum(w for _, w in mine), 0.0, None
            values = sorted({v for v, _ in mine})
            for i, v in enumerate(values):
                at = sum(w for u, w in mine if u == v)
                if run + at >= share * total:
                    nxt = values[i + 1] if i + 1 < len(values) else v
                    out = (v, nxt if run + at == share * total else v, run, at)
                    break
                run += at
            want[g] = out
        assert got == want


def test_quantiles_of_an_empty_table_and_of_extreme_values(spark):
    df = spark.createDataFrame([], "v double")
    assert exact_quantiles(df, F.col("v"), 0.5).collect() == []
    df = spark.createDataFrame([(x,) for x in (-1.7e308, -1e-300, 0.0, 1e-300, 1.7e308)], "v double")
    assert [exact_quantiles(df, F.col("v"), s).first().lower for s in (0.2, 0.4, 0.6, 0.8, 1.0)] == [-1.7e308, -1e-300, 0.0, 1e-300, 1.7e308]


# ---------------------------------------------------------------------- kernel maps
KERNELS = [("rbf", dict(gamma=0.5)), ("polynomial", dict(gamma=0.5, coef0=1.0, degree=2)), ("sigmoid", dict(gamma=0.05)), ("linear", {})]


@pytest.mark.parametrize("kernel,par", KERNELS)
def test_map_is_the_kernel_at_its_landmarks(spark, kernel, par):
    rng = np.random.default_rng(1)
    marks, x = rng.normal(size=(2, 6)), rng.normal(size=(20, 6))
    m = T.map_of_landmarks(marks, kernel, **par)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate([*x, *marks])], "id int, features array<double>")
    phi = np.array([r.features for r in m.transform(df).orderBy("id").collect()])
    base = V.SvmModel("c_svc", kernel, marks, np.ones((1, 2)), [0.0], **par)
    assert np.allclose(phi[:20] @ phi[20:].T, V.kernel_matrix_np(base, x, (x * x).sum(1)))


def test_map_error_falls_with_landmarks(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([([float(v) for v in r],) for r in rng.normal(size=(200, 3))], "features array<double>")
    errors = [T.kernel_map(df, "rbf", landmarks=k, gamma=0.3).error(df) for k in (2, 10, 50, 200)]
    assert errors[0] > errors[1] > errors[2] > errors[3] >= -1e-9 and errors[3] < 1e-6


def test_landmarks_are_repeatable_and_distinct(spark):
    df = spark.createDataFrame([([1.0, 2.0],)] * 500 + [([float(i), 0.0],) for i in range(5)], "features array<double>")
    a, b = (T.kernel_map(d, "rbf", landmarks=4, gamma=1.0).base.sv for d in (df, df.repartition(7)))
    assert (a == b).all() and len(np.unique(a, axis=0)) == 4


@pytest.mark.parametrize("kernel,par", [("rbf", dict(gamma=1.0)), ("polynomial", dict(gamma=1.0, coef0=1.0, degree=2))])
def test_kernel_fits_what_no_line_separates(spark, kernel, par):
    rng = np.random.default_rng(3)
    angle, radius = rng.uniform(0, 2 * np.pi, 160), np.where(np.arange(160) % 2, 2.0, 0.7) + rng.normal(0, 0.1, 160)
    rows = [(i, i % 2, [float(r * np.cos(a)), float(r * np.sin(a))]) for i, (a, r) in enumerate(zip(angle, radius))]
    df = spark.createDataFrame(rows, "rid long, label int, features array<double>").coalesce(1)
    m, _ = T.train(df, "c_svc", kernel, landmarks=40, C=10.0, **par)
    back = V.parse_model_text(V.model_to_text(m))
    assert back.kernel_type == kernel
    got = V.score_arrow(df, back, keep=("rid", "label"), with_decisions=True).collect()
    assert np.mean([r.prediction == r.label for r in got]) > 0.97
    assert [r.prediction for r in got] == [r.prediction for r in V.score_arrow(df, m, keep=("rid",)).collect()]


def test_sigmoid_and_three_labels(spark):
    df, rows = blobs(spark)
    m, _ = T.train(df, "c_svc", "sigmoid", landmarks=30, gamma=0.1, C=10.0)
    pred = V.score_arrow(df, m, keep=("rid", "label")).collect()
    assert m.n_sv == [30, 30, 0] and np.mean([r.prediction == r.label for r in pred]) > 0.85


def test_precomputed_kernel_fits(spark):
    df, rows = blobs(spark, 45)
    x = np.array([r[2] for r in rows])
    k = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(2))
    pre = spark.createDataFrame([(r[0], r[1], [float(i + 1), *map(float, k[i])]) for i, r in enumerate(rows)], "rid long, label int, features array<double>")
    m, _ = T.train(pre, "c_svc", "precomputed", landmarks=45)
    n, _ = T.train(df, "c_svc", "rbf", landmarks=45, gamma=0.5)
    a, b = ({r.rid: r.prediction for r in V.score_arrow(d, V.parse_model_text(V.model_to_text(mm)), keep=("rid",)).collect()} for d, mm in ((pre, m), (df, n)))
    assert np.mean([a[i] == b[i] for i in a]) > 0.95


# ---------------------------------------------------------------------- nu problems
def test_nu_svc_has_the_nu_property_and_equals_its_c_svc(spark):
    df, rows = blobs(spark, 120, spread=1.3)
    nu = 0.4
    m, f = T.train(df, "nu_svc", nu=nu)
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    for p, (i, j) in enumerate([(5, 6), (5, 7), (6, 7)]):
        use = (y == i) | (y == j)
        s = np.where(y[use] == i, 1.0, -1.0)
        margin = s * (x[use] @ m.sv[p] - m.rho[p])
        assert np.mean(margin < 1 - 1e-6) <= nu + 1e-9 <= np.mean(margin <= 1 + 1e-6) + 2e-2
        c = f.reported[0][p]

        def value(w, b):
            return 0.5 * w @ w + c * np.maximum(0, 1 - s * (x[use] @ w + b)).sum()

        rng = np.random.default_rng(p)
        best = min(value(m.sv[p] + d[:2], -m.rho[p] + d[2]) for d in rng.normal(0, 0.02, (400, 3)))
        assert value(m.sv[p], -m.rho[p]) <= best * 1.002  # a minimum of the C-SVC with the reported C


def test_one_class_dual_weights_add_up_to_nu_l(spark):
    rng = np.random.default_rng(6)
    x = rng.normal([2, 1], 0.4, size=(50, 2))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "rid long, features array<double>").coalesce(1)
    nu = 0.3
    m, _ = T.train(df, "one_class", nu=nu)
    alpha = np.full(50, nu)  # projected gradient on the dual: 0 <= a <= 1, sum a = nu l
    for _ in range(20_000):
        a = alpha - 0.002 * (x @ (x.T @ alpha))
        lo, hi = a.min() - 1, a.max()
        for _ in range(50):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.clip(a - mid, 0, 1).sum() > nu * 50 else (lo, mid)
        alpha = np.clip(a - (lo + hi) / 2, 0, 1)
    assert alpha.sum() == pytest.approx(nu * 50)
    assert np.allclose(m.sv[0], x.T @ alpha, rtol=0.02)
    dec = np.array([r.dec[0] for r in V.score_arrow(df, m, keep=("rid",), with_decisions=True).collect()])
    assert (dec < -1e-9).sum() <= nu * 50 <= (dec <= 1e-9).sum() + 1


def test_one_feature_problems_are_exact(spark):
    x = np.array([1.0, 2.0, 4.0, 8.0, 16.0])
    df = spark.createDataFrame([([float(v)],) for v in x], "features array<double>")
    m, _ = T.train(df, "one_class", nu=0.5)  # sum of 2.5 lowest
    assert m.sv[0, 0] == pytest.approx(1 + 2 + 0.5 * 4) and m.rho[0] == pytest.approx(5 * 4)


def test_nearest_point_of_a_hull():
    rng = np.random.default_rng(9)
    for _ in range(50):
        pts = rng.normal(rng.normal(0, 1, 3), 1, size=(8, 3))
        share = T.nearest_point(pts, np.eye(8)[0])
        v = share @ pts
        assert share.min() >= 0 and share.sum() == pytest.approx(1)
        assert (pts @ v >= v @ v - 1e-9).all()  # no point lies lower in its direction


# ----------------------------------------------------------- probabilities and folds
def test_platt_of_all_pairs_equals_one_by_one(spark):
    rng = np.random.default_rng(7)
    rows = [(int(c), [float(v) for v in rng.normal([c, 1 - c, 0.3], 1)]) for c in rng.integers(0, 3, 200)]
    df = spark.createDataFrame(rows, "label int, dec array<double>").coalesce(1)
    a, b = T.platt_pairs(df, [0, 1, 2])
    for p, (i, j) in enumerate([(0, 1), (0, 2), (1, 2)]):
        one = df.where(F.col("label").isin(i, j)).select(F.element_at("dec", p + 1).alias("dec"), F.when(F.col("label") == i, 1).otherwise(-1).alias("label"))
        assert (a[p], b[p]) == pytest.approx(W.platt_fit(one), abs=1e-4)


def test_probability_model_saves_and_sums_to_one(spark):
    df, rows = blobs(spark)
    m, _ = T.train(df, "c_svc", probability=1)
    back = V.parse_model_text(V.model_to_text(m))
    assert back.prob_a == m.prob_a and len(m.prob_b) == 3
    got = V.score_arrow(df, back, keep=("rid", "label"), probability=True).collect()
    assert all(sum(r.probability) == pytest.approx(1) for r in got)
    assert np.mean([r.prediction == r.label for r in got]) > 0.9


def test_fold_without_a_label_decides_for_the_other(spark):
    rows = [(i, 1 if i else 2, [float(i)]) for i in range(10)]  # one row of label 2: its fold trains on label 1 only
    df = spark.createDataFrame(rows, "rid long, label int, features array<double>")
    dec, _ = T.out_of_fold(df, "c_svc", folds=5)
    assert {r.rid: r.dec[0] for r in dec.collect()}[0] == 1.0


@pytest.mark.parametrize("kind", ["epsilon_svr", "nu_svr"])
def test_regression_folds_score_and_noise(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.uniform(-1, 1, 150)
    rows = [(i, float(2 * a + 1 + e), [float(a)]) for i, (a, e) in enumerate(zip(x, rng.laplace(0, 0.1, 150)))]
    df = spark.createDataFrame(rows, "rid long, label double, features array<double>").coalesce(1)
    r = T.regression_cv(df, kind, C=10.0, p=0.05).first()
    assert r.mse < 0.04 and r.scc > 0.95 and 0.05 < r.sigma < 0.15
    m, f = T.train(df, kind, C=10.0, p=0.05, probability=1)
    back = V.parse_model_text(V.model_to_text(m))
    pred = {q.rid: q.prediction for q in V.score_arrow(df, back, keep=("rid",)).collect()}
    assert np.mean([(pred[i] - y) ** 2 for i, y, _ in rows]) < 0.04 and back.prob_a[0] == pytest.approx(r.sigma, rel=0.2)


def test_rbf_regression_follows_a_curve(spark):
    x = np.linspace(-3, 3, 120)
    df = spark.createDataFrame([(i, float(np.sin(v)), [float(v)]) for i, v in enumerate(x)], "rid long, label double, features array<double>").coalesce(1)
    m, _ = T.train(df, "epsilon_svr", "rbf", gamma=0.5, C=10.0, p=0.01, landmarks=30)
    pred = np.array([r.prediction for r in V.score_arrow(df, m, keep=("rid",)).orderBy("rid").collect()])
    assert np.abs(pred - np.sin(x)).max() < 0.1


def test_summary_counts_rows_of_every_pair(spark):
    rows = [(0, [0.5, 1.0, 9.0]), (0, [1.0, 2.0, -9.0]), (1, [-2.0, 0.0, 0.2]), (2, [0.0, -1.0, 0.0])]
    df = spark.createDataFrame(rows, "label int, dec array<double>")
    got = {(r.label_i, r.label_j): (r.n_sv, r.n_inside) for r in T.summary(df, [0, 1, 2]).collect()}
    assert got == {(0, 1): (2, 1), (0, 2): (2, 0), (1, 2): (2, 2)}


# --------------------------------------------------------------------------- checks
@pytest.mark.parametrize("par,text", [
    (dict(svm_type="c_svm"), "unknown svm type"), (dict(kernel_type="cubic"), "unknown kernel type"), (dict(gamma=-1.0, kernel_type="rbf"), "gamma < 0"),
    (dict(degree=-1, kernel_type="polynomial"), "degree of polynomial kernel < 0"), (dict(C=0.0), "C <= 0"), (dict(svm_type="nu_svc", nu=1.5), "nu <= 0 or nu > 1"),
    (dict(svm_type="epsilon_svr", p=-0.1), "p < 0"), (dict(probability=2), "probability != 0 and probability != 1"),
    (dict(svm_type="one_class", probability=1), "one-class SVM probability output not supported yet"), (dict(svm_type="nu_svc", nu=0.9), "specified nu is infeasible")])
def test_bad_parameters_stop_a_fit(spark, par, text):
    df = spark.createDataFrame([(i, int(i > 1), [float(i)]) for i in range(12)], "rid long, label int, features array<double>")
    with pytest.raises(ValueError, match=text.replace("(", ".")):
        T.train(df, **par)


def test_unknown_weight_label_warns_and_odd_tables_raise(spark):
    df, _ = blobs(spark, 30)
    with pytest.warns(UserWarning, match="class label 99 specified in weight is not found"):
        T.train(df, weights={99: 2.0})
    with pytest.raises(ValueError, match="two labels"):
        T.train(df.where("label = 5"))
    with pytest.raises(ValueError, match="no rows to fit"):
        T.train(df.limit(0), "one_class")
