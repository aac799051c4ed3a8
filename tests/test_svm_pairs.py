"""C-SVC over all pairs, cross-validation, batch scoring of odd rows, coupling and Platt."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import svm as V
from kestrel.operators import svm_fit as W
from kestrel.operators.counts import Family, count_cells
from kestrel.sources.nominal import NominalData, reject_missing


def blobs(spark, n=90, seed=0):
    rng = np.random.default_rng(seed)
    centre = np.array([[0, 0], [3, 0], [0, 3]])
    rows = [(i, int(i % 3) + 5, [float(v) for v in centre[i % 3] + rng.normal(0, 0.8, 2)]) for i in range(n)]
    return spark.createDataFrame(rows, "rid long, label int, features array<double>"), rows


def test_csvc_is_a_minimum_and_scores(spark):
    df, rows = blobs(spark)
    weights = {6: 2.0}
    m = W.csvc_fit(df, C=0.7, weights=weights)
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    rng = np.random.default_rng(1)
    for p, (i, j) in enumerate([(5, 6), (5, 7), (6, 7)]):
        use = (y == i) | (y == j)
        s = np.where(y[use] == i, 1.0, -1.0)
        c = 0.7 * np.where(y[use] == 6, 2.0, 1.0)

        def value(w, b):
            return 0.5 * w @ w + (c * np.maximum(0, 1 - s * (x[use] @ w + b))).sum()

        w, b = m.sv[p], -m.rho[p]
        best = min(value(w + d[:2], b + d[2]) for d in rng.normal(0, 0.05, (500, 3)))
        assert value(w, b) <= best + 0.02 * value(w, b)
    back = V.parse_model_text(V.model_to_text(m))
    pred = {r.rid: r.prediction for r in V.score_arrow(df, back, keep=("rid",)).collect()}
    assert np.mean([pred[r[0]] == r[1] for r in rows]) > 0.9


def test_cross_validation_equals_fold_by_fold_fits(spark):
    df, _ = blobs(spark, 60, 2)
    got = W.csvc_cross_validate(df, 3).collect()
    assert len(got) == 60 and {r.fold for r in got} == {0, 1, 2}
    fold = {r.rid: r.fold for r in got}
    tagged = df.join(spark.createDataFrame(list(fold.items()), "rid long, fold int"), "rid")
    same = 0
    for f in range(3):
        m = W.csvc_fit(tagged.where(F.col("fold") != f))
        one = {r.rid: r.prediction for r in V.score_arrow(tagged.where(F.col("fold") == f), m, keep=("rid",)).collect()}
        same += sum(one[r.rid] == r.prediction for r in got if r.fold == f)
    assert same >= 58  # both stop within their tolerance


@pytest.mark.parametrize("few", [64, 0])
def test_nu_svr_scales_as_c_per_row(spark, monkeypatch, few):
    monkeypatch.setattr(W, "FEW_TASKS", few)  # both ways of adding partial sums
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, 200)
    df = spark.createDataFrame([([float(a)], float(2 * a + 1 + e)) for a, e in zip(x, rng.normal(0, 0.05, 200))], "features array<double>, label double")
    w, b, _ = W.primal_fit(df, "nu_svr", C=1.0)
    assert abs(w - 2) < 0.1 and abs(b - 1) < 0.1


def test_rows_wider_than_the_support_vectors(spark):
    m = V.SvmModel(svm_type="c_svc", kernel_type="rbf", sv=np.array([[1.0, 0.0]]), sv_coef=np.array([[1.0]]), rho=[0.5], labels=[1, -1], n_sv=[1, 0], gamma=1.0)
    df = spark.createDataFrame([("a", [1.0, 0.0, 2.0]), ("b", [1.0]), ("c", [])], "id string, features array<double>")
    got = {r.id: r for r in V.score_arrow(df, m, with_decisions=True).collect()}
    assert got["a"].dec[0] == pytest.approx(np.exp(-4) - 0.5) and got["a"].prediction == -1
    assert got["b"].dec[0] == pytest.approx(0.5) and got["c"].dec[0] == pytest.approx(np.exp(-1) - 0.5)


def test_precomputed_kernel_scores_and_checks(spark):
    m = V.SvmModel(svm_type="c_svc", kernel_type="precomputed", sv=np.array([[2.0], [1.0]]), sv_coef=np.array([[1.0, -1.0]]), rho=[0.0], labels=[1, -1], n_sv=[1, 1])
    df = spark.createDataFrame([("a", [1.0, 0.2, 0.9]), ("b", [2.0, 0.9, 0.2])], "id string, features array<double>")
    assert {r.id: r.prediction for r in V.score_arrow(df, V.parse_model_text(V.model_to_text(m))).collect()} == {"a": 1.0, "b": -1.0}
    with pytest.raises(Exception, match="fewer than 3 kernel values"):
        V.score_arrow(df.select("id", F.slice("features", 1, 2).alias("features")), m).collect()


def test_coupling_solves_its_equations():
    rng = np.random.default_rng(4)
    p = rng.dirichlet(np.ones(5), 40)
    r = p[:, :, None] / (p[:, :, None] + p[:, None, :])
    r[:, np.arange(5), np.arange(5)] = 0
    assert np.allclose(V.multiclass_probability(r), p, atol=0.01)  # consistent pairs give back p
    assert np.allclose(V.multiclass_probability(r).sum(1), 1)


def test_platt_reaches_the_optimum(spark):
    rng = np.random.default_rng(5)
    f = rng.normal(0, 2, 300)
    y = np.where(rng.random(300) < 1 / (1 + np.exp(-1.5 * f + 0.4)), 1, -1)
    a, b = W.platt_fit(spark.createDataFrame([(float(u), int(v)) for u, v in zip(f, y)], "dec double, label int"))
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    gap = t - 1 / (1 + np.exp(a * f + b))
    assert abs(gap.sum()) < 1e-3 and abs((gap * f).sum()) < 1e-3


@pytest.mark.parametrize("wide", [False, True])
def test_bad_codes_fail_alike_in_both_counting_paths(spark, monkeypatch, wide):
    from kestrel.operators import counts

    monkeypatch.setattr(counts, "EXPLICIT_FAMILY_LIMIT", 0 if wide else 400)
    fams = [Family(0, (1,)), Family(1, ())]
    for a0, text in ((5, "out of range: a0 = 5"), (None, "missing value is unsupported: a0")):
        df = spark.createDataFrame([(1, 0, 0, 0), (2, a0, 1, 1)], "rid long, a0 int, a1 int, cls int")
        with pytest.raises(Exception, match=text):
            count_cells(NominalData(df, ("a0", "a1"), (2, 2), 2), fams, collapse_duplicates=False).collect()


@pytest.mark.parametrize("wide", [False, True])
def test_parent_codes_beyond_32_bits(spark, monkeypatch, wide):
    from kestrel.operators import counts

    monkeypatch.setattr(counts, "EXPLICIT_FAMILY_LIMIT", 0 if wide else 400)
    df = spark.createDataFrame([(1, 2999, 2999, 2999, 1, 0)], "rid long, a0 int, a1 int, a2 int, a3 int, cls int")
    data = NominalData(df, ("a0", "a1", "a2", "a3"), (3000, 3000, 3000, 2), 2)
    (cell,) = count_cells(data, [Family(3, (0, 1, 2))], collapse_duplicates=False).collect()
    assert (cell.pidx, cell.v, cell.n) == (3000**3 - 1, 1, 1.0)


def test_missing_attribute_raises(spark):
    df = spark.createDataFrame([(1, None, 0)], "rid long, a0 int, cls int")
    data = NominalData(df, ("a0",), (2,), 2)
    with pytest.raises(Exception, match="missing value is unsupported"):
        reject_missing(data).df.select("rid").collect()
