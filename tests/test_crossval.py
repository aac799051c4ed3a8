"""Fold vectors, label noise in training folds, models of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import bayes as B
from kestrel.operators import bayes_join as BJ
from kestrel.operators import crossval as CV
from kestrel.operators import counts as C
from kestrel.operators import evaluate as E
from kestrel.operators import prep as P
from kestrel.operators.folds import interleaved_folds, with_repeats
from kestrel.sources.nominal import NominalData


def some(spark, n=240, seed=0, weight=False):
    rng = np.random.default_rng(seed)
    cls = rng.choice(3, n, p=[0.6, 0.3, 0.1])
    rows = [(int(i), int((c + rng.integers(0, 2)) % 3), int(rng.integers(0, 4)), int(c if rng.random() < 0.6 else rng.integers(0, 3)), int(c), float(1 + i % 3)) for i, c in enumerate(cls)]
    df = spark.createDataFrame(rows, "rid long, a0 int, a1 int, a2 int, cls int, w double")
    return NominalData(df, ("a0", "a1", "a2"), (3, 4, 3), 3, weight="w" if weight else None)


@pytest.mark.parametrize("repeats,folds", [(3, 4), (25, 7)])
def test_fold_vectors_are_the_folds_of_every_repeat(spark, repeats, folds):
    data = some(spark, 100)
    got = {(r.rid, i): f for r in CV.fold_vectors(data, repeats, folds, 5).data.df.collect() for i, f in enumerate(r.folds)}
    rows = interleaved_folds(with_repeats(data.df.select("rid", "cls"), repeats), folds, rep="rep", seed=5)
    assert got == {(r.rid, r.rep): r.fold for r in rows.collect()}


@pytest.mark.parametrize("rate,weight", [(0.1, False), (0.5, True)])
def test_noisy_training_counts_equal_refits(spark, rate, weight):
    data = some(spark, weight=weight)
    fv = CV.fold_vectors(data, 2, 3, 3)
    spec = B.ande_spec(data, n_dep=1)
    cell = ["component", "att", "cls", "pidx", "v"]
    got = {(r.g, *(r[c] for c in cell)): r.n for r in CV.training_counts(fv, spec, rate).collect()}
    want = {}
    rows = fv.exploded().persist()
    for rep in range(2):
        for fold in range(3):
            train = rows.where((F.col("rep") == rep) & (F.col("fold") != fold))
            noisy = P.label_noise(train, rate, 3, seed=CV.NOISE_SEED + rep)
            assert noisy.join(train.select("rid", F.col("cls").alias("was")), "rid").where("cls <> was").count() == int(train.count() * rate)
            for r in BJ.family_counts(data.with_df(noisy), spec).collect():
                want[(rep * 3 + fold, *(r[c] for c in cell))] = r.n
    assert got == pytest.approx(want)


def test_noise_rate_is_checked_and_zero_is_the_plain_run(spark):
    data = some(spark, 60)
    fv = CV.fold_vectors(data, 1, 3, 1)
    with pytest.raises(ValueError, match="Noise rate can not larger than 0.5"):
        CV.training_counts(fv, B.ande_spec(data, n_dep=0), 0.6)
    clean = {(r.rep, r.fold): r.accuracy for r in CV.cv_accuracy(fv, lambda d: B.ande_spec(d, n_dep=0)).collect()}
    tiny = {(r.rep, r.fold): r.accuracy for r in CV.cv_accuracy(fv, lambda d: B.ande_spec(d, n_dep=0), 1e-9).collect()}
    assert clean == tiny and len(clean) == 3


def _specs(data):
    free = [(0, 0, [3]), (0, 1, [0, 3]), (0, 2, [1]), (0, 3, [1]), (1, 0, []), (1, 1, [3]), (1, 2, [0, 1, 3]), (1, 3, [])]
    fixed = [(0, 0, [1, 3]), (0, 1, [3]), (0, 2, [0, 1, 3]), (0, 3, [3])]
    return {"nb": B.ande_spec(data, n_dep=0), "a1de": B.ande_spec(data, n_dep=1, limit=30.0), "a2de": B.ande_spec(data, n_dep=2), "norm": B.ande_spec(data, n_dep=1, limit=30.0, joint=False),
            "m": B.ande_spec(data, n_dep=1, m_estimate=True, m=2.0), "fixed": B.rbnc_spec(data, fixed), "free": B.rbnc_spec(data, free), "mle": B.rbnc_spec(data, fixed, alpha=0.0)}


@pytest.mark.parametrize("name,hot", [("nb", 32), ("a1de", 1), ("a1de", 32), ("a2de", 32), ("norm", 32), ("m", 32), ("fixed", 32), ("free", 1), ("mle", 32)])
def test_join_scores_equal_batch_scores(spark, monkeypatch, name, hot):
    """Rows that were not trained on, so values and parent codes that never occur are met."""
    monkeypatch.setattr(BJ, "HOT", hot)
    data, other = some(spark, 40, 1), some(spark, 200, 2)
    spec = _specs(data)[name]
    counts = BJ.family_counts(data, spec)
    want = {r.rid: r for r in B.score(other.df, B.fit(data, spec, counts=counts)).collect()}
    got = {r.rid: r for r in BJ.predict(other.df, data, spec, counts, limit=1).collect()}
    assert got.keys() == want.keys()
    for rid, r in got.items():
        assert np.allclose(r.probability, want[rid].probability, atol=1e-9, equal_nan=True), (name, rid)


def test_groups_in_runs_and_by_join_equal_one_model(spark):
    data = some(spark)
    fv = CV.fold_vectors(data, 2, 3, 1)
    spec_fn = lambda d: B.ande_spec(d, n_dep=1)
    size = spec_fn(data).offsets()[1]
    runs = [{(r.rep, r.fold): round(r.accuracy, 9) for r in CV.cv_accuracy(fv, spec_fn, limit=limit).collect()} for limit in (10**9, 2 * size, 1)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 6


def test_wide_models_join_through_higher_order_cells(spark, monkeypatch):
    data = some(spark, 80)
    spec = B.ande_spec(data, n_dep=2)
    counts = BJ.family_counts(data, spec)
    a = {r.rid: r.probability for r in BJ.predict(data.df, data, spec, counts, limit=1).collect()}
    monkeypatch.setattr(BJ, "EXPLICIT_FAMILY_LIMIT", 0)
    b = {r.rid: r.probability for r in BJ.predict(data.df, data, spec, counts, limit=1).collect()}
    assert all(np.allclose(a[i], b[i]) for i in a) and a.keys() == b.keys()


def test_join_scores_every_tuple_once(spark, monkeypatch):
    data = some(spark, 3000)
    seen, cells = [], BJ._explicit_cells
    monkeypatch.setattr(BJ, "_explicit_cells", lambda shape, *a: seen.append(shape.df) or cells(shape, *a))
    spec = B.ande_spec(data, n_dep=1)
    counts = BJ.family_counts(data, spec)
    # two rows outside the domains are scored row by row
    odd = spark.createDataFrame([(9001, 99, 1, 1, 0, 1.0), (9002, None, 1, 1, 0, 1.0)], data.df.schema)
    got = {r.rid: r for r in BJ.predict(data.df.union(odd), data, spec, counts, limit=1).collect()}
    assert sum(df.count() for df in seen) <= 36 + 2
    assert len(got) == 3002
    want = {r.rid: r for r in B.score(data.df, B.fit(data, spec)).collect()}
    for rid, r in want.items():
        assert got[rid].prediction == r.prediction and np.allclose(got[rid].probability, r.probability, atol=1e-9)
    old = {r.rid: r for r in BJ._score_rows(odd, spec, counts, None, ("rid",)).collect()}
    assert all(np.allclose(got[i].probability, old[i].probability, equal_nan=True) for i in (9001, 9002))


def test_cross_validation_counts_and_scores_tuples(spark, monkeypatch):
    """Thousands of rows are at most domain x classes x repeats x folds weighted tuples, with the same accuracies."""
    data, seen = some(spark, 2000, weight=True), []
    score = B.score
    monkeypatch.setattr(B, "score", lambda df, *a, **kw: seen.append(df) or score(df, *a, **kw))
    fv = CV.fold_vectors(data, 2, 3, 5)
    by_tuple = {n: CV.cv_accuracy(fv, lambda d: B.ande_spec(d, n_dep=1), noise=n).collect() for n in (0.0, 0.1)}
    summary = E.cv_summary(data, lambda d: B.ande_spec(d, n_dep=1), "m", repeats=2, folds=3, seed=5).first()
    assert all(df.count() <= 36 * 3 * 2 * 3 for df in seen) and len(seen) == 3
    monkeypatch.setattr(CV, "_collapse_pays", lambda *a: False)
    fv = CV.fold_vectors(data, 2, 3, 5)
    for n, rows in by_tuple.items():
        want = {(r.rep, r.fold): r.accuracy for r in CV.cv_accuracy(fv, lambda d: B.ande_spec(d, n_dep=1), noise=n).collect()}
        assert {(r.rep, r.fold) for r in rows} == set(want) and len(want) == 6
        assert all(abs(r.accuracy - want[r.rep, r.fold]) < 1e-12 for r in rows)
    assert abs(summary.acc_mean - np.mean([r.accuracy for r in by_tuple[0.0]])) < 1e-12


def test_noisy_classes_are_not_made_again_for_a_check(spark, monkeypatch):
    """Codes are checked on the rows as read; the class that noise draws lies in the domain (F10)."""
    few, real = [], CV.collapse
    monkeypatch.setattr(CV, "collapse", lambda *a, **k: (few.append(real(*a, **k)), few[-1])[1])
    df = spark.range(60).selectExpr("id AS rid", "cast(id % 2 AS int) AS a0", "cast(id % 3 AS int) AS cls")
    fv = CV.fold_vectors(NominalData(df, ("a0",), (2,), 3), 2, 3, 1)
    CV.training_counts(fv, B.ande_spec(fv.data, n_dep=0), 0.2)
    plan = few[-1].df._jdf.queryExecution().optimizedPlan().toString()
    assert "out of range: cls" in plan and "out of range: _c" not in plan


def test_keys_of_batches_are_md5(monkeypatch):
    import hashlib

    from kestrel.functions import md5

    monkeypatch.setattr(md5, "RUN", 100)
    tens = 10 ** np.arange(19)
    ids = np.concatenate([np.arange(1500), tens, tens - 1, -tens, [2**63 - 1, -(2**63), -1]])
    for prefix in ("1|", "109|c|", "-12|"):
        want = [int(hashlib.md5(f"{prefix}{i}".encode()).hexdigest()[:16], 16) for i in ids.tolist()]
        assert md5.keys(prefix, ids).tolist() == want
    assert len(md5.keys("1|", ids[:0])) == 0


def _in_small_blocks(monkeypatch):
    for name, value in {"RUN_ROWS": 70, "RANK_ROWS": 40, "DEAL_CELLS": 300}.items():
        monkeypatch.setattr(CV, name, value)


@pytest.mark.parametrize("repeats,folds", [(3, 4), (12, 300)])
def test_folds_travel_in_blocks(spark, monkeypatch, repeats, folds):
    """No record a row and repeat is sorted or shuffled, and every place is small (F2)."""
    _in_small_blocks(monkeypatch)
    data = some(spark, 500)
    ids = F.col("rid") * F.when(F.col("rid") % 3 == 0, -(10**12)).otherwise(7)
    data = data.with_df(data.df.withColumn("rid", ids).withColumn("note", F.array(F.col("a0").cast("string"), F.lit(None))))
    seen, put = [], CV._written_vectors
    monkeypatch.setattr(CV, "_written_vectors", lambda data, rows, *a: seen.append(rows) or put(data, rows, *a))
    rows = CV.fold_vectors(data, repeats, folds, 5).data.df
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Window", "Sort", "Generate", "Join"))
    got = {(r.rid, i): f for r in rows.collect() for i, f in enumerate(r.folds)}
    want = interleaved_folds(with_repeats(data.df.select("rid", "cls"), repeats), folds, rep="rep", seed=5)
    assert got == {(r.rid, r.rep): r.fold for r in want.collect()}
    assert sorted(map(str, rows.drop("folds").collect())) == sorted(map(str, data.df.collect()))


def test_folds_of_texts_and_of_rows_without_class(spark, monkeypatch):
    _in_small_blocks(monkeypatch)
    data = some(spark, 200)
    texts = CV.fold_vectors(data.with_df(data.df.withColumn("rid", F.col("rid").cast("string"))), 3, 4, 5).data.df
    assert {int(r.rid): r.folds for r in texts.collect()} == {r.rid: r.folds for r in CV.fold_vectors(data, 3, 4, 5).data.df.collect()}
    odd = data.with_df(data.df.withColumn("cls", F.when(F.col("rid") != 7, F.col("cls"))))
    want = interleaved_folds(with_repeats(odd.df.select("rid", "cls"), 3), 4, rep="rep", seed=5)
    got = {(r.rid, i): f for r in CV.fold_vectors(odd, 3, 4, 5).data.df.collect() for i, f in enumerate(r.folds)}
    assert got == {(r.rid, r.rep): r.fold for r in want.collect()}


def test_equal_first_bits_are_settled_by_the_whole_key():
    import hashlib

    ids, kind = np.array([5, 9, 2, 7, 4, 1]), np.array([0, 0, 0, 1, 1, 1])
    order = np.arange(6)
    CV._settle(ids, np.array([3, 3, 3, 3, 4, 4], np.uint64), kind, order, "1|")
    whole = lambda i: hashlib.md5(f"1|{ids[i]}".encode()).hexdigest()
    assert order.tolist() == [*sorted([0, 1, 2], key=whole), 3, *sorted([4, 5], key=whole)]


@pytest.mark.parametrize("rate,weight", [(0.0, True), (0.1, False), (0.4, True)])
def test_arrays_over_tuples_count_as_expressions_do(spark, monkeypatch, rate, weight):
    data = some(spark, 700, weight=weight)
    spec = B.ande_spec(data, n_dep=1)
    runs = []
    for dense in (CV.DENSE_BYTES, 0):
        monkeypatch.setattr(CV, "DENSE_BYTES", dense)
        fv = CV.fold_vectors(data, 2, 3, 3)
        assert fv.dense == (dense > 0)
        cells = {(r.rep, r.fold, r.g, r.a0, r.a1, r.a2, r.cls): r.weight for r in fv.cells.df.collect()}
        counts = {(r.g, r.component, r.att, r.cls, r.pidx, r.v): r.n for r in CV.training_counts(fv, spec, rate).collect()}
        runs.append((cells, counts))
        _in_small_blocks(monkeypatch)
    assert runs[0][0] == pytest.approx(runs[1][0]) and runs[0][1] == pytest.approx(runs[1][1])


def test_arrays_over_tuples_refuse_bad_codes(spark):
    data = some(spark, 50)
    bad = data.with_df(data.df.withColumn("a1", F.when(F.col("rid") == 3, 99).otherwise(F.col("a1"))))
    with pytest.raises(Exception, match="code out of range: a1 = 99"):
        CV.training_counts(CV.fold_vectors(bad, 2, 3, 3), B.ande_spec(bad, n_dep=0), 0.1).collect()
