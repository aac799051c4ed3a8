"""Bayes scoring, folds and preprocessing properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.operators import bayes as B
from kestrel.operators import folds as FO
from kestrel.operators import prep as P
from kestrel.sources.tables import linst, ninst
from tests.conftest import SF001


def test_probabilities_sum_to_one_and_twin_agrees(spark):
    data = ninst(spark, SF001)
    model = B.fit(data, B.ande_spec(data, n_dep=1))
    fast = {r.rid: list(r.probability) for r in B.score(data.df, model).collect()}
    twin = {r.rid: list(r.probability) for r in B.score_sql(data.df, model).collect()}
    assert fast.keys() == twin.keys()
    for k, p in fast.items():
        assert abs(sum(p) - 1) < 1e-9
        assert np.allclose(p, twin[k], atol=1e-12)


def test_rbnc_twin_agrees(spark):
    from kestrel.operators import counts as C
    from kestrel.operators.structures import random_structure_shuffled
    from kestrel.plans.catalog import attributes
    data = linst(spark, SF001)
    st = random_structure_shuffled(attributes(data), data.d, 4, 2, seed=2)
    model = B.fit(data, B.rbnc_spec(data, C.collect_structure(st), alpha=0.5))
    fast = {r.rid: list(r.probability) for r in B.score(data.df, model).collect()}
    twin = {r.rid: list(r.probability) for r in B.score_sql(data.df, model).collect()}
    assert all(np.allclose(fast[k], twin[k], atol=1e-12) for k in fast)


def test_bucketed_rank_equals_row_number(spark):
    df = spark.range(5000).select(F.col("id").alias("rid"), (F.col("id") % 3).alias("cls"))
    from kestrel.functions.hashing import h
    got = FO.bucketed_rank(df, ["cls"], h(1, F.col("rid")), "rid", digits=2)
    w = Window.partitionBy("cls").orderBy(h(1, F.col("rid")), "rid")
    want = df.withColumn("_rank", (F.row_number().over(w) - 1).cast("long"))
    a = got.select("rid", "_rank")
    b = want.select("rid", "_rank")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_fold_sizes(spark):
    data = ninst(spark, SF001)
    n = data.df.count()
    f = FO.interleaved_folds(data.df, 10)
    sizes = [r[1] for r in f.groupBy("fold").count().collect()]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    p = FO.proportional_folds(data.df, 5)
    per = p.groupBy("cls", "fold").count().groupBy("cls").agg(F.max("count") - F.min("count")).collect()
    assert all(r[1] <= 1 for r in per)


def test_label_noise_flips_exactly(spark):
    data = ninst(spark, SF001)
    n = data.df.count()
    noisy = P.label_noise(data.df.select("rid", "cls"), 0.1, 3, seed=5)
    changed = noisy.join(data.df.select("rid", F.col("cls").alias("c0")), "rid").where("cls <> c0").count()
    assert changed == int(n * 0.1)


def brute_mdl(x, y, k):
    """Recursive supervised cuts by the same criterion, on sorted rows."""
    x, y = np.asarray(x), np.asarray(y)
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    bits = lambda v: -sum(n * np.log2(n / len(v)) for n in np.bincount(v, minlength=k) if n)
    ends = [i for i in range(1, len(x)) if x[i] != x[i - 1]]
    if not ends:
        return []
    at = min(ends, key=lambda i: round(bits(y[:i]) + bits(y[i:]), 9))
    count = lambda v: np.bincount(v, minlength=k).astype(float)
    if not P._accepts(count(y[:at]), count(y[at:])):
        return []
    return [*brute_mdl(x[:at], y[:at], k), (x[at - 1] + x[at]) / 2, *brute_mdl(x[at:], y[at:], k)]


def test_mdl_cuts_equal_the_recursion(spark):
    rng = np.random.default_rng(6)
    n = 600
    a = rng.normal(0, 1, n).round(2)
    b = rng.integers(0, 12, n).astype(float)
    cls = ((a > 0.3).astype(int) + (b > 7)) % 3
    cls = np.where(rng.random(n) < 0.05, rng.integers(0, 3, n), cls)
    rows = [(float(u), float(v), 1.0, None, int(c)) for u, v, c in zip(a, b, cls)] + [(None, None, None, None, 0)]
    df = spark.createDataFrame(rows, "a double, b double, same double, missing double, cls int")
    got = {r.att: r.cuts for r in P.mdl_cuts(df, ["a", "b", "same", "missing"], "cls", 3).collect()}
    assert got[0] == pytest.approx(brute_mdl(a, cls, 3)) and got[1] == pytest.approx(brute_mdl(b, cls, 3))
    assert len(got[0]) > 0 and len(got[1]) > 0 and got[2] == [] and got[3] == []


def test_driver_and_spark_estimates_agree(spark):
    data = linst(spark, SF001)
    for spec in (B.ande_spec(data, n_dep=2), B.ande_spec(data, n_dep=1, m_estimate=True, m=2.0)):
        a = B.fit(data, spec)
        b = B.fit(data, spec, estimate_in_spark=True)
        assert np.allclose(a.logtab, b.logtab, atol=1e-12) and np.allclose(a.freq, b.freq)


def test_wide_position_gather_equals_dense(spark, monkeypatch):
    from kestrel.operators import counts as C
    from kestrel.operators.structures import random_structure_shuffled
    from kestrel.plans.catalog import declared_attributes
    data = ninst(spark, SF001)
    st = random_structure_shuffled(declared_attributes(data), data.d, 4, 2, seed=9)
    model = B.fit(data, B.rbnc_spec(data, C.collect_structure(st), alpha=0.5))
    dense = {r.rid: list(r.probability) for r in B.score(data.df, model).collect()}
    monkeypatch.setattr(B, "DENSE_POSITION_LIMIT", 0)
    monkeypatch.setattr(B, "WIDE_ROWS_PER_SLICE", 50)
    wide = {r.rid: list(r.probability) for r in B.score(data.df, model).collect()}
    assert dense.keys() == wide.keys()
    assert all(np.allclose(dense[k], wide[k], atol=1e-12) for k in dense)
