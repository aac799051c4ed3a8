"""Ranks by range partitions, line numbers from files, segments of the MDL descent."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import prep as P
from kestrel.operators.ranks import dense_ranks
from kestrel.sources import nominal as N


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_dense_ranks_equal_a_sort(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(int(g), None if v == 0 else f"v{v:03d}", i) for i, (g, v) in enumerate(zip(rng.choice([0, 0, 0, 1, 2], 400), rng.integers(0, 60, 400)))] + [(None, "x", -1), (None, None, -2), (3, "only", -3)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.i: r["rank"] for r in dense_ranks(spark.createDataFrame(rows, "g int, v string, i int"), ["g"], "v").collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {}
    for g in {r[0] for r in rows}:
        order = sorted({r[1] for r in rows if r[0] == g}, key=lambda v: (v is not None, v or ""))
        want.update({r[2]: order.index(r[1]) for r in rows if r[0] == g})
    assert got == want


def test_ranks_of_an_empty_table(spark):
    assert dense_ranks(spark.createDataFrame([], "g int, v string"), ["g"], "v").count() == 0


@pytest.mark.parametrize("split", ["64", "1000", "128m"])
def test_line_numbers_do_not_depend_on_the_splits(spark, tmp_path, split):
    files = {"b.txt": ["0,1,0"] * 50 + ["", "1,0,1 "] + ["0,0,1"], "a.txt": ["1,1," + "0" * 400 if i == 3 else f"{i % 2},1,1" for i in range(30)]}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name == "a.txt" else ""))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = {(r.file.rsplit("/", 1)[-1], r.line_no): (r.line, r.rid) for r in N.numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(f, i): (line, (no << N.LINE_BITS) + i) for no, f in enumerate(sorted(files)) for i, line in enumerate(files[f])}


def test_nominal_files_are_read_with_their_places(spark, tmp_path):
    (tmp_path / "x.txt").write_text("0,1,0\n\n1, 0\t,1\n0|0|1\n")
    data = N.read_nominal_text(spark, str(tmp_path), (2, 2), 2)
    assert sorted(map(tuple, data.df.collect())) == [(0, 0, 1, 0), (2, 1, 0, 1), (3, 0, 0, 1)]
    (tmp_path / "y.txt").write_text("0,1\n")
    with pytest.raises(Exception, match="wrong arity"):
        N.read_nominal_text(spark, str(tmp_path), (2, 2), 2).df.collect()


def recursive_cuts(x, c, k):
    """Fayyad and Irani on sorted values, by recursion."""
    def ent(v):
        n = np.bincount(v, minlength=k)
        p = n[n > 0] / n.sum()
        return float(-(p * np.log2(p)).sum()), int((n > 0).sum())

    values = sorted(set(x))
    best = None
    for a, b in zip(values, values[1:]):
        left, right = c[x <= a], c[x > a]
        e = round(len(left) * ent(left)[0] + len(right) * ent(right)[0], 9)
        if best is None or e < best[0]:
            best = (e, a, b)
    if best is None:
        return []
    _, a, b = best
    (h, kk), (h1, k1), (h2, k2), n = ent(c), ent(c[x <= a]), ent(c[x > a]), len(c)
    gain = h - best[0] / n
    if gain <= (math.log2(n - 1) + math.log2(3.0**kk - 2) - (kk * h - k1 * h1 - k2 * h2)) / n:
        return []
    return recursive_cuts(x[x <= a], c[x <= a], k) + [(a + b) / 2] + recursive_cuts(x[x > a], c[x > a], k)


@pytest.mark.parametrize("levels", [1, 8])
def test_segment_descent_equals_the_recursion(spark, monkeypatch, levels):
    monkeypatch.setattr(P, "MDL_LEVELS", levels)
    rng = np.random.default_rng(levels)
    x = rng.integers(0, 200, 900).astype(float)
    c = np.where(rng.random(900) < 0.15, rng.integers(0, 3, 900), (x // 25 % 3).astype(int))
    y, z = rng.normal(size=900).round(1), np.full(900, 4.0)
    df = spark.createDataFrame([(float(a), float(b), float(d), int(k)) for a, b, d, k in zip(x, y, z, c)] + [(None, None, None, 1)], "x double, y double, z double, cls int")
    got = {r.att: list(r.cuts) for r in P.mdl_cuts(df, ["x", "y", "z"], "cls", 3).collect()}
    assert got == {0: recursive_cuts(x, c, 3), 1: recursive_cuts(y, c, 3), 2: []} and len(got[0]) >= 6


def test_distinct_ids_keeps_a_word_for_64_ids(spark):
    ids = [*range(-70, 3000), *range(2000, 2500), 2**60, 2**60 + 1, 2**60, None]
    df = spark.createDataFrame([("a" if i is None or i % 3 else "b", i) for i in ids], "f string, rid long")
    got = {r.f: tuple(r) for r in N.distinct_ids(df, "f", "rid", "rid").collect()}
    want = {r.f: tuple(r) for r in df.groupBy("f").agg(F.count(F.lit(1)), F.countDistinct("rid"), F.max("rid")).collect()}
    assert got == want and sum(v[2] for v in got.values()) < len(ids)


def test_mdl_running_sums_use_no_python(spark):
    """The sums of a range partition are taken by a window, not by a Python function over all of it."""
    df = spark.range(2000).select((F.col("id") * 7 % 1000 / 8).alias("x"), (F.col("id") % 5 / 2).alias("y"), (F.col("id") % 3).cast("int").alias("cls"))
    cum, totals = P._running_counts(df, ["x", "y"], "cls", 3)
    assert {a: sum(n) for a, n in totals.items()} == {0: 2000, 1: 2000}
    rows = sorted((r.att, r.x, r.next_x, list(r.upto)) for r in cum.collect())
    data, want = df.collect(), []
    for att, c in enumerate(("x", "y")):
        values = sorted({r[c] for r in data})
        for v, nxt in zip(values, values[1:]):
            want.append((att, v, nxt, [sum(r[c] <= v and r.cls == k for r in data) for k in range(3)]))
    assert rows == want and not hasattr(P, "pd")
