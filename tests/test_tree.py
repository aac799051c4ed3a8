"""The C4.5-like tree against a plain recursive one."""

import math
import random
from collections import Counter, defaultdict
from statistics import NormalDist

import pytest

from kestrel.operators import crossval as CV
from kestrel.operators import evaluation_job as EJ
from kestrel.operators import tree as TR
from kestrel.sources.nominal import NominalData

ATTRS = ("a0", "a1", "a2")


def entropy(rows):
    n = len(rows)
    return -sum(c / n * math.log2(c / n) for c in Counter(r[-1] for r in rows).values())


def added(n, e, cf=0.25):
    if e < 1:
        return n * (1 - cf ** (1 / n))
    if e + 0.5 >= n:
        return max(n - e, 0)
    z, f = NormalDist().inv_cdf(1 - cf), (e + 0.5) / n
    return n * (f + z * z / (2 * n) + z * math.sqrt(f / n - f * f / n + z * z / (4 * n * n))) / (1 + z * z / n) - e


def plain(rows, path="", prune=True):
    """(nodes as path -> (attribute or None, class), estimate of the errors)."""
    n, count = len(rows), Counter(r[-1] for r in rows)
    cls = min(c for c in count if count[c] == max(count.values()))
    errors = n - count[cls]
    own = errors + added(n, errors)
    found = []
    for a in range(len(ATTRS)):
        by = defaultdict(list)
        for r in rows:
            by[r[a]].append(r)
        gain = round(entropy(rows) - sum(len(b) / n * entropy(b) for b in by.values()), 9)
        if gain > 0 and sum(len(b) >= 2 for b in by.values()) >= 2:
            info = -sum(len(b) / n * math.log2(len(b) / n) for b in by.values())
            found.append((gain, round(gain / info, 9), a, by))
    if not found:
        return {path: (None, cls)}, own
    mean = sum(f[0] for f in found) / len(found)
    _, _, att, by = min((f for f in found if f[0] >= mean - 1e-3), key=lambda f: (-f[1], f[2]))
    nodes, parts = {path: (att, cls)}, 0
    for v, part in by.items():
        below, estimate = plain(part, f"{path}/{att}={v}", prune)
        nodes |= below
        parts += estimate
    if prune and round(own, 9) <= round(parts + 0.1, 9):
        return {path: (None, cls)}, own
    return nodes, parts


def walk(nodes, row):
    path = ""
    while True:
        att, cls = nodes[path]
        if att is None or f"{path}/{att}={row[att]}" not in nodes:
            return cls
        path = f"{path}/{att}={row[att]}"


def sample(n, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b, c = rng.randrange(3), rng.randrange(4), rng.randrange(2)
        rows.append((a, b, c, rng.randrange(3) if rng.random() < 0.2 else (a if c else (b + a) % 3)))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rid bigint, a0 int, a1 int, a2 int, cls int")


@pytest.mark.parametrize("prune", [True, False])
def test_tree_equals_the_recursive_one(spark, prune):
    rows = {0: sample(150, 1), 1: sample(40, 2)}
    both = table(spark, rows[0]).selectExpr("*", "0 AS g").union(table(spark, rows[1]).selectExpr("*", "1 AS g"))
    tree = TR.grow(both, ATTRS, prune=prune)
    got = {g: {} for g in rows}
    for r in tree.nodes.collect():
        got[r.g][r.node] = (r.att, r.cls)
    want = {g: plain(rows[g], prune=prune)[0] for g in rows}
    assert got == want
    assert any(len(path) > 4 for path in want[0]) and len(want[0]) > len(want[1]) > 1
    new = [(a, b, c, 0) for a in range(5) for b in range(5) for c in range(3)]  # also values that no tree saw
    for limit in (10**6, 0):  # by broadcast, and by the salted join
        pred = TR.predict(table(spark, new).selectExpr("*", "0 AS g"), tree, limit=limit)
        assert {r.rid: r.prediction for r in pred.collect()} == {i: walk(want[0], r) for i, r in enumerate(new)}


def test_grown_by_salted_joins(spark):
    rows = table(spark, sample(60, 3)).selectExpr("*", "0 AS g")
    a, b = (sorted(TR.grow(rows, ATTRS, limit=k).nodes.select("node", "att", "cls").collect(), key=str) for k in (10**6, 0))
    assert a == b and len(a) > 1


def test_added_errors_of_the_published_table(spark):
    """Quinlan's examples: 0.206 for (6, 0), 0.143 for (9, 0), 0.750 for (1, 0) at 25 %."""
    got = spark.createDataFrame([(6.0, 0.0), (9.0, 0.0), (1.0, 0.0), (16.0, 1.0)], "n double, e double")
    got = [r[0] for r in got.select(TR.added_errors(got.n, got.e) / got.n).collect()]
    assert [round(x, 3) for x in got[:3]] == [0.206, 0.143, 0.75]
    assert got[3] == pytest.approx(added(16, 1) / 16)


def test_folds_are_scored_by_the_trees_grown_without_them(spark):
    rows = sample(90, 4)
    fv = CV.fold_vectors(NominalData(table(spark, rows), ATTRS, (3, 4, 2), 3), 2, 3, 1)
    fold = {r.rid: list(r.folds) for r in fv.data.df.collect()}
    got = TR.cv_predict(fv).collect()
    assert len(got) == 180
    for rep in range(2):
        for f in range(3):
            nodes, _ = plain([r for i, r in enumerate(rows) if fold[i][rep] != f])
            mine = {r.rid: r.prediction for r in got if (r.rep, r.fold) == (rep, f)}
            assert mine == {i: walk(nodes, rows[i]) for i in fold if fold[i][rep] == f}


def test_label_noise_of_the_training_sets(spark):
    """A third of each training set flips; the rest and the folds stay."""
    fv = CV.fold_vectors(NominalData(table(spark, sample(90, 5)), ATTRS, (3, 4, 2), 3), 2, 3, 1)
    clean = {(r.g, r.rid): r.cls for r in TR.training_rows(fv).collect()}
    noisy = {(r.g, r.rid): r.cls for r in TR.training_rows(fv, 0.3).collect()}
    assert clean.keys() == noisy.keys()
    flipped = Counter(k[0] for k in clean if clean[k] != noisy[k])
    sizes = Counter(k[0] for k in clean)
    assert flipped == {g: int(n * 0.3) for g, n in sizes.items()}


def test_small_tables(spark):
    one = table(spark, [(0, 0, 0, 2)]).selectExpr("*", "0 AS g")
    tree = TR.grow(one, ATTRS)
    assert [(r.node, r.att, r.cls) for r in tree.nodes.collect()] == [("", None, 2)]
    assert [r.prediction for r in TR.predict(one, tree).collect()] == [2]
    none = TR.grow(one.limit(0), ATTRS)
    assert none.nodes.count() == 0
    assert [r.prediction for r in TR.predict(one, none).collect()] == [None]


def test_tree_in_the_evaluation_job(spark, tmp_path):
    d = tmp_path / "sets"
    d.mkdir()
    (d / "xor.csv").write_text("\n".join(["p,q,class", *[f"{'ab'[i % 2]},{'cd'[i // 2 % 2]},{'yes' if (i % 2) and (i // 2 % 2) else 'no'}" for i in range(48)]]) + "\n")
    got = EJ.evaluate_folder(spark, str(d), str(tmp_path / "report"), ["tree"], repeats=1, folds=3).first()
    assert got.report == "xor.csv, 100.0:0.0, " and not got.failed
