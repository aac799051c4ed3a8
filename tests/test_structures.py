"""B-1..B-3 rules and the structure round trip (FIXTURES F3)."""

from kestrel.operators import structures as S


def test_f3_roundtrip_sorts_parents(spark, tmp_path):
    rows = [(0, 0, [2, 3]), (0, 1, [2]), (0, 3, [1, 0]), (1, 0, [1, 3]), (1, 1, [1, 2]), (1, 2, [0, 1])]
    st = S.structure_from_rows(spark, rows)
    path = str(tmp_path / "st")
    st.write.parquet(path)
    back = {(r.component, r.att): list(r.parents) for r in spark.read.parquet(path).collect()}
    assert back[(0, 3)] == [0, 1] and back[(1, 2)] == [0, 1] and back[(0, 0)] == [2, 3]


def _atts(spark, d):
    return spark.range(d).selectExpr("CAST(id AS INT) AS att")


def test_fixed_structure_rules(spark):
    d, m = 6, 2
    rows = S.random_structure_fixed(_atts(spark, d), d, size=4, max_parents=m, seed=7).collect()
    for r in rows:
        ps = list(r.parents)
        assert ps == sorted(ps)
        if r.att == d:
            assert ps == [d]
        else:
            assert ps[-1] == d and len(ps) - 1 == min(r.att, m) and all(p < r.att for p in ps[:-1])
    assert len(rows) == 4 * (d + 1)


def test_shuffled_structure_rules(spark):
    d, m = 6, 2
    rows = S.random_structure_shuffled(_atts(spark, d), d, size=3, max_parents=m, seed=1).collect()
    per = {}
    for r in rows:
        per.setdefault(r.component, {})[r.att] = list(r.parents)
    for comp, fam in per.items():
        sizes = sorted(len(p) - 1 for a, p in fam.items() if a != d)
        assert sizes == sorted(min(k, m) for k in range(d))
        assert all(d in p for p in fam.values())


def test_free_structure_has_class_node(spark):
    d = 5
    rows = S.random_structure_free(_atts(spark, d), d, size=2, max_parents=2, seed=0).collect()
    assert {r.att for r in rows} == set(range(d + 1))
    assert sum(1 for r in rows if len(r.parents) == 0) == 2
