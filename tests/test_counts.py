"""C-1 / C-2 goldens (FIXTURES F1, F2) and count-table properties."""

from pyspark.sql import functions as F

from kestrel.operators import counts as C
from kestrel.operators.structures import structure_from_rows
from kestrel.sources.nominal import NominalData, parse_nominal_text

# FIXTURES F1: one row, two components over 5 binary attributes + class (index 5).
F1_STRUCT = [
    (0, 0, [1, 2, 5]), (0, 1, [2, 5]), (0, 2, [5]), (0, 3, [5]), (0, 4, [5]), (0, 5, [5]),
    (1, 0, [1, 2, 5]), (1, 1, [2, 5]), (1, 2, [1, 5]), (1, 3, [5]), (1, 4, [2, 5]), (1, 5, [5]),
]
F1_CELLS = {
    0: [(0, 1, 3, 1), (1, 1, 3, 0), (2, 1, 1, 1), (3, 1, 1, 0), (4, 1, 1, 0), (5, 1, 1, 1)],
    1: [(0, 1, 3, 1), (1, 1, 3, 0), (2, 1, 1, 1), (3, 1, 1, 0), (4, 1, 3, 0), (5, 1, 1, 1)],
}


def _one_row(spark):
    lines = spark.createDataFrame([("1,0,1,0,0,1",)], "line STRING")
    df = parse_nominal_text(lines, 5).withColumn("rid", F.lit(0).cast("long"))
    return NominalData(df, tuple(f"a{i}" for i in range(5)), (2,) * 5, 2)


def test_f1_mapper_cells_with_class_digit(spark):
    data = _one_row(spark)
    st = structure_from_rows(spark, F1_STRUCT)
    got = C.count_structure(data, st, include_class_digit=True).collect()
    cells = {(r.component, r.att, r.cls, r.pidx, r.v): r.n for r in got}
    want = {(c, *cell): 1.0 for c, cs in F1_CELLS.items() for cell in cs}
    assert cells == want


def test_f2_merge_is_elementwise_sum(spark):
    # T1 = {{{{1,2},{3}},{{4,5},{6,7}}}} in [att][cls][pidx][v] order, ragged
    t1 = [(0, 0, 0, 0, 0, 1.0), (0, 0, 0, 0, 1, 2.0), (0, 0, 0, 1, 0, 3.0),
          (0, 0, 1, 0, 0, 4.0), (0, 0, 1, 0, 1, 5.0), (0, 0, 1, 1, 0, 6.0), (0, 0, 1, 1, 1, 7.0)]
    schema = "component INT, att INT, cls INT, pidx INT, v INT, n DOUBLE"
    d1 = spark.createDataFrame(t1, schema)
    d3 = spark.createDataFrame([(*r[:5], r[5] * 10) for r in t1], schema)
    assert sorted(r.n for r in C.merge_counts(d1).collect()) == [1, 2, 3, 4, 5, 6, 7]
    got = sorted(r.n for r in C.merge_counts(d1, d1, d3).collect())
    assert got == [12, 24, 36, 48, 60, 72, 84]


def _ninst(spark):
    from kestrel.sources.tables import ninst
    from tests.conftest import SF001
    return ninst(spark, SF001)


def test_cells_sum_to_rows_and_merge_equals_union(spark):
    from kestrel.operators.structures import random_structure_fixed
    from kestrel.plans.catalog import attributes
    data = _ninst(spark)
    n = data.df.count()
    st = random_structure_fixed(attributes(data), data.d, 5, 2, seed=3)
    fams = C.families_from_structure(C.collect_structure(st), data.d)
    whole = C.count_families(data, fams)
    per = whole.groupBy("component", "att").agg(F.sum("n").alias("s")).collect()
    assert all(r.s == n for r in per)
    a = data.with_df(data.df.where(F.col("rid") % 2 == 0))
    b = data.with_df(data.df.where(F.col("rid") % 2 == 1))
    merged = C.merge_counts(C.count_families(a, fams), C.count_families(b, fams))
    key = ["component", "att", "cls", "pidx", "v"]
    assert merged.exceptAll(whole.select(*key, "n")).count() == 0
    assert whole.select(*key, "n").exceptAll(merged).count() == 0


def test_wide_paths_equal_explicit(spark, monkeypatch):
    from kestrel.operators.structures import random_structure_fixed
    from kestrel.plans.catalog import declared_attributes
    data = _ninst(spark)
    st = random_structure_fixed(declared_attributes(data), data.d, 6, 3, seed=4)
    fams = C.families_from_structure(C.collect_structure(st), data.d)
    fams += [(100 + c, f) for c, f in C.anDE_families(data.d, 1)]
    rows = data.df.withColumn("fold", (F.col("rid") % 3).cast("int"))
    dk = data.with_df(rows)
    for keys, digit in (((), False), ((), True), (("fold",), False)):
        explicit = C.count_families(dk, fams, keys=keys, include_class_digit=digit)
        monkeypatch.setattr(C, "EXPLICIT_FAMILY_LIMIT", 0)
        monkeypatch.setattr(C, "ARROW_FAMILY_CHUNK", 7)
        arrow = C.count_families(dk, fams, keys=keys, include_class_digit=digit)
        hof = C.count_cells(dk, list(dict.fromkeys(f for _, f in fams)), keys=keys,
                            include_class_digit=digit, hof=True)
        monkeypatch.undo()
        assert explicit.exceptAll(arrow).count() == 0 and arrow.exceptAll(explicit).count() == 0
        assert hof.count() == C.count_cells(dk, list(dict.fromkeys(f for _, f in fams)), keys=keys,
                                            include_class_digit=digit).count()


def test_complement_counts_is_total_minus_fold(spark):
    data = _ninst(spark)
    fams = [(c, f) for c, f in C.anDE_families(data.d, 0) if f.att >= 0]
    rows = data.df.withColumn("fold", (F.col("rid") % 3).cast("int"))
    part = C.count_families(data.with_df(rows), fams, keys=("fold",))
    train = C.complement_counts(part, "fold", 3)
    direct = C.count_families(data.with_df(rows.where(F.col("fold") != 1)), fams)
    t1 = train.where("fold = 1").drop("fold")
    assert t1.exceptAll(direct).count() == 0 and direct.exceptAll(t1).count() == 0
