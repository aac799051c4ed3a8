"""The evaluation job on small folders of CSV files."""

import pytest

from kestrel.operators import crossval as CV
from kestrel.operators import evaluation_job as EJ


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("sets")
    rows = [f"{'red' if i % 3 else 'blue'},{i % 7 + (i % 2) * 10}.5,{'x' if i % 5 else '?'},{'yes' if i % 2 else 'no'}" for i in range(60)]
    (d / "mixed.csv").write_text("\n".join(["colour,size,mark,class", *rows, "red,,x,", "red,3,x,yes"]) + "\n")
    parts = d / "Parts.csv"
    parts.mkdir()
    for k in range(2):
        (parts / f"part-{k}.csv").write_text("\n".join(["colour,size,mark,class", *rows[k::2]]) + "\n")
    (d / "ragged.csv").write_text("a,b,class\n1,2,x\n1,2\n")
    (d / "zebra.csv").write_text("a,class\n1,x\n2,y\n")
    return str(d)


def test_names_lie_in_the_range_without_regard_to_case(spark, folder):
    assert EJ.dataset_names(spark, folder) == ["Parts.csv", "mixed.csv", "ragged.csv", "zebra.csv"]
    assert EJ.dataset_names(spark, folder, "N", "z") == ["Parts.csv", "ragged.csv"]


def test_a_dataset_becomes_codes(spark, folder):
    data = EJ.prepared(spark, f"{folder}/mixed.csv")
    # the row without a class is gone; ? is imputed and leaves ``mark`` one value; ``size`` is cut once
    assert data.df.count() == 61 and data.cards == (2, 2) and data.n_classes == 2
    got = sorted(tuple(r) for r in data.df.collect())
    assert got[0] == (1, 0, 0, 0) and got[1][0] == 2 and {r[2] for r in got} == {0, 1}


def test_failing_datasets_are_lines_of_the_report(spark, folder, tmp_path):
    got = {r.dataset: r for r in EJ.evaluate_folder(spark, folder, str(tmp_path / "report"), ["nb"], end="z", repeats=2, folds=3).collect()}
    assert set(got) == {"Parts.csv", "mixed.csv", "ragged.csv"}
    assert got["ragged.csv"].failed and got["ragged.csv"].report == "ragged.csv, failed: a row has another number of fields than the header"
    fv = CV.fold_vectors(EJ.prepared(spark, f"{folder}/mixed.csv"), 2, 3, 1)
    r = CV.cv_summary(fv, EJ.MODELS["nb"], "nb").first()
    assert not got["mixed.csv"].failed and got["mixed.csv"].report == f"mixed.csv, {round(r.acc_mean * 100, 2)}:{round(r.acc_std * 100, 2)}, "
    with pytest.raises(ValueError, match="unknown model: c45"):
        EJ.evaluate_folder(spark, folder, str(tmp_path / "other"), ["c45"])


def test_text_is_read_once(spark, folder):
    """Rows and codes come from what was written, not from another pass over the lines (F12)."""
    rows, *_ = EJ.read_dataset(spark, f"{folder}/Parts.csv")
    data = EJ.prepared(spark, f"{folder}/Parts.csv")
    files = [*rows.inputFiles(), *data.df.inputFiles()]
    assert files and not any("Parts.csv" in f for f in files)


def test_line_numbers_run_on_over_splits(spark, tmp_path):
    """A place in the file is the same however the file is cut, and one task may read many splits."""
    from kestrel.sources.nominal import numbered_lines

    (tmp_path / "a.txt").write_text("\n".join(f"a{i}" for i in range(200)) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(f"b{i}" for i in range(50)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("40", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = numbered_lines(spark, str(tmp_path))
            assert "MapInArrow" not in lines._jdf.queryExecution().toString()
            got = lines.collect()
            assert sorted((r.file_no, r.line_no, r.line) for r in got) == [(0, i, f"a{i}") for i in range(200)] + [(1, i, f"b{i}") for i in range(50)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
