"""The evaluation job: a folder of datasets, each prepared and cross-validated, one report (E-9, IO-11, IO-13).

A dataset is a CSV file, or a folder of CSV files, with a header and no quoted commas; the last
column is the class.
Names in [begin, end) are taken, without regard to case.  Each dataset is a run of its own: rows
without a class go, missing values are imputed (T-1), numeric columns are cut by MDL
(T-2), attributes with one value are removed (P-5), values become codes, folds are dealt
once (E-1) and every model is cross-validated on them (E-4, with label noise in the training folds if
asked for).  A run that fails becomes a line of the report and stops nothing else.  Runs go
side by side from a small pool, so small datasets share the cluster.

What the driver holds of a dataset is its column names, imputation values, cuts, and the
values of its nominal columns (at most ``MAX_VALUES`` each, checked).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators import bayes as B
from kestrel.operators import crossval as CV
from kestrel.operators import prep as P
from kestrel.operators import structures as S
from kestrel.operators import tree as TR
from kestrel.operators.counts import collect_structure
from kestrel.sources.model_io import scratch_path
from kestrel.sources.nominal import NominalData, in_name_range, numbered_lines

MAX_VALUES = 10_000
MISSING = ("", "?")


def _rbnc(parents: int, size: int = 20, seed: int = 0) -> Callable[[NominalData], B.BayesSpec]:
    def spec(data: NominalData) -> B.BayesSpec:
        atts = data.df.sparkSession.range(data.d).select(F.col("id").cast("int").alias("att"))
        return B.rbnc_spec(data, collect_structure(S.random_structure_shuffled(atts, data.d, size, parents, seed)), alpha=0.5)
    return spec


#: the count models by the names of the report
MODELS: dict[str, Callable[[NominalData], B.BayesSpec]] = {
    "rbnc3": _rbnc(3), "rbnc2": _rbnc(2), "rbnc1": _rbnc(1), "nb": lambda d: B.ande_spec(d, n_dep=0),
    "aode": lambda d: B.ande_spec(d, n_dep=1), "a2de": lambda d: B.ande_spec(d, n_dep=2)}

#: models that are no count models
OTHERS = {"tree": TR.cv_summary}


def dataset_names(spark: SparkSession, folder: str, begin: str | None = None, end: str | None = None) -> list[str]:
    """IO-11: names of the files and folders in ``folder`` that lie in [begin, end), in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    root = folder.rstrip("/").rsplit("/", 1)[-1]
    name = F.split(F.element_at(F.split("path", f"/{root}/"), -1), "/")[0]
    return in_name_range(sorted(r[0] for r in files.select(name).distinct().collect()), begin, end)


def read_dataset(spark: SparkSession, path: str, id_col: str | None = None) -> tuple[DataFrame, list[str], list[str], str]:
    """(rows, numeric columns, nominal columns, class): strings and doubles, null where missing.  ``id_col``
    names the column that identifies a row; without it the place of the line does."""
    lines = numbered_lines(spark, path)
    header = lines.where("line_no = 0").select("line").distinct().collect()
    if len(header) != 1:
        raise ValueError("the files of a dataset have different headers")
    names = [c.strip() for c in header[0].line.split(",")]
    if len(names) != len(set(names)) or len(names) < 2:
        raise ValueError("a header needs two or more different names")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = lines.where((F.col("line_no") > 0) & (F.trim("line") != "")).select("rid", F.size(F.split("line", ",")).alias("n"), F.from_csv("line", schema, {"mode": "PERMISSIVE"}).alias("v"))

    def value(i: int) -> Column:
        v = F.trim(F.col("v")[f"c{i}"])
        return F.when(v.isin(*MISSING), None).otherwise(v)

    # a try: filters may be evaluated on the header lines too
    rid = F.col("v")[f"c{names.index(id_col)}"].try_cast("bigint") if id_col in names else F.col("rid")
    attrs = [i for i, c in enumerate(names) if c != id_col]
    # lines are parsed once; what follows reads the columns that it needs
    rows = rows.select(rid.alias("rid"), "n", *[value(i).alias(f"c{i}") for i in attrs])
    path = scratch_path(spark, "dataset-rows")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    attrs, cls = attrs[:-1], attrs[-1]
    # numeric: every value there is a number, and one is there
    seen = rows.agg(F.max(F.col("n") != len(names)).alias("ragged"), F.max(F.col("rid").isNull()).alias("nameless"),
                    *[(F.count(F.col(f"c{i}").try_cast("double")) == F.count(f"c{i}")).alias(f"c{i}") for i in attrs],
                    *[F.count(f"c{i}").alias(f"n{i}") for i in attrs]).first()
    if seen.ragged:
        raise ValueError("a row has another number of fields than the header")
    if seen.nameless:
        raise ValueError("a row has no id")
    numeric = [i for i in attrs if seen[f"c{i}"] and seen[f"n{i}"]]
    rows = rows.select("rid", *[(F.col(f"c{i}").try_cast("double") if i in numeric else F.col(f"c{i}")).alias(names[i]) for i in [*attrs, cls]])
    return rows, [names[i] for i in numeric], [names[i] for i in attrs if i not in numeric], names[cls]


def _coded(df: DataFrame, col: str) -> tuple[Column, int]:
    """(code of a column's value, number of values), values in order."""
    values = sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(MAX_VALUES + 1).collect())
    if len(values) > MAX_VALUES:
        raise ValueError(f"attribute {col} has more than {MAX_VALUES} values")
    return (F.array_position(F.array(*[F.lit(v) for v in values]), F.col(col)) - 1).cast("int"), len(values)


def prepared(spark: SparkSession, path: str, id_col: str | None = None) -> NominalData:
    """A dataset as codes: T-1, T-2, P-5."""
    rows, numeric, nominal, cls = read_dataset(spark, path, id_col)
    rows = rows.where(F.col(cls).isNotNull())
    code, n_classes = _coded(rows, cls)
    if n_classes < 2:
        raise ValueError("the class has fewer than two values")
    rows = P.replace_missing(rows.withColumn(cls, code), numeric, nominal)
    if numeric:
        cuts = {r["att"]: list(r["cuts"]) for r in P.mdl_cuts(rows, numeric, cls, n_classes).collect()}
        rows = P.mdl_apply(rows, numeric, cuts)
    kept = [c for c in P.drop_single_valued(rows, [*numeric, *nominal]).columns if c not in ("rid", cls)]
    cards, out = [], []
    for i, c in enumerate(kept):
        code, n = _coded(rows, c)
        cards.append(n)
        out.append(code.alias(f"a{i}"))
    attrs = tuple(f"a{i}" for i in range(len(kept)))
    coded = rows.select("rid", *out, F.col(cls).alias("cls"))
    path = scratch_path(spark, "dataset-codes")
    coded.write.parquet(path)
    return NominalData(spark.read.schema(coded.schema).parquet(path), attrs, tuple(cards), n_classes)


def _run(spark, folder, name, models, repeats, folds, seed, noise, id_col) -> str:
    try:
        fv = CV.fold_vectors(prepared(spark, f"{folder.rstrip('/')}/{name}", id_col), repeats, folds, seed)
        cells = []
        for m in models:
            summary = OTHERS[m](fv, m, noise) if m in OTHERS else CV.cv_summary(fv, MODELS[m], m, noise)
            r = summary.select(F.round(F.col("acc_mean") * 100, 2), F.round(F.col("acc_std") * 100, 2)).first()
            cells.append(f"{r[0]}:{r[1]}")
        return ", ".join([name, *cells, ""])
    except Exception as e:  # noqa: BLE001 - one dataset's failure is a line of the report
        return f"{name}, failed: {str(e).splitlines()[0]}"


def evaluate_folder(spark: SparkSession, folder: str, report: str, models: list[str], *, begin: str | None = None, end: str | None = None,
                    repeats: int = 10, folds: int = 10, seed: int = 1, noise: float = 0.0, id_col: str | None = None, side_by_side: int = 4) -> DataFrame:
    """Writes the report, one line ``dataset, mean:std, ..., `` (percent) or ``dataset, failed: why`` a dataset, as
    text under ``report``, and returns it read back: (dataset, report, failed)."""
    unknown = [m for m in models if m not in MODELS and m not in OTHERS]
    if unknown:
        raise ValueError(f"unknown model: {unknown[0]}")
    names = dataset_names(spark, folder, begin, end)
    with ThreadPoolExecutor(side_by_side) as pool:
        lines = list(pool.map(lambda n: _run(spark, folder, n, models, repeats, folds, seed, noise, id_col), names))
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(report)
    return read_report(spark, report)


def read_report(spark: SparkSession, report: str) -> DataFrame:
    """IO-13 read back."""
    line = F.col("value")
    return spark.read.schema("value string").text(report).select(F.split(line, ", ")[0].alias("dataset"), line.alias("report"), F.split(line, ", ")[1].startswith("failed: ").alias("failed"))
