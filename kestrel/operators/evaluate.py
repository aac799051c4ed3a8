"""E-4 .. E-9: cross-validated evaluation, metrics and the comparison report.

Count models are cross-validated in one pass: rows are replicated per repeat, given
their fold, counted once with (rep, fold) in the key, and every training table is
the total minus its own fold (:func:`kestrel.operators.counts.complement_counts`),
so the 10 x 10 protocol costs one aggregation instead of 100 refits.  Every row is
then scored by the model of its (rep, fold) in the same narrow batch scorer.
Where only accuracies are wanted and the declared domains allow few different tuples, the rows of a
(rep, fold) are added up by tuple before they are counted and scored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.operators import bayes as B
from kestrel.operators.counts import _collapse_pays, collapse, complement_counts, count_families
from kestrel.operators.folds import interleaved_folds, with_repeats
from kestrel.sources.model_io import scratch_path
from kestrel.sources.nominal import NominalData


def cv_rows(data: NominalData, repeats: int = 10, folds: int = 10, seed: int = 1, tuples: bool = False) -> DataFrame:
    """The rows of every repeat with their fold, written once to the shared folder: counting
    and scoring of every model read it, and the folds are not assigned again.  With ``tuples`` the
    rows of a (rep, fold) that are alike in attributes and class are one row with their weight
    and no id, if the domain is small enough for this to pay."""
    rows = interleaved_folds(with_repeats(data.df, repeats), folds, rid=data.rid, cls=data.cls,
                             rep="rep", seed=seed)
    rows = rows.withColumn("g", (F.col("rep") * folds + F.col("fold")).cast("int"))
    if tuples and _collapse_pays(data, ()):
        rows = collapse(data.with_df(rows), ("rep", "fold", "g")).df
    path = scratch_path(rows.sparkSession, "cv-rows")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def cv_predictions(data: NominalData, spec_fn: Callable[[NominalData], B.BayesSpec], *,
                   repeats: int = 10, folds: int = 10, seed: int = 1, rows: DataFrame | None = None) -> DataFrame:
    """E-4: (rep, fold, rid, cls, weight, prediction) — every row predicted, in every
    repeat, by the model fitted without its fold.  ``rows`` takes the result of
    :func:`cv_rows`, for several models over the same folds; of weighted tuples there is no rid."""
    spec = spec_fn(data)
    rows = cv_rows(data, repeats, folds, seed) if rows is None else rows
    ids = [data.rid] if data.rid in rows.columns else []
    rd = data.with_df(rows) if ids else replace(data, df=rows, weight="weight")
    part = count_families(rd, [(tid, t.family) for tid, t in enumerate(spec.tables)], keys=("rep", "fold"))
    train = complement_counts(part, "fold", folds, keys=("rep",)).withColumn(
        "g", (F.col("rep") * folds + F.col("fold")).cast("int"))
    model = B.fit(rd, spec, group_col="g", n_groups=repeats * folds, counts=train)
    keep = ("rep", "fold", *ids, data.cls, *([rd.weight] if rd.weight else []))
    scored = B.score(rows, model, group_col="g", keep=keep).withColumn("weight", rd.w())
    return scored.select("rep", "fold", *ids, data.cls, "weight", "prediction")


def fold_accuracy(pred: DataFrame, cls: str = "cls") -> DataFrame:
    """E-5 per (rep, fold): correct / total (weighted)."""
    hit = F.when(F.col("prediction") == F.col(cls), F.col("weight")).otherwise(0.0)
    return pred.groupBy("rep", "fold").agg((F.sum(hit) / F.sum("weight")).alias("accuracy"))


def mean_std(df: DataFrame, col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """E-8: mean and sample standard deviation (n-1) of ``col``."""
    return df.groupBy(*by).agg(F.avg(col).alias("acc_mean"), F.stddev_samp(col).alias("acc_std"))


def accuracy(pred: Column, label: Column) -> Column:
    """E-5 aggregate expression."""
    return F.avg(F.when(pred == label, 1.0).otherwise(0.0))


def regression_metrics(df: DataFrame, pred: str = "prediction", label: str = "label") -> DataFrame:
    """E-6 / E-7: mean squared error and squared correlation coefficient
    ((nΣvy − ΣvΣy)² / ((nΣv² − (Σv)²)(nΣy² − (Σy)²)))."""
    v, y = F.col(pred), F.col(label)
    agg = df.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(v).alias("sv"), F.sum(y).alias("sy"),
                 F.sum(v * v).alias("svv"), F.sum(y * y).alias("syy"), F.sum(v * y).alias("svy"),
                 F.avg((v - y) * (v - y)).alias("mse"))
    num = (F.col("n") * F.col("svy") - F.col("sv") * F.col("sy"))
    den = (F.col("n") * F.col("svv") - F.col("sv") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2)
    return agg.select("mse", F.try_divide(num * num, den).alias("scc"))


def cv_summary(data: NominalData, spec_fn, name: str, **kw) -> DataFrame:
    """(model, acc_mean, acc_std) of the repeated stratified CV of one count model."""
    if kw.get("rows") is None:
        kw["rows"] = cv_rows(data, *(kw.get(c, n) for c, n in (("repeats", 10), ("folds", 10), ("seed", 1))), tuples=True)
    acc = fold_accuracy(cv_predictions(data, spec_fn, **kw))
    return mean_std(acc, "accuracy").select(F.lit(name).alias("model"), "acc_mean", "acc_std")


def comparison_matrix(summaries: DataFrame, models: list[str]) -> DataFrame:
    """E-9 / IO-13: one row per dataset, one ``mean:std`` cell per model (percent,
    rounded to 2 decimals, printed as the shortest decimal), in the given model
    order, plus the report line ``dataset, cell, cell, ..., ``."""
    def pct(c):
        return F.round(F.col(c) * 100, 2).cast("string")
    cell = F.concat(pct("acc_mean"), F.lit(":"), pct("acc_std"))
    wide = summaries.withColumn("cell", cell).groupBy("dataset").pivot("model", models).agg(F.first("cell"))
    line = F.concat(F.concat_ws(", ", F.col("dataset"), *[F.col(f"`{m}`") for m in models]), F.lit(", "))
    return wide.select("dataset", *[F.col(f"`{m}`").alias(f"m_{m}") for m in models], line.alias("report"))
