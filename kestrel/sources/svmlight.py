"""Sparse-vector text formats (IO-5 .. IO-8, P-4).

svmlight line: ``[id] label i:v i:v ...`` tokenised on blanks and ':'.  Parsed with
``split`` / ``slice`` / ``transform`` only (the built-in libsvm source rejects the id
form and shifts indices to 0-based).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPARSE_SCHEMA = "id STRING, label DOUBLE, idx ARRAY<INT>, val ARRAY<DOUBLE>"


def parse_svmlight(lines: DataFrame, with_id: bool, line_col: str = "line") -> DataFrame:
    """IO-5: (id, label, idx, val); ``id`` is NULL when the lines carry none."""
    toks = F.filter(F.split(F.trim(F.col(line_col)), r"[ \t\n\r\f]+"), lambda t: t != "")
    out = lines.select(toks.alias("_t"))
    first = 2 if with_id else 1
    pairs = F.transform(F.slice(F.col("_t"), first + 1, 1 << 30), lambda t: F.split(t, ":"))
    return out.select(
        (F.col("_t")[0] if with_id else F.lit(None).cast("string")).alias("id"),
        F.col("_t")[first - 1].cast("double").alias("label"),
        F.transform(pairs, lambda p: p[0].cast("int")).alias("idx"),
        F.transform(pairs, lambda p: p[1].cast("double")).alias("val"))


def read_svmlight(spark: SparkSession, path: str, with_id: bool = False) -> DataFrame:
    lines = spark.read.text(path).select(F.col("value").alias("line")).where(F.length(F.trim("line")) > 0)
    return parse_svmlight(lines, with_id)


def dense_to_sparse(features: Column) -> tuple[Column, Column]:
    """P-4: drop zeros, 1-based index, ascending."""
    pairs = F.filter(F.transform(features.cast("array<double>"), lambda v, i: F.struct((i + 1).alias("i"),
                                                                                    v.alias("v"))),
                     lambda e: e["v"] != 0)
    return F.transform(pairs, lambda e: e["i"]).alias("idx"), F.transform(pairs, lambda e: e["v"]).alias("val")


def sparse_to_dense(idx: Column, val: Column, dim: int) -> Column:
    """Dense array of length ``dim`` from 1-based sparse entries (later ones win)."""
    m = F.map_from_entries(F.arrays_zip(idx.alias("k"), val.alias("v")))
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0)))


def _num(c: Column) -> Column:
    """Numbers printed like ``%g``-free shortest decimals (Spark's double -> string)."""
    return c.cast("string")


def to_svmlight(df: DataFrame, label: str = "label", idx: str = "idx", val: str = "val",
                id_col: str | None = None) -> DataFrame:
    """IO-6: one text line per row, zero values omitted."""
    pairs = F.filter(F.arrays_zip(F.col(idx).alias("i"), F.col(val).alias("v")), lambda e: e["v"] != 0)
    feats = F.array_join(F.transform(pairs, lambda e: F.concat(e["i"].cast("string"), F.lit(":"),
                                                               _num(e["v"]))), " ")
    parts = ([F.col(id_col)] if id_col else []) + [_num(F.col(label)), feats]
    return df.select(F.concat_ws(" ", *parts).alias("value"))


def prediction_text(df: DataFrame, id_col: str = "id", pred: str = "prediction",
                    probability: str | None = None) -> DataFrame:
    """IO-8: ``id prediction [p1 ... pk]`` lines."""
    parts = [F.col(id_col), _num(F.col(pred))]
    if probability:
        parts.append(F.array_join(F.transform(F.col(probability), lambda p: p.cast("string")), " "))
    return df.select(F.concat_ws(" ", *parts).alias("value"))


def write_predictions(pred: DataFrame, path: str, id_col: str = "id", pred_col: str = "prediction",
                      probability: str | None = None, labels: list[int] | None = None) -> None:
    """IO-8 sink: text lines ``id prediction [p1 ... pk]``; with ``labels`` the first file holds the one
    line ``labels l1 l2 ...`` that names the order of the probabilities."""
    lines = prediction_text(pred, id_col, pred_col, probability)
    if labels is not None:
        head = lines.sparkSession.createDataFrame([("labels " + " ".join(map(str, labels)),)], "value STRING").coalesce(1)
        lines = head.union(lines)
    lines.write.mode("errorifexists").text(path)


def read_predictions(spark: SparkSession, path: str) -> tuple[list[int] | None, DataFrame]:
    """IO-8 read back: (labels or None, (id, prediction, probability))."""
    toks = spark.read.text(path).select(F.split("value", " ").alias("t")).where(F.size("t") >= 2)
    head = toks.where("t[0] = 'labels'").first()
    rows = toks.where("t[0] <> 'labels'").select(
        F.col("t")[0].alias("id"), F.col("t")[1].cast("double").alias("prediction"),
        F.transform(F.slice("t", 3, 1 << 30), lambda p: p.cast("double")).alias("probability"))
    return [int(x) for x in head.t[1:]] if head else None, rows


def write_svmlight(df: DataFrame, path: str, **kw) -> None:
    """IO-6 sink: one text line per row."""
    to_svmlight(df, **kw).write.mode("errorifexists").text(path)
