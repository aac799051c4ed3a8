"""Preprocessing jobs: T-1 .. T-8, P-5, P-7, P-8, IO-10.

Every fit is one aggregation over the data whose result is small (one value per
column, per feature index or per class) and is applied by a narrow projection.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.functions.arrays import MAX_LITERAL_CELLS
from kestrel.functions.hashing import h, h_int
from kestrel.operators.folds import range_assign
from kestrel.sources.model_io import scratch_path


# ----------------------------------------------------------------- T-1 imputation
def impute_fit(df: DataFrame, numeric: list[str], nominal: list[str]) -> dict:
    """Mean of every numeric column, mode (lowest value on ties) of every nominal one."""
    out = {c: None for c in nominal}
    if numeric:
        out |= df.agg(*[F.avg(c).alias(c) for c in numeric]).first().asDict()
    for c in nominal:  # values are counted in parallel; only each partial best moves on
        top = df.where(F.col(c).isNotNull()).groupBy(c).count().agg(F.min(F.struct(-F.col("count"), c)).alias("top")).first().top
        out[c] = top[1] if top else None
    return out


def impute_apply(df: DataFrame, values: dict) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c), F.lit(values[c])).alias(c) if c in values else F.col(c)
                       for c in df.columns])


def replace_missing(df: DataFrame, numeric: list[str], nominal: list[str]) -> DataFrame:
    """T-1: fitted on the whole input, then applied."""
    return impute_apply(df, impute_fit(df, numeric, nominal))


# ------------------------------------------------------- T-3 equal-width binning
def equal_width(df: DataFrame, cols: list[str], bins: int = 10) -> DataFrame:
    """T-3: bin = least(floor((x - min) / width), bins - 1); NULL stays NULL."""
    row = df.agg(*[F.min(c).alias(f"mn_{c}") for c in cols], *[F.max(c).alias(f"mx_{c}") for c in cols]).first()
    out = []
    for c in df.columns:
        if c in cols:
            mn, mx = row[f"mn_{c}"], row[f"mx_{c}"]
            w = (mx - mn) / bins if mx is not None and mx > mn else None
            e = F.lit(0) if w is None else F.least(F.floor((F.col(c) - F.lit(mn)) / F.lit(w)), F.lit(bins - 1))
            out.append(F.when(F.col(c).isNull(), None).otherwise(e).cast("int").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# ------------------------------------------------------ T-2 supervised MDL cuts
def _entropy(counts: np.ndarray) -> np.ndarray:
    """Entropy in bits of each row of class counts."""
    total = counts.sum(axis=-1, keepdims=True)
    p = counts / np.where(total > 0, total, 1.0)
    return -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=-1)


def _accepts(left: np.ndarray, right: np.ndarray) -> bool:
    """The MDL criterion of Fayyad and Irani for the split of a segment."""
    both = left + right
    n, parts = both.sum(), np.stack([both, left, right])
    h, k = _entropy(parts), (parts > 0).sum(axis=1)
    gain = h[0] - (left.sum() * h[1] + right.sum() * h[2]) / n
    delta = math.log2(3.0 ** k[0] - 2) - (k[0] * h[0] - k[1] * h[1] - k[2] * h[2])
    return gain > (math.log2(n - 1) + delta) / n


def _running_counts(df: DataFrame, cols: list[str], cls: str, n_classes: int) -> tuple[DataFrame, dict]:
    """(att, x, next_x, upto): every distinct value of every attribute, the value after it and
    the class counts of all rows up to it, written once.  Values are range-partitioned;
    each partition adds its running sums to the totals of the partitions before it, so no
    attribute is held by one task.  A value with no other after it is left out.  Also the
    class counts of each attribute."""
    spark = df.sparkSession
    pairs = F.array(*[F.struct(F.lit(i).alias("att"), F.col(c).cast("double").alias("x")) for i, c in enumerate(cols)])
    c = F.col(cls).cast("int")
    hist = (df.select(c.alias("c"), F.inline_outer(pairs)).where("x is not null").groupBy("att", "x")
            .agg(F.array(*[F.sum((F.col("c") == k).cast("bigint")) for k in range(n_classes)]).alias("n")))
    path = scratch_path(spark, "mdl-histogram")
    hist.repartitionByRange("att", "x").sortWithinPartitions("att", "x").select(
        F.spark_partition_id().alias("part"), "att", "x", "n").write.parquet(path)
    hist = spark.read.parquet(path)
    sums = hist.groupBy("part", "att").agg(F.min("x").alias("first"), F.array(*[F.sum(F.col("n")[k]) for k in range(n_classes)]).alias("n")).collect()
    starts, run = [], {}
    ordered = sorted(sums, key=lambda r: (r.att, r.first))  # a row per partition and attribute in it
    for r, later in zip(ordered, [*ordered[1:], None], strict=True):
        before = run.get(r.att, np.zeros(n_classes, np.int64))
        run[r.att] = before + np.array(r.n)
        starts.append((r.part, r.att, before.tolist(), later.first if later is not None and later.att == r.att else None))
    # a row per partition and attribute in it, as collected above
    starts = F.broadcast(spark.createDataFrame(starts, "part int, att int, before array<bigint>, after double"))
    # a window is the part of one attribute in one range partition; its sums stay in the JVM, which spills
    order = Window.partitionBy("part", "att").orderBy("x")
    upto = F.array(*[F.sum(F.col("n")[k]).over(order.rowsBetween(Window.unboundedPreceding, 0)) for k in range(n_classes)])
    cum = hist.select("part", "att", "x", "n", F.lead("x").over(order).alias("_next"), upto.alias("_upto")).join(starts, ["part", "att"])
    cum = cum.select("att", "x", F.coalesce("_next", "after").alias("next_x"), F.zip_with("_upto", "before", lambda a, b: a + b).alias("upto")).where("next_x is not null")
    path = scratch_path(spark, "mdl-running")
    cum.write.parquet(path)
    return spark.read.parquet(path), run


#: levels of the descent after which the values' segment ids are written anew
MDL_LEVELS = 8


def mdl_cuts(df: DataFrame, cols: list[str], cls: str, n_classes: int) -> DataFrame:
    """T-2: (att, cuts ARRAY<DOUBLE>), supervised cuts by the MDL criterion.

    The recursion goes level by level over all attributes.  Every value carries the number of its
    segment; a level joins values and open segments on it (one segment a value), one
    aggregation finds the candidate of smallest class entropy in each segment (the smallest value
    among equals), and accepted cuts renumber the values of their two halves.  Values of
    segments that are not cut drop out.  What the driver holds is a few numbers a segment."""
    spark = df.sparkSession
    values, totals = _running_counts(df, cols, cls, n_classes)
    values = values.withColumn("seg", F.col("att"))
    cuts: dict[int, list[float]] = {i: [] for i in range(len(cols))}
    # number -> (attribute, class counts up to the segment, class counts up to its end)
    open_ = {att: (att, np.zeros(n_classes, np.int64), n) for att, n in totals.items()}
    count, level = len(cols), 0

    def bits(counts):
        total = sum_cols(counts)
        return sum_cols([F.when(c > 0, -c * F.log2(c / total)).otherwise(0.0) for c in counts])

    while open_:
        table = spark.createDataFrame([(i, c0.tolist(), c1.tolist()) for i, (_, c0, c1) in open_.items()], "seg int, below array<bigint>, all array<bigint>")
        rows = values.join(F.broadcast(table), "seg")
        left = [F.col("upto")[k] - F.col("below")[k] for k in range(n_classes)]
        right = [F.col("all")[k] - F.col("upto")[k] for k in range(n_classes)]
        # rounded, so that equal entropies tie whatever the order of the additions
        best = rows.withColumn("e", F.round(bits(left) + bits(right), 9)).groupBy("seg").agg(F.min(F.struct("e", "x", "next_x", "upto")).alias("b"))
        nxt, split = {}, []
        for r in best.collect():
            att, c0, c1 = open_[r.seg]
            mid = np.array(r.b.upto)
            if _accepts((mid - c0).astype(float), (c1 - mid).astype(float)):
                cuts[att].append((r.b.x + r.b.next_x) / 2.0)
                nxt[count], nxt[count + 1] = (att, c0, mid), (att, mid, c1)
                split.append((r.seg, r.b.x, count, count + 1))
                count += 2
        open_ = nxt
        if split:
            halves = spark.createDataFrame(split, "seg int, cut double, lower int, upper int")
            # the value at the cut is a candidate of neither half
            values = values.join(F.broadcast(halves), "seg").where("x <> cut").select(
                "att", "x", "next_x", "upto", F.when(F.col("x") < F.col("cut"), F.col("lower")).otherwise(F.col("upper")).alias("seg"))
            level += 1
            if level % MDL_LEVELS == 0:
                path = scratch_path(spark, "mdl-segments")
                values.write.parquet(path)
                values = spark.read.parquet(path)
    return spark.createDataFrame([(a, sorted(c)) for a, c in cuts.items()], "att int, cuts array<double>")


def sum_cols(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def mdl_apply(df: DataFrame, cols: list[str], cuts: dict[int, list[float]]) -> DataFrame:
    """Bin index = number of cuts below the value; no cut -> single-valued (0)."""
    out = []
    for c in df.columns:
        if c in cols:
            cl = F.array(*[F.lit(float(v)) for v in cuts.get(cols.index(c), [])]).cast("array<double>")
            out.append(F.when(F.col(c).isNull(), None).otherwise(
                F.size(F.filter(cl, lambda t: F.col(c) > t))).cast("int").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# ------------------------------------------------------------------ P-5 remove
def drop_single_valued(df: DataFrame, cols: list[str]) -> DataFrame:
    """P-5: remove attributes with one distinct value (one aggregation)."""
    one = [F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in cols]
    row = df.agg(*one).first()
    return df.drop(*[c for c in cols if row[c]])


# ------------------------------------------------------------- T-4 .. T-7 scaling
def scale_fit(df: DataFrame, idx: str = "idx", val: str = "val", label: str | None = "label") -> tuple[DataFrame, dict]:
    """T-4: per feature index min / max over all rows, an absent entry counting as 0.

    One pass: entries are exploded (an empty vector still yields one row) and grouped
    by index; each group also counts the rows it saw first (position 0 or empty), so
    the row total, the largest index and the target range come out of the same
    feature-sized result, which is written once and read as a table.  Returns the
    parameter table (att, fmin, fmax) of every index that occurs (any other feature is
    constantly 0, which scaling skips) and the totals {n, max_index, y_min, y_max}."""
    ent = df.select((F.col(label).cast("double") if label else F.lit(None).cast("double")).alias("_y"),
                    F.posexplode_outer(F.arrays_zip(F.col(idx).alias("att"), F.col(val).alias("v"))).alias("_p", "_e"))
    per = ent.groupBy(F.col("_e.att").alias("att")).agg(
        F.min("_e.v").alias("mn"), F.max("_e.v").alias("mx"),
        F.count("_e.v").alias("cnt"),
        F.sum(F.when(F.col("_p").isNull() | (F.col("_p") == 0), 1).otherwise(0)).alias("first"),
        F.min("_y").alias("ymn"), F.max("_y").alias("ymx"))
    path = scratch_path(df.sparkSession, "scale-stats")
    per.write.parquet(path)
    per = df.sparkSession.read.schema(per.schema).parquet(path)
    total = per.agg(F.sum("first").alias("n"), F.max("att").alias("top"), F.min("ymn").alias("lo"), F.max("ymx").alias("hi")).first()
    n = int(total.n or 0)
    sparse = F.col("cnt") < n  # some row has no entry: that row's value is 0
    params = per.where("att is not null").select(
        F.col("att").cast("int").alias("att"),
        F.when(sparse, F.least("mn", F.lit(0.0))).otherwise(F.col("mn")).cast("double").alias("fmin"),
        F.when(sparse, F.greatest("mx", F.lit(0.0))).otherwise(F.col("mx")).cast("double").alias("fmax"))
    info = {"n": n, "max_index": int(total.top or 0)}
    if label and n:
        info.update(y_min=float(total.lo), y_max=float(total.hi))
    return params, info


def scale_apply(df: DataFrame, params: DataFrame, lower: float = -1.0, upper: float = 1.0,
                idx: str = "idx", val: str = "val", keep: tuple[str, ...] = ("id", "label")) -> DataFrame:
    """T-5 / P-7: scale every feature of ``params`` (absent entries as 0), exact min ->
    lower and max -> upper, single-valued features skipped, zero results dropped.

    One vectorised pass over the flat index and value buffers of each batch.  Present
    entries are scaled in place; an absent feature contributes its scaled zero, so only
    the features whose scaled zero is not 0 are added.  The parameters are feature-sized
    and broadcast."""
    import pyarrow as pa

    if not upper > lower:
        raise ValueError("inconsistent lower/upper specification")
    p = params.limit(MAX_LITERAL_CELLS + 1).toPandas().sort_values("att")
    if len(p) > MAX_LITERAL_CELLS:
        raise ValueError("too many features for broadcast parameters")
    att, lo, hi = p["att"].to_numpy(np.int64), p["fmin"].to_numpy(float), p["fmax"].to_numpy(float)

    def scaled(v, a, b):
        width = np.where(b > a, b - a, 1.0)
        out = lower + (upper - lower) * (v - a) / width
        return np.where(v == a, lower, np.where(v == b, upper, out))

    zero = np.where(hi > lo, scaled(np.zeros(len(att)), lo, hi), 0.0)
    dense = zero != 0
    sent = df.sparkSession.sparkContext.broadcast((att, lo, hi, att[dense], zero[dense]))

    def run(batches):
        att, lo, hi, z_att, z_val = sent.value
        for b in batches:
            size = b.column(idx).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            i = b.column(idx).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            v = b.column(val).flatten().cast("double").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(att, i), max(0, len(att) - 1))
            known = att[at] == i if len(att) else np.zeros(len(i), bool)
            lacks = np.ones((len(size), len(z_att)), bool)
            if len(z_att) and len(i):
                z = np.minimum(np.searchsorted(z_att, i), len(z_att) - 1)
                hit = z_att[z] == i
                lacks[row[hit], z[hit]] = False
            extra_row, extra = np.nonzero(lacks)
            use = known & (hi[at] > lo[at]) if len(att) else known
            rows_ = np.concatenate([row[use], extra_row])
            ids = np.concatenate([i[use], z_att[extra]])
            vals = np.concatenate([scaled(v[use], lo[at[use]], hi[at[use]]), z_val[extra]])
            rows_, ids, vals = (x[vals != 0] for x in (rows_, ids, vals))
            order = np.lexsort((ids, rows_))
            off = pa.array(np.searchsorted(rows_[order], np.arange(len(size) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.ListArray.from_arrays(off, pa.array(ids[order], pa.int32())),
                 pa.ListArray.from_arrays(off, pa.array(vals[order], pa.float64()))], names=[*keep, idx, val])

    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{c} {fields[c]}" for c in keep] + [f"{idx} array<int>", f"{val} array<double>"])
    return df.select(*keep, idx, val).mapInArrow(run, schema)


def scale_target(y: Column, y_min: float, y_max: float, y_lower: float, y_upper: float) -> Column:
    """T-6."""
    return (F.when(y == y_min, F.lit(y_lower)).when(y == y_max, F.lit(y_upper))
            .otherwise(F.lit(y_lower) + F.lit(y_upper - y_lower) * (y - F.lit(y_min)) / F.lit(y_max - y_min)))


def density_report(before: DataFrame, after: DataFrame, idx: str = "idx") -> DataFrame:
    """T-7: one row (nz_before, nz_after, grew); two scalar aggregates."""
    nb = before.agg(F.sum(F.size(idx))).first()[0] or 0
    na = after.agg(F.sum(F.size(idx))).first()[0] or 0
    return before.sparkSession.createDataFrame([(int(nb), int(na), bool(na > nb))],
                                               "nz_before LONG, nz_after LONG, grew BOOLEAN")


def save_scaling_text(params: DataFrame, lower: float, upper: float, y: tuple | None = None) -> str:
    """IO-10 writer: the reference's text form (%.16g), only non-constant features."""
    lines = []
    if y is not None:
        lines += ["y", f"{y[0]:.16g} {y[1]:.16g}", f"{y[2]:.16g} {y[3]:.16g}"]
    lines += ["x", f"{lower:.16g} {upper:.16g}"]
    for r in params.where(F.col("fmin") != F.col("fmax")).orderBy("att").collect():
        lines.append(f"{r['att']} {r['fmin']:.16g} {r['fmax']:.16g}")
    return "\n".join(lines) + "\n"


def restore_scaling_text(spark, text: str) -> tuple[DataFrame, float, float, tuple | None]:
    """IO-10 reader -> (params, lower, upper, y-block or None)."""
    lines = [ln for ln in text.splitlines() if ln.strip()]
    y = None
    i = 0
    if lines[0].strip() == "y":
        a, b = map(float, lines[1].split())
        c, d = map(float, lines[2].split())
        y = (a, b, c, d)
        i = 3
    if lines[i].strip() != "x":
        raise ValueError("scaling file: 'x' block expected")
    lower, upper = map(float, lines[i + 1].split())
    rows = [(int(p[0]), float(p[1]), float(p[2])) for p in (ln.split() for ln in lines[i + 2:])]
    return spark.createDataFrame(rows, "att INT, fmin DOUBLE, fmax DOUBLE"), lower, upper, y


# ------------------------------------------------------------------- T-8 noise
def label_noise(df: DataFrame, rate: float, n_classes: int, *, rid: str = "rid", cls: str = "cls",
                seed: int = 100) -> DataFrame:
    """T-8: exactly int(n * rate) rows (first in md5 order) get a different class,
    (cls + 1 + u % (k-1)) % k with u drawn from another md5 key."""
    if rate > 0.5:
        raise ValueError("Noise rate can not larger than 0.5")
    if rate <= 0:
        return df
    if n_classes < 2:
        raise ValueError("label noise needs at least two classes")
    marked = range_assign(df.withColumn("_all", F.lit(0)), ["_all"], h(seed, F.col(rid)), rid,
                          lambda rank, n: rank >= F.floor(n * F.lit(rate)), "_keep")
    u = h_int(seed, "c", F.col(rid))
    new = ((F.col(cls) + 1 + u % (n_classes - 1)) % n_classes).cast(df.schema[cls].dataType)
    return marked.withColumn(cls, F.when(F.col("_keep"), F.col(cls)).otherwise(new)).drop("_keep", "_all")


# --------------------------------------------------------------- P-8 class groups
def class_groups(df: DataFrame, label: str = "label", order_key: str = "rid") -> DataFrame:
    """P-8: labels truncated to int, numbered by first appearance, with counts."""
    g = df.groupBy(F.col(label).cast("int").alias("label")).agg(
        F.min(order_key).alias("_first"), F.count(F.lit(1)).alias("count"))
    return g.select("label", (F.row_number().over(Window.orderBy("_first")) - 1).cast("int").alias("code"),
                    "count")
