"""G-5: a C4.5-like tree over nominal attributes, grown level by level in Spark.

Rows are first summed to different (group, attributes, class) tuples; a group is one training
set, so the trees of all folds grow together.  A level is one aggregation of the tuples to
(group, node, attribute, value, class) counts, from which every open node takes its split:
multiway, by gain ratio among the attributes whose gain is at least the mean of the admissible
ones; admissible is an attribute with two or more values of at least ``min_rows`` rows each and a
gain.  Ratios and gains are rounded to nine digits, ties go to the smaller attribute.  Tuples
then move to the child of their value.  A node is named by its path (``/attribute=value`` ...).

Pruning is by pessimistic errors (Quinlan 1993, upper limit of the binomial at confidence
``cf``), from the deepest level up: a node whose errors as a leaf exceed those of its subtree by
at most 0.1 becomes a leaf.  Subtrees are replaced, not raised.

A value that a node never saw is predicted by the node's majority class (ties to the smaller
class).  An empty table gives no tree, and its rows a null prediction.

Every tuple of a level may lie in one node, so tuples meet their node by a broadcast of the node
table where its checked size allows, else by a join salted by the tuple.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.arrays import const_doubles
from kestrel.functions.hashing import h_int
from kestrel.operators.counts import BROADCAST_MAP_LIMIT
from kestrel.operators.crossval import NOISE_SEED, FoldedData, noise_key, noise_thresholds
from kestrel.operators.evaluate import fold_accuracy, mean_std
from kestrel.sources.model_io import scratch_path
from kestrel.sources.nominal import NominalData

MIN_ROWS, CONFIDENCE = 2, 0.25
#: what a leaf's errors may exceed its subtree's by and still replace it
SLACK = 0.1
SALTS = 16
DIGITS = 9


@dataclass(frozen=True)
class Tree:
    """``nodes``: (g, node, depth, att, cls, n, errors), ``att`` null for a leaf, ``cls`` the majority."""

    nodes: DataFrame
    depth: int
    size: int
    attrs: tuple[str, ...]


def _kept(df: DataFrame, tag: str) -> DataFrame:
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _meet(rows: DataFrame, nodes: DataFrame, size: int, attrs: tuple[str, ...], limit: int, how: str = "inner") -> DataFrame:
    """Rows joined to their node on (g, node)."""
    if size <= limit:
        return rows.join(F.broadcast(nodes), ["g", "node"], how)
    salted = nodes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*attrs), F.lit(SALTS)).cast("int")).join(salted, ["g", "node", "_salt"], how).drop("_salt")


def _child(att: Column, attrs: tuple[str, ...]) -> Column:
    """The path of the child that a row's value leads to."""
    value = F.element_at(F.array(*[F.col(a).cast("int") for a in attrs]), att + 1)
    return F.concat("node", F.lit("/"), att.cast("string"), F.lit("="), value.cast("string"))


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


def added_errors(n: Column, e: Column, cf: float = CONFIDENCE) -> Column:
    """Errors to add to ``e`` of ``n`` for the upper limit at confidence ``cf``."""
    z = NormalDist().inv_cdf(1 - cf)
    f = (e + 0.5) / n
    upper = (f + z * z / (2 * n) + z * F.sqrt(f / n - f * f / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(e < 1, n * (1 - F.pow(F.lit(cf), 1 / n))).when(e + 0.5 >= n, F.greatest(n - e, F.lit(0.0))).otherwise(upper * n - e)


def _splits(cells: DataFrame, min_rows: int) -> DataFrame:
    """(g, node, att) of the nodes that split."""
    value = cells.groupBy("g", "node", "att", "val").agg(F.sum("n").alias("nv"), F.sum(_xlogx(F.col("n"))).alias("inner"))
    classes = cells.where("att = 0").groupBy("g", "node", "cls").agg(F.sum("n").alias("nc"))
    whole = classes.groupBy("g", "node").agg(F.sum("nc").alias("n"), F.sum(_xlogx(F.col("nc"))).alias("by_class"))
    per = value.groupBy("g", "node", "att").agg(
        F.sum(_xlogx(F.col("nv"))).alias("by_value"), F.sum("inner").alias("by_both"),
        F.sum(F.when(F.col("nv") >= min_rows, 1).otherwise(0)).alias("large")).join(whole, ["g", "node"])
    # n gain = H(class) n - H(class | value) n, each as x log x sums
    n, by_n = F.col("n"), _xlogx(F.col("n"))
    gain = F.round((by_n - F.col("by_class") - F.col("by_value") + F.col("by_both")) / n, DIGITS)
    info = (by_n - F.col("by_value")) / n
    good = per.where("large >= 2").withColumn("gain", gain).where("gain > 0").withColumn("ratio", F.round(F.col("gain") / info, DIGITS))
    node = Window.partitionBy("g", "node")  # at most one row an attribute
    good = good.withColumn("mean", F.avg("gain").over(node)).where(F.col("gain") >= F.col("mean") - 1e-3)
    best = good.withColumn("r", F.row_number().over(node.orderBy(F.desc("ratio"), "att"))).where("r = 1")
    return best.select("g", "node", "att")


def grow(rows: DataFrame, attrs: tuple[str, ...], cls: str = "cls", weight: str | None = None, prune: bool = True,
         min_rows: int = MIN_ROWS, cf: float = CONFIDENCE, limit: int = BROADCAST_MAP_LIMIT) -> Tree:
    """Trees of ``rows`` (column ``g`` names the training set)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    state = _kept(rows.groupBy("g", *attrs, F.col(cls).cast("int").alias("cls")).agg(F.sum(w).alias("n")).withColumn("node", F.lit("")), "tree-tuples")
    levels: list[DataFrame] = []
    size = 0
    while True:
        by_class = Window.partitionBy("g", "node").orderBy(F.desc("n"), "cls")
        total = Window.partitionBy("g", "node")
        sums = state.groupBy("g", "node", "cls").agg(F.sum("n").alias("n"))
        leaf = sums.withColumn("r", F.row_number().over(by_class)).withColumn("all", F.sum("n").over(total)).where("r = 1")
        leaf = leaf.select("g", "node", F.lit(len(levels)).alias("depth"), "cls", F.col("all").alias("n"), (F.col("all") - F.col("n")).alias("errors"))
        cells = state.select("g", "node", "cls", "n", F.posexplode(F.array(*[F.col(a).cast("int") for a in attrs])).alias("att", "val")) \
            .groupBy("g", "node", "att", "val", "cls").agg(F.sum("n").alias("n"))
        splits = _splits(cells, min_rows)
        level = _kept(leaf.join(splits, ["g", "node"], "left"), "tree-level")
        levels.append(level)
        size += level.count()
        open_nodes = level.where("att is not null").select("g", "node", "att")
        n_open = open_nodes.count()
        if not n_open or len(levels) > len(attrs):
            break
        moved = _meet(state, open_nodes, n_open, attrs, limit)
        state = _kept(moved.withColumn("node", _child(F.col("att"), attrs)).drop("att"), "tree-tuples")
    if prune:
        levels = _pruned(levels, cf)
    cols = ["g", "node", "depth", "att", "cls", "n", "errors"]
    nodes = _kept(reduce(DataFrame.unionByName, [lv.select(*cols) for lv in levels]), "tree-nodes")
    return Tree(nodes, len(levels) - 1, size, attrs)


def _pruned(levels: list[DataFrame], cf: float) -> list[DataFrame]:
    """From the deepest level up; then nodes below a new leaf go, from the root down."""
    out, below = [], None
    for level in reversed(levels):
        own = F.col("errors") + added_errors(F.col("n"), F.col("errors"), cf)
        level = level.withColumn("own", own)
        if below is None:
            done = level.withColumn("estimate", F.col("own"))
        else:
            parts = below.groupBy("g", F.regexp_replace("node", "/[^/]*$", "").alias("node")).agg(F.sum("estimate").alias("parts"))
            done = level.join(parts, ["g", "node"], "left")
            cut = F.col("att").isNull() | (F.round(F.col("own"), DIGITS) <= F.round(F.col("parts") + SLACK, DIGITS))
            done = done.withColumn("estimate", F.when(cut, F.col("own")).otherwise(F.col("parts"))).withColumn("att", F.when(~cut, F.col("att"))).drop("parts")
        done = _kept(done, "tree-pruned")
        out.append(done.drop("own", "estimate"))
        below = done
    reached = out[-1:]
    for level in out[-2::-1]:
        parents = reached[-1].where("att is not null").select("g", F.col("node").alias("_up"))
        up = F.regexp_replace(F.col("node"), "/[^/]*$", "")
        reached.append(_kept(level.withColumn("_up", up).join(parents, ["g", "_up"], "left_semi").drop("_up"), "tree-reached"))
    return reached


def predict(rows: DataFrame, tree: Tree, limit: int = BROADCAST_MAP_LIMIT) -> DataFrame:
    """``rows`` (with ``g``) and ``prediction``: a row goes down as far as there are nodes for it."""
    nodes = tree.nodes.select("g", "node", "att", F.col("cls").alias("_cls"))
    at = rows.withColumn("node", F.lit("")).withColumn("prediction", F.lit(None).cast("int"))
    for _ in range(tree.depth + 1):
        # a row at a leaf has a null node, which meets nothing
        at = _meet(at, nodes, tree.size, tree.attrs, limit, "left")
        at = at.withColumn("prediction", F.coalesce("_cls", "prediction")).withColumn("node", _child(F.col("att"), tree.attrs)).drop("att", "_cls")
    return at.drop("node")


def training_rows(fv: FoldedData, noise: float = 0.0) -> DataFrame:
    """One record for each training set that holds a row, made inside the task that sums them; with label
    noise the class is that of the training set."""
    data = fv.data
    rows = fv.exploded().withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(fv.folds - 1)))).where("to <> fold")
    rows = rows.withColumn("g", (F.col("rep") * fv.folds + F.col("to")).cast("int"))
    old = F.col(data.cls).cast("int")
    if noise <= 0:
        return rows.withColumn(data.cls, old)
    if data.n_classes < 2:
        raise ValueError("label noise needs at least two classes")
    cut = F.element_at(const_doubles(noise_thresholds(fv, noise).ravel()), F.col("g") + 1)
    new = ((old + 1 + h_int(F.col("rep") + F.lit(NOISE_SEED), "c", F.col(data.rid)) % (data.n_classes - 1)) % data.n_classes).cast("int")
    return rows.withColumn(data.cls, F.when(noise_key(F.col("rep"), data.rid) <= cut, new).otherwise(old))


def cv_predict(fv: FoldedData, noise: float = 0.0, prune: bool = True, limit: int = BROADCAST_MAP_LIMIT) -> DataFrame:
    """(rep, fold, rid, class, prediction, weight): every row predicted by the tree grown without its fold."""
    data = fv.data
    tree = grow(training_rows(fv, noise), data.attrs, data.cls, data.weight, prune, limit=limit)
    w = F.col(data.weight).cast("double") if data.weight else F.lit(1.0)
    scored = predict(fv.exploded(), tree, limit)
    return scored.select("rep", "fold", data.rid, data.cls, "prediction", w.alias("weight"))


def cv_summary(fv: FoldedData, name: str, noise: float = 0.0) -> DataFrame:
    """(model, acc_mean, acc_std) over all folds of all repeats."""
    scored = cv_predict(fv, noise)
    return mean_std(fold_accuracy(scored, fv.data.cls), "accuracy").select(F.lit(name).alias("model"), "acc_mean", "acc_std")


def score(data: NominalData, tree_of: NominalData | None = None, prune: bool = True) -> DataFrame:
    """(rid, prediction) of ``data`` by the tree of ``tree_of`` (of itself, if not given)."""
    source = tree_of or data
    tree = grow(source.df.withColumn("g", F.lit(0)), source.attrs, source.cls, source.weight, prune)
    return predict(data.df.withColumn("g", F.lit(0)), tree).select(data.rid, "prediction")
