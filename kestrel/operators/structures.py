"""B-1 .. B-3: random network structures for an ensemble of Bayesian classifiers.

A structure table is ``(component INT, att INT, parents ARRAY<INT>)``; attribute
indices are 0..d-1 and the class is index ``d``.  Parents are ascending (the radix
order of the parent code).  Every random choice is an order by an md5 key
(:mod:`kestrel.functions.hashing`), so structures are reproducible and identical in
Spark and in any SQL engine.

All three generators start from a one-column ``att`` table (e.g. the attribute list
of a domain scan) and never join: per (component, node) the candidate parents are an
array, shuffled by md5, cut to size and sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.hashing import h

STRUCTURE_SCHEMA = "component INT, att INT, parents ARRAY<INT>"


def _int_range(lo: Column, hi_incl: Column) -> Column:
    """[lo..hi] as array<int>, empty when hi < lo (Spark's sequence would count down)."""
    return F.when(hi_incl >= lo, F.sequence(lo, hi_incl)).otherwise(F.array().cast("array<int>"))


def _pick(cands: Column, k: Column, key) -> Column:
    """k elements of the int array ``cands`` chosen by md5 order ``key(c)``, ascending."""
    keyed = F.transform(cands, lambda c: F.struct(key(c).alias("k"), c.alias("c")))
    chosen = F.slice(F.array_sort(keyed), 1, k)
    return F.array_sort(F.transform(chosen, lambda s: s["c"]))


def _with_components(attributes: DataFrame, size: int) -> DataFrame:
    return attributes.select(F.col("att").cast("int").alias("att"),
                             F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("component"))


def random_structure_fixed(attributes: DataFrame, d: int, size: int = 20, max_parents: int = 2,
                           seed: int = 0) -> DataFrame:
    """B-1: attribute i draws min(i, m) distinct parents from 0..i-1, plus the class;
    the class gets the parent set {class}."""
    base = _with_components(attributes.where(F.col("att") < d), size)
    att, comp = F.col("att"), F.col("component")
    cands = _int_range(F.lit(0), att - 1)
    picked = _pick(cands, F.least(att, F.lit(max_parents)), lambda c: h(seed, comp, att, c))
    rows = base.select(comp, att, F.concat(picked, F.array(F.lit(d))).alias("parents"))
    cls_rows = (base.select("component").distinct()
                .select("component", F.lit(d).alias("att"), F.array(F.lit(d)).alias("parents")))
    return rows.unionByName(cls_rows).select(
        F.col("component").cast("int"), F.col("att").cast("int"), F.col("parents").cast("array<int>"))


def _ordered(attributes: DataFrame, d: int, size: int, seed: int, with_class: bool) -> DataFrame:
    """Per component the node order as an array sorted by md5 key (class first when it
    is held out of the shuffle): (component, order ARRAY<INT>)."""
    nodes = attributes.where(F.col("att") < d).select(F.col("att").cast("int"))
    if with_class:
        nodes = nodes.unionByName(nodes.agg(F.lit(d).cast("int").alias("att")))
    base = _with_components(nodes, size)
    keyed = base.select("component", F.struct(h(seed, F.col("component"), "order", F.col("att")).alias("k"),
                                              F.col("att").alias("a")).alias("s"))
    grouped = keyed.groupBy("component").agg(F.array_sort(F.collect_list("s")).alias("o"))
    return grouped.select("component", F.transform("o", lambda s: s["a"]).alias("order"))


def random_structure_shuffled(attributes: DataFrame, d: int, size: int = 20, max_parents: int = 2,
                              seed: int = 0) -> DataFrame:
    """B-2: random attribute order per component (class first, naive-Bayes init).

    The node at order position k (1-based, class at 0) gets the class plus all earlier
    attributes when k-1 <= m, else m attributes drawn from positions 1..k-1."""
    orders = _ordered(attributes, d, size, seed, with_class=False)
    exploded = orders.select("component", "order", F.posexplode("order").alias("p0", "att"))
    k = F.col("p0") + 1
    prefix = F.expr("slice(order, 1, p0)")
    comp, att = F.col("component"), F.col("att")
    picked = F.when(k - 1 <= max_parents, F.array_sort(prefix)).otherwise(
        _pick(prefix, F.lit(max_parents), lambda c: h(seed, comp, att, c)))
    rows = exploded.select(comp, att, F.concat(picked, F.array(F.lit(d))).alias("parents"))
    cls_rows = orders.select("component", F.lit(d).alias("att"), F.array(F.lit(d)).alias("parents"))
    return rows.unionByName(cls_rows).select(
        F.col("component").cast("int"), F.col("att").cast("int"), F.col("parents").cast("array<int>"))


def random_structure_free(attributes: DataFrame, d: int, size: int = 20, max_parents: int = 2,
                          seed: int = 0) -> DataFrame:
    """B-3: no naive-Bayes initialisation; the class (index d) is shuffled with the
    attributes, so it may be a child and may be absent from parent sets.  The node at
    position k (0-based) gets min(k, m) parents drawn from positions 0..k-1."""
    orders = _ordered(attributes, d, size, seed, with_class=True)
    exploded = orders.select("component", "order", F.posexplode("order").alias("p0", "att"))
    prefix = F.expr("slice(order, 1, p0)")
    comp, att = F.col("component"), F.col("att")
    picked = _pick(prefix, F.least(F.col("p0"), F.lit(max_parents)), lambda c: h(seed, comp, att, c))
    return exploded.select(comp.cast("int"), att.cast("int"), picked.cast("array<int>").alias("parents"))


def structure_from_rows(spark, rows: list[tuple[int, int, list[int]]]) -> DataFrame:
    """A structure table from literal rows (tests and user-supplied structures);
    parents are sorted on the way in, like the reference's set read-back."""
    df = spark.createDataFrame(rows, STRUCTURE_SCHEMA)
    return df.select("component", "att", F.array_sort("parents").alias("parents"))
