"""E-1 .. E-3: reproducible (stratified) fold assignment.

The random shuffle is an order by md5(seed|rid).  Ranking inside a class must not
become one window over a whole class (a class may hold a third of all rows), so
every rank is computed in two steps: rows are split into up to 16^p buckets by the
first p hex digits of their md5 key; a row's rank is the number of rows of its
group in earlier buckets (a small (group, bucket) count table with a running sum,
broadcast back) plus its row number inside its bucket.  Because the bucket is a
prefix of the sort key, the result equals one global ``row_number``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.functions.hashing import h

# 16^3 = 4096 buckets per group.
BUCKET_HEX_DIGITS = 3


def _bucketed(df: DataFrame, groups: list[str], key: Column, tiebreak: str, name: str, digits: int):
    keyed = df.withColumn("_key", key).withColumn("_b", F.substring("_key", 1, digits))
    sizes = keyed.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    run = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = sizes.select(*groups, "_b", F.coalesce(F.sum("_cnt").over(run), F.lit(0)).alias("_off"),
                           F.sum("_cnt").over(whole).alias("_n"))
    # the bucket first: it tells most rows apart in the sort
    inner = Window.partitionBy("_b", *groups).orderBy("_key", tiebreak)
    # the key is made again behind the shuffle, so that records stay narrow
    dealt = keyed.drop("_key").repartition(*groups, "_b").withColumn("_key", key)
    ranked = dealt.withColumn("_rn", F.row_number().over(inner) - 1)
    # (group, bucket) table: at most groups x 16^digits rows
    out = ranked.join(F.broadcast(offsets), [*groups, "_b"])
    out = out.withColumn(name, (F.col("_off") + F.col("_rn")).cast("long")).drop("_key", "_b", "_rn", "_off")
    group_sizes = sizes.groupBy(*groups).agg(F.sum("_cnt").alias("_n"))
    return out, group_sizes


def bucketed_rank(df: DataFrame, groups: list[str], key: Column, tiebreak: str,
                  name: str = "_rank", digits: int = BUCKET_HEX_DIGITS) -> DataFrame:
    """Adds ``name`` = 0-based rank of each row inside ``groups`` ordered by
    (key, tiebreak), plus ``_n`` = the size of the row's group."""
    return _bucketed(df, groups, key, tiebreak, name, digits)[0]


def range_assign(df: DataFrame, groups: list[str], key: Column, tiebreak: str, assign: Callable[[Column, Column], Column],
                 name: str, digits: int = BUCKET_HEX_DIGITS) -> DataFrame:
    """Adds ``name`` = assign(rank in the group, size of the group), for an ``assign`` that never
    falls as the rank grows.  A bucket whose first and last rank are assigned alike needs no
    ranks; only rows of the few buckets that hold a cut are shuffled and ranked."""
    keyed = df.withColumn("_key", key).withColumn("_b", F.substring("_key", 1, digits))
    sizes = keyed.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    run = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    table = sizes.select(*groups, "_b", "_cnt", F.coalesce(F.sum("_cnt").over(run), F.lit(0)).alias("_off"),
                         F.sum("_cnt").over(Window.partitionBy(*groups)).alias("_n"))
    table = table.select(*groups, "_b", "_off", "_n", assign(F.col("_off"), F.col("_n")).alias("_first"),
                         assign(F.col("_off") + F.col("_cnt") - 1, F.col("_n")).alias("_last"))
    # (group, bucket) table: at most groups x 16^digits rows
    rows = keyed.join(F.broadcast(table), [*groups, "_b"])
    whole = rows.where("_first = _last").withColumn(name, F.col("_first"))
    inner = Window.partitionBy(*groups, "_b").orderBy("_key", tiebreak)
    rank = F.col("_off") + F.row_number().over(inner) - 1
    cut = rows.where("_first <> _last").withColumn("_rank", rank).withColumn(name, assign(F.col("_rank"), F.col("_n")))
    return whole.select(*df.columns, name).union(cut.select(*df.columns, name))


def with_repeats(df: DataFrame, repeats: int, name: str = "rep") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))


def interleaved_folds(df: DataFrame, k: int, *, rid: str = "rid", cls: str = "cls", rep: str | None = None,
                      seed: int = 1) -> DataFrame:
    """E-1: shuffle (md5), group by class, deal every k-th row to the next fold:
    fold = (rank in class + rows of smaller classes) % k.  With ``rep`` each repeat
    uses seed + rep."""
    reps = [rep] if rep else []
    s = (F.col(rep) + F.lit(seed)) if rep else F.lit(seed)
    ranked, class_sizes = _bucketed(df, [*reps, cls], h(s, F.col(rid)), rid, "_rank", BUCKET_HEX_DIGITS)
    # class offsets from the small (group, bucket) count table, not from the rows
    before = Window.partitionBy(*reps).orderBy(cls).rowsBetween(Window.unboundedPreceding, -1)
    offs = class_sizes.select(*reps, cls, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_coff"))
    out = ranked.join(F.broadcast(offs), [*reps, cls])
    return out.withColumn("fold", ((F.col("_rank") + F.col("_coff")) % k).cast("int")).drop("_rank", "_n", "_coff")


def _range_fold(k: int) -> Callable[[Column, Column], Column]:
    """fold = ceil(k (rank + 1) / n) - 1, in integers."""
    return lambda rank, n: (F.floor((k * (rank + 1) + n - 1) / n) - 1).cast("int")


def proportional_folds(df: DataFrame, k: int, *, rid: str = "rid", cls: str = "cls", seed: int = 1) -> DataFrame:
    """E-2: per class, shuffled ranks r = 0..n_c-1 are cut into k near-equal ranges."""
    return range_assign(df, [cls], h(seed, F.col(rid)), rid, _range_fold(k), "fold")


def plain_folds(df: DataFrame, k: int, *, rid: str = "rid", seed: int = 1) -> DataFrame:
    """E-3: one shuffled order cut into k ranges [i l / k, (i+1) l / k)."""
    return range_assign(df.withColumn("_all", F.lit(0)), ["_all"], h(seed, F.col(rid)), rid, _range_fold(k), "fold").drop("_all")
