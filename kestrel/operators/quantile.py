"""Exact weighted quantiles of every group, by narrowing histograms.

A round cuts each group's open range into equal-width buckets and adds up weights (one
aggregation with map-side partial sums); only the bucket that holds the target weight
stays open.  Its smallest and largest value are the next range, so ranges shrink until one
value is left.  No group is sorted or collected: a round brings at most groups x buckets
sums to the driver, and the number of groups is checked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: groups whose ranges the driver keeps
MAX_GROUPS = 20_000
BUCKETS = 512


def exact_quantiles(df: DataFrame, value: Column, target: float | Callable[[tuple, float], float], by: list[str] | None = None,
                    weight: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(by..., lower, upper, below, at, total): ``lower`` is the smallest value whose running
    weight reaches the target, ``upper`` the smallest whose running weight exceeds it (the two
    differ where the target falls between two values), ``below`` the weight of smaller
    values than ``lower`` and ``at`` its own.  ``target`` is a share of the group's weight, or a
    function of (group, total) that gives the target weight.

    Rows without a value or with a weight that is null, NaN or not positive take no part; a group without
    rows is absent.  ``df`` is read once per round, so pass what is persisted or written."""
    by = by or []
    spark = df.sparkSession
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(*by, value.cast("double").alias("_v"), w.alias("_w")).where("_v is not null and not isnan(_v) and _w > 0 and not isnan(_w)")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    first = rows.groupBy(*by).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.sum("_w").alias("total")).where("total is not null")
    got = first.limit(MAX_GROUPS + 1).collect()
    if len(got) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    aim = target if callable(target) else lambda _, total: target * total
    open_, done = {}, []
    for r in got:
        key = tuple(r[c] for c in by)
        open_[key] = dict(lo=r.lo, hi=r.hi, total=r.total, target=min(max(aim(key, r.total), 0.0), r.total), before=0.0, above=None)

    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    schema = ", ".join([f"_{c} {kinds[c]}" for c in by] + ["_lo double", "_hi double"])
    while open_:
        ranges = spark.createDataFrame([(*k, s["lo"], s["hi"]) for k, s in open_.items()], schema)
        inside = rows.join(F.broadcast(ranges), same & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        place = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * buckets
        bucket = F.when(F.col("_lo") == F.col("_hi"), 0).otherwise(F.least(F.floor(place), F.lit(buckets - 1))).cast("int")
        sums = inside.groupBy(*by, bucket.alias("_b")).agg(F.sum("_w").alias("s"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect()
        found: dict[tuple, list] = {}
        for r in sorted(sums, key=lambda r: r["_b"]):
            found.setdefault(tuple(r[c] for c in by), []).append(r)
        for key, parts in found.items():
            s = open_[key]
            slack = 1e-12 * s["total"]
            running = s["before"]
            for i, p in enumerate(parts):
                if running + p.s >= s["target"] - slack or i == len(parts) - 1:
                    break
                running += p.s
            above = parts[i + 1].lo if i + 1 < len(parts) else s["above"]
            if p.lo < p.hi:
                s.update(lo=p.lo, hi=p.hi, before=running, above=above)
                continue
            between = abs(running + p.s - s["target"]) <= slack and above is not None
            done.append((*key, p.lo, above if between else p.lo, running, p.s, s["total"]))
            del open_[key]
    schema = ", ".join([f"{c} {kinds[c]}" for c in by] + ["lower double, upper double, below double, at double, total double"])
    return spark.createDataFrame(done, schema)
