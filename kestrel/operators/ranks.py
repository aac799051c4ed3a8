"""Ranks over tables of any size: range partitions, local ranks, offsets (IO-2).

Rows are range-partitioned and sorted by (group, value), each task numbers its rows as they pass,
and a group that goes on in the next partition is moved on by the rows it had before.  A
partition can only continue one group, so the table of offsets has at most one row per
partition; no group is ranked by one task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.sources.model_io import scratch_path


def dense_ranks(df: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """``df`` with ``name`` = 0-based dense rank of ``value`` inside the group ``by``, nulls first.
    The rows are written once to the shared folder, so partitions stay what they were when
    the offsets are taken."""
    spark = df.sparkSession
    cols = df.columns
    ordered = df.repartitionByRange(*by, value).sortWithinPartitions(*by, value)

    def number(batches):
        from pyspark import TaskContext

        part, group, last, rank = TaskContext.get().partitionId(), None, None, 0
        for b in batches:
            local = []
            for *g, v in zip(*(b.column(c).to_pylist() for c in [*by, value]), strict=True):
                if g != group:
                    group, rank = g, 0
                elif v != last:
                    rank += 1
                last = v
                local.append(rank)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(local), pa.int32()), pa.array(local, pa.int64())], names=[*cols, "_part", "_local"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    path = scratch_path(spark, "ranks")
    ordered.mapInArrow(number, f"{kinds}, _part int, _local bigint").write.parquet(path)
    rows = spark.read.parquet(path)
    # distinct values of a group in a partition, for groups that are in more than one
    sizes = rows.groupBy(*by, "_part").agg((F.max("_local") + 1).alias("_n"))
    over = Window.partitionBy(*by).orderBy("_part")
    # equal values are never cut apart by a range partition
    offsets = sizes.withColumn("_before", F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1))).where("_before is not null")
    offsets = offsets.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), "_before")
    same = rows["_part"] == offsets["_p"]
    for i, c in enumerate(by):
        same = same & rows[c].eqNullSafe(offsets[f"_g{i}"])
    out = rows.join(F.broadcast(offsets), same, "left")  # at most one row per partition
    return out.select(*[rows[c] for c in cols], (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("bigint").alias(name))
