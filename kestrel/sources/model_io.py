"""Model tables on storage: IO-3 structures, IO-4 count tables.

Both are plain Parquet tables; count tables are partitioned by component so a
scorer can read the components it needs.  Scratch output goes under the shared
folder named by ``spark.checkpoint.dir`` (never a machine-local temp folder).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kestrel-{name}-{uuid.uuid4().hex}"


def write_structure(structure: DataFrame, path: str) -> None:
    """IO-3 writer."""
    structure.select("component", "att", "parents").write.mode("overwrite").parquet(path)


def read_structure(spark: SparkSession, path: str) -> DataFrame:
    """IO-3 reader: parents come back ascending (the radix order)."""
    df = spark.read.parquet(path)
    return df.select(F.col("component").cast("int"), F.col("att").cast("int"),
                     F.array_sort(F.col("parents").cast("array<int>")).alias("parents"))


def write_counts(counts: DataFrame, path: str) -> None:
    """IO-4 writer: one folder per component, one file in it."""
    counts.repartition("component").write.mode("overwrite").partitionBy("component").parquet(path)


def read_counts(spark: SparkSession, path: str, components: list[int] | None = None) -> DataFrame:
    """IO-4 reader; a component list is a partition filter (pruned at the scan)."""
    df = spark.read.parquet(path)
    if components is not None:
        df = df.where(F.col("component").isin(components))
    return df.select(F.col("component").cast("int"), F.col("att").cast("int"), F.col("cls").cast("int"),
                     F.col("pidx").cast("bigint"), F.col("v").cast("int"), F.col("n").cast("double"))
