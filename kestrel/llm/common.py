"""Small Spark helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: regular expressions of the two word classes (on text lower-cased in A-Z)
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet under the shared folder that the cluster
    names in ``spark.checkpoint.dir`` and read it back.  A lost executor loses
    nothing that is already written."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/kestrel/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names are compared without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str) -> DataFrame:
    """``mapInArrow`` with one output batch (or a dict of columns) per input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, dict):
                out = pa.RecordBatch.from_pydict(out)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def shipped(spark: SparkSession, value) -> Callable:
    """A broadcast of ``value`` and a function that gives it in a task.  The classes of this package
    travel with it by value, so executors need no copy of the package."""
    sent, held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get():
        if not held:
            held.append(cloudpickle.loads(sent.value))
        return held[0]

    return get


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for what is planned inside: for wide rows, whose
    default batches would not fit a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def lists(values, offsets, kind: pa.DataType) -> pa.Array:
    """List array from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def text_key(col) -> list:
    """128 bits that name a text: two independent 64-bit hashes."""
    col = F.coalesce(col, F.lit(""))
    return [F.xxhash64(col), F.xxhash64(F.lit(7), col, F.length(col))]
