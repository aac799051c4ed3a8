"""Incremental count maintenance with Structured Streaming (C-2 in streaming form).

New instance files arriving in a folder are counted micro-batch by micro-batch with
the same ``count_families`` aggregation; every micro-batch appends its partial count
table under ``batch=<id>`` (overwritten on replay, so a restarted query is
idempotent), and the model's counts are the merge (element-wise sum) of all parts.
Progress is tracked by the query's checkpoint in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators.counts import Family, count_families, merge_counts
from kestrel.sources.nominal import NominalData


def start_count_stream(spark: SparkSession, source: str, schema: str, template: NominalData,
                       comp_fams: list[tuple[int, Family]], sink: str, checkpoint: str,
                       available_now: bool = True):
    """Start the streaming count job; returns the StreamingQuery."""
    stream = spark.readStream.schema(schema).parquet(source)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        part = count_families(template.with_df(batch), comp_fams)
        part.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def current_counts(spark: SparkSession, sink: str) -> DataFrame:
    """The merged count table of every micro-batch written so far."""
    parts = spark.read.parquet(sink).drop("batch")
    return merge_counts(parts).select("component", "att", "cls", "pidx", "v", F.col("n"))
