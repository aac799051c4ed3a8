"""Corpus pipeline: STAGES in order, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last keep the columns of
``documents``.
"""

from __future__ import annotations

from kestrel.llm import stages
from kestrel.llm.common import table, written

STAGES = [
    ("language_id", stages.language_id),
    ("near_dedup", stages.near_dedup),
    ("decontaminate", stages.decontaminate),
    ("pii", stages.pii),
    ("packing", stages.packing),
]

#: language ID and the PII model are trained, which SQL cannot express
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
