"""Stages of the corpus pipeline: operators applied to ``documents``, decisions in effect."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.llm import decontaminate as decon
from kestrel.llm import langid, neardup
from kestrel.llm import packing as packs
from kestrel.llm import pii as personal
from kestrel.llm.common import table, unused, written

#: a text whose best language value is lower is rejected
MIN_LANGUAGE_SCORE = 0.3


def language_id(spark, docs, sf_dir):
    """Keeps texts of a recognised language; the model learns from the labelled rows."""
    model = langid.fit(docs)
    lang, score = unused(docs, "__lang"), unused(docs, "__score")
    got = langid.apply(model, docs, label=lang, score=score)
    return got.where((F.col(lang) != langid.UNDECIDED) & (F.col(score) >= MIN_LANGUAGE_SCORE)).drop(lang, score)


def near_dedup(spark, docs, sf_dir):
    """Keeps one row of each group of near-duplicates (five words a shingle, 0.8): that of the
    smallest doc_id, null last.  The operator runs on written row ids, so rows that share a
    doc_id, or have none, are judged each by its own text.  Texts without words are copies of
    nothing, but rows of one doc_id without words are one."""
    row = unused(docs, "__row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "dedup-rows")  # written: the ids stay
    got = neardup.near_duplicates(rows, doc_id=row, k=5).select(F.col("doc_id").alias(row), "component_id", "n_shingles")
    got = got.join(rows.select(row, "doc_id"), row)
    wordless = F.col("n_shingles") == 0
    group = [F.when(~wordless | F.col("doc_id").isNull(), F.col("component_id")), F.when(wordless, F.col("doc_id"))]
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))
    kept = got.groupBy(*group).agg(first.alias("first")).select(F.col("first")[row].alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def decontaminate(spark, docs, sf_dir):
    """Drops documents that hold a passage of a benchmark item."""
    return decon.clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark, docs, sf_dir):
    """Replaces personal data by its kind in brackets; every document stays."""
    return personal.mask(docs, personal.fit(docs), n_chars="n_chars")


def packing(spark, docs, sf_dir):
    """One row per sequence of the kept documents."""
    return packs.pack(docs)
