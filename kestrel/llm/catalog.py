"""Registered queries of the training-data operators and their DuckDB restatements."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.llm import conversations, decontaminate, filteraudit, langid, licenses, lm, neardup, packing, pii, repeats, tokencount, topk, toxicity
from kestrel.llm.common import table


def op1_benchmark_decontamination(spark, sf_dir):
    got = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "item_id", "substitutions")


def op2_token_counts(spark, sf_dir):
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.apply(model, docs.select("doc_id", "held_out", "text")).drop("text")


def op4_minhash_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_lm_scoring(spark, sf_dir):
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op7_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op8_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), passage=repeats.WORDS)


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark, sf_dir):
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op12_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op13_filter_audit(spark, sf_dir):
    return filteraudit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_pii": op7_pii,
    "op8_license_scan": op8_license_scan,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_packing": op10_packing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_toxicity": op12_toxicity,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE = {
    "op1_benchmark_decontamination": decontaminate.CONTAMINATED_SQL,
    "op4_minhash_near_dedup": neardup.NEAR_SQL,
    "op5_exact_top_k": topk.TOPK_SQL,
    "op8_license_scan": licenses.LICENSE_SQL,
    "op10_packing": packing.PACK_SQL,
    "op11_conversation_repair": conversations.REPAIR_SQL,
    "op13_filter_audit": filteraudit.AUDIT_SQL,
}
