"""License scans by an exact set-similarity join, in DataFrame and SQL functions only.

Words are ``ALNUM`` words (A-Z lower-cased).  A text is cut into blocks of ``BLOCK`` words that
start every ``STRIDE`` words; a template is a short notice with a label.  A block holds a
template where |block and template| >= ``CONTAINMENT`` * |template|, over sets of words, and the join
finds every such pair:

* the words of the templates are ordered by the number of documents of the corpus that hold
  them, rarest first (ties by the word): one global order for both sides;
* *prefix filter*: with n words of which m must be met, a block that holds the template has one
  of the template's first n - m + 1 words;
* *length filter*: a block has at least m template words;
* *positional filter*: from the first shared prefix word, at place p in the template and b in the
  block (both ordered), at most 1 + min(n - p - 1, size - b - 1) words can be shared;
* what is left is counted on the full sets.

A block can only hold a template if its whole text does, so texts are reduced first to those
whose different words reach m of some template (or hold a base phrase's words); the words of
other texts are not kept.  The templates and their prefix index are a few dozen rows.

Base labels are exact phrases, found at every place.  ``labels`` are both kinds; ``score`` is the
largest containment of a found pair, 1 where a base phrase stands, else 0.

Defined cases: a null or empty text has 0 words, no places and empty label strings; every row
gives one row; long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import UPPER, written

BLOCK, STRIDE = 32, 16
CONTAINMENT = 0.8
#: base phrases and their labels
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
#: notices looked for, at most STRIDE different words each
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("public-domain", "this work is dedicated to the public domain"),
)


def required(n: int, containment: float = CONTAINMENT) -> int:
    """The fewest shared words that reach the containment of n."""
    m = int(n * containment)
    return m if m >= n * containment - 1e-9 else m + 1


def words_of(text: Column) -> Column:
    """The words of a text; ``lower`` is right for A-Z, and the two other characters that it would
    turn into A-Z are kept apart."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(text.rlike("[Kİ]"), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def places(words: Column, phrase) -> Column:
    """Every place (from 0) where the words of a phrase stand one after the other."""
    hit = lambda i: [F.get(words, i + k) == w for k, w in enumerate(phrase)]

    def test(i):
        all_ = hit(i)
        out = all_[0]
        for c in all_[1:]:
            out = out & c
        return out

    last = F.size(words) - len(phrase)
    return F.when((last >= 0) & F.array_contains(words, phrase[0]), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), test)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    spark = docs.sparkSession
    sets = [(label, sorted(set(t.split()))) for label, t in templates]
    vocab = sorted({w for _, ws in sets for w in ws} | {w for p in PHRASES for w in p})
    need = [required(len(ws), containment) for _, ws in sets]

    words, present = F.col("w"), F.col("present")
    enough = F.lit(False)
    for (_, ws), m in zip(sets, need, strict=True):
        enough = enough | (F.size(F.array_intersect(present, _strings(ws))) >= m)
    for phrase in PHRASES:
        enough = enough | (F.size(F.array_intersect(present, _strings(phrase))) == len(set(phrase)))
    read = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("w"))
    read = read.select("doc_id", "w", F.array_intersect(_strings(vocab), words).alias("present"))
    read = read.select("doc_id", F.size("w").cast("bigint").alias("n_words"), "present", F.when(enough, words).alias("w"))
    read = written(read.withColumn("rid", F.monotonically_increasing_id()), "license-words")  # written: the ids stay

    # global order: rarest first
    df = {r.word: r.n for r in read.select(F.explode("present").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # template words
    order = sorted(vocab, key=lambda w: (df.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index, whole = [], []
    for t, ((label, ws), m) in enumerate(zip(sets, need, strict=True)):
        ranks = sorted(rank[w] for w in ws)
        whole.append((t, label, ranks, len(ws), m))
        index += [(r, t, p, len(ws), m) for p, r in enumerate(ranks[: len(ws) - m + 1])]
    index = spark.createDataFrame(index, "rank int, template int, p int, n int, need int")
    whole = spark.createDataFrame(whole, "template int, label string, ranks array<int>, n int, need int")

    kept = read.where("w is not null")
    ids = F.create_map(*[x for w, i in rank.items() for x in (F.lit(w), F.lit(i))])
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(words) - 1) / STRIDE), F.lit(0)).cast("int"))
    blocks = kept.select("rid", "w", F.posexplode(starts).alias("block", "s")).select(
        "rid", "block", F.slice("w", F.col("s") * STRIDE + 1, F.lit(BLOCK)).alias("w"))
    blocks = blocks.select("rid", "block", F.array_intersect("w", _strings(vocab)).alias("w")).where(F.size("w") >= min(need))
    blocks = blocks.select("rid", "block", F.array_sort(F.transform("w", lambda x: F.element_at(ids, x))).alias("own"))
    entries = blocks.select("rid", "block", "own", F.posexplode("own").alias("b", "rank"))
    pairs = entries.join(F.broadcast(index), "rank").where(F.size("own") >= F.col("need"))
    pairs = pairs.groupBy("rid", "block", "template", "own", "n", "need").agg(F.min("p").alias("p"), F.min("b").alias("b"))
    pairs = pairs.where(1 + F.least(F.col("n") - F.col("p") - 1, F.size("own") - F.col("b") - 1) >= F.col("need"))
    pairs = pairs.drop("n", "need").join(F.broadcast(whole), "template").withColumn("shared", F.size(F.array_intersect("own", "ranks")))
    pairs = pairs.where("shared >= need")
    found = pairs.groupBy("rid").agg(F.collect_set("label").alias("found"), F.max(F.col("shared") / F.col("n")).alias("containment"))

    at = {label: places(words, phrase) for phrase, label in PHRASES.items()}
    based = kept.select("rid", *[p.alias(f"at_{i}") for i, p in enumerate(at.values())])
    every = F.concat(*[F.col(f"at_{i}") for i in range(len(at))])
    named = F.concat(*[F.when(F.size(f"at_{i}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for i, label in enumerate(at)])
    based = based.select("rid", F.size(every).cast("bigint").alias("n_base"), F.array_min(every).cast("bigint").alias("first_word"),
                         F.array_max(every).cast("bigint").alias("last_word"), named.alias("base"))

    got = read.select("rid", "doc_id", "n_words").join(based, "rid", "left").join(found, "rid", "left")
    none = F.array().cast("array<string>")
    base, more = F.coalesce("base", none), F.coalesce("found", none)
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    n_base = F.coalesce("n_base", F.lit(0)).cast("bigint")
    return got.select("doc_id", "n_words", n_base.alias("n_base"), "first_word", "last_word", joined(base).alias("base_labels"),
                      joined(F.concat(base, more)).alias("labels"),
                      F.when(n_base > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).cast("double").alias("score"))


def _sql() -> str:
    """The same rule without filters: every block against every template."""
    values = ", ".join(f"('{label}', {sorted(set(t.split()))!r})" for label, t in TEMPLATES)
    base = ", ".join(f"('{label}', {list(p)!r})" for p, label in PHRASES.items())
    return rf"""
WITH t(label, words) AS (VALUES {values}),
p(label, words) AS (VALUES {base}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT rid, unnest([w[i * {STRIDE} + 1 : i * {STRIDE} + {BLOCK}] FOR i IN range(0, CAST((len(w) + {STRIDE} - 1) // {STRIDE} AS BIGINT))]) AS w FROM d),
m AS (SELECT rid, label, len(list_intersect(list_distinct(b.w), t.words)) AS n, len(t.words) AS size FROM b JOIN t ON len(list_intersect(list_distinct(b.w), t.words)) >= {CONTAINMENT} * len(t.words) - 1e-9),
f AS (SELECT rid, list_distinct(list(label)) AS found, max(n / size) AS containment FROM m GROUP BY rid),
s AS (SELECT rid, p.label, p.words, w, unnest(range(0, len(w))) AS i FROM d JOIN p ON list_has_all(d.w, p.words)),
h AS (SELECT rid, label, i FROM s WHERE w[i + 1 : i + len(words)] = words),
g AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_distinct(list(label)) AS base FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ',') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(containment, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN g USING (rid) LEFT JOIN f USING (rid)
"""


LICENSE_SQL = _sql()
