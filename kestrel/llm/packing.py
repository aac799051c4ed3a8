"""Packing into optimal length buckets.

Texts are measured in words (``SPACE`` words) and cut into sequences of at most
``max_len`` words, so that the histogram of lengths has at most ``max_len + 1`` entries
at any input size.  Dynamic programming over this global histogram chooses the
``n_buckets`` bucket lengths that minimise padding in total (of equal costs the smaller
boundary, from the longest bucket down).  Each sequence goes to the smallest bucket that
holds it; inside a bucket, batches of ``budget // bucket_len`` sequences (one at least)
are formed in the order of md5(doc_id/seq).

Ranks are not taken by one window per bucket: sequences are dealt to 256 groups a bucket
by the first byte of the md5, ranked inside a group, and moved on by the counts of the
groups before (a table of at most 256 x n_buckets rows).

Defined cases: a null or empty text is one sequence of 0 words; repeated rows are packed
each; a null doc_id orders as the text 'null'; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import written

MAX_LEN = 8192
N_BUCKETS = 16
BUDGET = 65536


def bucket_lengths(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """The upper lengths of the buckets with the least padding; exact, O(B L^2)."""
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(x)
    b = min(n_buckets, n)
    if not n:
        return []
    C, S = np.concatenate(([0], np.cumsum(c))), np.concatenate(([0], np.cumsum(c * x)))
    best = x * C[1:] - S[1:]  # one bucket for the first j+1 lengths
    back = []
    for k in range(1, b):
        new, frm = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        for j in range(k, n):  # the last bucket holds lengths i+1..j
            i = np.arange(k - 1, j)
            cost = best[i] + x[j] * (C[j + 1] - C[i + 1]) - (S[j + 1] - S[i + 1])
            at = int(np.argmin(cost))
            new[j], frm[j] = cost[at], i[at]
        back.append(frm)
        best = new
    out, j = [], n - 1
    for frm in reversed(back):
        out.append(int(x[j]))
        j = int(frm[j])
    return [*reversed([*out, int(x[j])])]


def n_words(text):
    blank = F.lit(" \t\n\x0b\x0c\r")
    t = F.btrim(F.coalesce(text, F.lit("")), blank)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("bigint")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_len: int = MAX_LEN,
         n_buckets: int = N_BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, seq, n_tokens, bucket_len, batch, slot): one row per sequence; ``batch``
    counts from 0 in each bucket, ``slot`` from 0 in each batch."""
    seqs = docs.select(F.col(doc_id).alias("doc_id"), n_words(F.col(text)).alias("n")).select(
        "doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("n") / max_len) - 1, F.lit(0)))).alias("seq"))
    seqs = seqs.select("doc_id", "seq", F.least(F.lit(max_len), F.col("n") - F.col("seq") * max_len).cast("bigint").alias("n_tokens"))
    seqs = written(seqs, "lengths")  # the texts are measured once
    hist = seqs.groupBy("n_tokens").count().collect()  # at most max_len + 1 rows
    bounds = bucket_lengths(np.array([r.n_tokens for r in hist]), np.array([r["count"] for r in hist]), n_buckets)
    at = F.lit(None).cast("bigint")
    for b in reversed(bounds):
        at = F.when(F.col("n_tokens") <= b, F.lit(b).cast("bigint")).otherwise(at)
    order = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("seq").cast("string")).cast("binary"))
    seqs = seqs.withColumn("bucket_len", at).withColumn("ord", order).withColumn("grp", F.substring("ord", 1, 2))
    before = seqs.groupBy("bucket_len", "grp").count().withColumn(
        "before", F.sum("count").over(Window.partitionBy("bucket_len").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("bucket_len", "grp", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = seqs.withColumn("rank", F.row_number().over(Window.partitionBy("bucket_len", "grp").orderBy("ord", "n_tokens")) - 1)
    size = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))), F.lit(1))
    rank = F.col("rank") + F.col("before")
    return ranked.join(F.broadcast(before), ["bucket_len", "grp"]).select(
        "doc_id", "seq", "n_tokens", "bucket_len", F.floor(rank / size).cast("bigint").alias("batch"), (rank % size).cast("bigint").alias("slot"))


PACK_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
s AS (SELECT doc_id, n, unnest(range(0, greatest(CAST(ceil(n / 8192.0) AS BIGINT), 1))) AS seq FROM t),
q AS (SELECT doc_id, seq, CAST(least(8192, n - seq * 8192) AS BIGINT) AS n_tokens FROM s),
h AS (SELECT n_tokens AS x, row_number() OVER (ORDER BY n_tokens) AS j,
        CAST(sum(count(*)) OVER (ORDER BY n_tokens) AS BIGINT) AS c,
        CAST(sum(n_tokens * count(*)) OVER (ORDER BY n_tokens) AS BIGINT) AS s FROM q GROUP BY n_tokens),
dp AS (
  SELECT 1 AS k, j, x, c, s, x * c - s AS cost, [x] AS path FROM h
  UNION ALL
  SELECT k, j, x, c, s, b.cost, b.path FROM (
    SELECT dp.k + 1 AS k, h.j, h.x, h.c, h.s,
      min({'cost': dp.cost + h.x * (h.c - dp.c) - (h.s - dp.s), 'i': dp.j, 'path': list_append(dp.path, h.x)}) AS b
    FROM dp JOIN h ON h.j > dp.j WHERE dp.k < 16 GROUP BY dp.k, h.j, h.x, h.c, h.s)),
top AS (SELECT path FROM dp WHERE j = (SELECT max(j) FROM h) ORDER BY k DESC LIMIT 1),
b AS (SELECT unnest(path) AS bucket_len FROM top),
a AS (SELECT q.*, (SELECT min(bucket_len) FROM b WHERE bucket_len >= n_tokens) AS bucket_len,
        md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || CAST(seq AS VARCHAR)) AS ord FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket_len ORDER BY ord, n_tokens) - 1 AS rank,
        greatest(65536 // greatest(bucket_len, 1), 1) AS size FROM a)
SELECT doc_id, seq, n_tokens, bucket_len, rank // size AS batch, rank % size AS slot FROM r
"""
