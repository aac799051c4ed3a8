"""Benchmark decontamination by spaced-seed hashing.

A document is contaminated by a benchmark item when some ``WINDOW`` consecutive words
of the document, laid against as many consecutive words of the item, differ in at most
``SUBSTITUTIONS`` places.  Words are ``ALNUM`` words (A-Z lower-cased), so punctuation
and line breaks do not hide a passage.

Method.  Cut a window into four blocks of three words.  Two substitutions spoil at most
two blocks, so two whole blocks stay equal: each mask keeps two blocks and ignores the
positions between them.  The three masks (distance 1, 2, 3 between the blocks) hence hit
*every* window within the tolerance.  Each side hashes its words under each mask; the
hashes are joined; every hit is verified by counting the differing places of all windows
around it.  The training side is filtered by a bitmap of the item hashes first, whose
size is fixed (2 MiB), whatever the number of items, so the join shuffles only hits.

Defined cases: an item of 5..11 words contaminates where all its words stand in sequence;
an item with fewer words, or null, names no passage and never matches; a null or empty
document matches nothing; repeated rows count once per (doc_id, item_id); a null doc_id
is a key like any other.  Extra columns of either table are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import lists, map_batches, unused
from kestrel.llm.text import ALNUM, buffers, mix, slices, word_hashes

WINDOW = 12
SUBSTITUTIONS = 2
MIN_ITEM_WORDS = 5
#: kept positions of the masks
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 6, 7, 8), (0, 1, 2, 9, 10, 11))
BITMAP_BITS = 24
#: words around a hit that its windows can touch
AROUND = 2 * WINDOW - 1
_OUT_DOC, _OUT_ITEM = 0, 1


def _mask_hash(w: np.ndarray, kept, salt: int) -> np.ndarray:
    n = len(w) - kept[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(salt + 1))
    for k in kept:
        h = mix(h * np.uint64(0xA0761D6478BD642F) + w[k : k + n])
    return h


def _seeds(text: pa.Array, ids: pa.Array, masks: dict[int, tuple], outside: int, keep, whole_item: bool):
    """Rows (id, mask, hash, pos, around) of a batch for which ``keep(hash)`` holds."""
    data, off = buffers(text)
    rows, mask_ids, hashes, poss, ctx = [], [], [], [], []
    for i, j in slices(off):
        w, first = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM)
        size = np.diff(first)
        doc = np.repeat(np.arange(j - i), size)
        for m, kept in masks.items():
            h = _mask_hash(w, kept, m)
            if not len(h):
                continue
            fits = doc[: len(h)] == doc[kept[-1] : kept[-1] + len(h)]
            if whole_item:  # an item shorter than the window is one seed of its own length
                n = size[doc[: len(h)]]
                fits &= (n >= WINDOW) if m < len(MASKS) else (n == len(kept))
            at = np.flatnonzero(fits)
            at = at[keep(h[at])]
            if not len(at):
                continue
            around = at[:, None] + np.arange(-(WINDOW - 1), WINDOW)
            d = doc[at]
            ok = (around >= first[d][:, None]) & (around < first[d + 1][:, None])
            ctx.append(np.where(ok, w[np.clip(around, 0, len(w) - 1)], np.uint64(outside)).ravel())
            rows.append(d + i)
            mask_ids.append(np.full(len(at), m, np.int32))
            hashes.append(h[at])
            poss.append(at - first[d])
    if not rows:
        return None
    n = sum(map(len, rows))
    return {
        "id": ids.take(pa.array(np.concatenate(rows))),
        "mask": np.concatenate(mask_ids),
        "hash": np.concatenate(hashes).view(np.int64),
        "pos": np.concatenate(poss).astype(np.int64),
        "around": lists(np.concatenate(ctx).view(np.int64), np.arange(n + 1) * AROUND, pa.int64()),
    }


def _schema(df: DataFrame) -> str:
    return f"id {df.schema['id'].dataType.simpleString()}, mask int, hash bigint, pos bigint, around array<bigint>"


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, substitutions, first_pos): every document and the items it
    overlaps, with the fewest differing places of any of its windows (0 for an item
    shorter than the window) and the smallest word position of a hit."""
    spark = docs.sparkSession
    items = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text"))
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def item_words(b):
        data, off = buffers(b.column("text"))
        _, first = word_hashes(data, off, ALNUM)
        return {"n": np.diff(first).astype(np.int64)}

    lengths = map_batches(items, item_words, "n bigint").where(F.col("n").between(MIN_ITEM_WORDS, WINDOW - 1)).distinct()
    masks = dict(enumerate(MASKS)) | {100 + r.n: tuple(range(r.n)) for r in lengths.collect()}  # at most 7 more

    everything = lambda h: slice(None)
    seeds = map_batches(items, lambda b: _seeds(b.column("text"), b.column("id"), masks, _OUT_ITEM, everything, True), _schema(items))
    seeds = seeds.groupBy("id", "mask", "hash", "around").agg(F.min("pos").alias("pos"))
    top = 64 - BITMAP_BITS
    words = seeds.select(F.shiftrightunsigned("hash", top).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    for r in words.toLocalIterator():  # at most 2**18 rows
        bitmap[r.word] = np.uint64(r.bits & (2**64 - 1))
    shared = spark.sparkContext.broadcast(bitmap)

    def known(h):
        bit = h >> np.uint64(top)
        return np.flatnonzero((shared.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))

    hits = map_batches(docs, lambda b: _seeds(b.column("text"), b.column("id"), masks, _OUT_DOC, known, False), _schema(docs))
    hits = hits.groupBy("id", "mask", "hash", "around").agg(F.min("pos").alias("pos"))  # a run of equal words is one hit
    hits = hits.withColumnsRenamed({"id": "doc_id", "around": "doc_around"})
    pairs = hits.join(seeds.select(F.col("id").alias("item_id"), "mask", "hash", "around"), ["mask", "hash"])
    differ = F.zip_with("doc_around", "around", lambda a, b: F.when((a == _OUT_DOC) | (b == _OUT_ITEM), 99).when(a == b, 0).otherwise(1))
    total = lambda start, n: F.aggregate(F.slice("differ", start, n), F.lit(0), lambda s, x: s + x)
    best = F.array_min(F.transform(F.sequence(F.lit(1), F.lit(WINDOW)), lambda i: total(i, F.lit(WINDOW))))
    pairs = pairs.withColumn("differ", differ).select(
        "doc_id", "item_id", "pos",
        F.when(F.col("mask") < len(MASKS), best).otherwise(total(F.lit(WINDOW), F.greatest(F.col("mask") - 100, F.lit(1)))).alias("d"),
        F.when(F.col("mask") < len(MASKS), SUBSTITUTIONS).otherwise(0).alias("allowed"))
    return pairs.where("d <= allowed").groupBy("doc_id", "item_id").agg(
        F.min("d").cast("bigint").alias("substitutions"), F.min("pos").alias("first_pos"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that no benchmark item contaminates, with all their columns.  Rows are
    judged by their own text, also where they share a doc_id."""
    key = F.xxhash64("doc_id", "text")
    bad = contaminated(docs.select(key.alias("__key"), "text"), items, doc_id="__key").select(F.col("doc_id").alias("__key")).distinct()
    own = unused(docs, "__own")
    return docs.withColumn(own, key).join(bad, F.col(own) == bad["__key"], "left_anti").drop(own)


#: the same rule by joining equal words: a window holds 10 of 12 places exactly where some
#: 12 places of the diagonal do, since a window can be moved inwards over missing places
CONTAMINATED_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
iw AS (SELECT item_id, len(w) AS m, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM i WHERE len(w) >= 5),
e AS (SELECT doc_id, item_id, n, m, p - q AS diag, q FROM dw JOIN iw USING (word)),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, n, diag ORDER BY q RANGE BETWEEN CURRENT ROW AND 11 FOLLOWING) AS eq,
        least(m, n - diag) - greatest(1, 1 - diag) + 1 AS size FROM e)
SELECT doc_id, item_id, CAST(min(least(m, 12) - eq) AS BIGINT) AS substitutions FROM c
WHERE size >= least(m, 12) AND eq >= (CASE WHEN m >= 12 THEN 10 ELSE m END)
GROUP BY doc_id, item_id
"""
