"""Removal of repeated byte strings by bucket-pointer refinement of suffix buckets.

Every byte that is covered by a string of ``LENGTH`` bytes which also starts anywhere else (in
the same text too; overlaps count) is removed.  Strings never cross texts and are judged on
the input.

A suffix array of all positions would move every position; here buckets are refined only
where they can still split:

1. *Initial buckets.*  The start positions of a text are grouped by anchor: the leftmost
   smallest ``Q``-gram hash inside their string (a function of the string alone, so equal strings
   have equal anchors at equal offsets).  An anchor and its run of at most LENGTH - Q + 1
   consecutive start positions is one row; its bucket is the anchor's q-gram.
2. *Buckets that occur once* are settled: nothing in them is repeated.  A bitmap of fixed size
   over the buckets that occur again lets them pass no further.
3. *Refinement by the whole run.*  A bucket is split by the bytes that the run covers.  If a
   bucket holds one such content, all its strings are repeated (it occurs twice or more) or
   none is.
4. *Refinement inside.*  Buckets with several contents: one occurrence of each content is
   fetched.  Its positions get bucket numbers by sorting their q-grams; then the positions of
   every bucket that still has several are sorted by the bucket number of the later offset that
   follows the part compared so far, which doubles that part and gives new numbers, and the new numbers
   are what the next round looks up, until ``length`` is reached.  Buckets of more than ``HOT`` contents
   are not brought to one task: their positions are named by pairs of names in the same
   pattern, as hashes, and counted by an aggregate over (bucket, name).

Strings of one run all overlap, so its repeated strings cover one interval.

The same search runs over words in place of bytes (``WORDS`` words in place of LENGTH bytes, ``WORD_Q``
in place of Q): it tells how many words of a text lie in a passage of WORDS words that also starts
anywhere else.  Nothing is removed for it.

Only texts that may hold a repeat are shuffled (a bitmap of their keys, again of fixed size; on
corpora that fill it, it lets more through and the result is the same).

Names are 64-bit hashes inside a bucket of a 64-bit hash, contents likewise; texts are named
by 128 bits.  Rows with equal texts have equal results and are occurrences of each other.

Defined cases: a null text is empty; texts shorter than LENGTH keep all bytes; an empty table
gives no rows; a null doc_id passes through.  Long texts are read in pieces of ``PIECE`` bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import map_batches, text_key, written
from kestrel.llm.text import POWERS, buffers, mix, prefix, slices, span_hash, word_hashes

LENGTH = 400
Q = 64
PIECE = 1 << 21
HOT = 4096
WORDS = 50
WORD_Q = 8
#: bits of the filters, a power of two; they are broadcast as at most FILTER / 64 rows
FILTER = 1 << 24


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of w values (prefix and suffix minima of blocks)."""
    n = len(x) - w + 1
    pad = np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def _prefix(data: np.ndarray) -> np.ndarray:
    """Prefix hashes of a buffer of bytes, or of words (64-bit hashes)."""
    if data.dtype == np.uint8:
        return prefix(data)
    p, _ = POWERS.upto(len(data) + 1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * p[: len(data)])))


def _runs(data: np.ndarray, off: np.ndarray, length: int, q: int):
    """(text, start, positions, bucket, content) of the runs of a buffer of texts."""
    empty = [np.zeros(0, np.int64)] * 5
    if len(data) < length:
        return empty
    h = _prefix(data)
    at = np.arange(len(data) - q + 1)
    g = mix(span_hash(h, at, at + q))
    low = np.uint64((1 << 24) - 1)  # a place in the buffer; buffers are below 2**24 bytes
    anchor = (_window_min((g & ~low) | at.astype(np.uint64), length - q + 1) & low).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(anchor)]
    valid = np.flatnonzero(np.arange(len(anchor)) + length <= off[doc + 1])
    if not len(valid):
        return empty
    a, d = anchor[valid], doc[valid]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (d[1:] != d[:-1]))))
    first = valid[new]
    count = np.diff(np.concatenate((new, [len(valid)])))
    content = mix(span_hash(h, first, first + count + length - 1) + mix(count.astype(np.uint64)))
    return d[new], first - off[d[new]], count, g[a[new]].view(np.int64), content.view(np.int64)


def _pieces(data: np.ndarray, off: np.ndarray, length: int, words: bool = False):
    """(first text, buffer, offsets, place of the buffer in its text): whole texts, or pieces
    of a long one that overlap so that each start position is in exactly one."""
    for i, j in slices(off, PIECE // 2):
        part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        if words:
            part, o = word_hashes(part, o)
        n = len(part)
        if j > i + 1 or n <= PIECE:
            yield i, part, o, 0
        else:  # one long text
            for at in range(0, max(1, n - length + 1), PIECE):
                piece = part[at : min(n, at + PIECE + length - 1)]
                yield i, piece, np.array([0, len(piece)]), at


def _names(data: np.ndarray, at: np.ndarray, length: int, q: int) -> np.ndarray:
    """Names of the strings of ``length`` elements at places ``at``, alike in every task: hashes of q
    elements, then of twice as many with the name of the later place, until the length is reached."""
    h = _prefix(data)
    p = np.arange(len(data) - q + 1)
    name, size = mix(span_hash(h, p, p + q)), q
    pair = lambda x, gap: mix(x[: len(x) - gap] * np.uint64(0xA0761D6478BD642F) + x[gap:])
    while 2 * size <= length:
        name, size = pair(name, size), 2 * size
    if size < length:
        name = pair(name, length - size)
    return name[at]


def _refined(data: np.ndarray, at: np.ndarray, length: int, q: int) -> np.ndarray:
    """Bucket numbers of the strings of ``length`` elements at places ``at``: equal for equal strings.

    Buckets of equal q-grams are refined by sorting their positions on the bucket number of
    the later offset; numbers are updated at once and used by the next round.  Buckets with one
    position are settled."""
    h = _prefix(data)
    p = np.arange(len(data) - q + 1)
    _, bucket = np.unique(span_hash(h, p, p + q), return_inverse=True)
    size = q
    while size < length:
        gap = min(size, length - size)
        own, later = bucket[: len(bucket) - gap], bucket[gap:]
        many = np.flatnonzero(np.bincount(own)[own] > 1)
        base = int(bucket.max()) + 1
        _, new = np.unique(own[many] * base + later[many], return_inverse=True)
        bucket = own.copy()
        bucket[many] = base + new
        size += gap
    return bucket[at]


def _inside(batches, length: int, q: int, words: bool = False):
    """First and last repeated position of contents that arrive sorted by bucket."""

    def solve(t: pa.Table):
        n = t["positions"].to_numpy()
        col = t["bytes"].combine_chunks()
        data, off = _elements(col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col, words)
        begin = np.concatenate(([0], np.cumsum(n)))
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(begin[-1]) - begin[row]
        name = _refined(data, off[row] + place, length, q)
        times = np.bincount(name, t["times"].to_numpy()[row])
        twice = times[name] >= 2
        lo = np.minimum.reduceat(np.where(twice, place, 1 << 30), begin[:-1])
        hi = np.maximum.reduceat(np.where(twice, place, -1), begin[:-1])
        ok = pa.array(hi >= 0)
        return pa.RecordBatch.from_arrays([t["h"].combine_chunks().filter(ok), t["content"].combine_chunks().filter(ok),
                                           pa.array(lo).filter(ok), pa.array(hi).filter(ok)], names=["h", "content", "lo", "hi"])

    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        h = t["h"].to_numpy()
        size = np.cumsum(t["positions"].to_numpy() + (length - 1))
        new = np.concatenate((np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]))  # ends of buckets
        at = 0
        for i, e in enumerate(new[:-1]):  # the last bucket may go on
            if size[new[i + 1] - 1] - (size[at - 1] if at else 0) > (1 << 20):
                yield solve(t.slice(at, e - at))
                at = e
        end = new[-2] if len(new) > 1 else 0
        if end > at:
            yield solve(t.slice(at, end - at))
            at = end
        rest = t.slice(at)
    if rest is not None and rest.num_rows:
        yield solve(rest)


def _filter(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of FILTER bits over the hashes in ``key``: (word, bits), at most FILTER / 64 rows."""
    bit = F.pmod(F.col(key), F.lit(FILTER))
    return keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))


def _possible(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """``df`` with ``hit``: whether the bitmap knows the key."""
    bit = F.pmod(F.col(key), F.lit(FILTER))
    met = df.withColumn("word", F.shiftright(bit, 6)).withColumn("at", (bit % 64).cast("int")).join(F.broadcast(bits), "word", "left")
    return met.withColumn("hit", F.coalesce(F.expr("shiftright(bits, at) & 1") == 1, F.lit(False))).drop("word", "at", "bits")


def repeated_intervals(docs: DataFrame, text: str = "text", length: int = LENGTH, q: int = Q, hot: int = HOT, words: bool = False) -> DataFrame:
    """(k1, k2, spans): for the 128-bit key of each different text with repeated strings, its
    list of covered intervals (begin, end) in bytes, or in words, unmerged."""
    keyed = docs.select(*(k.alias(n) for k, n in zip(text_key(F.col(text)), ("k1", "k2"), strict=True)), F.col(text).alias("text"))

    def runs(batches):
        for b in batches:
            data, off = buffers(b.column("text"))
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            for i, part, o, at in _pieces(data, off, length, words):
                d, start, count, h, content = _runs(part, o, length, q)
                if len(d):
                    yield pa.RecordBatch.from_pydict({"k1": k1[d + i], "k2": k2[d + i], "start": start + at, "positions": count, "h": h, "content": content})

    every = written(keyed.mapInArrow(runs, "k1 bigint, k2 bigint, start bigint, positions bigint, h bigint, content bigint"), "runs")
    again = _filter(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "h")
    occ = _possible(every, "h", again).where("hit").drop("hit")
    contents = occ.groupBy("h", "content").agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("k1", "k2", "start", "positions")])
    contents = written(contents, "contents")
    kinds = contents.groupBy("h").agg(F.count("*").alias("kinds"), F.max("times").alias("most")).where("kinds > 1 or most > 1")
    open_ = contents.join(kinds, "h")
    whole = open_.where("kinds = 1").select("h", "content", F.lit(0).cast("bigint").alias("lo"), (F.col("positions") - 1).alias("hi"))

    several = open_.where("kinds > 1").select("k1", "k2", "h", "content", "times", "kinds", "start", "positions")
    holders = _possible(keyed, "k1", _filter(several, "k1")).where("hit").drop("hit").dropDuplicates(["k1", "k2"])
    if words:
        parts = several.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "content", "times", "kinds", "start", "positions")).alias("runs"))
        fetched = holders.join(parts, ["k1", "k2"]).select("text", "runs").mapInArrow(
            lambda it: _word_contexts(it, length), "h bigint, content bigint, times bigint, kinds bigint, positions bigint, bytes binary")
    else:
        fetched = holders.join(several, ["k1", "k2"]).select(
            "h", "content", "times", "kinds", "positions",
            F.col("text").cast("binary").substr(F.col("start").cast("int") + 1, (F.col("positions") + length - 1).cast("int")).alias("bytes"))
    fetched = written(fetched, "contexts")
    out = "h bigint, content bigint, lo bigint, hi bigint"
    cold = fetched.where(F.col("kinds") <= hot).repartition("h").sortWithinPartitions("h")
    inside = cold.select("h", "content", "times", "positions", "bytes").mapInArrow(lambda it: _inside(it, length, q, words), out)

    def leaves(b):
        data, off = _elements(b.column("bytes"), words)
        n = b.column("positions").to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        take = pa.array(row)
        return {"h": b.column("h").take(take), "content": b.column("content").take(take), "times": b.column("times").take(take),
                "place": place, "name": _names(data, off[row] + place, length, q).view(np.int64) if len(row) else place}

    named = map_batches(fetched.where(F.col("kinds") > hot), leaves, "h bigint, content bigint, times bigint, place bigint, name bigint")
    twice = named.groupBy("h", "name").agg(F.sum("times").alias("n")).where("n > 1").select("h", "name")
    hot_rows = named.join(twice, ["h", "name"]).groupBy("h", "content").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))

    found = whole.union(inside).union(hot_rows)
    spans = occ.select("k1", "k2", "start", "h", "content").join(found, ["h", "content"])
    spans = spans.select("k1", "k2", (F.col("start") + F.col("lo")).alias("begin"), (F.col("start") + F.col("hi") + length).alias("end")).distinct()
    return spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def _word_contexts(batches, length: int):
    """The words (64-bit hashes) that each run of a text covers, one row a run."""
    for b in batches:
        data, off = buffers(b.column("text"))
        runs = b.column("runs")
        at = np.frombuffer(runs.buffers()[1], np.int32, len(runs) + 1, runs.offset * 4).astype(np.int64)
        flat = runs.flatten()
        start, n = flat.field("start").to_numpy(), flat.field("positions").to_numpy()
        pieces = []
        for i, j in slices(off):
            w, first = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
            for d in range(i, j):
                for k in range(at[d] - at[0], at[d + 1] - at[0]):
                    s = first[d - i] + start[k]
                    pieces.append(w[s : s + n[k] + length - 1].tobytes())
        yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in ("h", "content", "times", "kinds", "positions")), pa.array(pieces, pa.binary())],
                                         names=["h", "content", "times", "kinds", "positions", "bytes"])


def _elements(col: pa.Array, words: bool):
    """Bytes, or words of 8 bytes, of a binary column, and the offsets of its rows."""
    data, off = _binary(col)
    return (data.copy().view(np.uint64), off // 8) if words else (data, off)


def _binary(col: pa.Array):
    off = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64)
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, q: int = Q, hot: int = HOT,
                   keep_bytes: bool = False, passage: int = 0) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept][, n_passages, passage_words]) of every
    row; ``kept`` holds the remaining bytes.  With ``passage``, ``passage_words`` words in ``n_passages``
    maximal runs are covered by that many words which also start elsewhere."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = repeated_intervals(docs, "text", length, q, hot)
    if passage:
        in_words = repeated_intervals(docs, "text", passage, min(WORD_Q, passage), hot, words=True).withColumnRenamed("spans", "passages")
        spans = spans.join(in_words, ["k1", "k2"], "full_outer")
    else:
        spans = spans.withColumn("passages", F.lit(None).cast("array<struct<begin:bigint,end:bigint>>"))
    spans = written(spans, "spans")
    keyed = docs.withColumns(dict(zip(("k1", "k2"), text_key(F.col("text")), strict=True)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(b):
        nb, nr, ns, sha, kept, np_, nw = [], [], [], [], [], [], []
        for t, s, w in zip(*(b.column(c).to_pylist() for c in ("text", "spans", "passages")), strict=True):
            raw = t.encode()
            runs = merged([(x["begin"], x["end"]) for x in s or ()])
            edges = [0, *(x for r in runs for x in r), len(raw)]
            rest = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            nb.append(len(raw))
            nr.append(len(raw) - len(rest))
            ns.append(len(runs))
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
            runs = merged([(x["begin"], x["end"]) for x in w or ()])
            np_.append(len(runs))
            nw.append(sum(e - a for a, e in runs))
        out = {"doc_id": b.column("doc_id"), "n_bytes": pa.array(nb, pa.int64()), "n_removed": pa.array(nr, pa.int64()),
               "n_spans": pa.array(ns, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        out |= {"kept": pa.array(kept, pa.binary())} if keep_bytes else {}
        return out | ({"n_passages": pa.array(np_, pa.int64()), "passage_words": pa.array(nw, pa.int64())} if passage else {})

    # texts without a repeat, which are most, are not shuffled
    marked = _possible(keyed, "k1", _filter(spans, "k1"))
    clear = marked.where("not hit").select("doc_id", "text", *(F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in ("spans", "passages")))
    touched = marked.where("hit").join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans", "passages")
    return map_batches(clear.union(touched), cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
                       + ", kept binary" * keep_bytes + ", n_passages bigint, passage_words bigint" * bool(passage))
