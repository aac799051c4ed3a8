"""Near-duplicate documents by SetSketch registers.

A document's set: its different k-word shingles (``SPACE`` words, A-Z lower-cased); with
fewer words the whole sequence as one; without words empty, and linked with nothing.  Two
documents are linked where 100 * |A and B| >= ``percent`` * |A or B|, confirmed on full sets.

1. *Sets and registers.*  Equal sets become one node (128-bit key).  A SetSketch has
   ``REGISTERS`` registers; register i holds the truncated, exponentially spaced minimum
   floor(1 - log_b min h_i(x)), h_i exponential with rate ``RATE``.  It merges by maximum, and
   two sets agree in a register with at least the probability of their Jaccard similarity.
2. *Bands.*  ``REGISTERS / ROWS`` bands of ``ROWS`` register values are hashed; sets that share a
   band are candidates.  At the threshold 0.8 a pair shares none with probability
   (1 - 0.8^4)^32 = 5e-8.
3. *Stars.*  Every member of a band's bucket is held against the bucket's smallest node only, so
   a bucket of n sets gives n - 1 candidates.  The joint likelihood of the similarity, given
   the numbers of registers that are larger, smaller and equal, drops a pair where every
   value from the threshold on is exp(-``SURE``) times less likely than the best one; the rest are
   verified on full sets.  Connected components follow.
4. *Crossings.*  In buckets that still hold several components, members outside the bucket's
   largest component are held against all others: members are packed into blocks, and a task
   compares a pair of blocks as matrices, first by registers (same likelihood), then, for the
   members that are left, by full sets.  It returns links only, at most one for each member,
   partner component and pair of blocks; no list of pairs exists anywhere.

Components are labelled by alternating large-star and small-star steps on the links; the
links stay in Spark, and each step is written to the shared folder.

Defined cases: a null text is empty; rows of one doc_id are one name (component_id is the
smallest doc_id of the component); a null doc_id takes part, is never the smallest, and is
kept only if the whole component has none other; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import map_batches, rows_per_batch, written
from kestrel.llm.text import buffers, mix, shingle_hashes, slices, word_hashes

REGISTERS = 128
ROWS = 4
BASE = 1.001
RATE = 20.0
LIMIT = 2**16 - 2
SURE = 8.0
#: members of a block: of registers, of full sets
BLOCK, SET_BLOCK = 256, 64
#: pairs of blocks that a worker holds at a time: of registers, of full sets
BATCH, SET_BATCH = 32, 4
#: edges of a task in the component steps
EDGES = 200_000

_MULT = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


# -- sets and sketches -------------------------------------------------------------------

def sets_of(col: pa.Array, k: int):
    """The sorted different shingle hashes of each text."""
    data, off = buffers(col)
    for i, j in slices(off):
        w, first = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
        h, begin = shingle_hashes(w, first, k)
        for d in range(j - i):
            yield np.unique(h[begin[d] : begin[d + 1]])


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, whatever the order of its elements."""
    with np.errstate(over="ignore"):
        a = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))
        b = mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64) + np.uint64(len(s))
    return tuple(mix(np.array([a, b])).view(np.int64).tolist())


def registers(s: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of uniform 64-bit hashes."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for at in range(0, len(s), 4096):
        np.minimum(low, (s[at : at + 4096, None] * _MULT).min(0), out=low)
    e = -np.log1p(-(low.astype(float) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(e, 1e-300)) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def bands(regs: np.ndarray) -> np.ndarray:
    """Band hashes (sketches x bands) of register rows."""
    r = regs.reshape(len(regs), -1, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, r.shape[1] + 1, dtype=np.uint64), r.shape[:2])
    for k in range(ROWS):
        h = mix(h * np.uint64(0xA0761D6478BD642F) + r[:, :, k])
    return h.view(np.int64)


def possible(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Joint estimate: whether a similarity of ``least`` or more is not much less likely
    than the best one, given how many registers of a are larger and smaller than b's."""
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    equal = REGISTERS - more - less

    def loglik(j):
        a, b = p(u - v * j), p(v - u * j)
        return more * np.log(a) + less * np.log(b) + equal * np.log(np.maximum(1 - a - b, 1e-12))

    best, high = np.full(len(top), -np.inf), np.full(len(top), -np.inf)
    for share in np.linspace(0, 1, 21):
        best = np.maximum(best, loglik(share * top))
        # the part from the threshold to the largest similarity that the sizes allow
        high = np.maximum(high, loglik(np.maximum(top, least) - share * np.maximum(top - least, 0)))
    return (top >= least - 1e-12) & (high >= best - SURE)


def _matrix(col: pa.Array, width: int, kind) -> np.ndarray:
    data = col.buffers()[2]
    off = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(kind).reshape(len(col), width)


def _sets(col: pa.Array):
    """The sets of a binary column, as views of its buffer."""
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    off = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4)
    for i in range(len(col)):
        yield data[off[i] : off[i + 1]].view(np.uint64)


# -- connected components ----------------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node in ``links`` (a, b): comp is the smallest node reachable.

    Each step deals its edges once by ``a``: the smallest neighbour and the join with it need
    no further shuffle.  The number of tasks follows the number of edges, however many
    partitions a shuffle of the session has."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    while True:
        tasks = max(1, -(-2 * mark[0] // EDGES))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks).repartition("a")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").coalesce(tasks).repartition("a")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks).union(
            low.select("a", F.col("m").alias("b")).coalesce(tasks))
        edges = written(small.where("a != b").distinct().coalesce(tasks), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


# -- crossings ---------------------------------------------------------------------------

def _blocks(rows: DataFrame, size: int, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """Members of each bucket in blocks: those outside its largest component, and all."""
    blocks = rows.withColumn("blk", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / size)))

    def packed(df, name):
        return df.groupBy("band", "blk").agg(F.collect_list(F.struct("node", "comp", *payload)).alias(name)).select("band", name)

    return packed(blocks.where("comp != largest"), "few"), packed(blocks, "all")


def _cross(rows: DataFrame, size: int, payload: list[str], fn, schema: str) -> DataFrame:
    few, everyone = _blocks(rows, size, payload)
    # rows are wide, so a skewed band may be split into far more tasks than there is work for
    most = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = few.join(everyone, "band").coalesce(most)

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                out = fn(b.column("few")[k].values, b.column("all")[k].values, b.column("band")[k].as_py())
                if out is not None and out.num_rows:
                    yield out

    return joined.mapInArrow(run, schema)


def _crossing(least: float):
    """Pairs of different components that meet in this bucket first and may be linked."""

    def pairs(x: pa.StructArray, y: pa.StructArray, band: int) -> np.ndarray:
        f = lambda s, c: s.field(c).to_numpy(zero_copy_only=False)
        rx, ry = (_matrix(s.field("sketch"), REGISTERS, np.uint16) for s in (x, y))
        nx, ny = f(x, "n").astype(float), f(y, "n").astype(float)
        cx, cy = f(x, "comp"), f(y, "comp")
        bx, by = bands(rx), bands(ry)
        here = int(np.flatnonzero(bx[0] == band)[0])
        ok = (cx[:, None] != cy) & (np.minimum(nx[:, None], ny) >= least * np.maximum(nx[:, None], ny) * (1 - 1e-12))
        for k in range(here):  # an earlier band would have shown the pair
            ok &= bx[:, k, None] != by[:, k]
        i, j = np.nonzero(ok)
        keep = [np.zeros(0, np.int64)]
        for at in range(0, len(i), 1 << 14):
            ii, jj = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            more, less = (rx[ii] > ry[jj]).sum(1), (rx[ii] < ry[jj]).sum(1)
            keep.append(at + np.flatnonzero(possible(more, less, nx[ii], ny[jj], least)))
        k = np.concatenate(keep)
        return np.stack([i[k], j[k]], 1)

    return pairs


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    least = percent / 100
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(b):
        keys, nums, regs, ok, seen = [], [], [], [], {}
        for s in sets_of(b.column("text"), k):
            key = set_key(s)
            keys.append(key)
            nums.append(len(s))
            ok.append(len(s) > 0)
            if key not in seen:
                seen[key] = registers(s).tobytes()
            regs.append(seen[key])
        return {"doc_id": b.column("doc_id"), "n": np.array(nums, np.int64),
                "k1": pa.array([x[0] if o else None for x, o in zip(keys, ok, strict=True)], pa.int64()),
                "k2": pa.array([x[1] if o else None for x, o in zip(keys, ok, strict=True)], pa.int64()),
                "sketch": pa.array(regs, pa.binary())}

    rows = written(map_batches(docs, sketch, f"doc_id {kind}, n bigint, k1 bigint, k2 bigint, sketch binary"), "sets")
    nodes = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written: the ids stay

    def band_rows(b):
        h = bands(_matrix(b.column("sketch"), REGISTERS, np.uint16))
        return {"node": np.repeat(b.column("node").to_numpy(), h.shape[1]), "band": h.ravel()}

    banded = map_batches(nodes.select("node", "sketch"), band_rows, "node bigint, band bigint")
    buckets = banded.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("members")).where("members > 1")
    shared = written(banded.join(buckets, "band"), "shared")

    # full sets of the nodes that share a band with another
    active = shared.select("node").distinct().join(nodes, "node")
    source = docs.join(active, docs["doc_id"].eqNullSafe(F.col("rep"))).select("node", "k1", "k2", "n", "sketch", "text")

    def full(b):
        sets = list(sets_of(b.column("text"), k))
        own = list(zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), strict=True))
        keep = [i for i, s in enumerate(sets) if len(s) and set_key(s) == own[i]]  # a doc_id may have other rows
        at = pa.array(keep, pa.int64())
        return {"node": b.column("node").take(at), "n": b.column("n").take(at), "sketch": b.column("sketch").take(at),
                "set": pa.array([sets[i].tobytes() for i in keep], pa.binary())}

    full_sets = written(map_batches(source, full, "node bigint, n bigint, sketch binary, set binary").dropDuplicates(["node"]), "full-sets")

    # stars
    small = full_sets.select("node", "n", "sketch")
    pairs = shared.where("node != leader").select("leader", "node").distinct()
    pairs = pairs.join(small, "node").join(small.toDF("leader", "n2", "sketch2"), "leader")

    def likely(b):
        x, y = _matrix(b.column("sketch"), REGISTERS, np.uint16), _matrix(b.column("sketch2"), REGISTERS, np.uint16)
        ok = possible((x > y).sum(1), (x < y).sum(1), b.column("n").to_numpy().astype(float), b.column("n2").to_numpy().astype(float), least)
        return {"leader": b.column("leader").filter(pa.array(ok)), "node": b.column("node").filter(pa.array(ok))}

    pairs = map_batches(pairs, likely, "leader bigint, node bigint")
    whole = full_sets.select("node", "set")
    pairs = pairs.join(whole, "node").join(whole.toDF("leader", "set2"), "leader")

    def confirm(b):
        ok = [_linked(x, y, percent) for x, y in zip(_sets(b.column("set")), _sets(b.column("set2")), strict=True)]
        return {"a": b.column("node").filter(pa.array(ok, pa.bool_())), "b": b.column("leader").filter(pa.array(ok, pa.bool_()))}

    comp = components(map_batches(pairs, confirm, "a bigint, b bigint"))

    # crossings
    rows_in = shared.select("band", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    parts = rows_in.groupBy("band", "comp").agg(F.count("*").alias("c"))
    parts = parts.groupBy("band").agg(F.max_by("comp", F.struct("c", "comp")).alias("largest"), F.sum("c").alias("members"), F.count("*").alias("comps")).where("comps > 1")
    mixed = written(rows_in.join(parts, "band").drop("comps"), "mixed")
    pairs_of = _crossing(least)

    def candidates(x, y, band):
        p = pairs_of(x, y, band)
        node = np.unique(np.concatenate([x.field("node").to_numpy()[p[:, 0]], y.field("node").to_numpy()[p[:, 1]]]))
        return pa.RecordBatch.from_pydict({"band": np.full(len(node), band), "node": node})

    with rows_per_batch(docs.sparkSession, BATCH):
        left = written(_cross(mixed.join(small, "node"), BLOCK, ["n", "sketch"], candidates, "band bigint, node bigint").distinct(), "crossing")
    left = mixed.join(left, ["band", "node"])

    def links(x, y, band):
        sx, sy = (list(_sets(s.field("set"))) for s in (x, y))
        vx, vy, cy = x.field("node").to_numpy(), y.field("node").to_numpy(), y.field("comp").to_numpy()
        out, done = [], set()
        for i, j in pairs_of(x, y, band).tolist():
            if (i, cy[j]) not in done and _linked(sx[i], sy[j], percent):
                done.add((i, cy[j]))
                out.append((vx[i], vy[j]))
        return pa.RecordBatch.from_pydict({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    with rows_per_batch(docs.sparkSession, SET_BATCH):
        crossed = written(_cross(left.join(full_sets, "node"), SET_BLOCK, ["n", "sketch", "set"], links, "a bigint, b bigint"), "crossed")
    known = comp.where("node != comp").toDF("a", "b")  # stars already, so this closes in few steps
    comp = components(known.union(crossed))

    # names
    named = nodes.select("k1", "k2", "node", "rep").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least_id = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(least_id, "comp").select("k1", "k2", "component_id")
    got = rows.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    name = F.when(F.col("k1").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return got.select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"), F.col("doc_id").eqNullSafe(name).alias("kept"))


NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) = 1 THEN w
        ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
      JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON c.a = doc_id
"""
