"""Exact top-k inner products by columnar branch and bound.

Vectors become integers, floor(256 * x), and are packed into blocks in vertical layout (one
row of a block's matrix per dimension, in the smallest integers that hold it).  A block of
queries meets a block of candidates: the products are accumulated ``STEP`` dimensions at a time,
and after a step a pair survives only if its partial product plus the product of the remaining
lengths (Cauchy-Schwarz: the remaining mass) can still reach the query's k-th best lower
bound; candidate columns in which no query of the group survives are compacted away.  The
bound starts from the k-th best score that the task has already completed for the query.  A step
that lately dropped few columns is tried on one group of ``RETRY`` only; the others add its dimensions
to the next.  Completed scores are exact, so the result is exact.

Candidates are dealt to slots and queries to parts, each of about ``SIDE_BYTES`` at most, however
large the table is; a task takes one slot and one part, holds the part and its best k so far,
and streams the slot's blocks.  So a candidate goes to every part and a query to every
slot, and no task, join buffer or batch grows with the table.  The queries are a stated share of
the rows; nothing is broadcast.

Defined cases: rows whose id or vector is null, or whose vector holds a null or non-finite
component, take no part; vectors meet only vectors of their own length; a row is no candidate
of a query with the same id; equal scores order by the smaller id; a repeated query row is one
query; of rows that share an id but not a vector, queries are merged under that id (the best
scores of either count).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEP = 16
QUERY_BLOCK = 512
BLOCK = 4096
GROUP = 32
#: a step is left out where it drops less than this share of the columns, but for one group of RETRY
WORTH, RETRY = 0.1, 16
#: largest block, and largest slot of candidates or part of queries, counted as 8 bytes a component
BLOCK_BYTES, SIDE_BYTES = 2 << 20, 32 << 20
#: slots of fewer bytes are not made for the sake of more tasks
LEAST_BYTES = 4 << 20
#: what :func:`_packed` gathers before it gives out blocks that are not full
HELD_BYTES = 32 << 20
#: score of an empty place
NONE = np.iinfo(np.int64).min


def quantised(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    x = F.col("x")
    df = df.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    df = df.where(F.col("id").isNotNull() & x.isNotNull()).where(fine)
    return df.select("id", F.transform(x, lambda v: F.floor(v * 256).cast("bigint")).alias("v"), F.size(x).alias("dim"))


def _packed(df: DataFrame, size: int) -> DataFrame:
    """Blocks (dim, ids, matrix): one row per dimension, little-endian integers of the smallest width
    that holds the block."""

    def run(batches):
        held: dict[int, list] = {}
        kept = 0

        def block(dim, rows):
            ids = np.concatenate([r[0] for r in rows])
            m = np.concatenate([r[1] for r in rows])
            most = max(1, min(size, BLOCK_BYTES // (8 * max(dim, 1))))
            for at in range(0, len(ids), most):
                part = m[at : at + most]
                lo, hi = (int(part.min()), int(part.max())) if part.size else (0, 0)
                kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max)
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": pa.array([ids[at : at + most].tobytes()], pa.binary()),
                                                  "matrix": pa.array([np.ascontiguousarray(part.T.astype(kind)).tobytes()], pa.binary())})

        for b in batches:
            dims = b.column("dim").to_numpy()
            col, ids = b.column("v"), b.column("id").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                m = col.take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim)
                held.setdefault(dim, []).append((ids[at], m))
                kept += m.nbytes + 8 * len(at)
                if sum(len(r[0]) for r in held[dim]) >= size:
                    kept -= sum(r[1].nbytes + 8 * len(r[0]) for r in held[dim])
                    yield from block(dim, held.pop(dim))
            if kept > HELD_BYTES:
                for dim in list(held):
                    yield from block(dim, held.pop(dim))
                kept = 0
        for dim, rows in held.items():
            yield from block(dim, rows)

    return df.mapInArrow(run, "dim int, ids binary, matrix binary")


def _matrix(m, dim: int, n: int) -> np.ndarray:
    """The matrix of a block of ``n`` vectors; vectors without components get one that is zero."""
    if not dim:
        return np.zeros((1, n), np.int8)
    return np.frombuffer(m, f"<i{m.size // (dim * n)}").reshape(dim, n)


def _suffix(m: np.ndarray) -> np.ndarray:
    """Lengths of what remains after each step, per column."""
    sq = np.cumsum((m.astype(float) ** 2)[::-1], axis=0)[::-1]
    return np.sqrt(np.vstack([sq, np.zeros(m.shape[1])])[np.minimum(np.arange(STEP, len(m) + STEP, STEP), len(m))])


class Block:
    """Vectors of one length in vertical layout, with what every meeting needs of them."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        self.ids, self.m, self.rest = ids, m, _suffix(m)
        self.top = max(-int(m.min(initial=0)), int(m.max(initial=0)))
        self.order = np.argsort(ids, kind="stable")
        self._as: dict = {}

    def as_kind(self, kind) -> np.ndarray:
        if kind not in self._as:
            self._as[kind] = self.m.astype(kind)
        return self._as[kind]

    def places(self, ids: np.ndarray):
        """(i, j): own vector j has the id ``ids[i]``."""
        there = self.ids[self.order]
        lo, hi = np.searchsorted(there, ids), np.searchsorted(there, ids, side="right")
        i = np.repeat(np.arange(len(ids)), hi - lo)
        return i, self.order[np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)]


class Queries:
    """A block of queries with the k best candidates each has met, best first."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, k: int):
        self.block, self.k = Block(ids, m), k
        self.score = np.full((len(ids), k), NONE)
        self.who = np.zeros((len(ids), k), np.int64)

    def found(self) -> dict:
        i, j = np.nonzero(self.score > NONE)
        return {"query_id": self.block.ids[i], "vec_id": self.who[i, j], "score": self.score[i, j]}

    def take(self, at: int, i: np.ndarray, who: np.ndarray, score: np.ndarray) -> None:
        """Adds scores of the group that starts at ``at`` to its best."""
        n = len(self.score[at : at + GROUP])
        i = np.concatenate([np.repeat(np.arange(n), self.k), i])
        score = np.concatenate([self.score[at : at + n].ravel(), score])
        who = np.concatenate([self.who[at : at + n].ravel(), who])
        there = np.flatnonzero(score > NONE)
        order = there[np.lexsort((who[there], -score[there], i[there]))]
        row = i[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        order, row, rank = order[rank < self.k], row[rank < self.k], rank[rank < self.k]
        self.score[at + row, rank], self.who[at + row, rank] = score[order], who[order]


def meet(qs: Queries, x: Block, gain: np.ndarray) -> None:
    """Gives each query its best of ``x``.  ``gain``: the share of columns that each step dropped lately."""
    q, k = qs.block, qs.k
    bound, dim = len(q.m) * q.top * x.top, len(q.m)
    kind = np.float32 if bound < 2**23 else np.float64 if bound < 2**52 else np.int64  # floats hold these sums exactly
    exact = kind is not np.int64  # beyond doubles nothing is pruned
    none = -np.inf if exact else NONE
    qm, xm = q.m.astype(kind), x.as_kind(kind)
    rest_q, rest_x = ((r * (1 + 1e-6)).astype(np.float32 if kind is np.float32 else np.float64) for r in (q.rest, x.rest))
    own_i, own_j = x.places(q.ids)
    last = len(rest_q) - 1
    for g, at in enumerate(range(0, qm.shape[1], GROUP)):
        now = slice(at, at + GROUP)
        floor = qs.score[now, -1]
        low = np.where(floor == NONE, none, floor.astype(kind))
        i, j = (c[slice(*np.searchsorted(own_i, [at, at + GROUP]))] for c in (own_i, own_j))
        i, live, done, part = i - at, None, 0, None
        left = xm
        for s in range(last + 1):
            end = min((s + 1) * STEP, dim)
            if s < last and not (exact and (gain[s] >= WORTH or g % RETRY == 0)):
                continue
            add = qm[done:end, now].T @ left[done:end]
            part, done = add if part is None else part + add, end
            if s == last:
                break
            slack = rest_q[s, now][:, None] * (rest_x[s] if live is None else rest_x[s][live])
            if np.isneginf(low).any() and part.shape[1] > k + len(i):
                least = part - slack - 2  # a float32 sum is off by less than 2
                least[i, _at(live, j)] = -np.inf
                low = np.maximum(low, np.partition(least, -k, axis=1)[:, -k])
            keep = (part + slack >= low[:, None] - 2).any(0)
            gain[s] += (1 - keep.mean() - gain[s]) / 4 if len(keep) else 0
            if keep.mean() < 0.8 if len(keep) else False:
                live = np.flatnonzero(keep) if live is None else live[keep]
                part, left = part[:, keep], left[:, keep]
                there = np.isin(j, live)
                i, j = i[there], j[there]
        part[i, _at(live, j)] = none
        first = low == none
        if first.any() and part.shape[1] > k:
            low = np.where(first, np.partition(part, -k, axis=1)[:, -k], low)
        i, j = np.nonzero(part >= low[:, None])
        score = part[i, j]
        i, j, score = i[score != none], (j if live is None else live[j])[score != none], score[score != none].astype(np.int64)
        who = x.ids[j]
        better = (score > floor[i]) | (who < qs.who[now, -1][i])  # of equal scores the smaller id
        if better.any():
            qs.take(at, i[better], who[better], score[better])


def _at(live: np.ndarray | None, j: np.ndarray) -> np.ndarray:
    """Places of the columns ``j`` among those that live."""
    return j if live is None else np.searchsorted(live, j)


def top_k(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for each row whose id is divisible
    by ``every``."""
    spark = vectors.sparkSession
    rows = quantised(vectors, vec_id, vector)
    chosen = F.col(vec_id).cast("bigint") % every == 0
    size = (F.size(F.col(vector)) + F.lit(1)).cast("bigint") * 8
    x_bytes, q_bytes = (n or 0 for n in vectors.where(F.col(vector).isNotNull()).agg(F.sum(size), F.sum(F.when(chosen, size))).first())
    slots = max(1, -(-x_bytes // SIDE_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-x_bytes // LEAST_BYTES)))
    parts = max(1, -(-q_bytes // SIDE_BYTES))

    def dealt(df, n, copies, query):
        mine, every_other = F.pmod(F.xxhash64("ids", "matrix"), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        slot, part = (every_other, mine) if query else (mine, every_other)
        df = df.select("dim", "ids", "matrix", slot.alias("slot"), part.alias("part"))
        return df.select((F.col("part") * slots + F.col("slot")).alias("place"), "dim", F.lit(not query).alias("candidates"), "ids", "matrix")

    queries = dealt(_packed(rows.where(F.col("id") % every == 0).distinct(), QUERY_BLOCK), parts, slots, True)
    blocks = dealt(_packed(rows, BLOCK), slots, parts, False)
    # one task a place, its queries first; the sort spills where memory is short
    met = queries.unionByName(blocks).repartitionById(slots * parts, "place").sortWithinPartitions("place", "dim", "candidates")

    def run(batches):
        at, held, gain = None, [], None
        for b in batches:
            place, dims, candidates = (b.column(c).to_pylist() for c in ("place", "dim", "candidates"))
            for n, dim in enumerate(dims):
                if (place[n], dim) != at:
                    yield from (pa.RecordBatch.from_pydict(q.found()) for q in held)
                    at, held, gain = (place[n], dim), [], np.ones(-(-max(dim, 1) // STEP))
                if candidates[n] and not held:
                    continue
                ids = np.frombuffer(b.column("ids")[n].as_buffer(), np.int64)
                m = _matrix(b.column("matrix")[n].as_buffer(), dim, len(ids))
                if not candidates[n]:
                    held.append(Queries(ids.copy(), m.copy(), k))
                    continue
                x = Block(ids, m)
                for q in held:
                    meet(q, x, gain)
        yield from (pa.RecordBatch.from_pydict(q.found()) for q in held)

    found = met.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOPK_SQL = """
WITH v AS (SELECT vec_id AS id, [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id % 50 = 0 AND c.id <> q.id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
