"""Cross-validation from fold vectors, with label noise in the training folds (E-4, T-8).

A row is written once, with its fold of every repeat as an array; ranks are taken over narrow
(row id, class, repeat) records only.  Counting and scoring explode the array inside a
task, where partial sums follow at once, so no copy of a row's attributes is ever
shuffled or written.

Where the declared domains allow few different tuples, the rows of a (repeat, fold) are added up by
tuple first (:meth:`FoldedData.cells`): counting and scoring then see weighted tuples, at
most domain x classes x repeats x folds of them, however many rows there are.

Noise.  The training set of (repeat, fold) is every row outside the fold; its first int(n rate)
rows by md5(seed + repeat | row id) get another class, as :func:`prep.label_noise` draws it.
Where those rows end is one threshold key for each training set, found from a histogram of
keys and an exact quantile inside the one bucket that holds it.  A row below every threshold of
its repeat is counted with its new class; a row between thresholds is counted as it is and sends
signed corrections (one less in the old cell, one more in the new) to the training sets that flip
it.  All training sets of all repeats thus come from one counting pass.

Integer row ids (the usual case) are hashed in batches (:mod:`kestrel.functions.md5`) and travel in blocks
of many, not as a record a repeat: a task ranks the ids of one key range of one repeat, and
the folds go back to the rows by a hash of the id.  Where the tuples of all folds fit ``DENSE_BYTES``, a task adds
up its rows in arrays over them.  Other ids and domains take the same steps as Spark expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.arrays import MAX_LITERAL_CELLS, const_doubles
from kestrel.functions.hashing import h, h_int
from kestrel.functions.md5 import keys, texts
from kestrel.operators import bayes as B
from kestrel.operators.bayes_join import predict
from kestrel.operators.counts import BROADCAST_MAP_LIMIT, _collapse_pays, collapse, complement_counts, count_families, valid_codes
from kestrel.operators.evaluate import fold_accuracy, mean_std
from kestrel.operators.folds import BUCKET_HEX_DIGITS, with_repeats
from kestrel.operators.quantile import exact_quantiles
from kestrel.sources.model_io import scratch_path
from kestrel.sources.nominal import NominalData

NOISE_SEED = 100
#: hex digits of the noise key (52 bits, exact in a double) and of its bucket
KEY_DIGITS, KEY_BUCKET = 13, 3
#: rows that a task gathers before it works on them, ids that are ranked together (about), and folds
#: (rows x repeats) that are put to their rows together (about)
RUN_ROWS, RANK_ROWS, DEAL_CELLS = 1 << 17, 1 << 19, 2_500_000
#: arrays over the tuples of all folds in one task
DENSE_BYTES = 64 << 20


@dataclass(frozen=True)
class FoldedData:
    """Rows with ``folds array<int>``: the fold of each repeat."""

    data: NominalData
    repeats: int
    folds: int

    @property
    def n_groups(self) -> int:
        return self.repeats * self.folds

    def exploded(self) -> DataFrame:
        """One record a repeat, made inside the task: (row..., rep, fold, g)."""
        df = self.data.df.select("*", F.posexplode("folds").alias("rep", "fold")).drop("folds")
        return df.withColumn("g", (F.col("rep") * self.folds + F.col("fold")).cast("int"))

    @property
    def dense(self) -> bool:
        """Do sums of all tuples of all folds, with and without corrections, fit one task?"""
        return _collapse_pays(self.data, ()) and self.data.n_classes * int(np.prod(self.data.cards, dtype=object)) * self.n_groups * 16 <= DENSE_BYTES

    @cached_property
    def cells(self) -> NominalData | None:
        """The exploded rows as weighted tuples (rep, fold, g, attributes, class, weight), written once; None
        where the domain is too large for this to pay."""
        if not _collapse_pays(self.data, ()):
            return None
        if self.dense:
            few = tuple_sums(self)
            few = few.with_df(few.df.drop("direct").withColumn("g", (F.col("rep") * self.folds + F.col("fold")).cast("int")))
        else:
            few = collapse(self.data.with_df(self.exploded()), ("rep", "fold", "g"))
        path = scratch_path(few.df.sparkSession, "fold-cells")
        few.df.write.parquet(path)
        return few.with_df(few.df.sparkSession.read.schema(few.df.schema).parquet(path))


def fold_vectors(data: NominalData, repeats: int = 10, folds: int = 10, seed: int = 1) -> FoldedData:
    """E-1 folds of every repeat as one array a row, written once to the shared folder.  ``rid`` names
    a row.  The folds are those of :func:`folds.interleaved_folds` with repeats."""
    rid, cls = data.rid, data.cls
    if _integer(data.df, rid) and _integer(data.df, cls):
        path = scratch_path(data.df.sparkSession, "fold-rows")
        data.df.write.parquet(path)
        data = data.with_df(data.df.sparkSession.read.schema(data.df.schema).parquet(path))
        # a text without an id, and a class that is missing, are left to the expressions below
        if not data.df.where(F.col(rid).isNull() | F.col(cls).isNull()).limit(1).count():
            return _written_vectors(data, _dealt_in_blocks(data, repeats, folds, seed), repeats, folds)
    key = h(F.col("rep") + F.lit(seed), F.col(rid))
    narrow = with_repeats(data.df.select(rid, cls), repeats).withColumn("_b", F.substring(key, 1, BUCKET_HEX_DIGITS))
    sizes = narrow.groupBy("rep", cls, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("rep").orderBy(cls, "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("rep", cls, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    if repeats * data.n_classes * 16**BUCKET_HEX_DIGITS <= BROADCAST_MAP_LIMIT:
        offsets = F.broadcast(offsets)
    # the key is made again behind the shuffle, so records stay narrow
    dealt = narrow.repartition("rep", cls, "_b")
    inner = Window.partitionBy("_b", "rep", cls).orderBy(key, rid)
    ranked = dealt.withColumn("_r", F.row_number().over(inner) - 1).join(offsets, ["rep", cls, "_b"])
    fold = ((F.col("_off") + F.col("_r")) % folds).cast("bigint")
    # several repeats share one number, a digit each
    per = max(1, int(62 / np.log2(max(folds, 2))))
    words = [F.sum(F.when((F.col("rep") >= lo) & (F.col("rep") < lo + per), fold * F.element_at(F.array(*[F.lit(folds**i).cast("bigint") for i in range(per)]), F.col("rep") - lo + 1)).otherwise(0)).alias(f"_w{lo}")
             for lo in range(0, repeats, per)]
    vectors = ranked.groupBy(rid).agg(*words)
    digits = [F.expr(f"cast((_w{r // per * per} div {folds ** (r % per)}L) % {folds} as int)") for r in range(repeats)]
    vectors = vectors.select(rid, F.array(*digits).alias("folds"))
    return _written_vectors(data, data.df.join(vectors, rid), repeats, folds)


def _written_vectors(data: NominalData, rows: DataFrame, repeats: int, folds: int) -> FoldedData:
    path = scratch_path(rows.sparkSession, "fold-vectors")
    rows.write.parquet(path)
    return FoldedData(data.with_df(rows.sparkSession.read.schema(rows.schema).parquet(path)), repeats, folds)


def _integer(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _runs(batches):
    """The batches as tables of about ``RUN_ROWS`` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= RUN_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _ints(table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64, copy=False)


def _fold_matrix(table, repeats: int) -> np.ndarray:
    return table.column("folds").combine_chunks().flatten().to_numpy().reshape(-1, repeats)


def _narrow(a: np.ndarray) -> bytes:
    return a.astype("<i4" if not len(a) or (a.min() >= -(2**31) and a.max() < 2**31) else "<i8").tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{len(raw) // n}").astype(np.int64)


def _split(place: np.ndarray, n: int):
    """Order of rows by place, and where each of the ``n`` places begins and ends."""
    order = np.argsort(place.astype(np.uint16) if n <= 2**16 else place, kind="stable")
    ends = np.cumsum(np.bincount(place, minlength=n))
    return order, np.concatenate([[0], ends])


def _spread(ids: np.ndarray, n: int) -> np.ndarray:
    """A place of ``n`` for each id; as :func:`_spread_column`."""
    u = ids.astype(np.uint64)
    return ((u ^ (u >> np.uint64(7)) ^ (u >> np.uint64(21))) & np.uint64(2**62 - 1)).astype(np.int64) % n


def _spread_column(c: Column, n: int) -> Column:
    c = c.cast("bigint")
    mixed = c.bitwiseXOR(F.shiftrightunsigned(c, 7)).bitwiseXOR(F.shiftrightunsigned(c, 21)).bitwiseAND(F.lit(2**62 - 1))
    return (mixed % n).cast("int")


def _dealt_in_blocks(data: NominalData, repeats: int, folds: int, seed: int) -> DataFrame:
    """The rows with ``folds``.  Ids go in blocks to the task of their (repeat, key range), which ranks them; their folds go in blocks
    to the task of a hash of the id, where the rows are."""
    spark, df, rid, cls = data.df.sparkSession, data.df, data.rid, data.cls
    n = df.count()
    bits = min(16, max(0, -(-n // RANK_ROWS) - 1).bit_length())
    ranges = 1 << bits
    places = max(1, -(-n * repeats // DEAL_CELLS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * repeats // (DEAL_CELLS // 5))))
    narrow = df.select(F.col(rid).cast("bigint").alias("rid"), F.col(cls).cast("bigint").alias("cls"))

    def of(key):
        return (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)

    def counted(batches):
        total: dict[int, np.ndarray] = {}
        for t in _runs(batches):
            text, (kinds, kind) = texts(_ints(t, "rid")), np.unique(_ints(t, "cls"), return_inverse=True)
            sums = np.stack([np.bincount(kind * ranges + of(keys(f"{rep + seed}|", text)), minlength=len(kinds) * ranges) for rep in range(repeats)])
            for i, c in enumerate(kinds.tolist()):
                total[c] = total.get(c, 0) + sums[:, i * ranges : (i + 1) * ranges]
        for c, sums in total.items():
            rep, at = np.nonzero(sums)
            yield pa.RecordBatch.from_pydict({"cls": np.full(len(rep), c), "rep": rep, "at": at, "n": sums[rep, at]})

    # (repeat, range, class): where its ranks begin
    sizes = (narrow if bits else narrow.groupBy("cls").agg(F.count(F.lit(1)).alias("n")))
    begin: dict[tuple, int] = {}
    run = [0] * repeats
    if bits:
        sizes = sizes.mapInArrow(counted, "cls bigint, rep bigint, at bigint, n bigint").groupBy("cls", "at", "rep").agg(F.sum("n").alias("n"))
    else:
        sizes = sizes.select("cls", F.lit(0).alias("at"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep"), "n")
    for c, at, rep, size in sorted(tuple(r) for r in sizes.collect()):
        begin[rep, at, c] = run[rep] % folds
        run[rep] += size

    def sent(batches):
        for t in _runs(batches):
            ids, kind = _ints(t, "rid"), _ints(t, "cls")
            text = texts(ids)
            for rep in range(repeats):
                order, ends = _split(of(keys(f"{rep + seed}|", text)), ranges)
                there = np.flatnonzero(np.diff(ends))
                cuts = [order[ends[r] : ends[r + 1]] for r in there]
                yield pa.RecordBatch.from_pydict({"place": pa.array(rep * ranges + there, pa.int32()), "n": pa.array([len(c) for c in cuts], pa.int32()),
                                                  "ids": pa.array([_narrow(ids[c]) for c in cuts], pa.binary()), "cls": pa.array([_narrow(kind[c]) for c in cuts], pa.binary())})

    def ranked(batches):
        held: dict[int, list] = {}
        for b in batches:
            for place, size, ids, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(place, []).append((_wide(ids, size), _wide(kind, size)))
        for place in list(held):
            parts = held.pop(place)
            rep, at = divmod(place, ranges)
            ids, (kinds, kind) = np.concatenate([i for i, _ in parts]), np.unique(np.concatenate([c for _, c in parts]), return_inverse=True)
            kind = kind.astype(np.uint16) if len(kinds) <= 2**16 else kind
            key = keys(f"{rep + seed}|", texts(ids))
            order = np.argsort(key)
            order = order[np.argsort(kind[order], kind="stable")]
            _settle(ids, key, kind, order, f"{rep + seed}|")
            first = np.searchsorted(kind[order], np.arange(len(kinds)))
            start = np.array([begin[rep, at, c] for c in kinds.tolist()]) - first
            fold = np.empty(len(ids), np.int64)
            fold[order] = (np.arange(len(ids)) + start[kind[order]]) % folds
            order, ends = _split(_spread(ids, places), places)
            there = np.flatnonzero(np.diff(ends))
            cuts = [order[ends[p] : ends[p + 1]] for p in there]
            yield pa.RecordBatch.from_pydict({"_place": pa.array(there, pa.int32()), "_rep": pa.array([rep] * len(there), pa.int32()), "_n": pa.array([len(c) for c in cuts], pa.int32()),
                                              "_ids": pa.array([_narrow(ids[c]) for c in cuts], pa.binary()), "_folds": pa.array([_narrow(fold[c]) for c in cuts], pa.binary())})

    back = "_place int, _rep int, _n int, _ids binary, _folds binary"
    blocks = narrow.mapInArrow(sent, "place int, n int, ids binary, cls binary").repartitionById(repeats * ranges, "place").mapInArrow(ranked, back)
    rows = df.select(_spread_column(F.col(rid), places).alias("_place"), F.struct(*[F.col(c) for c in df.columns]).alias("_row"))
    met = rows.unionByName(blocks, allowMissingColumns=True).repartitionById(places, "_place")

    def put(batches):
        own, folded = [], [([], []) for _ in range(repeats)]
        for b in batches:
            row = b.column("_ids").is_null()
            own.append(pa.RecordBatch.from_struct_array(b.column("_row").filter(row)))
            sent_back = b.select(["_rep", "_n", "_ids", "_folds"]).filter(pc.invert(row))
            for rep, size, ids, fold in zip(*(c.to_pylist() for c in sent_back.columns), strict=True):
                folded[rep][0].append(_wide(ids, size))
                folded[rep][1].append(_wide(fold, size).astype(np.int32))
        own = [b for b in own if b.num_rows]
        if not own:
            return
        t = pa.Table.from_batches(own).combine_chunks()
        ids = _ints(t, rid)
        order = np.argsort(ids, kind="stable")
        matrix = np.empty((len(ids), repeats), np.int32)
        for rep in range(repeats):
            theirs, fold = (np.concatenate(c) for c in folded[rep])
            folded[rep] = None
            at = np.argsort(theirs, kind="stable")
            if not np.array_equal(theirs[at], ids[order]):
                raise ValueError("rows and folds do not meet by their ids")
            matrix[order, rep] = fold[at]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, repeats), pa.int32()), pa.array(matrix.ravel()))
        yield from t.append_column("folds", lists).to_batches(max_chunksize=1 << 16)

    return met.mapInArrow(put, T.StructType([*df.schema.fields, T.StructField("folds", T.ArrayType(T.IntegerType()))]))


def _settle(ids: np.ndarray, key: np.ndarray, kind: np.ndarray, order: np.ndarray, prefix: str) -> None:
    """Orders rows whose first 64 bits and class are equal by their whole key, then by id."""
    k, c = key[order], kind[order]
    same = np.concatenate([[False], (k[1:] == k[:-1]) & (c[1:] == c[:-1]), [False]])
    begins, ends = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:]) + 1
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        order[a:b] = sorted(order[a:b].tolist(), key=lambda i: (hashlib.md5(f"{prefix}{ids[i]}".encode()).hexdigest(), ids[i]))


def _summed(parts: DataFrame, n: int, emit, schema: str) -> DataFrame:
    """Adds up the arrays of (place int, direct boolean, sums binary) that tasks made and gives ``emit`` each sum."""

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            for place, direct, raw in zip(b.column("place").to_pylist(), b.column("direct").to_pylist(), b.column("sums"), strict=True):
                more = np.frombuffer(raw.as_buffer(), np.float64)
                held[place, direct] = held[place, direct] + more if (place, direct) in held else more.copy()
        for (place, direct), sums in held.items():
            yield pa.RecordBatch.from_pydict(emit(place, direct, sums))

    return parts.repartitionById(n, "place").mapInArrow(run, schema)


def _sums_batch(place, direct, sums):
    return pa.RecordBatch.from_pydict({"place": pa.array(place, pa.int32()), "direct": pa.array(direct, pa.bool_()), "sums": pa.array([s.tobytes() for s in sums], pa.binary())})


def _noise_keys(rep: int, text) -> np.ndarray:
    """As :func:`noise_key`, whole numbers below 2**52."""
    return (keys(f"{rep + NOISE_SEED}|", text) >> np.uint64(64 - 4 * KEY_DIGITS)).astype(np.int64)


def tuple_sums(fv: FoldedData, cut: np.ndarray | None = None) -> NominalData:
    """(rep, fold, direct, attributes, class, weight): the exploded rows as weighted tuples.  With ``cut``, rows below every threshold of
    their repeat have their new class, and signed corrections are ``direct`` (see the head of this module)."""
    data, repeats, folds, k = fv.data, fv.repeats, fv.folds, fv.data.n_classes
    named = [*zip(data.attrs, data.cards, strict=True), (data.cls, k)]
    code, size = F.lit(0).cast("bigint"), 1
    for name, card in named:
        code, size = code * card + F.col(name), size * card
    rows = data.df.where(valid_codes(data)).select(*([F.col(data.rid).cast("bigint").alias("rid")] if cut is not None else []), code.alias("code"), "folds",
                                                   *([data.w().alias("w")] if data.weight else []))
    weighted = data.weight is not None

    def run(batches):
        sums = np.zeros((2, repeats * folds, size))
        for t in _runs(batches):
            old, fold = _ints(t, "code"), _fold_matrix(t, repeats)
            w = np.nan_to_num(t.column("w").to_numpy(zero_copy_only=False).astype(float)) if weighted else None
            text = texts(_ints(t, "rid")) if cut is not None else None
            for rep in range(repeats):
                now, of = old, fold[:, rep].astype(np.int64)
                if cut is not None:
                    key = _noise_keys(rep, text)
                    at = np.flatnonzero(key <= cut[rep].max())
                    key, was = key[at], old[at]
                    drawn = (keys(f"{rep + NOISE_SEED}|c|", (text[0][at], text[1][at])) >> np.uint64(36)).astype(np.int64)
                    new = was - was % k + (was % k + 1 + drawn % (k - 1)) % k
                    everywhere = key <= cut[rep].min()
                    now = old.copy()
                    now[at[everywhere]] = new[everywhere]
                    at, key, was, new = at[~everywhere], key[~everywhere], was[~everywhere], new[~everywhere]
                    for f in range(folds):
                        flips = (key <= cut[rep, f]) & (of[at] != f)
                        more = w[at[flips]] if weighted else 1.0
                        np.subtract.at(sums[1, rep * folds + f], was[flips], more)
                        np.add.at(sums[1, rep * folds + f], new[flips], more)
                sums[0, rep * folds : (rep + 1) * folds] += np.bincount(of * size + now, w, folds * size).reshape(folds, size)
        for direct in (False, True):
            some = np.flatnonzero(sums[int(direct)].any(1))
            for place in some.tolist():
                yield _sums_batch([place], [direct], [sums[int(direct), place]])

    def emit(place, direct, sums):
        at = np.flatnonzero(sums)
        rep, fold = divmod(place, folds)
        return {"rep": pa.array([rep] * len(at), pa.int32()), "fold": pa.array([fold] * len(at), pa.int32()), "direct": pa.array([direct] * len(at), pa.bool_()), "_t": at, "weight": sums[at]}

    spark = data.df.sparkSession
    parts = rows.mapInArrow(run, "place int, direct boolean, sums binary")
    few = _summed(parts, min(fv.n_groups, int(spark.conf.get("spark.sql.shuffle.partitions"))), emit, "rep int, fold int, direct boolean, _t bigint, weight double")
    stride, cols = 1, []
    for name, card in reversed(named):
        cols.insert(0, F.expr(f"cast((_t div {stride}L) % {card}L as int)").alias(name))
        stride *= card
    return NominalData(few.select("rep", "fold", "direct", *cols, "weight"), data.attrs, data.cards, k, cls=data.cls, weight="weight")


def noise_key(rep: Column, rid: str) -> Column:
    return F.conv(F.substring(h(rep + F.lit(NOISE_SEED), F.col(rid)), 1, KEY_DIGITS), 16, 10).cast("double")


def noise_thresholds(fv: FoldedData, rate: float) -> np.ndarray:
    """repeats x folds: rows of the training set whose key is at most this are flipped."""
    if rate > 0.5:
        raise ValueError("Noise rate can not larger than 0.5")
    width = 16.0 ** (KEY_DIGITS - KEY_BUCKET)
    # at most repeats x folds x 4096 sums
    hist = np.zeros((fv.repeats, fv.folds, 16**KEY_BUCKET))
    in_batches = _integer(fv.data.df, fv.data.rid)
    if in_batches:
        rows = fv.data.df.where(F.col(fv.data.rid).isNotNull()).select(F.col(fv.data.rid).cast("bigint").alias("rid"), "folds")
        for r in _key_sums(rows, fv.repeats, fv.folds).toLocalIterator():
            hist[r.place] = np.frombuffer(r.sums).reshape(fv.folds, -1)
    else:
        rows = fv.exploded().select("rep", "fold", noise_key(F.col("rep"), fv.data.rid).alias("key"))
        rows = rows.withColumn("b", F.floor(F.col("key") / width).cast("int"))
        sums = rows.groupBy("rep", "fold", "b").count().toArrow()
        hist[tuple(sums[c].to_numpy() for c in ("rep", "fold", "b"))] = sums["count"].to_numpy()
    train = hist.sum(1, keepdims=True) - hist
    want = np.floor(train.sum(2) * rate)
    run = train.cumsum(2)
    bucket = (run < want[:, :, None]).sum(2).clip(max=16**KEY_BUCKET - 1)
    left = want - np.where(bucket > 0, np.take_along_axis(run, np.maximum(bucket - 1, 0)[:, :, None], 2)[:, :, 0], 0)
    found = bucket * width - 1.0  # nobody of the bucket
    at = [(int(r), int(f), int(bucket[r, f])) for r in range(fv.repeats) for f in range(fv.folds) if left[r, f] > 0]
    if at:
        if in_batches:
            edge = _edge_keys(rows, at, fv.repeats).persist()
        else:
            cut = rows.sparkSession.createDataFrame(at, "rep int, f int, b int")
            edge = rows.join(F.broadcast(cut), ["rep", "b"]).where(F.col("fold") != F.col("f")).select("rep", "f", "key").persist()
        for r in exact_quantiles(edge, F.col("key"), lambda k, _: float(left[k[0], k[1]]), ["rep", "f"]).collect():
            found[r["rep"], r["f"]] = r["lower"]
        edge.unpersist()
    return found


def _key_sums(rows: DataFrame, repeats: int, folds: int) -> DataFrame:
    """(place, sums): rows of each fold and bucket of noise keys, a record a repeat."""
    buckets = 16**KEY_BUCKET

    def run(batches):
        sums = np.zeros((repeats, folds * buckets))
        for t in _runs(batches):
            text, fold = texts(_ints(t, "rid")), _fold_matrix(t, repeats)
            for rep in range(repeats):
                b = _noise_keys(rep, text) >> (4 * (KEY_DIGITS - KEY_BUCKET))
                sums[rep] += np.bincount(fold[:, rep].astype(np.int64) * buckets + b, minlength=folds * buckets)
        for rep in range(repeats):
            yield _sums_batch([rep], [False], [sums[rep]])

    return _summed(rows.mapInArrow(run, "place int, direct boolean, sums binary"), repeats,
                   lambda place, _, sums: {"place": pa.array([place], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())}, "place int, sums binary")


def _edge_keys(rows: DataFrame, at: list[tuple], repeats: int) -> DataFrame:
    """(rep, f, key): the keys of each training set that lie in its bucket."""

    def run(batches):
        for t in _runs(batches):
            text, fold = texts(_ints(t, "rid")), _fold_matrix(t, repeats)
            for rep in range(repeats):
                mine = [(f, b) for r, f, b in at if r == rep]
                if not mine:
                    continue
                key = _noise_keys(rep, text)
                bucket = key >> (4 * (KEY_DIGITS - KEY_BUCKET))
                near = np.flatnonzero(np.isin(bucket, [b for _, b in mine]))
                for f, b in mine:
                    got = near[(bucket[near] == b) & (fold[near, rep] != f)]
                    yield pa.RecordBatch.from_pydict({"rep": pa.array([rep] * len(got), pa.int32()), "f": pa.array([f] * len(got), pa.int32()), "key": key[got].astype(float)})

    return rows.mapInArrow(run, "rep int, f int, key double")


def training_counts(fv: FoldedData, spec: B.BayesSpec, noise: float = 0.0) -> DataFrame:
    """(rep, fold, component, att, cls, pidx, v, n, g): counts of every training set, one pass."""
    data, comp_fams = fv.data, [(tid, t.family) for tid, t in enumerate(spec.tables)]
    rows = fv.exploded()
    if noise <= 0:
        part = count_families(fv.cells or data.with_df(rows), comp_fams, keys=("rep", "fold"))
        return _grouped(complement_counts(part, "fold", fv.folds, keys=("rep",)), fv)
    if data.n_classes < 2:
        raise ValueError("label noise needs at least two classes")
    cut = noise_thresholds(fv, noise)
    if fv.dense and _integer(data.df, data.rid):
        signed = collapse(tuple_sums(fv, cut), ("rep", "fold", "direct"), checked=True)
    else:
        signed = _signed_rows(fv, cut)
    part = count_families(signed, comp_fams, keys=("rep", "fold", "direct")).persist()
    base = complement_counts(part.where("not direct").drop("direct"), "fold", fv.folds, keys=("rep",))
    cell = ["rep", "fold", "component", "att", "cls", "pidx", "v"]
    both = base.select(*cell, "n").unionByName(part.where("direct").select(*cell, "n"))
    return _grouped(both.groupBy(*cell).agg(F.sum("n").alias("n")).where("n <> 0"), fv)


def _signed_rows(fv: FoldedData, cut: np.ndarray) -> NominalData:
    """Rows with their class of the training sets and signed corrections, as Spark expressions."""
    data, rows = fv.data, fv.exploded()
    key, w = noise_key(F.col("rep"), data.rid), data.w()
    seed = F.col("rep") + F.lit(NOISE_SEED)
    old = F.col(data.cls).cast("int")
    new = ((old + 1 + h_int(seed, "c", F.col(data.rid)) % (data.n_classes - 1)) % data.n_classes).cast("int")
    all_cuts = const_doubles(cut.ravel())
    low, high = F.element_at(const_doubles(cut.min(1)), F.col("rep") + 1), F.element_at(const_doubles(cut.max(1)), F.col("rep") + 1)
    everywhere = F.col("_key") <= low
    some = ~everywhere & (F.col("_key") <= high)
    # a new class lies in the domain where the old one does
    keyed = rows.where(valid_codes(data)).withColumn("_key", key)
    once = keyed.select(*data.attrs, "rep", F.col("fold").cast("int").alias("fold"), F.when(everywhere, new).otherwise(old).alias("_c"), w.alias("_w"), F.lit(False).alias("direct"))
    # only the few rows between thresholds go through arrays
    flips = F.filter(F.sequence(F.lit(0), F.lit(fv.folds - 1)), lambda f: (f != F.col("fold")) & (F.col("_key") <= F.element_at(all_cuts, (F.col("rep") * fv.folds + f + 1).cast("int"))))
    change = F.flatten(F.transform(flips, lambda f: F.array(
        F.struct(f.alias("fold"), old.alias("_c"), (-w).alias("_w"), F.lit(True).alias("direct")),
        F.struct(f.alias("fold"), F.col("_new").alias("_c"), w.alias("_w"), F.lit(True).alias("direct")))))
    between = keyed.where(some).withColumn("_new", new).withColumn("_e", change).select(*data.attrs, "rep", F.inline("_e"))
    emitted = once.unionByName(between)
    signed = NominalData(emitted, data.attrs, data.cards, data.n_classes, cls="_c", weight="_w")
    if _collapse_pays(data, ()):
        signed = collapse(signed, ("rep", "fold", "direct"), checked=True)
    return signed


def _grouped(counts: DataFrame, fv: FoldedData) -> DataFrame:
    return counts.withColumn("g", (F.col("rep") * fv.folds + F.col("fold")).cast("int"))


def cv_accuracy(fv: FoldedData, spec_fn: Callable[[NominalData], B.BayesSpec], noise: float = 0.0, limit: int = MAX_LITERAL_CELLS) -> DataFrame:
    """(rep, fold, accuracy): every row predicted, in every repeat, by the model that was trained
    without its fold (and with label noise in its training set); tested on its true class."""
    data, spec = fv.data, spec_fn(fv.data)
    counts = training_counts(fv, spec, noise)
    few = fv.cells
    tested = few or data.with_df(fv.exploded())
    of_row = (*data.attrs,) if few else (data.rid,)
    keep = ("rep", "fold", *of_row, data.cls, *([tested.weight] if tested.weight else []))
    scored = predict(tested.df, tested, spec, counts, group_col="g", n_groups=fv.n_groups, keep=keep, limit=limit)
    scored = scored.withColumn("weight", tested.w())
    return fold_accuracy(scored, data.cls)


def cv_summary(fv: FoldedData, spec_fn, name: str, noise: float = 0.0, limit: int = MAX_LITERAL_CELLS) -> DataFrame:
    """(model, acc_mean, acc_std) over all folds of all repeats."""
    return mean_std(cv_accuracy(fv, spec_fn, noise, limit), "accuracy").select(F.lit(name).alias("model"), "acc_mean", "acc_std")
