"""C-1 .. C-5: conditional-count tables — the distributed core of the Bayes side.

One operator, :func:`count_families`, covers every count the classifiers need.  A
*family* is ``(att, parents)``: the child attribute and its attribute parents (the
class is always part of the key).  A row contributes ``weight`` to the cell

    (family, cls, pidx, v)   with  v = x[att],  pidx = fold(code*card(p) + x[p])

over the parents in ascending order (mixed-radix parent code, P-3).  Naive Bayes,
A1DE/A2DE super-parent counts and random-network CPTs are different family lists over
the same aggregation.

Plan shape: scan -> project -> [partial/final HashAggregate of identical tuples, when
the declared tuple domain is small] -> Generate(inline: one struct per distinct
family) -> partial HashAggregate -> Exchange(hash on the cell key) -> final
HashAggregate -> broadcast join to the (family -> component) map.  The partial aggregate is the
in-mapper combiner: per task the hash table holds at most the number of distinct
cells, which is bounded by the model (sum over families of K * S * card), not by
the data; a hot cell is collapsed map-side before the shuffle.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.sources.nominal import NominalData

COUNT_COLUMNS = ("component", "att", "cls", "pidx", "v", "n")
# Above this many distinct families the per-family expressions (generated code grows
# with the family count) are replaced by vectorised per-batch partial counts.
EXPLICIT_FAMILY_LIMIT = 400
ARROW_FAMILY_CHUNK = 256            # families per index matrix inside a batch
BINCOUNT_LIMIT = 1 << 24            # dense per-batch accumulator size (cells)
# Largest (component, family) map that is broadcast; it is model metadata whose
# size is known on the driver before any job runs.
BROADCAST_MAP_LIMIT = 1_000_000
# Tuple domains (product of cardinalities x classes) up to this size are collapsed to
# weighted distinct tuples before the family explode.
COLLAPSE_DOMAIN_LIMIT = 1 << 20


@dataclass(frozen=True)
class Family:
    att: int                      # child attribute; d = the class node; -1 = class counts
    parents: tuple[int, ...]      # attribute parents, ascending (class excluded)
    class_parent: bool = True     # is the class among the parents (always, except B-3)


def families_from_structure(rows, d: int) -> list[tuple[int, Family]]:
    """(component, Family) pairs from structure rows ``(component, att, parents)``;
    the class index ``d`` inside ``parents`` becomes the ``class_parent`` flag."""
    out = []
    for r in rows:
        comp, att, parents = int(r[0]), int(r[1]), [int(p) for p in r[2]]
        out.append((comp, Family(att, tuple(sorted(p for p in parents if p != d)), d in parents)))
    return out


def collect_structure(structure: DataFrame, limit: int = BROADCAST_MAP_LIMIT) -> list[tuple]:
    """Bring a structure table (model metadata, size = components x nodes) to the
    driver, refusing anything larger than ``limit`` rows."""
    rows = structure.select("component", "att", "parents").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"structure table has more than {limit} rows")
    return sorted((r[0], r[1], list(r[2])) for r in rows)


def _radix(data: NominalData, parents: tuple[int, ...]) -> Column:
    if not parents:
        return F.lit(0).cast("bigint")
    code = data.x(parents[0]).cast("bigint")
    for p in parents[1:]:
        code = code * data.cards[p] + data.x(p)
    return code


def _child(data: NominalData, att: int) -> Column:
    if att < 0:
        return F.lit(0)
    if att == data.d:
        return F.col(data.cls)
    return data.x(att)


def _explicit_cells(data: NominalData, fams: list[Family], class_digit: bool) -> Column:
    structs = []
    for fid, f in enumerate(fams):
        pidx = _radix(data, f.parents)
        if class_digit and f.class_parent and f.att >= 0:
            pidx = pidx * data.n_classes + F.col(data.cls)
        structs.append(F.struct(F.lit(fid).alias("fid"), pidx.alias("pidx"),
                                _child(data, f.att).cast("int").alias("v")))
    return F.inline_outer(F.array(*structs))


def _literal_families(fams: list[Family], d: int) -> Column:
    payload = json.dumps([{"fid": i, "att": (f.att if f.att >= 0 else d + 1), "parents": list(f.parents),
                           "cp": bool(f.class_parent and f.att >= 0)} for i, f in enumerate(fams)])
    return F.from_json(F.lit(payload), "array<struct<fid:int,att:int,parents:array<int>,cp:boolean>>")


def _arrow_cells(data: NominalData, df: DataFrame, w: Column, fams: list[Family], keys: tuple[str, ...],
                 class_digit: bool) -> DataFrame:
    """Per-batch partial counts for wide models (many families): every Arrow batch is
    reduced to its non-zero cells with one ``np.bincount`` over (family offset + cell)
    codes — the reference mapper's in-memory combining, vectorised — and Spark sums
    the partial cells of all batches.  Families are processed in chunks so the
    per-batch index matrix stays bounded."""
    import pandas as pd

    d, k = data.d, data.n_classes
    cards = np.array(list(data.cards) + [k, 1], dtype=np.int64)      # d = class, d+1 = constant
    att_ix = np.array([f.att if f.att >= 0 else d + 1 for f in fams], dtype=np.int64)
    card_f = cards[att_ix]
    digit = np.array([bool(class_digit and f.class_parent and f.att >= 0) for f in fams])
    s_f = np.array([int(np.prod(cards[list(f.parents)])) if f.parents else 1 for f in fams], dtype=np.int64)
    s_f = np.where(digit, s_f * k, s_f)
    size_f = k * s_f * card_f
    off_f = np.concatenate([[0], np.cumsum(size_f)[:-1]])
    total = int(size_f.sum())
    chunks = []
    by_np: dict[int, list[int]] = {}
    for i, f in enumerate(fams):
        by_np.setdefault(len(f.parents), []).append(i)
    for npar, ids in by_np.items():
        for a in range(0, len(ids), ARROW_FAMILY_CHUNK):
            sel = np.array(ids[a:a + ARROW_FAMILY_CHUNK])
            par = np.array([fams[i].parents for i in sel], dtype=np.int64).reshape(len(sel), npar)
            mult = np.ones_like(par)
            for j in range(npar - 2, -1, -1):
                mult[:, j] = mult[:, j + 1] * cards[par[:, j + 1]]
            chunks.append((sel, par, mult))
    attrs = list(data.attrs)

    def run(batches):
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            x = np.zeros((n, d + 2), dtype=np.int64)
            x[:, :d] = pdf[attrs].to_numpy(dtype=np.int64)
            x[:, d] = pdf["_cls"].to_numpy(dtype=np.int64)
            cls = x[:, d]
            wt = pdf["_w"].to_numpy(dtype=float)
            if keys:
                kidx, kuniq = pd.MultiIndex.from_frame(pdf[list(keys)]).factorize()
            else:
                kidx, kuniq = np.zeros(n, dtype=np.int64), None
            nk = int(kidx.max()) + 1
            acc = {}
            for sel, par, mult in chunks:
                pidx = (x[:, par] * mult[None, :, :]).sum(axis=2) if par.shape[1] else np.zeros((n, len(sel)), np.int64)
                pidx = np.where(digit[sel][None, :], pidx * k + cls[:, None], pidx)
                code = off_f[sel][None, :] + (cls[:, None] * s_f[sel][None, :] + pidx) * card_f[sel][None, :] \
                    + x[:, att_ix[sel]]
                flat = (kidx[:, None] * total + code).ravel()
                ww = np.repeat(wt, len(sel))
                if nk * total <= BINCOUNT_LIMIT:
                    cnt = np.bincount(flat, weights=ww, minlength=nk * total)
                    nz = np.nonzero(cnt)[0]
                    for u, c in zip(nz, cnt[nz]):
                        acc[u] = acc.get(u, 0.0) + c
                else:
                    uq, inv = np.unique(flat, return_inverse=True)
                    cnt = np.bincount(inv, weights=ww)
                    for u, c in zip(uq, cnt):
                        acc[u] = acc.get(u, 0.0) + c
            if not acc:
                continue
            u = np.fromiter(acc.keys(), dtype=np.int64, count=len(acc))
            c = np.fromiter(acc.values(), dtype=float, count=len(acc))
            kk, local = u // total, u % total
            fid = np.searchsorted(off_f, local, side="right") - 1
            rest = local - off_f[fid]
            v = rest % card_f[fid]
            t = rest // card_f[fid]
            out = pd.DataFrame()
            if keys:
                kv = kuniq[kk]
                for j, name in enumerate(keys):
                    out[name] = [row[j] for row in kv]
            out["fid"] = fid.astype(np.int32)
            out["cls"] = (t // s_f[fid]).astype(np.int32)
            out["pidx"] = t % s_f[fid]
            out["v"] = v.astype(np.int32)
            out["n"] = c
            yield out

    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{c} {fields[c]}" for c in keys] +
                       ["fid int", "cls int", "pidx bigint", "v int", "n double"])
    src = df.select(*keys, *attrs, F.col(data.cls).cast("int").alias("_cls"), w.alias("_w"))
    part = src.mapInPandas(run, schema)
    return part.groupBy(*keys, "fid", "cls", "pidx", "v").agg(F.sum("n").alias("n"))


def _hof_cells(data: NominalData, fams: list[Family], class_digit: bool) -> Column:
    """One higher-order expression for any number of families: x and cards are arrays,
    the family list is a constant-folded literal."""
    x = F.array(*[data.x(i) for i in range(data.d)], F.col(data.cls), F.lit(0))
    cards = F.array(*[F.lit(c) for c in data.cards], F.lit(data.n_classes), F.lit(1))
    k = data.n_classes

    def cell(f):
        pidx = F.aggregate(f["parents"], F.lit(0).cast("bigint"), lambda acc, p: acc * F.element_at(cards, p + 1)
                           + F.element_at(x, p + 1))
        if class_digit:
            pidx = F.when(f["cp"], pidx * k + F.col(data.cls)).otherwise(pidx)
        return F.struct(f["fid"].alias("fid"), pidx.alias("pidx"), F.element_at(x, f["att"] + 1).alias("v"))

    return F.inline_outer(F.transform(_literal_families(fams, data.d), cell))


def _collapse_pays(data: NominalData, keys: tuple[str, ...]) -> bool:
    """Collapsing identical tuples first is a sure win when the tuple domain — known
    from the declared cardinalities — is small: the map-side partial aggregate then
    holds at most that many rows per task, and the family explode runs on distinct
    tuples only."""
    if keys:
        return False
    size = data.n_classes
    for c in data.cards:
        size *= c
        if size > COLLAPSE_DOMAIN_LIMIT:
            return False
    return True


def valid_codes(data: NominalData) -> Column:
    """True for a row whose codes all lie in their declared domains; fails the job at any
    other row (a NULL or an out-of-range code), alike for every counting path."""
    bad = F.lit(None).cast("string")
    for name, card in [(data.cls, data.n_classes), *zip(data.attrs, data.cards, strict=True)]:
        c = F.col(name)
        bad = F.when(c.isNull(), F.lit(f"missing value is unsupported: {name}")).when(
            (c < 0) | (c >= card), F.concat(F.lit(f"code out of range: {name} = "), c.cast("string"))).otherwise(bad)
    return F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(True)


def _check_radix(data: NominalData, fams: list[Family], class_digit: bool) -> None:
    """Parent codes are BIGINT; a family whose codes (times class and child, as the batch
    counter numbers its cells) do not fit is refused before any job runs."""
    total = 0
    for f in fams:
        size = data.n_classes * max(data.n_classes, *data.cards, 1)
        for p in f.parents:
            size *= data.cards[p]
        total += size * (data.n_classes if class_digit else 1)
    if total >= 2**62:
        raise ValueError("parent codes exceed 64 bits")


def collapse(data: NominalData, keys: tuple[str, ...] = (), checked: bool = False) -> NominalData:
    """Rows of equal ``keys``, attributes and class as one row with the sum of their weights.  They are
    grouped by the mixed-radix code of the tuple, so a task's partial sums hold two or three
    numbers a tuple.  The row id is lost.  ``checked`` rows had their codes checked before (a class that
    is made from keys would be made again for the check)."""
    named = [*zip(data.attrs, data.cards, strict=True), (data.cls, data.n_classes)]
    code = F.lit(0).cast("bigint")
    for name, card in named:
        code = code * card + F.col(name)
    few = (data.df if checked else data.df.where(valid_codes(data))).groupBy(*keys, code.alias("_t")).agg(F.sum(data.w()).cast("double").alias("weight"))
    stride, cols = 1, []
    for name, card in reversed(named):
        cols.insert(0, F.expr(f"cast((_t div {stride}L) % {card}L as int)").alias(name))
        stride *= card
    return NominalData(few.select(*keys, *cols, "weight"), data.attrs, data.cards, data.n_classes, cls=data.cls, weight="weight")


def count_cells(data: NominalData, fams: list[Family], *, keys: tuple[str, ...] = (),
                include_class_digit: bool = False, collapse_duplicates: bool | str = "auto",
                hof: bool = False) -> DataFrame:
    """Cells of the distinct families: (keys..., fid, cls, pidx, v, n).

    Up to ``EXPLICIT_FAMILY_LIMIT`` families: codegen'd structs + Generate + hash
    aggregate.  Above: vectorised per-batch partial counts (``hof=True`` keeps it in
    the JVM with higher-order functions, much slower per cell)."""
    _check_radix(data, fams, include_class_digit)
    df = data.df.where(valid_codes(data))
    w = data.w()
    if collapse_duplicates == "auto":
        collapse_duplicates = _collapse_pays(data, keys)
    if collapse_duplicates:
        # identical tuples first (wins when the tuple domain is small); one extra shuffle
        df = df.groupBy(*keys, *data.attrs, data.cls).agg(F.sum(w).alias("_w"))
        w = F.col("_w")
    if len(fams) > EXPLICIT_FAMILY_LIMIT and not hof:
        return _arrow_cells(data, df, w, fams, keys, include_class_digit)
    gen = (_explicit_cells if len(fams) <= EXPLICIT_FAMILY_LIMIT else _hof_cells)(
        data, fams, include_class_digit)
    exploded = df.select(*keys, F.col(data.cls).cast("int").alias("_cls"), w.alias("_w"), gen)
    return (exploded.groupBy(*keys, "fid", "_cls", "pidx", "v").agg(F.sum("_w").alias("n"))
            .withColumnRenamed("_cls", "cls"))


def count_families(data: NominalData, comp_fams: list[tuple[int, Family]], *,
                   keys: tuple[str, ...] = (), include_class_digit: bool = False,
                   collapse_duplicates: bool | str = "auto") -> DataFrame:
    """C-1 / C-5: ``(keys..., component, att, cls, pidx, v, n)`` sparse count table.

    Families shared by several components are counted once and fanned out after the
    aggregation through a broadcast join on the small (family -> component) map."""
    spark = data.df.sparkSession
    distinct: dict[Family, int] = {}
    for _, f in comp_fams:
        distinct.setdefault(f, len(distinct))
    fams = list(distinct)
    cells = count_cells(data, fams, keys=keys, include_class_digit=include_class_digit,
                        collapse_duplicates=collapse_duplicates)
    fmap = spark.createDataFrame([(distinct[f], c, f.att) for c, f in comp_fams],
                                 "fid INT, component INT, att INT")
    fmap = F.broadcast(fmap) if len(comp_fams) <= BROADCAST_MAP_LIMIT else fmap
    return cells.join(fmap, "fid").select(*keys, *COUNT_COLUMNS)


def count_structure(data: NominalData, structure: DataFrame, **kw) -> DataFrame:
    """C-1 (flagship): CPT counts of every component of a structure table."""
    rows = collect_structure(structure)
    return count_families(data, families_from_structure(rows, data.d), **kw)


def merge_counts(*tables: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """C-2: element-wise sum of count tables (combiner / reducer; incremental training)."""
    u = tables[0]
    for t in tables[1:]:
        u = u.unionByName(t)
    key = [*keys, "component", "att", "cls", "pidx", "v"]
    return u.groupBy(*key).agg(F.sum("n").alias("n"))


def complement_counts(part: DataFrame, fold_col: str, n_folds: int,
                      keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts of all rows *outside* each fold, from per-fold counts, without recounting
    and without a join: every per-fold cell is sent to the other ``n_folds - 1`` folds
    and summed.  (keys..., fold, component, att, cls, pidx, v, n) -> same schema where
    ``n`` is the training count of the fold (the E-4 total - fold identity).  The input
    is model-sized (cells x folds), so the fan-out is small."""
    cell = ["component", "att", "cls", "pidx", "v"]
    others = F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda f: f != F.col(fold_col))
    fanned = part.select(*keys, F.explode(others).alias("_f"), *cell, "n")
    return (fanned.groupBy(*keys, "_f", *cell).agg(F.sum("n").alias("n"))
            .withColumnRenamed("_f", fold_col))


def class_counts(data: NominalData, keys: tuple[str, ...] = ()) -> DataFrame:
    """C-3: (keys..., cls, n) — the true class counts (emitted once, not per component)."""
    return data.df.groupBy(*keys, F.col(data.cls).cast("int").alias("cls")).agg(F.sum(data.w()).alias("n"))


def superparent_counts(data: NominalData, n_dep: int = 1) -> DataFrame:
    """C-4: F(c, s) per super-parent set s (n_dep = 1 or 2) and its value code:
    (sp ARRAY<INT>, code, cls, n); F(s) is the sum over cls."""
    comp_fams = anDE_families(data.d, n_dep)
    prior = [(c, f) for c, f in comp_fams if f.att < data.d and _is_prior(c, f, data.d, n_dep)]
    counts = count_families(data, prior)
    sets = _superparent_sets(data.d, n_dep)
    sp = F.element_at(F.array(*[F.array(*[F.lit(a) for a in s]) for s in sets]), F.col("component") + 1)
    card = F.element_at(F.array(*[F.lit(data.cards[s[-1]]) for s in sets]), F.col("component") + 1)
    return counts.select(sp.alias("sp"), (F.col("pidx") * card + F.col("v")).alias("code"), "cls", "n")


# --------------------------------------------------------------------- family lists
def _superparent_sets(d: int, n_dep: int) -> list[tuple[int, ...]]:
    if n_dep == 0:
        return [()]
    if n_dep == 1:
        return [(s,) for s in range(d)]
    if n_dep == 2:
        return [(a, b) for a in range(d) for b in range(a + 1, d)]
    raise ValueError("n-dependence must be 0, 1 or 2")


def _is_prior(comp: int, f: Family, d: int, n_dep: int) -> bool:
    s = _superparent_sets(d, n_dep)[comp]
    return (n_dep == 0 and f.att == -1) or (n_dep > 0 and f.att == s[-1] and f.parents == s[:-1])


def anDE_families(d: int, n_dep: int) -> list[tuple[int, Family]]:
    """C-4 / C-5 families of an AnDE model: component = super-parent set (index into
    :func:`superparent_sets`).  Per component one *prior* family giving F(c, s) and
    one conditional family (a | s) per other attribute a.  n_dep = 0 is naive Bayes."""
    out = []
    for comp, s in enumerate(_superparent_sets(d, n_dep)):
        out.append((comp, Family(-1, ()) if not s else Family(s[-1], s[:-1])))
        for a in range(d):
            if a not in s:
                out.append((comp, Family(a, s)))
    return out


def superparent_sets(d: int, n_dep: int) -> list[tuple[int, ...]]:
    return _superparent_sets(d, n_dep)
