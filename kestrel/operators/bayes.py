"""Estimation and scoring of count-based Bayesian classifiers.

A-1 .. A-6  Laplace / m-estimate conditionals and joint priors, SPnDE components,
            A1DE / A2DE ensembles (and naive Bayes as A0DE, G-2)
B-4 .. B-6  random-network CPTs with pseudo-count alpha, component posteriors,
            ensemble with NaN components skipped
G-1         argmax prediction (first maximum wins)
P-6         super-parent frequency limit

Every model is a list of *log tables*; a table is one count family (C-1) turned into
``log((n + a0) / (sum + a0 * cells))`` over its dense domain, where the sum runs over
the child values (conditional tables) or over all cells (prior tables).

fit:   count_families (one distributed aggregation)  ->  dense domain per table from
       ``sequence`` (model-sized, no data)  ->  left join counts  ->  window sums
       -> log estimates.  The estimated model is bounded by the domain, checked
       *before* any job runs, and brought to the driver as one array.
score: one projection over the instances: every table lookup is ``element_at`` on
       the constant array; components are combined with log-sum-exp.  No join,
       no shuffle: the plan is scan -> project.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.functions.arrays import MAX_LITERAL_CELLS, argmax_first, const_doubles, const_ints
from kestrel.operators.counts import Family, count_families, superparent_sets
from kestrel.sources.nominal import NominalData

JOINT_SUM = "joint_sum"          # AnDE: P(c) ∝ Σ_components joint(c, s)
SOFTMAX_AVG = "softmax_avg"      # RBNC: average of per-component posteriors
NORM_SUM = "norm_sum"            # AnDE with normalised components (A-4 non-joint)


@dataclass(frozen=True)
class LogTable:
    component: int               # -1 for the shared class prior
    family: Family
    prior: bool                  # normalise over all cells (joint prior) or per parent code
    a0: float                    # pseudo-count added to every cell
    class_norm: bool = False     # class as the child: normalise over classes per parent code


@dataclass
class BayesSpec:
    attrs: tuple[str, ...]
    cards: tuple[int, ...]
    n_classes: int
    tables: list[LogTable]
    n_components: int
    combine: str
    limit: float | None = None   # AnDE: component used only if F(s) >= limit
    prior_of: dict[int, int] = field(default_factory=dict)   # component -> its prior table
    class_prior: int | None = None                            # table index of P(c)

    def sizes(self) -> list[tuple[int, int]]:
        """(S, card) of every table."""
        out = []
        for t in self.tables:
            s = int(np.prod([self.cards[p] for p in t.family.parents])) if t.family.parents else 1
            card = 1 if t.family.att < 0 else self.cards[t.family.att]
            out.append((s, card))
        return out

    def offsets(self) -> tuple[list[int], int]:
        offs, tot = [], 0
        for s, card in self.sizes():
            offs.append(tot)
            tot += self.n_classes * s * card
        return offs, tot


# ------------------------------------------------------------------ model specs
def ande_spec(data: NominalData, n_dep: int = 1, *, m_estimate: bool = False, m: float = 1.0,
              limit: float | None = 1.0, joint: bool = True) -> BayesSpec:
    """AnDE (n_dep = 1: A1DE/AODE, 2: A2DE, 0: naive Bayes).  Laplace estimates by
    default; ``m_estimate`` uses pseudo-counts m/card (conditionals) and m/(K·S) (prior)."""
    d, k = data.d, data.n_classes
    sets = superparent_sets(d, n_dep)
    tables: list[LogTable] = []
    prior_of = {}
    for comp, s in enumerate(sets):
        pf = Family(-1, ()) if not s else Family(s[-1], s[:-1])
        cells = k * int(np.prod([data.cards[a] for a in s])) if s else k
        prior_of[comp] = len(tables)
        tables.append(LogTable(comp, pf, True, (m / cells) if m_estimate else 1.0))
        for a in range(d):
            if a not in s:
                tables.append(LogTable(comp, Family(a, s), False, (m / data.cards[a]) if m_estimate else 1.0))
    class_prior = len(tables)
    tables.append(LogTable(-1, Family(-1, ()), True, 1.0))
    return BayesSpec(data.attrs, data.cards, k, tables, len(sets), JOINT_SUM if joint else NORM_SUM,
                     limit if n_dep > 0 else None, prior_of, class_prior)


def rbnc_spec(data: NominalData, structure_rows, alpha: float = 0.5) -> BayesSpec:
    """Random-network ensemble (B-4): every node's CPT with pseudo-count alpha.

    B-1 / B-2 structures (class a parent of every attribute): one conditional table
    per attribute, the class node is the shared prior (F(c)+alpha)/(N+alpha*K).
    B-3 structures (class anywhere): the class node's table P(c | its parents) is
    normalised over the classes; attributes with the class among their parents give
    conditional tables; the others do not depend on the class and cancel in the
    per-component normalisation, so they are left out."""
    d = data.d
    tables = []
    comps = sorted({int(r[0]) for r in structure_rows})
    index = {c: i for i, c in enumerate(comps)}
    free = any(int(att) != d and d not in [int(p) for p in parents] for _, att, parents in structure_rows)
    for comp, att, parents in structure_rows:
        ps = tuple(sorted(int(p) for p in parents if int(p) != d))
        if int(att) == d:
            if free:
                tables.append(LogTable(index[int(comp)], Family(-1, ps), False, alpha, class_norm=True))
            continue
        if d not in [int(p) for p in parents]:
            continue
        tables.append(LogTable(index[int(comp)], Family(int(att), ps), False, alpha))
    class_prior = None
    if not free:
        class_prior = len(tables)
        tables.append(LogTable(-1, Family(-1, ()), True, alpha))
    return BayesSpec(data.attrs, data.cards, data.n_classes, tables, len(comps), SOFTMAX_AVG,
                     None, {}, class_prior)


# ------------------------------------------------------------------------- fitting
@dataclass
class FittedBayes:
    spec: BayesSpec
    logtab: np.ndarray           # n_groups * size
    freq: np.ndarray             # same shape: F(parent code) summed over classes (prior tables)
    size: int                    # cells of one model
    n_groups: int


def _estimates(counts: DataFrame, spec: BayesSpec, n_groups: int, group_col: str | None) -> DataFrame:
    spark = counts.sparkSession
    k = spec.n_classes
    meta = [(tid, s, card, float(t.a0), bool(t.prior)) for tid, (t, (s, card)) in
            enumerate(zip(spec.tables, spec.sizes()))]
    tdf = spark.createDataFrame(meta, "tid INT, S INT, card INT, a0 DOUBLE, prior BOOLEAN")
    dense = (tdf.select("*", F.explode(F.sequence(F.lit(0), F.col("S") * F.col("card") * k - 1)).alias("idx"))
             .select("*", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("g"))
             .select("g", "tid", "S", "card", "a0", "prior", "idx",
                     (F.col("idx") / (F.col("S") * F.col("card"))).cast("int").alias("cls"),
                     ((F.col("idx") / F.col("card")).cast("int") % F.col("S")).alias("pidx"),
                     (F.col("idx") % F.col("card")).alias("v")))
    g = F.col(group_col).cast("int") if group_col else F.lit(0)
    cnt = counts.select(g.alias("g"), F.col("component").alias("tid"), "cls", "pidx", "v", "n")
    joined = dense.join(cnt, ["g", "tid", "cls", "pidx", "v"], "left").fillna(0.0, ["n"])
    per_parent = Window.partitionBy("g", "tid", "cls", "pidx")
    per_table = Window.partitionBy("g", "tid")
    per_value = Window.partitionBy("g", "tid", "pidx", "v")
    num = F.col("n") + F.col("a0")
    den = F.when(F.col("prior"), F.sum("n").over(per_table) + F.col("a0") * F.col("S") * F.col("card") * k) \
        .otherwise(F.sum("n").over(per_parent) + F.col("a0") * F.col("card"))
    logp = (F.when((num == 0) & (den == 0), F.lit(float("nan")))
            .when(num == 0, F.lit(float("-inf")))
            .otherwise(F.log(num / den)))
    return joined.select("g", "tid", "idx", logp.alias("logp"), F.sum("n").over(per_value).alias("freq"))


def _estimate_numpy(cnt, spec: BayesSpec, n_groups: int, size: int, offs: list[int]):
    """Log estimates of every table from the collected sparse counts (model-sized)."""
    k = spec.n_classes
    dense = np.zeros(size * n_groups)
    pos = (cnt["g"].to_numpy(dtype=np.int64) * size + np.asarray(offs, dtype=np.int64)[cnt["tid"].to_numpy()]
           + (cnt["cls"].to_numpy(dtype=np.int64) * 0))
    sizes = spec.sizes()
    s_arr = np.asarray([s for s, _ in sizes], dtype=np.int64)[cnt["tid"].to_numpy()]
    c_arr = np.asarray([c for _, c in sizes], dtype=np.int64)[cnt["tid"].to_numpy()]
    pos = pos + (cnt["cls"].to_numpy(dtype=np.int64) * s_arr + cnt["pidx"].to_numpy(dtype=np.int64)) * c_arr \
        + cnt["v"].to_numpy(dtype=np.int64)
    np.add.at(dense, pos, cnt["n"].to_numpy(dtype=float))
    logtab = np.empty_like(dense)
    freq = np.empty_like(dense)
    blocks = dense.reshape(n_groups, size)
    lt, fq = logtab.reshape(n_groups, size), freq.reshape(n_groups, size)
    for tid, (t, (s, card)) in enumerate(zip(spec.tables, sizes)):
        a, b = offs[tid], offs[tid] + k * s * card
        n = blocks[:, a:b].reshape(n_groups, k, s, card)
        if t.prior:
            den = n.sum(axis=(1, 2, 3), keepdims=True) + t.a0 * k * s * card
        elif t.class_norm:
            den = n.sum(axis=(1, 3), keepdims=True) + t.a0 * k * card
        else:
            den = n.sum(axis=3, keepdims=True) + t.a0 * card
        num = n + t.a0
        with np.errstate(divide="ignore", invalid="ignore"):
            val = np.where(num == 0, np.where(den == 0, np.nan, -np.inf), np.log(num / np.where(den == 0, 1, den)))
        lt[:, a:b] = val.reshape(n_groups, -1)
        fq[:, a:b] = np.broadcast_to(n.sum(axis=1, keepdims=True), n.shape).reshape(n_groups, -1)
    return logtab, freq


def fit(data: NominalData, spec: BayesSpec, *, group_col: str | None = None, n_groups: int = 1,
        counts: DataFrame | None = None, estimate_in_spark: bool = False) -> FittedBayes:
    """Count (one aggregation over the data) and estimate every table.  With
    ``group_col`` one model per group value 0..n_groups-1 is estimated from ``counts``
    (already keyed by that column, e.g. the training counts of each CV fold).

    The sparse count table is model-sized (at most ``size * n_groups`` cells, checked
    before any job runs); by default it is collected and turned into log estimates
    with NumPy, as Spark ML estimators do with their aggregated statistics.
    ``estimate_in_spark`` computes the same estimates as a DataFrame (dense domain
    from ``sequence``, left join, window sums) before collecting them."""
    offs, size = spec.offsets()
    if size * n_groups > MAX_LITERAL_CELLS:
        raise ValueError(f"model of {size * n_groups} cells exceeds {MAX_LITERAL_CELLS}")
    if counts is None:
        counts = count_families(data, [(tid, t.family) for tid, t in enumerate(spec.tables)],
                                keys=(group_col,) if group_col else ())
    if estimate_in_spark and any(t.class_norm for t in spec.tables):
        raise ValueError("class-normalised tables are estimated on the collected counts only")
    if not estimate_in_spark:
        g = F.col(group_col).cast("int") if group_col else F.lit(0)
        cnt = counts.select(g.alias("g"), F.col("component").alias("tid"), "cls", "pidx", "v", "n").toPandas()
        logtab, freq = _estimate_numpy(cnt, spec, n_groups, size, offs)
        return FittedBayes(spec, logtab, freq, size, n_groups)
    est = _estimates(counts, spec, n_groups, group_col).toPandas()
    logtab = np.empty(size * n_groups)
    freq = np.zeros(size * n_groups)
    pos = est["g"].to_numpy() * size + np.asarray(offs)[est["tid"].to_numpy()] + est["idx"].to_numpy()
    logtab[pos] = est["logp"].to_numpy()
    freq[pos] = est["freq"].to_numpy()
    return FittedBayes(spec, logtab, freq, size, n_groups)


# ------------------------------------------------------------------------- scoring
def _pidx(spec: BayesSpec, parents) -> Column:
    if not parents:
        return F.lit(0)
    code = F.col(spec.attrs[parents[0]])
    for p in parents[1:]:
        code = code * spec.cards[p] + F.col(spec.attrs[p])
    return code


def _base_index(spec: BayesSpec, tid: int, offs, base: Column) -> Column:
    """1-based position of the row's cell for class 0 in table ``tid``."""
    t = spec.tables[tid]
    _, card = spec.sizes()[tid]
    v = F.lit(0) if t.family.att < 0 else F.col(spec.attrs[t.family.att])
    return (base + offs[tid] + _pidx(spec, t.family.parents) * card + v + 1).cast("int")


def score_sql(df: DataFrame, model: FittedBayes, *, group_col: str | None = None,
              keep: tuple[str, ...] = ("rid",)) -> DataFrame:
    """Expression twin of :func:`score` (same output), JVM only.

    One codegen'd projection computes each table's cell position (integer radix
    arithmetic); the lookups and the log-sum-exp combination are higher-order array
    functions over constant arrays, so the generated code stays small whatever the
    number of tables."""
    spec = model.spec
    k = spec.n_classes
    offs, _ = spec.offsets()
    sizes = spec.sizes()
    tab = const_doubles(model.logtab)
    strides = const_ints([s * card for s, card in sizes])
    base = (F.col(group_col).cast("int") * model.size) if group_col else F.lit(0)
    by_comp: dict[int, list[int]] = {}
    for tid, t in enumerate(spec.tables):
        if t.component >= 0:
            by_comp.setdefault(t.component, []).append(tid)
    comps = sorted(by_comp)
    comp_tabs = F.from_json(F.lit(json.dumps([by_comp[c] for c in comps])), "array<array<int>>")
    classes = F.sequence(F.lit(0), F.lit(k - 1))
    ix = F.col("_ix")

    def cell(t, c):
        return F.element_at(tab, F.element_at(ix, t + 1) + c * F.element_at(strides, t + 1))

    cp_t = F.lit(spec.class_prior if spec.class_prior is not None else 0)
    has_cp = spec.class_prior is not None
    step = df.select(*keep, F.array(*[_base_index(spec, tid, offs, base) for tid in range(len(spec.tables))])
                     .alias("_ix"))
    cp = F.transform(classes, lambda c: cell(cp_t, c)) if has_cp else F.array_repeat(F.lit(0.0), k)
    init = (lambda c: cell(cp_t, c)) if (spec.combine == SOFTMAX_AVG and has_cp) else (lambda c: F.lit(0.0))
    # log score per component and class: [comp][c]
    lp = F.transform(comp_tabs, lambda ts: F.transform(
        classes, lambda c: F.aggregate(ts, init(c), lambda acc, t: acc + cell(t, c))))
    step = step.select(*keep, "_ix", lp.alias("_lp"), cp.alias("_cp"))
    lpc = F.col("_lp")
    cpc = F.col("_cp")
    prior_softmax = F.transform(cpc, lambda v: F.exp(v - F.array_max(cpc)) /
                                F.aggregate(cpc, F.lit(0.0), lambda a, y: a + F.exp(y - F.array_max(cpc))))
    if spec.combine == NORM_SUM:
        freq = const_doubles(model.freq)
        prior_tids = const_ints([spec.prior_of[c] for c in comps])
        limit = F.lit(float(spec.limit or 0.0))
        act = F.transform(prior_tids, lambda t: F.element_at(freq, F.element_at(ix, t + 1)) >= limit)
        post = F.transform(lpc, lambda row: F.transform(
            row, lambda l: F.exp(l - F.array_max(row)) /
            F.aggregate(row, F.lit(0.0), lambda a, y: a + F.exp(y - F.array_max(row)))))
        step = step.select(*keep, "_cp", F.zip_with(post, act, lambda p, a: F.when(a, p).otherwise(
            F.array_repeat(F.lit(0.0), k))).alias("_post"))
        raw = F.transform(classes, lambda c: F.aggregate(F.col("_post"), F.lit(0.0),
                                                          lambda acc, p: acc + F.element_at(p, c + 1)))
    elif spec.combine == JOINT_SUM:
        freq = const_doubles(model.freq)
        prior_tids = const_ints([spec.prior_of[c] for c in comps])
        limit = F.lit(float(spec.limit or 0.0))
        act = F.transform(prior_tids, lambda t: F.element_at(freq, F.element_at(ix, t + 1)) >= limit)
        ninf = F.lit(float("-inf"))
        masked = F.zip_with(lpc, act, lambda row, a: F.when(a, row).otherwise(F.array_repeat(ninf, k)))
        step = step.select(*keep, "_cp", masked.alias("_m")).select(
            *keep, "_cp", "_m", F.array_max(F.flatten("_m")).alias("_mx"))
        raw = F.transform(classes, lambda c: F.aggregate(
            F.col("_m"), F.lit(0.0), lambda acc, row: acc + F.coalesce(
                F.when(F.col("_mx") > ninf, F.exp(F.element_at(row, c + 1) - F.col("_mx"))), F.lit(0.0))))
    else:
        post = F.transform(lpc, lambda row: F.transform(
            row, lambda l: F.exp(l - F.array_max(row)) /
            F.aggregate(row, F.lit(0.0), lambda a, y: a + F.exp(y - F.array_max(row)))))
        valid = F.filter(post, lambda p: ~F.exists(p, lambda x: F.isnan(x)))
        raw = F.transform(classes, lambda c: F.aggregate(valid, F.lit(0.0),
                                                          lambda acc, p: acc + F.element_at(p, c + 1)))
    step = step.select(*keep, "_cp", raw.alias("_r"))
    tot = F.aggregate(F.col("_r"), F.lit(0.0), lambda a, y: a + y)
    probs = F.when(tot > 0, F.transform("_r", lambda r: r / tot)).otherwise(prior_softmax)
    out = step.select(*keep, probs.alias("probability"))
    return out.select(*keep, "probability", argmax_first(F.col("probability")).alias("prediction"))


def sum_cols(cols: list[Column]) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total


def long_probabilities(scored: DataFrame, keep: tuple[str, ...] = ("rid",), digits: int = 6) -> DataFrame:
    """(keep..., cls, prob) with probabilities rounded for cross-engine comparison."""
    return scored.select(*keep, F.posexplode_outer("probability").alias("cls", "prob")).select(
        *keep, F.col("cls").cast("int"), F.round("prob", digits).alias("prob"))


# --------------------------------------------------------------- Arrow fast path
DENSE_POSITION_LIMIT = 2_000_000     # d x tables above which positions are gathered
WIDE_ROWS_PER_SLICE = 20_000_000     # rows x tables per slice of a batch (index memory)


def _batch_scorer(model: FittedBayes, attrs: tuple[str, ...], group_col: str | None,
                  keep: tuple[str, ...]):
    """A numpy scorer closed over the (size-checked) model arrays.

    Cell positions of all tables are one integer matrix product ``X @ M`` (radix
    multipliers), lookups are fancy-indexing gathers, per-component sums are
    ``np.add.reduceat`` over tables grouped by component."""
    import pandas as pd

    spec = model.spec
    k = spec.n_classes
    d = len(attrs)
    offs, _ = spec.offsets()
    sizes = spec.sizes()
    comp_t = sorted((t.component, tid) for tid, t in enumerate(spec.tables) if t.component >= 0)
    order = [tid for _, tid in comp_t]
    comps = sorted({c for c, _ in comp_t})
    starts = np.searchsorted([c for c, _ in comp_t], comps)
    mult = np.zeros((d, len(order)), dtype=np.int64)
    const = np.zeros(len(order), dtype=np.int64)
    stride = np.zeros(len(order), dtype=np.int64)
    for j, tid in enumerate(order):
        t = spec.tables[tid]
        s, card = sizes[tid]
        m = card
        for p in reversed(t.family.parents):
            mult[p, j] += m
            m *= spec.cards[p]
        if t.family.att >= 0:
            mult[t.family.att, j] += 1
        const[j] = offs[tid]
        stride[j] = s * card
    has_cp = spec.class_prior is not None
    cp_off = offs[spec.class_prior] if has_cp else 0
    cp_stride = sizes[spec.class_prior][0] * sizes[spec.class_prior][1] if has_cp else 0
    prior_pos = {tid: j for j, tid in enumerate(order)}
    prior_cols = np.array([prior_pos[spec.prior_of[c]] for c in comps]) if spec.combine != SOFTMAX_AVG else None
    logtab, freq, size = model.logtab, model.freq, model.size
    limit = float(spec.limit or 0.0)

    # Cell positions: one dense product for narrow models; for wide ones (many
    # attributes x many tables) a gather of each table's few parents instead.
    wide = d * len(order) > DENSE_POSITION_LIMIT
    groups = []
    if wide:
        by_np: dict[int, list[int]] = {}
        for j, tid in enumerate(order):
            by_np.setdefault(len(spec.tables[tid].family.parents), []).append(j)
        for npar, js in by_np.items():
            sel = np.array(js)
            par = np.array([spec.tables[order[j]].family.parents for j in js], dtype=np.int64).reshape(len(js), npar)
            pm = np.array([[mult[p, j] for p in spec.tables[order[j]].family.parents] for j in js],
                          dtype=np.int64).reshape(len(js), npar)
            att = np.array([spec.tables[order[j]].family.att for j in js], dtype=np.int64)
            groups.append((sel, par, pm, att))

    def positions(x: np.ndarray) -> np.ndarray:
        if not wide:
            return x @ mult + const
        out = np.empty((x.shape[0], len(order)), dtype=np.int64)
        for sel, par, pm, att in groups:
            v = np.where(att[None, :] >= 0, x[:, np.maximum(att, 0)], 0)
            out[:, sel] = (x[:, par] * pm[None, :, :]).sum(axis=2) + v + const[sel][None, :]
        return out

    def run(batches):
        for whole in batches:
          step = max(1, WIDE_ROWS_PER_SLICE // max(1, len(order))) if wide else max(1, len(whole))
          for lo in range(0, len(whole), step):
            pdf = whole.iloc[lo:lo + step]
            n = len(pdf)
            x = pdf[list(attrs)].to_numpy(dtype=np.int64)
            base = (pdf[group_col].to_numpy(dtype=np.int64) * size) if group_col else np.zeros(n, np.int64)
            ix = positions(x) + base[:, None]                           # n x T, class 0
            lp = np.empty((n, len(comps), k))
            cpl = (np.stack([logtab[base + cp_off + c * cp_stride] for c in range(k)], axis=1)  # n x K
                   if has_cp else np.zeros((n, k)))
            with np.errstate(invalid="ignore", over="ignore"):
                for c in range(k):
                    vals = logtab[ix + c * stride]
                    lp[:, :, c] = np.add.reduceat(vals, starts, axis=1)
                cpe = np.exp(cpl - cpl.max(axis=1, keepdims=True))
                prior_p = cpe / cpe.sum(axis=1, keepdims=True)
                if spec.combine == NORM_SUM:
                    act = freq[ix[:, prior_cols]] >= limit
                    e = np.exp(lp - lp.max(axis=2, keepdims=True))
                    post = e / e.sum(axis=2, keepdims=True)
                    raw = np.where(act[:, :, None], post, 0.0).sum(axis=1)
                elif spec.combine == JOINT_SUM:
                    act = freq[ix[:, prior_cols]] >= limit                 # n x comps
                    masked = np.where(act[:, :, None], lp, -np.inf)
                    mx = masked.reshape(n, -1).max(axis=1) if len(comps) else np.full(n, -np.inf)
                    ok = np.isfinite(mx)
                    raw = np.where(ok[:, None], np.exp(masked - np.where(ok, mx, 0)[:, None, None]).sum(axis=1), 0.0)
                else:
                    lpc = lp + cpl[:, None, :]
                    e = np.exp(lpc - lpc.max(axis=2, keepdims=True))
                    post = e / e.sum(axis=2, keepdims=True)
                    valid = ~np.isnan(post).any(axis=2)
                    raw = np.where(valid[:, :, None], post, 0.0).sum(axis=1)
                tot = raw.sum(axis=1)
                probs = np.where((tot > 0)[:, None], raw / np.where(tot > 0, tot, 1.0)[:, None], prior_p)
            out = pd.DataFrame({c: pdf[c].to_numpy() for c in keep})
            out["probability"] = list(probs)
            out["prediction"] = probs.argmax(axis=1).astype(np.int32)
            yield out

    return run


def score(df: DataFrame, model: FittedBayes, *, group_col: str | None = None,
          keep: tuple[str, ...] = ("rid",)) -> DataFrame:
    """(keep..., probability ARRAY<DOUBLE>, prediction INT) for every row of ``df``.

    Narrow ``mapInPandas`` over Arrow batches (no shuffle); the model travels with the
    task closure and its size was checked when it was fitted.  :func:`score_sql` is
    the JVM-expression twin."""
    spec = model.spec
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{c} {fields[c]}" for c in keep] + ["probability array<double>", "prediction int"])
    cols = list(dict.fromkeys([*keep, *spec.attrs, *([group_col] if group_col else [])]))
    return df.select(*cols).mapInPandas(_batch_scorer(model, spec.attrs, group_col, keep), schema)
