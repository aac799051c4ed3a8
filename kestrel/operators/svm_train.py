"""SVM training jobs: every type, kernel and label pair, checked, with probabilities (W-1 .. W-12).

One descent fits all label pairs and all cross-validation folds together: a mask says which
row belongs to which problem, every evaluation of the objective is one aggregation over the
persisted rows, and the driver holds the coefficients only.

Kernels.  A Nyström map (:class:`KernelMap`) takes a row to the values of its kernel with at
most ``landmarks`` rows, times the inverse root of the landmarks' own kernel matrix.  Landmarks are
the different rows with the smallest hash, so the sample is bounded and repeatable.  A linear
fit on the map *is* a kernel model whose support vectors are the landmarks: it scores, saves
and loads like any other model, and no separate map has to be kept.

nu problems.  After the descent the offsets are not estimated but taken as exact quantiles of the
margins (:func:`kestrel.operators.quantile.exact_quantiles`): of nu n / 2 rows of either label for a
pair, of nu n rows for one class.  The weight vector is then improved by the corners that
the thresholds ask for until the duality gap is small.  A pair is rescaled by 1 / rho with C = 1 / (n rho) reported; a one-class model is scaled by nu n, the sum of
its dual weights.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators import evaluate
from kestrel.operators.folds import interleaved_folds, plain_folds
from kestrel.operators.quantile import exact_quantiles
from kestrel.operators.svm import SvmModel, _predict_np, dense_batch, kernel_matrix_np, kernel_width, row_runs
from kestrel.operators.svm_fit import _lbfgs, _smooth_hinge, _summed, _summed_blocks, _tasks, check_parameter, laplace_sigma, linear_model, nu_feasibility, packed, read_blocks
from kestrel.sources.model_io import scratch_path

CLASSIFIERS = ("c_svc", "nu_svc")
LANDMARKS = 256
#: numbers of free offsets behind the weight vector of a problem
EXTRA = {"c_svc": 1, "nu_svc": 2, "one_class": 1, "epsilon_svr": 1, "nu_svr": 2}
#: what a block holds beside the vectors
OTHERS = {"y": "f8", "c": "i4", "g": "i4"}
#: sums a task makes at once to narrow thresholds
MARGIN_SUMS = 1 << 16


# ------------------------------------------------------------------ W-6 kernel maps
@dataclass
class KernelMap:
    """phi(x) = k(x, landmarks) @ root.  ``base`` holds kernel, parameters and landmarks;
    ``root`` is U S^(-1/2) of the landmarks' kernel matrix U S U'."""

    base: SvmModel
    root: np.ndarray

    @property
    def size(self) -> int:
        return self.root.shape[1]

    def features(self, col) -> np.ndarray:
        """phi of an Arrow list column."""
        width = kernel_width(self.base)
        x, norms, sizes = dense_batch(col, width)
        if self.base.kernel_type == "precomputed" and (sizes < width).any():
            raise ValueError(f"wrong input format: a precomputed row has fewer than {width} kernel values")
        phi = np.empty((len(x), self.size))
        for i in row_runs(len(x), len(self.base.sv)):
            phi[i] = kernel_matrix_np(self.base, x[i], norms[i]) @ self.root
        return phi

    def transform(self, df: DataFrame, features: str = "features", out: str = "features") -> DataFrame:
        """``df`` with ``out`` = phi(features); every other column passes."""
        names = [c for c in df.columns if c != out]
        kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

        def run(batches):
            for b in batches:
                phi = self.features(b.column(features))
                col = pa.ListArray.from_arrays(pa.array(np.arange(len(phi) + 1) * phi.shape[1], pa.int32()), pa.array(phi.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), col], names=[*names, out])

        return df.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"`{out}` array<double>"]))

    def error(self, df: DataFrame, features: str = "features") -> float:
        """Mean of k(x, x) - phi(x).phi(x) over all rows: what the map misses of the kernel."""
        def part(b):
            x, norms, _ = dense_batch(b.column(features), kernel_width(self.base))
            own, base = np.zeros(len(x)), self.base
            for i in range(len(x)):  # k(x, x), one row against itself
                one = SvmModel(base.svm_type, base.kernel_type, x[i : i + 1], np.ones((1, 1)), [0.0], degree=base.degree, gamma=base.gamma, coef0=base.coef0)
                own[i] = kernel_matrix_np(one, x[i : i + 1], norms[i : i + 1])[0, 0]
            phi = self.features(b.column(features))
            return np.array([(own - (phi * phi).sum(1)).sum(), len(x)])

        got = _summed(df.select(features), part, 2, _tasks(df))
        return float(got[0] / max(got[1], 1))


def map_of_landmarks(landmarks: np.ndarray, kernel_type: str, *, gamma: float = 0.0, degree: int = 3, coef0: float = 0.0,
                     cutoff: float = 1e-9) -> KernelMap:
    """The map of given landmarks (for a precomputed kernel: rows ``serial, k1, k2, ...``).  Directions
    whose eigenvalue is not above ``cutoff`` times the largest are left out; a sigmoid kernel
    may have negative ones, its map is that of its positive part."""
    base = SvmModel("c_svc", kernel_type, np.asarray(landmarks, float), np.zeros((1, len(landmarks))), [0.0], degree=degree, gamma=gamma, coef0=coef0)
    rows = base.sv
    if kernel_type == "precomputed":
        base.sv = base.sv[:, :1]
        kernel_width(base)
    k = kernel_matrix_np(base, rows, (rows * rows).sum(1))
    value, vector = np.linalg.eigh((k + k.T) / 2)
    keep = value > cutoff * max(value.max(), 0.0)
    if not keep.any():
        raise ValueError("the landmarks' kernel matrix has no positive direction")
    return KernelMap(base, vector[:, keep] / np.sqrt(value[keep]))


def kernel_map(df: DataFrame, kernel_type: str, *, features: str = "features", landmarks: int = LANDMARKS, **kernel) -> KernelMap:
    """A map of at most ``landmarks`` rows of ``df``: the different ones with the smallest hash.
    Only rows below a bound that their number gives are compared."""
    rows = df.select(F.col(features).cast("array<double>").alias("x")).where("x is not null")
    n = rows.count()
    if not n:
        raise ValueError("no rows to fit")
    hash_ = F.shiftrightunsigned(F.xxhash64("x"), 1)
    few = rows.withColumn("h", hash_).where(F.col("h") <= min(2**63 - 1, 2**63 * 4 * landmarks // n)).distinct().orderBy("h", "x").limit(landmarks).collect()
    if len(few) < min(landmarks, n):  # many equal rows: the bound took too few
        few = rows.withColumn("h", hash_).distinct().orderBy("h", "x").limit(landmarks).collect()
    width = max(len(r.x) for r in few)
    marks = np.zeros((len(few), width))
    for i, r in enumerate(few):
        marks[i, : len(r.x)] = [0.0 if v is None else v for v in r.x]
    return map_of_landmarks(marks, kernel_type, **kernel)


# ------------------------------------------------------------------- the problems
@dataclass
class Job:
    """Checked parameters and the persisted rows of a fit, blocks of (x, y, c, g)."""

    svm_type: str
    labels: list[int]
    C: float
    nu: float
    eps: float
    cost: np.ndarray
    map: KernelMap | None
    data: DataFrame | None
    d: int
    tasks: int
    n_groups: int
    #: rows by (group that a row is held out of, label index); -1, the last entry, is none
    rows: np.ndarray
    pairs: list[tuple[int, int]] = field(default_factory=list)

    @property
    def side(self) -> np.ndarray:
        """labels x pairs: +1 / -1 where the label takes part."""
        s = np.zeros((max(1, len(self.labels)), len(self.pairs)))
        for p, (i, j) in enumerate(self.pairs):
            s[i, p], s[j, p] = 1.0, -1.0
        return s

    @property
    def light(self) -> Job:
        """The same without the rows: what batch functions take along."""
        return replace(self, data=None)

    def train_rows(self) -> np.ndarray:
        """groups x labels: rows that each group is trained on."""
        return self.rows.sum(0)[None, :] - self.rows[: self.n_groups]


def _labels(df: DataFrame, label: str) -> list[int]:
    return sorted(r[0] for r in df.select(F.col(label).cast("int")).where(F.col(label).isNotNull()).distinct().collect())


def prepare(df: DataFrame, svm_type: str = "c_svc", kernel_type: str = "linear", *, features: str = "features", label: str = "label", group: str | None = None,
            n_groups: int = 1, gamma: float = 0.0, degree: int = 3, coef0: float = 0.0, C: float = 1.0, nu: float = 0.5, p: float = 0.1,
            weights: dict[int, float] | None = None, landmarks: int = LANDMARKS, probability: int = 0, kmap: KernelMap | None = None) -> Job:
    """Checks everything that can stop a fit (W-10), then maps and persists the rows.

    Errors: the parameters' own messages; no rows; one label only; a nu that a pair of labels
    cannot meet.  A class weight for a label that does not occur is a warning."""
    fault = check_parameter(svm_type, kernel_type, gamma=gamma, degree=degree, C=C, nu=nu, p=p, probability=probability)
    if fault:
        raise ValueError(fault)
    if kernel_type != "linear" and kmap is None:
        if gamma == 0.0 and kernel_type != "precomputed":
            gamma = 1.0 / max(1, int(df.agg(F.max(F.size(features))).first()[0] or 1))
        kmap = kernel_map(df, kernel_type, features=features, landmarks=landmarks, gamma=gamma, degree=degree, coef0=coef0)
    labels = _labels(df, label) if svm_type in CLASSIFIERS else []
    if svm_type in CLASSIFIERS and len(labels) < 2:
        raise ValueError("a classifier needs two labels")
    for lab in weights or {}:
        if lab not in labels:
            warnings.warn(f"class label {lab} specified in weight is not found", stacklevel=3)
    index = F.lit(0) if not labels else F.array_position(F.array(*[F.lit(lab) for lab in labels]), F.col(label).cast("int")).cast("int") - 1
    y = F.lit(0.0) if svm_type == "one_class" or labels else F.col(label).cast("double")
    data = df.select(F.col(features).cast("array<double>").alias("x"), y.alias("y"), index.alias("c"), (F.col(group) if group else F.lit(-1)).cast("int").alias("g"))
    data = data.where("c >= 0 and y is not null and x is not null")
    data = packed(data, OTHERS, None if kmap is None else kmap.features).persist()
    size = data.agg(F.max("width").alias("d")).first()
    if size.d is None:
        data.unpersist()
        raise ValueError("no rows to fit")
    shape, tasks = (n_groups + 1, max(1, len(labels))), _tasks(data)

    def count(x, y, c, g):  # g = -1 is the last line
        return np.bincount(g % shape[0] * shape[1] + c, minlength=shape[0] * shape[1])

    rows = _summed_blocks(data, OTHERS, size.d, count, shape[0] * shape[1], tasks).reshape(shape)
    cost = np.array([C * (weights or {}).get(lab, 1.0) for lab in labels] or [C])
    pairs = [(i, j) for i in range(len(labels)) for j in range(i + 1, len(labels))]
    job = Job(svm_type, labels, C, nu, p, cost, kmap, data, size.d, tasks, n_groups, rows, pairs)
    if svm_type == "nu_svc":
        of_class = df.sparkSession.createDataFrame([(lab, int(job.rows.sum(0)[i])) for i, lab in enumerate(labels)], "label int, count long")
        if nu_feasibility(of_class, nu).where("not feasible").limit(1).count():
            data.unpersist()
            raise ValueError("specified nu is infeasible")
    return job


def _masks(job: Job, c: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Of a block's rows, rows x (groups * pairs): +-1 where a row is trained on."""
    kept = (g[:, None] != np.arange(job.n_groups)[None, :]).astype(float)
    sign = job.side[c] if job.pairs else np.ones((len(c), 1))
    return (kept[:, :, None] * sign[:, None, :]).reshape(len(c), -1)


def _problem_rows(job: Job) -> np.ndarray:
    """Rows of every problem (groups * pairs)."""
    n = job.train_rows()
    return (n @ np.abs(job.side)).ravel() if job.pairs else n.sum(1)


def _evaluate(job: Job, theta: np.ndarray, mu: float) -> tuple[float, np.ndarray]:
    """Smoothed objective of all problems and its gradient, one aggregation."""
    d, kind = job.d, job.svm_type
    t = theta.reshape(-1, d + EXTRA[kind])
    w, b = t[:, :d], t[:, d]
    last = t[:, -1]  # rho of nu_svc and one_class, epsilon of nu_svr
    n = np.maximum(_problem_rows(job), 1.0)
    data, job = job.data, job.light

    def part(x, y, c, g):
        which = _masks(job, c, g)
        f, on = x @ w.T, np.abs(which)
        if kind in ("c_svc", "nu_svc"):
            share = on * (job.cost[c][:, None] if kind == "c_svc" else 1 / n)
            v, dv = _smooth_hinge((1.0 if kind == "c_svc" else last) - which * (f + b), mu)
            pull = -share * dv * which
            more = [pull.sum(0)] if kind == "c_svc" else [pull.sum(0), (share * dv).sum(0)]
        elif kind == "one_class":
            share = on / (job.nu * n)
            v, dv = _smooth_hinge(last - f, mu)
            pull, more = -share * dv, [(share * dv).sum(0)]
        else:
            share = on * job.C
            r, e = y[:, None] - f - b, last if kind == "nu_svr" else job.eps
            v1, d1 = _smooth_hinge(r - e, mu)
            v2, d2 = _smooth_hinge(-r - e, mu)
            v, pull = v1 + v2, -share * (d1 - d2)
            more = [pull.sum(0)] + ([-(share * (d1 + d2)).sum(0)] if kind == "nu_svr" else [])
        return np.append(np.hstack([pull.T @ x, np.column_stack(more)]).ravel(), (share * v).sum())

    got = _summed_blocks(data, OTHERS, d, part, len(theta) + 1, job.tasks)
    grad = got[:-1].reshape(t.shape)
    value = got[-1] + 0.5 * float((w * w).sum())
    grad[:, :d] += w
    if kind == "nu_svc":
        value -= job.nu * last.sum()
        grad[:, -1] -= job.nu
    elif kind == "one_class":
        value -= last.sum()
        grad[:, -1] -= 1
    elif kind == "nu_svr":
        value += float((job.C * job.nu * n * last).sum())
        grad[:, -1] += job.C * job.nu * n
    return value, grad.ravel()


def descend(job: Job, max_iter: int = 2000, tol: float | None = None) -> np.ndarray:
    """groups x pairs x (d + extra) coefficients: L-BFGS with falling smoothing.  For nu problems the
    smoothing is in units of the decisions, which the first gradient tells."""
    shape = (job.n_groups, max(1, len(job.pairs)), job.d + EXTRA[job.svm_type])
    theta = np.zeros(int(np.prod(shape)))
    unit = 1.0
    if job.svm_type in ("nu_svc", "one_class"):
        tol = tol or 1e-9
        _, g = _evaluate(job, theta, 1.0)
        w = 2 * np.abs(g.reshape(-1, shape[2])[:, : job.d])
        unit = max(float((w * w).sum(1).max()), 1e-12)
    scale = unit if unit != 1.0 else 1.0
    for mu in (1.0, 0.1, 0.01):
        theta = _lbfgs(lambda th, mu=mu: _scaled(_evaluate(job, th, mu * unit), scale), theta, max_iter, tol or 1e-6, memory=20)
    return theta.reshape(shape)


def _scaled(value_and_grad, scale: float):
    return value_and_grad[0] / scale, value_and_grad[1] / scale


# --------------------------------------------------- exact offsets of the nu problems
@dataclass
class Offsets:
    """Thresholds of the margins by (problem, side)."""

    t: np.ndarray           # problems x sides, midpoint of the quantile's two ends
    w: np.ndarray           # the weight vector that the thresholds ask for


def offsets(job: Job, w: np.ndarray) -> Offsets:
    """Exact thresholds for weight vectors ``w`` (problems x d): of the margins y w.x of either
    label of a pair the quantile at nu n / 2 rows, of w.x for one class that at nu n."""
    n, sides = _problem_rows(job), 2 if job.pairs else 1
    goal = np.repeat((job.nu * n / sides)[:, None], sides, 1)
    data, job = job.data, job.light
    groups = len(n) * sides

    def of_block(x, y, c, g):
        """(group of a margin, margin): group = problem * sides + side."""
        which = _masks(job, c, g)
        row, problem = np.nonzero(which)
        sign = which[row, problem]
        return problem * sides + (sign < 0), sign * (x @ w.T)[row, problem]

    # the range of every group's margins, then one histogram: only margins of the bucket that holds the goal
    # (and of the next that is not empty) become rows
    def ends(batches):
        lo, hi = np.full(groups, np.inf), np.full(groups, -np.inf)
        for b in batches:
            for block in read_blocks(b, OTHERS, job.d):
                k, m = of_block(*block)
                np.minimum.at(lo, k, m)
                np.maximum.at(hi, k, m)
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(groups), pa.int32()), "lo": pa.array(lo), "hi": pa.array(hi)})

    lo, hi = np.zeros(groups), np.zeros(groups)
    for r in data.mapInArrow(ends, "k int, lo double, hi double").groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <= hi").collect():
        lo[r.k], hi[r.k] = r.lo, r.hi
    buckets = int(max(8, min(4096, MARGIN_SUMS // groups)))

    def bucket(k, m):
        width = np.where(hi > lo, hi / 2 - lo / 2, 1.0)
        return np.minimum((m / 2 - lo[k] / 2) / width[k] * buckets, buckets - 1).astype(int)

    def histogram(x, y, c, g):
        k, m = of_block(x, y, c, g)
        return np.bincount(k * buckets + bucket(k, m), minlength=groups * buckets)

    hist = _summed_blocks(data, OTHERS, job.d, histogram, groups * buckets, job.tasks).reshape(groups, buckets)
    run, aim = hist.cumsum(1), goal.ravel()
    slack = 1e-12 * run[:, -1]
    first = np.minimum((run < (aim - slack)[:, None]).sum(1), buckets - 1)
    last = np.array([next((b for b in range(f + 1, buckets) if hist[k, b]), buckets - 1) for k, f in enumerate(first)])
    before = np.where(first > 0, run[np.arange(groups), np.maximum(first - 1, 0)], 0.0)
    left = aim - before
    left = np.where(np.abs(left - np.round(left)) <= slack, np.round(left), left).reshape(-1, sides)

    def margins(batches):
        for b in batches:
            for block in read_blocks(b, OTHERS, job.d):
                k, m = of_block(*block)
                at = bucket(k, m)
                k, m = (v[(at >= first[k]) & (at <= last[k])] for v in (k, m))
                yield pa.RecordBatch.from_pydict({"problem": pa.array(k // sides, pa.int32()), "side": pa.array(k % sides, pa.int32()), "m": pa.array(m)})

    long = data.mapInArrow(margins, "problem int, side int, m double").persist()
    try:
        q = exact_quantiles(long, F.col("m"), lambda key, _: float(left[key[0], key[1]]), ["problem", "side"]).collect()
    finally:
        long.unpersist()
    t, edge, part = np.zeros((len(n), sides)), np.full((len(n), sides), -np.inf), np.zeros((len(n), sides))
    for r in q:
        t[r.problem, r.side], edge[r.problem, r.side] = (r.lower + r.upper) / 2, r.lower
        part[r.problem, r.side] = (left[r.problem, r.side] - r.below) / r.at
    size = 1 / np.maximum(n if job.pairs else job.nu * n, 1.0)

    def pull(x, y, c, g):
        """Rows below the threshold count whole, rows at it in the share that fills the goal."""
        which = _masks(job, c, g)
        m, s = which * (x @ w.T), (which < 0).astype(int)
        at = np.arange(len(n))[None, :]
        alpha = np.where(m < edge[at, s], 1.0, np.where(m == edge[at, s], part[at, s], 0.0)) * np.abs(which) * size
        return ((alpha * which).T @ x).ravel()

    return Offsets(t, _summed_blocks(data, OTHERS, job.d, pull, len(n) * job.d, job.tasks).reshape(len(n), job.d))


def nearest_point(points: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shares of ``points`` (rows) whose mix is the nearest to the origin in their hull, from feasible
    ``share``: the nearest point of the plane through the points in use is taken; where it would
    leave the hull, the walk stops at the border and drops the point that got there."""
    gram = points @ points.T
    share = share.copy()
    for _ in range(10 * len(points) + 10):
        mix = gram @ share
        new = int(mix.argmin())
        if share @ mix - mix[new] <= 1e-14 * max(gram.max(), 1e-300):
            return share
        use = np.flatnonzero(share > 0)
        use = np.unique(np.append(use, new))
        for _ in range(len(points) + 1):
            k = len(use)
            kkt = np.zeros((k + 1, k + 1))
            kkt[:k, :k], kkt[:k, k], kkt[k, :k] = gram[np.ix_(use, use)], 1.0, 1.0
            goal = np.linalg.lstsq(kkt, np.append(np.zeros(k), 1.0), rcond=None)[0][:k]
            if (goal > 0).all():
                share = np.zeros(len(points))
                share[use] = goal / goal.sum()
                break
            now = share[use]
            fall = goal <= 0
            step = float((now[fall] / np.maximum(now[fall] - goal[fall], 1e-300)).min())
            now = np.maximum(now + step * (goal - now), 0.0)
            now[fall & (now <= 1e-15)] = 0.0
            if (now > 0).all():
                now[np.flatnonzero(fall)[0]] = 0.0
            share = np.zeros(len(points))
            share[use] = now / now.sum()
            use = use[now > 0]
    return share


def exact_nu(job: Job, theta: np.ndarray, tries: int = 12, tol: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weight vectors, thresholds) of every problem.

    A nu problem asks for the point nearest to the origin among the mixes sum alpha y x that its
    bounds allow.  The descent's vector is such a mix; the vector that exact thresholds ask for is the
    corner that lies lowest in its direction, and |w|^2 - corner.w bounds what is missing.  Corners are
    added and the nearest mix is taken again until that gap is at most ``tol`` |w|^2."""
    start = theta.reshape(-1, theta.shape[-1])[:, : job.d]
    w = start.copy()
    corners = [[v] for v in start]
    shares = [np.ones(1) for _ in start]
    best = offsets(job, w)
    gap = (w * w).sum(1) - (best.w * w).sum(1)
    for _ in range(tries):
        open_ = gap > tol * (w * w).sum(1) if job.d > 1 else (w != best.w).any(1)
        if not open_.any():
            break
        new_w = w.copy()
        for i in np.flatnonzero(open_):
            corners[i].append(best.w[i])
            shares[i] = nearest_point(np.array(corners[i]), np.append(shares[i], 0.0))
            new_w[i] = shares[i] @ np.array(corners[i])
        if (new_w == w).all():
            break
        w, best = new_w, offsets(job, new_w)
        gap = (w * w).sum(1) - (best.w * w).sum(1)
    return w, best.t


# ------------------------------------------------------------------------ models
@dataclass
class Fitted:
    """Coefficients of every (group, problem): decision = w . phi(x) + b."""

    job: Job
    w: np.ndarray   # groups x problems x d
    b: np.ndarray   # groups x problems
    #: nu-SVC: the C of the equivalent C-SVC, by (group, pair); nu-SVR: the learned epsilon
    reported: np.ndarray | None = None

    def model(self, group: int = 0) -> SvmModel:
        """A scorable, writable model."""
        job, w, b = self.job, self.w[group], self.b[group]
        if job.pairs:
            k = len(job.labels)
            if job.map is None:
                m = linear_model(np.hstack([w, b[:, None]]), job.labels)
                m.svm_type = job.svm_type
                return m
            # every label but the last brings the landmarks once; pair (i, j) uses those of i
            marks = len(job.map.base.sv)
            coef = np.zeros((k - 1, marks * (k - 1)))
            for p, (i, j) in enumerate(job.pairs):
                coef[j - 1, marks * i : marks * (i + 1)] = job.map.root @ w[p]
            return self._of(np.tile(job.map.base.sv, (k - 1, 1)), coef, -b, list(job.labels), [marks] * (k - 1) + [0])
        if job.map is None:
            return self._of(w[:1], np.ones((1, 1)), -b, [], [])
        return self._of(job.map.base.sv, (job.map.root @ w[0])[None, :], -b, [], [])

    def _of(self, sv, coef, rho, labels, n_sv) -> SvmModel:
        base = self.job.map.base if self.job.map else SvmModel("", "linear", sv, coef, [])
        return SvmModel(self.job.svm_type, base.kernel_type, sv, coef, [float(r) for r in rho], labels, n_sv, base.degree, base.gamma, base.coef0)

    def decisions(self, x: np.ndarray, group: np.ndarray) -> np.ndarray:
        """rows x problems, each row by the coefficients of its group."""
        out = np.empty((len(x), self.w.shape[1]))
        for g in np.unique(group):
            out[group == g] = x[group == g] @ self.w[g].T + self.b[g]
        return out


def solve(job: Job, **kw) -> Fitted:
    theta = descend(job, **kw)
    shape, d = theta.shape[:2], job.d
    if job.svm_type == "nu_svc":
        w, t = exact_nu(job, theta)
        rho, b = (t[:, 0] + t[:, 1]) / 2, (t[:, 1] - t[:, 0]) / 2
        n = _problem_rows(job)
        ok = rho > 1e-12 * np.maximum(1e-300, np.abs(t).max(1))
        scale = np.where(ok, 1 / np.where(ok, rho, 1.0), 1.0)  # a pair that no margin separates stays unscaled
        c = np.where(ok, scale / np.maximum(n, 1), np.nan)
        return Fitted(job, (w * scale[:, None]).reshape(*shape, d), (b * scale).reshape(shape), c.reshape(shape))
    if job.svm_type == "one_class":
        w, t = exact_nu(job, theta)
        scale = job.nu * _problem_rows(job)
        return Fitted(job, (w * scale[:, None]).reshape(*shape, d), (-t[:, 0] * scale).reshape(shape))
    return Fitted(job, theta[:, :, :d], theta[:, :, d], theta[:, :, -1] if job.svm_type == "nu_svr" else None)


# ----------------------------------------------- W-7, W-8: probabilities of all pairs
def _decided(job: Job, fitted: Fitted, keep: list[str], rows: DataFrame) -> DataFrame:
    """(keep..., dec): decisions of every row by the model that was trained without its fold."""
    fitted = replace(fitted, job=job.light)
    job = job.light

    def run(batches):
        for b in batches:
            x = job.map.features(b.column("x")) if job.map else dense_batch(b.column("x"), job.d)[0]
            dec = fitted.decisions(x, b.column("fold").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(list(dec), pa.list_(pa.float64()))], names=[*keep, "dec"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "dec array<double>"]))


def _with_folds(df: DataFrame, folds: int, rid: str, features: str, label: str, stratified: bool, seed: int) -> DataFrame:
    """(rid, label, x, fold), written once to the shared folder."""
    rows = df.select(F.col(rid).alias("rid"), F.col(label).alias("label"), F.col(features).cast("array<double>").alias("x"))
    rows = interleaved_folds(rows, folds, cls="label", seed=seed) if stratified else plain_folds(rows, folds, seed=seed)
    path = scratch_path(df.sparkSession, "svm-folds")
    rows.write.parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def platt_pairs(dec: DataFrame, labels: list[int], label: str = "label", max_iter: int = 100, eps: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """W-7 for every label pair at once: (A, B) by pair from a ``dec array<double>`` column.  A pair is
    fitted on the rows of its two labels; each Newton step is one aggregation that also tries
    all step lengths of the step before."""
    pairs = [(i, j) for i in range(len(labels)) for j in range(i + 1, len(labels))]
    side = np.zeros((len(labels), len(pairs)))
    for p, (i, j) in enumerate(pairs):
        side[i, p], side[j, p] = 1.0, -1.0
    index = F.array_position(F.array(*[F.lit(lab) for lab in labels]), F.col(label).cast("int")).cast("int") - 1
    data = dec.select("dec", index.alias("c")).where("c >= 0").persist()
    tasks, lengths = _tasks(data), 0.5 ** np.arange(34)

    def read(batch):
        f, _, _ = dense_batch(batch.column("dec"), len(pairs))
        return f, side[batch.column("c").to_numpy()]

    count = _summed(data, lambda b: np.concatenate([(read(b)[1] > 0).sum(0), (read(b)[1] < 0).sum(0)]).astype(float), 2 * len(pairs), tasks)
    pos, neg = count[: len(pairs)], count[len(pairs) :]
    hi, lo = (pos + 1) / (pos + 2), 1 / (neg + 2)

    def loss(z, t, on):
        return (on * (np.log1p(np.exp(-np.abs(z))) + t * z + np.maximum(-z, 0))).sum(0)

    def moments(theta):
        def part(batch):
            f, s = read(batch)
            on, t = np.abs(s), np.where(s > 0, hi, lo)
            z = f * theta[0] + theta[1]
            p = 1 / (1 + np.exp(np.clip(z, -700, 700)))
            gap, curve = on * (t - p), on * p * (1 - p)
            return np.concatenate([(f * gap).sum(0), gap.sum(0), (f * f * curve).sum(0), (f * curve).sum(0), curve.sum(0), loss(z, t, on)])

        return _summed(data, part, 6 * len(pairs), tasks).reshape(6, -1)

    def losses(theta, step):
        def part(batch):
            f, s = read(batch)
            on, t = np.abs(s), np.where(s > 0, hi, lo)
            return np.concatenate([loss(f * (theta[0] + a * step[0]) + theta[1] + a * step[1], t, on) for a in lengths])

        return _summed(data, part, len(lengths) * len(pairs), tasks).reshape(len(lengths), -1)

    theta = np.vstack([np.zeros(len(pairs)), np.log((neg + 1) / (pos + 1))])
    moving = np.ones(len(pairs), bool)
    try:
        for _ in range(max_iter):
            g1, g2, h11, h12, h22, now = moments(theta)
            moving &= np.maximum(np.abs(g1), np.abs(g2)) >= eps
            if not moving.any():
                break
            h11, h22 = h11 + 1e-12, h22 + 1e-12
            det = h11 * h22 - h12 * h12
            step = np.vstack([-(h22 * g1 - h12 * g2) / det, -(h11 * g2 - h12 * g1) / det]) * moving
            slope = g1 * step[0] + g2 * step[1]
            tried = losses(theta, step)
            ok = tried < now + 1e-4 * lengths[:, None] * slope
            best = ok.argmax(0)
            found = ok.any(0) & moving
            theta = theta + np.where(found, lengths[best], 0.0) * step
            moving &= found
    finally:
        data.unpersist()
    return theta[0], theta[1]


def out_of_fold(df: DataFrame, svm_type: str, kernel_type: str = "linear", *, folds: int = 5, rid: str = "rid", features: str = "features",
                label: str = "label", seed: int = 1, stratified: bool = False, **kw) -> tuple[DataFrame, Fitted]:
    """W-8 / E-4: (rid, label, fold, dec), every row decided by the model that was trained without its
    fold; all folds and pairs are one descent.  Where a fold leaves a pair one label only, its
    decision is that label's +-1; where it leaves none, 0."""
    rows = _with_folds(df, folds, rid, features, label, stratified, seed)
    job = prepare(rows, svm_type, kernel_type, features="x", label="label", group="fold", n_groups=folds, **kw)
    try:
        fitted = solve(job)
        train = job.train_rows()
        for p, (i, j) in enumerate(job.pairs):
            for g in range(folds):
                if train[g, i] == 0 or train[g, j] == 0:
                    fitted.w[g, p], fitted.b[g, p] = 0.0, float(train[g, i] > 0) - float(train[g, j] > 0)
    finally:
        job.data.unpersist()
    return _decided(job, fitted, ["rid", "label", "fold"], rows), fitted


def cross_validate(df: DataFrame, svm_type: str, kernel_type: str = "linear", folds: int = 5, **kw) -> DataFrame:
    """E-4: (rid, label, fold, prediction); stratified folds for classifiers, plain ones else."""
    dec, fitted = out_of_fold(df, svm_type, kernel_type, folds=folds, stratified=svm_type in CLASSIFIERS, **kw)
    model, width = fitted.model(), max(1, len(fitted.job.pairs))

    def run(batches):
        for b in batches:
            x, _, _ = dense_batch(b.column("dec"), width)
            pred, _ = _predict_np(model, x, False)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rid", "label", "fold")), pa.array(pred.astype(float))], names=["rid", "label", "fold", "prediction"])

    kinds = {f.name: f.dataType.simpleString() for f in dec.schema.fields}
    return dec.mapInArrow(run, f"rid {kinds['rid']}, label {kinds['label']}, fold int, prediction double")


def regression_cv(df: DataFrame, svm_type: str = "epsilon_svr", kernel_type: str = "linear", folds: int = 5, **kw) -> DataFrame:
    """E-4, E-6, E-7, W-9 of a regression: (mse, scc, sigma) over held-out predictions of all rows."""
    pred = cross_validate(df, svm_type, kernel_type, folds, **kw).withColumn("label", F.col("label").cast("double")).persist()
    try:
        noise = laplace_sigma(pred).first().sigma
        return evaluate.regression_metrics(pred).withColumn("sigma", F.lit(float(noise)))
    finally:
        pred.unpersist()


def train(df: DataFrame, svm_type: str = "c_svc", kernel_type: str = "linear", *, probability: int = 0, rid: str = "rid", features: str = "features",
          label: str = "label", seed: int = 1, **kw) -> tuple[SvmModel, Fitted]:
    """A checked fit of any type and kernel.  With ``probability`` the model carries Platt parameters of
    every label pair (from 5-fold decisions), or the noise scale of a regression (from 5-fold residuals)."""
    job = prepare(df, svm_type, kernel_type, features=features, label=label, probability=probability, **kw)
    try:
        fitted = solve(job)
    finally:
        job.data.unpersist()
    model = fitted.model()
    if probability:
        more = {**kw, "kmap": job.map} if job.map else kw
        if svm_type in CLASSIFIERS:
            dec, _ = out_of_fold(df, svm_type, kernel_type, rid=rid, features=features, label=label, seed=seed, **more)
            a, b = platt_pairs(dec, job.labels)
            model.prob_a, model.prob_b = a.tolist(), b.tolist()
        else:
            noise = regression_cv(df, svm_type, kernel_type, rid=rid, features=features, label=label, seed=seed, **more).first().sigma
            model.prob_a = [float(noise)]
    return model, fitted


def summary(dec: DataFrame, labels: list[int], label: str = "label") -> DataFrame:
    """W-12 for every label pair: rows on or inside the margin (y f <= 1) and inside (< 1), from a
    ``dec array<double>`` column in pair order."""
    pairs = [(i, j) for i in range(len(labels)) for j in range(i + 1, len(labels))]
    sides = [F.struct(F.lit(labels[i]).alias("label_i"), F.lit(labels[j]).alias("label_j"),
                      F.when(F.col(label) == labels[i], F.element_at("dec", p + 1)).when(F.col(label) == labels[j], -F.element_at("dec", p + 1)).alias("m"))
             for p, (i, j) in enumerate(pairs)]
    long = dec.select(F.inline(F.filter(F.array(*sides), lambda s: s["m"].isNotNull())))
    return long.groupBy("label_i", "label_j").agg(F.count_if(F.col("m") <= 1).alias("n_sv"), F.count_if(F.col("m") < 1).alias("n_inside"))
