"""SVM fitting re-aimed as distributed jobs (W-1 .. W-12).

The reference trains with a single-machine dual solver.  Here every fit is a loop
on the driver whose iterations are single aggregations over the data (the driver
holds only a handful of numbers), or a Spark ML estimator.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Defaults of the training parameters and the messages of ``check_parameter`` (fixed values).
DEFAULTS = dict(svm_type="c_svc", kernel_type="rbf", degree=3, gamma=0.0, coef0=0.0, C=1.0, nu=0.5,
                p=0.1, eps=1e-3, cache_size=100.0, shrinking=1, probability=0)


def default_gamma(df: DataFrame, idx: str = "idx") -> DataFrame:
    """W-11: gamma = 1 / max feature index when unset."""
    return df.agg((F.lit(1.0) / F.max(F.array_max(idx))).alias("gamma"))


def check_parameter(svm_type: str, kernel_type: str, *, gamma: float = 0.0, degree: int = 3, C: float = 1.0,
                    nu: float = 0.5, p: float = 0.1, eps: float = 1e-3, cache_size: float = 100.0,
                    shrinking: int = 1, probability: int = 0) -> str | None:
    """W-10 (scalar part): the reference's messages, or None when valid."""
    if svm_type not in ("c_svc", "nu_svc", "one_class", "epsilon_svr", "nu_svr"):
        return "unknown svm type"
    if kernel_type not in ("linear", "polynomial", "rbf", "sigmoid", "precomputed"):
        return "unknown kernel type"
    if gamma < 0:
        return "gamma < 0"
    if degree < 0:
        return "degree of polynomial kernel < 0"
    if cache_size <= 0:
        return "cache_size <= 0"
    if eps <= 0:
        return "eps <= 0"
    if svm_type in ("c_svc", "epsilon_svr", "nu_svr") and C <= 0:
        return "C <= 0"
    if svm_type in ("nu_svc", "one_class", "nu_svr") and (nu <= 0 or nu > 1):
        return "nu <= 0 or nu > 1"
    if svm_type == "epsilon_svr" and p < 0:
        return "p < 0"
    if shrinking not in (0, 1):
        return "shrinking != 0 and shrinking != 1"
    if probability not in (0, 1):
        return "probability != 0 and probability != 1"
    if probability == 1 and svm_type == "one_class":
        return "one-class SVM probability output not supported yet"
    return None


def nu_feasibility(class_counts: DataFrame, nu: float, label: str = "label", count: str = "count") -> DataFrame:
    """W-10 (data part): for every class pair, is ν(n1+n2)/2 <= min(n1, n2)?
    The class-count table has one row per class; pairs are formed from its arrays."""
    arr = class_counts.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"),
                                                                F.col(count).alias("n")))).alias("a"))
    pairs = arr.select(F.inline_outer(F.flatten(F.transform(
        F.sequence(F.lit(0), F.size("a") - 1), lambda i: F.transform(
            F.slice("a", i + 2, F.size("a")), lambda b: F.struct(
                F.element_at("a", i + 1)["l"].alias("label_i"), b["l"].alias("label_j"),
                F.element_at("a", i + 1)["n"].alias("n_i"), b["n"].alias("n_j")))))))
    return pairs.select("label_i", "label_j",
                        (F.lit(nu) * (F.col("n_i") + F.col("n_j")) / 2 <= F.least("n_i", "n_j")).alias("feasible"))


# --------------------------------------------------------------------- W-7 Platt
def platt_fit(df: DataFrame, dec: str = "dec", label: str = "label", max_iter: int = 100,
              min_step: float = 1e-10, ridge: float = 1e-12, eps: float = 1e-5) -> tuple[float, float]:
    """W-7: P(y = 1 | f) = 1 / (1 + exp(A f + B)) by damped Newton steps on the
    cross-entropy with smoothed targets (Platt; Lin, Lin and Weng).

    The state is the vector (A, B).  One aggregation over the persisted (f, t) gives
    gradient and Hessian, one more the loss at every step length 1, 1/2, 1/4, ..."""
    # kept before the labels are counted, so decisions are made once
    kept = df.select(F.col(dec).cast("double").alias("f"), (F.col(label) > 0).alias("p")).persist()
    n = kept.agg(F.count_if("p").alias("pos"), F.count_if(~F.col("p")).alias("neg")).first()
    data = kept.select("f", F.when(F.col("p"), (n.pos + 1) / (n.pos + 2)).otherwise(1 / (n.neg + 2)).alias("t"))
    basis = (F.col("f"), F.lit(1.0))

    def z_at(theta):
        return F.col("f") * float(theta[0]) + float(theta[1])

    def loss_at(theta):
        z = z_at(theta)
        return F.sum(F.log1p(F.exp(-F.abs(z))) + F.col("t") * z + F.greatest(-z, F.lit(0.0)))

    theta = np.array([0.0, math.log((n.neg + 1) / (n.pos + 1))])
    lengths = 0.5 ** np.arange(int(-math.log2(min_step)) + 1)
    try:
        loss = data.agg(loss_at(theta)).first()[0]
        for _ in range(max_iter):
            p = 1 / (1 + F.exp(z_at(theta)))
            curve = p * (1 - p)
            moments = [F.sum(u * (F.col("t") - p)) for u in basis] + [F.sum(u * v * curve) for u in basis for v in basis]
            m = np.array(data.agg(*moments).first(), dtype=float)
            gradient, hessian = m[:2], m[2:].reshape(2, 2) + ridge * np.eye(2)
            if np.abs(gradient).max() < eps:
                break
            step = -np.linalg.solve(hessian, gradient)
            losses = np.array(data.agg(*[loss_at(theta + a * step).alias(f"l{i}") for i, a in enumerate(lengths)]).first())
            better = np.flatnonzero(losses < loss + 1e-4 * lengths * (gradient @ step))
            if not len(better):
                break
            theta, loss = theta + lengths[better[0]] * step, losses[better[0]]
    finally:
        kept.unpersist()
    return float(theta[0]), float(theta[1])


# ----------------------------------------------------------------- W-9 SVR noise
def laplace_sigma(df: DataFrame, pred: str = "prediction", label: str = "label") -> DataFrame:
    """W-9: mae of the residuals, recomputed without |r| > 5·sqrt(2)·mae (two scalar
    aggregations)."""
    r = F.abs(F.col(label) - F.col(pred))
    mae0 = df.agg(F.avg(r)).first()[0]
    cut = 5.0 * math.sqrt(2.0) * mae0
    return df.agg((F.sum(F.when(r > cut, 0.0).otherwise(r)) /
                   F.sum(F.when(r > cut, 0).otherwise(1))).alias("sigma"))


# --------------------------------------------------------------------- W-1 C-SVC
#: up to so many tasks, their partial sums are added on the driver (one stage fewer)
FEW_TASKS = 64


def _tasks(data: DataFrame) -> int:
    return data.select(F.spark_partition_id().alias("p")).distinct().count()


def _summed(data: DataFrame, fn: Callable, size: int, tasks: int) -> np.ndarray:
    """The sum over all rows of ``fn(batch) -> vector of length size``: tasks add up their
    batches, Spark adds by position, ``size`` numbers reach the driver (from at most
    ``FEW_TASKS`` tasks, their partial sums do)."""
    import pyarrow as pa

    def part(batches):
        total = np.zeros(size)
        for batch in batches:
            total += fn(batch)
        yield pa.RecordBatch.from_pydict({"i": np.arange(size), "g": total})

    sums = data.mapInArrow(part, "i bigint, g double")
    if tasks > FEW_TASKS:
        sums = sums.groupBy("i").agg(F.sum("g").alias("g"))
    got = sums.toArrow()
    return np.bincount(got["i"].to_numpy(), got["g"].to_numpy(), size)


#: bytes of the vectors in a block
BLOCK_BYTES = 1 << 18


def packed(rows: DataFrame, others: dict[str, str], features: Callable | None = None) -> DataFrame:
    """Rows (x array<double>, others...) as blocks (n, width, x, others...), a column of a block being the
    bytes of its rows' values.  A pass over blocks reads NumPy arrays from them and makes no row anew; a block
    holds at most ``BLOCK_BYTES`` of vectors (one row, if that is longer) and comes from one Arrow batch.
    ``others`` gives NumPy types; ``features`` turns the column of vectors into an array."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from kestrel.operators.svm import dense_batch

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            if features is None:
                widest = pc.max(pc.list_value_length(b.column("x"))).as_py()
                x, _, _ = dense_batch(b.column("x"), widest or 0)
            else:
                x = features(b.column("x"))
            x = np.ascontiguousarray(x, float)
            more = {c: b.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in others.items()}
            size = max(1, BLOCK_BYTES // max(1, 8 * x.shape[1]))
            cuts = [slice(i, i + size) for i in range(0, len(x), size)]
            yield pa.RecordBatch.from_pydict({
                "n": pa.array([len(x[i]) for i in cuts], pa.int32()), "width": pa.array([x.shape[1]] * len(cuts), pa.int32()),
                "x": pa.array([x[i].tobytes() for i in cuts], pa.binary()), **{c: pa.array([v[i].tobytes() for i in cuts], pa.binary()) for c, v in more.items()}})

    return rows.select("x", *others).mapInArrow(run, ", ".join(["n int, width int, x binary", *(f"{c} binary" for c in others)]))


def read_blocks(batch, others: dict[str, str], d: int):
    """(x padded to ``d``, others...) of every block of an Arrow batch of :func:`packed`."""
    for i in range(batch.num_rows):
        n, width = batch.column("n")[i].as_py(), batch.column("width")[i].as_py()
        x = np.frombuffer(batch.column("x")[i].as_buffer(), float).reshape(n, width)
        if width < d:
            x = np.pad(x, ((0, 0), (0, d - width)))
        yield (x, *(np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in others.items()))


def _summed_blocks(data: DataFrame, others: dict[str, str], d: int, fn: Callable, size: int, tasks: int) -> np.ndarray:
    """:func:`_summed` over blocks: the sum of ``fn(x, others...)``."""
    def part(batch):
        total = np.zeros(size)
        for block in read_blocks(batch, others, d):
            total += fn(*block)
        return total

    return _summed(data, part, size, tasks)


def csvc_fit_groups(df: DataFrame, labels: list[int], *, n_groups: int = 1, features: str = "features", label: str = "label",
                    group: str | None = None, C: float = 1.0, weights: dict[int, float] | None = None,
                    mus: tuple[float, ...] = (1.0, 0.1, 0.01), max_iter: int = 2000, tol: float = 1e-6) -> np.ndarray:
    """Linear C-SVCs of every pair of labels, for every group, in one descent:
    (groups x pairs x (d + 1)) coefficients, the bias last.

    A pair (i, j) takes the rows of its two labels, i as +1; with ``group``, group g is
    fitted on the rows whose group is *not* g (cross-validation), else on all rows.  Each
    problem is 1/2 |w|^2 + C sum_rows weight(label) max(0, 1 - y (w.x + b)), smoothed; the
    sum over problems falls apart into them, so one aggregation per evaluation serves all."""
    pairs = [(i, j) for i in range(len(labels)) for j in range(i + 1, len(labels))]
    cost = np.array([C * (weights or {}).get(lb, 1.0) for lb in labels])
    index = F.array_position(F.array(*[F.lit(lb) for lb in labels]), F.col(label).cast("int")).cast("int") - 1
    others = {"c": "i4", "g": "i4"}
    data = df.select(F.col(features).cast("array<double>").alias("x"), index.alias("c"),
                     F.coalesce((F.col(group) if group else F.lit(-1)).cast("int"), F.lit(-1)).alias("g")).where("c >= 0")
    data = packed(data, others).persist()
    d = int(data.agg(F.max("width")).first()[0] or 0)
    tasks = _tasks(data)
    side = np.zeros((len(labels), len(pairs)))
    for p, (i, j) in enumerate(pairs):
        side[i, p], side[j, p] = 1.0, -1.0
    shape = (n_groups, len(pairs), d + 1)

    def evaluate(theta, mu):
        w = theta.reshape(-1, d + 1)

        def block_sum(x, c, g):
            y = np.where(g[:, None, None] == np.arange(n_groups)[None, :, None], 0.0, side[c][:, None, :]).reshape(len(x), -1)
            v, dv = _smooth_hinge(1 - y * (x @ w[:, :-1].T + w[:, -1]), mu)
            share = np.abs(y) * cost[c][:, None]
            pull = -(share * dv * y)
            return np.concatenate([np.hstack([pull.T @ x, pull.sum(0)[:, None]]).ravel(), [(share * v).sum()]])

        s = _summed_blocks(data, others, d, block_sum, len(theta) + 1, tasks)
        flat = w.copy()
        flat[:, -1] = 0.0
        return s[-1] + 0.5 * float((flat * flat).sum()), s[:-1] + flat.ravel()

    theta = np.zeros(int(np.prod(shape)))
    try:
        for mu in mus:
            theta = _lbfgs(lambda th, mu=mu: evaluate(th, mu), theta, max_iter, tol, memory=20)
    finally:
        data.unpersist()
    return theta.reshape(shape)


def linear_model(coef: np.ndarray, labels: list[int]):
    """A scorable, writable model of pair coefficients (pairs x (d + 1)): the weight vector of
    pair (i, j) stands as one support vector of label i with coefficient 1 against j."""
    from kestrel.operators.svm import SvmModel

    k = len(labels)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    sv_coef = np.zeros((k - 1, len(pairs)))
    for p, (_, j) in enumerate(pairs):
        sv_coef[j - 1, p] = 1.0
    return SvmModel(svm_type="c_svc", kernel_type="linear", sv=coef[:, :-1].copy(), sv_coef=sv_coef, rho=(-coef[:, -1]).tolist(),
                    labels=list(labels), n_sv=[sum(1 for p in pairs if p[0] == i) for i in range(k)])


def csvc_fit(df: DataFrame, *, label: str = "label", **kw):
    """W-1: one-against-one linear C-SVC over all labels; a kernel is fitted on a feature map
    (:func:`random_fourier_features`).  Returns an ``SvmModel`` that scores and saves."""
    labels = sorted(r[0] for r in df.select(F.col(label).cast("int")).where(F.col(label).isNotNull()).distinct().collect())
    if len(labels) < 2:
        raise ValueError("a classifier needs two labels")
    return linear_model(csvc_fit_groups(df, labels, label=label, **kw)[0], labels)


def csvc_cross_validate(df: DataFrame, folds: int = 5, *, rid: str = "rid", features: str = "features", label: str = "label",
                        seed: int = 1, **kw) -> DataFrame:
    """E-4 for C-SVC: (rid, label, fold, prediction), every row predicted by the model that was
    fitted without its stratified fold.  All folds are fitted in one descent."""
    import pyarrow as pa

    from kestrel.operators.folds import interleaved_folds
    from kestrel.operators.svm import _predict_np, dense_batch
    from kestrel.sources.model_io import scratch_path

    rows = interleaved_folds(df.select(rid, label, features), folds, rid=rid, cls=label, seed=seed)
    path = scratch_path(df.sparkSession, "svm-folds")
    rows.write.parquet(path)
    rows = df.sparkSession.read.schema(rows.schema).parquet(path)
    labels = sorted(r[0] for r in rows.select(F.col(label).cast("int")).distinct().collect())
    coef = csvc_fit_groups(rows, labels, n_groups=folds, features=features, label=label, group="fold", **kw)
    model = linear_model(coef[0], labels)

    def run(batches):
        for b in batches:
            x, _, _ = dense_batch(b.column(features), coef.shape[2] - 1)
            own = coef[b.column("fold").to_numpy()]
            dec = np.einsum("npd,nd->np", own[:, :, :-1], x) + own[:, :, -1]
            pred, _ = _predict_np(model, dec, False)
            yield pa.RecordBatch.from_arrays([b.column(rid), b.column(label), b.column("fold"), pa.array(pred)], names=[rid, label, "fold", "prediction"])

    t = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"{rid} {t[rid]}, {label} {t[label]}, fold int, prediction double")


def training_summary(df: DataFrame, dec: str = "dec", label: str = "label") -> DataFrame:
    """W-12 (primal reading): rows on or inside the margin (y·f <= 1) and strictly
    inside (< 1)."""
    y = F.when(F.col(label) > 0, 1.0).otherwise(-1.0)
    m = y * F.col(dec)
    return df.agg(F.sum(F.when(m <= 1, 1).otherwise(0)).alias("n_sv"),
                  F.sum(F.when(m < 1, 1).otherwise(0)).alias("n_inside"))


# ------------------------------------------------------- W-6 kernel feature maps
def random_fourier_features(df: DataFrame, features: str, dim_in: int, n_out: int, gamma: float,
                            seed: int = 0, out: str = "rff") -> DataFrame:
    """W-6 for RBF: z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2γ), b ~ U[0, 2π).  The
    map (D x dim) is drawn once from ``seed`` and applied per Arrow batch."""
    import pandas as pd

    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(n_out, dim_in))
    b = rng.uniform(0.0, 2 * math.pi, size=n_out)
    scale = math.sqrt(2.0 / n_out)
    cols = df.columns
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{c} {fields[c]}" for c in cols] + [f"{out} array<double>"])

    def run(batches):
        for pdf in batches:
            x = np.stack([np.asarray(v, dtype=float) for v in pdf[features]]) if len(pdf) else np.zeros((0, dim_in))
            z = scale * np.cos(x @ w.T + b)
            o = pdf.copy()
            o[out] = list(z)
            yield o

    return df.mapInPandas(run, schema)


# ------------------------------------------------- W-2 .. W-5 primal fits (L-BFGS)
def _smooth_hinge(z: np.ndarray, mu: float) -> tuple[np.ndarray, np.ndarray]:
    """max(0, z) smoothed as mu * log(1 + exp(z / mu)); value and derivative."""
    t = z / mu
    val = mu * np.logaddexp(0.0, t)
    der = 0.5 * (1.0 + np.tanh(0.5 * t))
    return val, der


def _objective_parts(kind: str, x: np.ndarray, y: np.ndarray, theta: np.ndarray, mu: float,
                     C: float, nu: float, eps: float, n: float):
    """Data term of the primal objective and its gradient for one batch."""
    d = x.shape[1]
    w = theta[:d]
    f = x @ w
    g = np.zeros_like(theta)
    if kind == "one_class":            # (1/(νn)) Σ max(0, ρ − w·x);  θ = (w, ρ)
        rho = theta[d]
        v, dv = _smooth_hinge(rho - f, mu)
        s = 1.0 / (nu * n)
        g[:d] = -s * (dv @ x)
        g[d] = s * dv.sum()
        return s * v.sum(), g
    if kind == "nu_svc":               # (1/n) Σ max(0, ρ − y(w·x + b));  θ = (w, b, ρ)
        b, rho = theta[d], theta[d + 1]
        v, dv = _smooth_hinge(rho - y * (f + b), mu)
        s = 1.0 / n
        g[:d] = -s * ((dv * y) @ x)
        g[d] = -s * (dv * y).sum()
        g[d + 1] = s * dv.sum()
        return s * v.sum(), g
    if kind == "epsilon_svr":          # C Σ max(0, |y − f − b| − ε);  θ = (w, b)
        b = theta[d]
        r = y - f - b
        v1, d1 = _smooth_hinge(r - eps, mu)
        v2, d2 = _smooth_hinge(-r - eps, mu)
        dr = d1 - d2                   # d/dr
        g[:d] = -C * (dr @ x)
        g[d] = -C * dr.sum()
        return C * (v1 + v2).sum(), g
    if kind == "nu_svr":               # C (ν n ε + Σ max(0, |y − f − b| − ε));  θ = (w, b, ε)
        b, e = theta[d], theta[d + 1]
        r = y - f - b
        v1, d1 = _smooth_hinge(r - e, mu)
        v2, d2 = _smooth_hinge(-r - e, mu)
        g[:d] = -C * ((d1 - d2) @ x)
        g[d] = -C * (d1 - d2).sum()
        g[d + 1] = -C * (d1 + d2).sum()
        return C * (v1 + v2).sum(), g
    raise ValueError(kind)


def _regulariser(kind: str, theta: np.ndarray, d: int, C: float, nu: float, n: float) -> tuple[float, np.ndarray]:
    w = theta[:d]
    val = 0.5 * float(w @ w)
    g = np.zeros_like(theta)
    g[:d] = w
    if kind == "one_class":
        val -= theta[d]
        g[d] -= 1.0
    elif kind == "nu_svc":
        val -= nu * theta[d + 1]
        g[d + 1] -= nu
    elif kind == "nu_svr":
        val += C * nu * n * theta[d + 1]
        g[d + 1] += C * nu * n
    return val, g


def primal_fit(df: DataFrame, kind: str, *, features: str = "features", label: str = "label",
               C: float = 1.0, nu: float = 0.5, eps: float = 0.1, max_iter: int = 500,
               mus: tuple[float, ...] = (1.0, 0.1, 0.01), tol: float = 1e-6) -> np.ndarray:
    """W-2 (nu_svc), W-3 (one_class), W-4 (epsilon_svr), W-5 (nu_svr) in the primal,
    linear in ``features`` (use :func:`random_fourier_features` for RBF).

    L-BFGS on the driver over a smoothed objective with decreasing smoothing; every
    function evaluation is one aggregation over the persisted rows: tasks reduce their
    rows to one gradient (``mapInArrow``), Spark sums the gradients by position, and only
    that sum reaches the driver.  Runs until the objective changes by less than ``tol``
    relative to itself; raises if ``max_iter`` does not suffice.  Rows shorter than the
    longest are padded with 0.
    Returns θ: (w, ρ) one-class, (w, b, ρ) ν-SVC, (w, b) ε-SVR, (w, b, ε) ν-SVR."""
    others = {"y": "f8"}
    data = packed(df.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y")), others).persist()
    size = data.agg(F.sum("n").alias("n"), F.max("width").alias("d")).first()
    if not size.n:
        raise ValueError("no rows to fit")
    n, d = float(size.n), int(size.d)
    extra = {"one_class": 1, "nu_svc": 2, "epsilon_svr": 1, "nu_svr": 2}[kind]
    theta, tasks = np.zeros(d + extra), _tasks(data)

    def evaluate(th: np.ndarray, mu: float) -> tuple[float, np.ndarray]:
        def block_sum(x, y):
            v, g = _objective_parts(kind, x, y, th, mu, C, nu, eps, n)
            return np.append(g, v)

        got = _summed_blocks(data, others, d, block_sum, len(th) + 1, tasks)
        rv, rg = _regulariser(kind, th, d, C, nu, n)
        return got[-1] + rv, got[:-1] + rg

    try:
        for mu in mus:
            theta = _lbfgs(lambda th, mu=mu: evaluate(th, mu), theta, max_iter, tol)
    finally:
        data.unpersist()
    return theta


def _lbfgs(evaluate, theta: np.ndarray, max_iter: int, tol: float, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with step halving.  A step that does not lower the objective is
    never taken: after a failed search along the quasi-Newton direction the curvature pairs
    are dropped and steepest descent is tried once; if that fails too, the point stands."""
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    value, grad = evaluate(theta)
    for _ in range(max_iter):
        direction = _two_loop(pairs, grad)
        slope = grad @ direction
        if slope >= 0:
            pairs, direction, slope = [], -grad, -(grad @ grad)
        step, moved = (1.0 if pairs else min(1.0, 1.0 / max(1e-12, np.abs(grad).sum()))), None
        while step >= 1e-10:
            v, g = evaluate(theta + step * direction)
            if v <= value + 1e-4 * step * slope:
                moved = (theta + step * direction, v, g)
                break
            step *= 0.5
        if moved is None:
            if not pairs:
                return theta
            pairs = []
            continue
        s, y = moved[0] - theta, moved[2] - grad
        if y @ s > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = value - moved[1] <= tol * max(1.0, abs(value))
        theta, value, grad = moved
        if done:
            return theta
    raise RuntimeError(f"no convergence in {max_iter} iterations")


def _two_loop(pairs, grad: np.ndarray) -> np.ndarray:
    """The quasi-Newton direction of the curvature pairs."""
    q, used = -grad, []
    for s, y in reversed(pairs):
        a = (s @ q) / (y @ s)
        used.append(a)
        q = q - a * y
    if pairs:
        s, y = pairs[-1]
        q = q * (s @ y) / (y @ y)
    for (s, y), a in zip(pairs, reversed(used), strict=True):
        q = q + s * (a - (y @ q) / (y @ s))
    return q


# ------------------------------------------------ W-8 out-of-fold Platt inputs
def out_of_fold_decisions(df: DataFrame, fit_fn, *, n_folds: int = 5, rid: str = "rid",
                          features: str = "features", label: str = "label", seed: int = 1) -> DataFrame:
    """W-8: decision values of every row from the model fitted without its fold
    (plain shuffled folds, E-3), signs aligned so that positive favours the label
    > 0 class.  ``fit_fn(train_df) -> SvmModel`` is called once per fold; a fold
    whose training part holds one class only gets the constant ±1 decision.
    Returns (rid, label, dec)."""
    from kestrel.operators import svm as V
    from kestrel.operators.folds import plain_folds

    from kestrel.sources.model_io import scratch_path

    dealt = plain_folds(df.select(rid, label, features), n_folds, rid=rid, seed=seed)
    path = scratch_path(df.sparkSession, "platt-folds")
    dealt.write.parquet(path)
    rows = df.sparkSession.read.schema(dealt.schema).parquet(path)
    positive = F.col(label) > 0
    sides = {r.fold: (r.pos, r.neg) for r in rows.groupBy("fold").agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")).collect()}

    def of_fold(f: int) -> DataFrame | None:
        test = rows.where(F.col("fold") == f)
        pos, neg = (sum(n[i] for g, n in sides.items() if g != f) for i in (0, 1))
        if not pos and not neg:
            return None
        if not neg or not pos:
            return test.select(rid, label, F.lit(1.0 if pos else -1.0).alias("dec"))
        model = fit_fn(rows.where(F.col("fold") != f))
        sign = 1.0 if model.labels and model.labels[0] > 0 else -1.0
        scored = V.score_arrow(test, model, features=features, keep=(rid, label), with_decisions=True)
        return scored.select(rid, label, (F.element_at("dec", 1) * sign).alias("dec"))

    with ThreadPoolExecutor(n_folds) as pool:
        parts = [p for p in pool.map(of_fold, range(n_folds)) if p is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def probability_fit(df: DataFrame, fit_fn, **kw) -> tuple[float, float]:
    """W-7 over W-8: Platt parameters from out-of-fold decision values."""
    dec = out_of_fold_decisions(df, fit_fn, **kw)
    return platt_fit(dec, dec="dec", label=kw.get("label", "label"))
