"""G-3: hidden naive Bayes.

Each attribute gets a hidden parent mixing one-dependence estimates:

    P(c | x) ∝ P(c) · Π_i Σ_{j≠i} W_ij · P(x_i | x_j, c)
    W_ij = I(A_i; A_j | C) / Σ_{j'≠i} I(A_i; A_j' | C)      (uniform when the sum is 0)

with Laplace estimates
    P(c) = (F(c)+1)/(N+K),   P(a_i | a_j, c) = (F(c,a_i,a_j)+1)/(F(c,a_j)+|A_i|)
and the conditional mutual information taken over
    P(a_i,a_j,c) = (F(c,a_i,a_j)+1)/(N+K|A_i||A_j|),  P(a_i,a_j|c) = (F(c,a_i,a_j)+1)/(F(c)+|A_i||A_j|),
    P(a_i|c) = (F(c,a_i)+1)/(F(c)+|A_i|).

The data-sized work — every pair count F(c, a_i, a_j) — is one ``count_families``
aggregation (families (i | j) for all ordered pairs).  The model (bounded by
K · Σ|A_i||A_j|) is then assembled with NumPy and scored by a narrow Arrow map.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from kestrel.functions.arrays import MAX_LITERAL_CELLS
from kestrel.operators.counts import Family, count_families
from kestrel.sources.nominal import NominalData


@dataclass
class HnbModel:
    attrs: tuple[str, ...]
    cards: tuple[int, ...]
    n_classes: int
    log_prior: np.ndarray            # K
    weights: np.ndarray              # d x d (W_ij, zero diagonal)
    cond: dict                       # (i, j) -> K x |A_j| x |A_i| array of P(a_i | a_j, c)


def fit_hnb(data: NominalData) -> HnbModel:
    d, k, cards = data.d, data.n_classes, data.cards
    size = k * sum(cards[i] * cards[j] for i in range(d) for j in range(d) if i != j)
    if size > MAX_LITERAL_CELLS:
        raise ValueError(f"hidden naive Bayes model of {size} cells is too large")
    # component ids: 0 = class counts, 1 + i = (i | -), 1 + d + i*d + j = (i | j)
    fams = [(0, Family(-1, ()))] + [(1 + i, Family(i, ())) for i in range(d)] + \
        [(1 + d + i * d + j, Family(i, (j,))) for i in range(d) for j in range(d) if i != j]
    cnt = count_families(data, fams).toPandas()
    fc = np.zeros(k)
    f1 = {i: np.zeros((k, cards[i])) for i in range(d)}
    f2 = {(i, j): np.zeros((k, cards[j], cards[i])) for i in range(d) for j in range(d) if i != j}
    for r in cnt.itertuples():
        if r.component == 0:
            fc[r.cls] += r.n
        elif r.component <= d:
            f1[r.att][r.cls, r.v] += r.n
        else:
            j = (r.component - 1 - d) % d
            f2[(r.att, j)][r.cls, r.pidx, r.v] += r.n
    n = fc.sum()
    log_prior = np.log((fc + 1.0) / (n + k))
    cmi = np.zeros((d, d))
    cond = {}
    for (i, j), t in f2.items():
        ci, cj = cards[i], cards[j]
        pj = (t + 1.0) / (n + k * ci * cj)
        pcond = (t + 1.0) / (fc[:, None, None] + ci * cj)
        pi_c = (f1[i] + 1.0) / (fc[:, None] + ci)                  # K x |Ai|
        pj_c = (f1[j] + 1.0) / (fc[:, None] + cj)                  # K x |Aj|
        cmi[i, j] = float((pj * np.log(pcond / (pi_c[:, None, :] * pj_c[:, :, None]))).sum())
        cond[(i, j)] = (t + 1.0) / (t.sum(axis=2, keepdims=True) + ci)
    w = np.zeros((d, d))
    for i in range(d):
        s = sum(cmi[i, j] for j in range(d) if j != i)
        for j in range(d):
            if j != i:
                w[i, j] = cmi[i, j] / s if s > 0 else 1.0 / (d - 1)
    return HnbModel(data.attrs, cards, k, log_prior, w, cond)


def score_hnb(df: DataFrame, model: HnbModel, keep: tuple[str, ...] = ("rid",)) -> DataFrame:
    """(keep..., probability ARRAY<DOUBLE>, prediction INT), narrow Arrow map."""
    import pandas as pd

    d, k = len(model.attrs), model.n_classes
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{c} {fields[c]}" for c in keep] + ["probability array<double>", "prediction int"])

    def run(batches):
        for pdf in batches:
            x = pdf[list(model.attrs)].to_numpy(dtype=np.int64)
            nrow = len(pdf)
            logp = np.tile(model.log_prior, (nrow, 1))
            for i in range(d):
                s = np.zeros((nrow, k))
                for j in range(d):
                    if j != i:
                        t = model.cond[(i, j)]                     # K x |Aj| x |Ai|
                        s += model.weights[i, j] * t[:, x[:, j], x[:, i]].T
                logp += np.log(s)
            e = np.exp(logp - logp.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            out = pd.DataFrame({c: pdf[c].to_numpy() for c in keep})
            out["probability"] = list(p)
            out["prediction"] = p.argmax(axis=1).astype(np.int32)
            yield out

    return df.select(*dict.fromkeys([*keep, *model.attrs])).mapInPandas(run, schema)
