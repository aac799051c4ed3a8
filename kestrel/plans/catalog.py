"""The query catalogue: one Spark query per operator of the inventory, each with its
DuckDB restatement.  ``__spark_entry__`` exposes both dictionaries.

Every query reads the driver tables (through the ``ninst`` / ``linst`` views or
directly) and runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators import counts as C
from kestrel.operators import structures as S
from kestrel.plans import oracle as O
from kestrel.sources import nominal as N
from kestrel.sources.tables import TABLES, read_table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# Fixed parameters of the catalogue queries.
DIST_SIZE, DIST_PARENTS = 10, 3          # distributed counting job (commented config)
RBNC_SIZE, RBNC_PARENTS = 20, 2          # standalone ensemble defaults
SEED = 0


def attributes(data: N.NominalData) -> DataFrame:
    """Attribute list of a nominal dataset, from a domain scan (IO-2)."""
    return N.domain_table(data.df, list(data.attrs)).select("att").distinct()


def declared_attributes(data: N.NominalData) -> DataFrame:
    """Attribute list from the declared schema (no pass over the data); used where
    the structure only feeds a job that reads the data anyway."""
    return data.df.sparkSession.range(data.d).select(F.col("id").cast("int").alias("att"))


# ------------------------------------------------------------------ sources (IO-*)
register("domain_table", """
SELECT CAST(att AS INTEGER) AS att, name, value,
       CAST(dense_rank() OVER (PARTITION BY att ORDER BY value) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT 0 AS att, 'o_orderstatus' AS name, o_orderstatus AS value FROM orders
      UNION SELECT DISTINCT 1, 'o_orderpriority', o_orderpriority FROM orders
      UNION SELECT DISTINCT 2, 'c_mktsegment', c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey) t
""")(lambda spark, sf: N.domain_table(
    read_table(spark, sf, "orders").join(read_table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")),
    ["o_orderstatus", "o_orderpriority", "c_mktsegment"]))


@register("nominal_parse", O.with_view("ninst") + "\nSELECT rid, a0, a1, a2, a3, a4, cls FROM ninst")
def _nominal_parse(spark, sf):
    data = view(spark, sf, "ninst")
    text = N.to_nominal_text(data, sep=" ,\t")
    return N.parse_nominal_text(text, data.d, keep=("rid",))


# ------------------------------------------------------------- structures (B-1..B-3)
def _struct_q(kind: str, view_name: str, size: int, m: int):
    gen = {"fixed": S.random_structure_fixed, "shuffled": S.random_structure_shuffled,
           "free": S.random_structure_free}[kind]
    sqlgen = {"fixed": O.structure_fixed_ctes, "shuffled": O.structure_shuffled_ctes,
              "free": O.structure_free_ctes}[kind]
    d = len(O.meta(view_name)[0])

    def q(spark, sf):
        data = view(spark, sf, view_name)
        return gen(attributes(data), data.d, size=size, max_parents=m, seed=SEED)

    sql = O.with_view(view_name, O.atts_cte(view_name), *sqlgen(d, size, m, SEED)) + \
        "\nSELECT component, att, parents FROM struct"
    return q, sql


for _kind in ("fixed", "shuffled", "free"):
    _q, _sql = _struct_q(_kind, "ninst", RBNC_SIZE, RBNC_PARENTS)
    register(f"random_structure_{_kind}", _sql)(_q)


# ------------------------------------------------------------------ counts (C-1..C-5)
def _rbnc_counts(class_digit: bool):
    d = len(O.meta("ninst")[0])

    def q(spark, sf):
        data = view(spark, sf, "ninst")
        st = S.random_structure_fixed(declared_attributes(data), data.d, DIST_SIZE, DIST_PARENTS, SEED)
        return C.count_structure(data, st, include_class_digit=class_digit)

    sql = O.with_view("ninst", O.inst_cte("ninst"), O.atts_cte("ninst"),
                      *O.structure_fixed_ctes(d, DIST_SIZE, DIST_PARENTS, SEED),
                      *O.count_ctes("ninst", class_digit=class_digit)) + \
        "\nSELECT component, att, cls, pidx, v, n FROM cpt"
    return q, sql


_q, _sql = _rbnc_counts(False)
register("rbnc_counts", _sql)(_q)
_q, _sql = _rbnc_counts(True)
register("rbnc_counts_compat", _sql)(_q)


@register("class_counts", O.with_view("linst") +
          "\nSELECT cls, sum(weight) AS n FROM linst GROUP BY cls")
def _class_counts(spark, sf):
    return C.class_counts(view(spark, sf, "linst"))


@register("counts_merge", O.with_view("ninst", O.inst_cte("ninst"), O.atts_cte("ninst"),
                                      *O.structure_fixed_ctes(5, DIST_SIZE, DIST_PARENTS, SEED),
                                      *O.count_ctes("ninst")) +
          "\nSELECT component, att, cls, pidx, v, n FROM cpt")
def _counts_merge(spark, sf):
    """C-2: count two disjoint parts (orders before / from 1998) and merge."""
    data = view(spark, sf, "ninst")
    st = S.random_structure_fixed(declared_attributes(data), data.d, DIST_SIZE, DIST_PARENTS, SEED)
    fams = C.families_from_structure(C.collect_structure(st), data.d)
    early = read_table(spark, sf, "orders").where(F.year("o_orderdate") < 1998).select(
        F.col("o_orderkey").alias("rid"))
    a = data.with_df(data.df.join(early, "rid", "left_semi"))
    b = data.with_df(data.df.join(early, "rid", "left_anti"))
    return C.merge_counts(C.count_families(a, fams), C.count_families(b, fams))


def _ande_counts_sql(view_name: str, n_dep: int) -> str:
    d = len(O.meta(view_name)[0])
    struct = (f"struct AS (SELECT component, att, list_append(ap, {d})::INTEGER[] AS parents FROM tabs "
              "WHERE component >= 0 AND att >= 0)")
    return O.with_view(view_name, O.inst_cte(view_name), O.Ande(n_dep).tabs(view_name), struct, *O.count_ctes(view_name)) + \
        "\nSELECT component, att, cls, pidx, v, n FROM cpt"


def _ande_counts(view_name: str, n_dep: int):
    def q(spark, sf):
        data = view(spark, sf, view_name)
        fams = [(c, f) for c, f in C.anDE_families(data.d, n_dep) if f.att >= 0]
        return C.count_families(data, fams)
    return q


register("a1de_counts", _ande_counts_sql("ninst", 1))(_ande_counts("ninst", 1))
register("a2de_counts", _ande_counts_sql("linst", 2))(_ande_counts("linst", 2))


@register("superparent_freq", O.with_view("linst") + """
SELECT [CAST(s AS INTEGER)] AS sp, code, cls, sum(weight) AS n FROM (
  SELECT 0 AS s, a0 AS code, cls, weight FROM linst UNION ALL
  SELECT 1, a1, cls, weight FROM linst UNION ALL SELECT 2, a2, cls, weight FROM linst UNION ALL
  SELECT 3, a3, cls, weight FROM linst UNION ALL SELECT 4, a4, cls, weight FROM linst) t
GROUP BY s, code, cls""")
def _superparent_freq(spark, sf):
    return C.superparent_counts(view(spark, sf, "linst"), 1)


# ------------------------------------------------------- Bayes scoring (A-*, B-4..6, G-*)
from kestrel.operators import bayes as B  # noqa: E402


def _sql_spec(n_dep: int, m_estimate: bool = False, m: float = 1.0, limit: float | None = 1.0, joint: bool = True) -> O.Ande:
    """The model of the same parameters as the oracle states it."""
    return O.Ande(n_dep, m if m_estimate else None, limit if n_dep else None, joint)


def _ande_score_q(view_name: str, **kw):
    def q(spark, sf):
        data = view(spark, sf, view_name)
        spec = B.ande_spec(data, **kw)
        model = B.fit(data, spec)
        return B.long_probabilities(B.score(data.df, model))
    return q


for _name, _view, _kw in [
    ("nb_score", "ninst", dict(n_dep=0)),
    ("a1de_score", "ninst", dict(n_dep=1)),
    ("a1de_mest_score", "ninst", dict(n_dep=1, m_estimate=True, m=1.0)),
    ("a2de_score", "linst", dict(n_dep=2)),
    ("freq_limit_score", "linst", dict(n_dep=1, limit=1500.0)),
    ("spnde_norm_score", "linst", dict(n_dep=1, limit=1500.0, joint=False)),
]:
    register(_name, O.bayes_score_sql(_view, _sql_spec(**_kw)))(_ande_score_q(_view, **_kw))


@register("predict_argmax", O.bayes_score_sql(
    "ninst", _sql_spec(n_dep=1),
    final="""SELECT rid, CAST(arg_max(cls, prob) AS INTEGER) AS prediction FROM (
  SELECT rid, cls, prob, row_number() OVER (PARTITION BY rid ORDER BY prob DESC, cls) AS r FROM probs) t
WHERE r = 1 GROUP BY rid"""))
def _predict_argmax(spark, sf):
    data = view(spark, sf, "ninst")
    model = B.fit(data, B.ande_spec(data, n_dep=1))
    return B.score(data.df, model).select("rid", "prediction")


def _rbnc_sql(view_name: str, size: int, m: int, alpha: float) -> str:
    """RBNC oracle: the B-2 structure in SQL, its tables as rows of ``tabs``."""
    attrs, cards, k = O.meta(view_name)
    d = len(attrs)
    tabs = f"""tabs AS (
  SELECT CAST(row_number() OVER (ORDER BY component, att) - 1 AS INTEGER) AS tid, component, att,
         list_filter(parents, lambda p: p <> {d}) AS ap,
         CAST(list_reduce(list_transform(list_filter(parents, lambda p: p <> {d}), lambda p: {O.cards_sql(view_name)}[p + 1]),
                     lambda a, b: a * b, 1) AS INTEGER) AS S,
         {O.cards_sql(view_name)}[att + 1] AS card, {alpha!r} AS a0, FALSE AS prior, FALSE AS cn
  FROM struct WHERE att < {d}
  UNION ALL SELECT 100000, -1, -1, []::INTEGER[], 1, 1, {alpha!r}, TRUE, FALSE)"""
    spec = B.BayesSpec(attrs, cards, k, [], size, B.SOFTMAX_AVG, class_prior=100000)
    model = O.bayes_model_ctes(view_name, spec)[1:]   # counting/estimation over ``tabs``
    return O.with_view(view_name, O.inst_cte(view_name), O.atts_cte(view_name),
                       *O.structure_shuffled_ctes(d, size, m, SEED), tabs, *model,
                       O.bayes_terms_cte(view_name, spec), *O.bayes_prob_ctes(spec, k)) + \
        "\nSELECT rid, CAST(cls AS INTEGER) AS cls, round(prob, 6) AS prob FROM probs"


@register("rbnc_score", _rbnc_sql("ninst", RBNC_SIZE, RBNC_PARENTS, 0.5))
def _rbnc_score(spark, sf):
    data = view(spark, sf, "ninst")
    st = S.random_structure_shuffled(declared_attributes(data), data.d, RBNC_SIZE, RBNC_PARENTS, SEED)
    model = B.fit(data, B.rbnc_spec(data, C.collect_structure(st), alpha=0.5))
    return B.long_probabilities(B.score(data.df, model))


# ------------------------------------------------------------- folds and CV (E-*)
from kestrel.operators import evaluate as E  # noqa: E402
from kestrel.operators import folds as FO  # noqa: E402

CV_REPEATS, CV_FOLDS, CV_SEED = 10, 10, 1


@register("folds_interleaved", O.with_view("ninst", O.inst_cte("ninst"),
                                           *O.interleaved_folds_ctes("ninst", CV_REPEATS, CV_FOLDS, CV_SEED)) +
          "\nSELECT rep, rid, cls, fold FROM fi")
def _folds_interleaved(spark, sf):
    data = view(spark, sf, "ninst")
    rows = FO.interleaved_folds(FO.with_repeats(data.df.select("rid", "cls"), CV_REPEATS), CV_FOLDS,
                                rep="rep", seed=CV_SEED)
    return rows.select("rep", "rid", "cls", "fold")


def _rank_sql(view_name: str, part: str, k: int) -> str:
    hk = O.h_sql(str(CV_SEED), "rid")
    return O.with_view(view_name) + f"""
SELECT rid, CAST(({k} * (r + 1) + n - 1) // n - 1 AS INTEGER) AS fold FROM (
  SELECT rid, row_number() OVER (PARTITION BY {part} ORDER BY {hk}, rid) - 1 AS r,
         count(*) OVER (PARTITION BY {part}) AS n FROM {view_name}) t"""


@register("folds_proportional", _rank_sql("linst", "cls", 5))
def _folds_proportional(spark, sf):
    data = view(spark, sf, "linst")
    return FO.proportional_folds(data.df.select("rid", "cls"), 5, seed=CV_SEED).select("rid", "fold")


@register("folds_plain", _rank_sql("linst", "1", 5))
def _folds_plain(spark, sf):
    data = view(spark, sf, "linst")
    return FO.plain_folds(data.df.select("rid"), 5, seed=CV_SEED).select("rid", "fold")


def _cv_q(name: str, n_dep: int):
    def q(spark, sf):
        data = view(spark, sf, "ninst")
        s = E.cv_summary(data, lambda d: B.ande_spec(d, n_dep=n_dep), name,
                         repeats=CV_REPEATS, folds=CV_FOLDS, seed=CV_SEED)
        return s.select("model", F.round("acc_mean", 6).alias("acc_mean"), F.round("acc_std", 6).alias("acc_std"))
    return q


register("cv_nb_accuracy", O.cv_sql("ninst", _sql_spec(n_dep=0), "nb",
                                    CV_REPEATS, CV_FOLDS, CV_SEED))(_cv_q("nb", 0))
register("cv_a1de_accuracy", O.cv_sql("ninst", _sql_spec(n_dep=1), "a1de",
                                      CV_REPEATS, CV_FOLDS, CV_SEED))(_cv_q("a1de", 1))


def _comparison_sql() -> str:
    parts = []
    for name, n_dep in (("nb", 0), ("a1de", 1)):
        q = O.cv_sql("ninst", _sql_spec(n_dep=n_dep), name, CV_REPEATS, CV_FOLDS, CV_SEED)
        parts.append(f"{name}_s AS ({q})")
    cell = ("CAST(round(acc_mean * 100, 2) AS VARCHAR) || ':' || CAST(round(acc_std * 100, 2) AS VARCHAR)")
    return ("WITH " + ",\n".join(parts) + f"""
SELECT 'ninst' AS dataset, a.c AS m_nb, b.c AS m_a1de, 'ninst, ' || a.c || ', ' || b.c || ', ' AS report
FROM (SELECT {cell} AS c FROM nb_s) a, (SELECT {cell} AS c FROM a1de_s) b""")


@register("comparison_matrix", _comparison_sql())
def _comparison_matrix(spark, sf):
    data = view(spark, sf, "ninst")
    rows = E.cv_rows(data, CV_REPEATS, CV_FOLDS, CV_SEED, tuples=True)  # one set of folds for all models
    sums = [E.cv_summary(data, lambda d, n=n: B.ande_spec(d, n_dep=n), name, rows=rows,
                         repeats=CV_REPEATS, folds=CV_FOLDS, seed=CV_SEED) for name, n in (("nb", 0), ("a1de", 1))]
    allm = sums[0].unionByName(sums[1]).select(
        F.lit("ninst").alias("dataset"), "model", F.round("acc_mean", 6).alias("acc_mean"),
        F.round("acc_std", 6).alias("acc_std"))
    return E.comparison_matrix(allm, ["nb", "a1de"])


# ------------------------------------------------------------------ SVM scoring (V-*)
import numpy as np  # noqa: E402

from kestrel.operators import svm as V  # noqa: E402
from kestrel.sources import svmlight as L  # noqa: E402

SVM_RHO_ONE_CLASS, SVM_RHO_SVR = 0.01, 0.0
POLY = dict(degree=3, coef0=1.0)
SIGM = dict(coef0=0.0)
PLATT_A, PLATT_B = -2.0, 0.1


def emb(spark, sf):
    return read_table(spark, sf, "embeddings").select(
        F.col("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("features"))


def _model(spark, sf, svm_type="c_svc", kernel="rbf", rho=0.0, **kw):
    return V.centroid_model(emb(spark, sf), "label", "features", svm_type=svm_type, kernel_type=kernel,
                            rho=rho, **kw)


SVM_BASE_SQL = """ex AS (SELECT vec_id, label, unnest(range(len(embedding))) AS pos,
                CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
dims AS (SELECT max(pos) + 1 AS dim FROM ex),
cen AS (SELECT label, pos, avg(x) AS c FROM ex GROUP BY label, pos),
labs AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS sv,
                count(*) OVER () AS k, avg(label) OVER () AS mlab FROM (SELECT DISTINCT label FROM embeddings) t),
raw AS (SELECT e.vec_id, l.sv, sum(e.x * c.c) AS dot, sum((e.x - c.c) * (e.x - c.c)) AS sq
        FROM ex e JOIN cen c ON e.pos = c.pos JOIN labs l ON c.label = l.label GROUP BY e.vec_id, l.sv)"""


def _kernel_sql(kind: str) -> str:
    g = "(1.0 / (SELECT dim FROM dims))"
    return {"linear": "dot", "rbf": f"exp(-{g} * sq)",
            "polynomial": f"pow({g} * dot + {POLY['coef0']}, {POLY['degree']})",
            "sigmoid": f"tanh({g} * dot + {SIGM['coef0']})"}[kind]


def _svm_sql(kind: str, final: str) -> str:
    return f"WITH {SVM_BASE_SQL},\nkv AS (SELECT vec_id, sv, {_kernel_sql(kind)} AS k FROM raw)\n{final}"


def _kernel_q(kind: str, precomputed: bool = False):
    def q(spark, sf):
        extra = POLY if kind == "polynomial" else SIGM if kind == "sigmoid" else {}
        m = _model(spark, sf, kernel=kind, **extra)
        x = F.col("features")
        dim = m.sv.shape[1]
        svs = V.const_doubles(m.sv.reshape(-1))
        kv = F.transform(F.sequence(F.lit(0), F.lit(m.l - 1)),
                         lambda j: V.kernel_expr(m, x, F.slice(svs, j * dim + 1, dim)))
        df = emb(spark, sf)
        if precomputed:
            # the kernel row as the precomputed representation: [serial, K(x, sv_1..l)]
            pre = F.concat(F.array((F.col("vec_id") + 1).cast("double")), kv)
            mp = V.SvmModel("c_svc", "precomputed", np.arange(1, m.l + 1, dtype=float)[:, None],
                            m.sv_coef, m.rho, m.labels, m.n_sv)
            kv = F.transform(F.sequence(F.lit(1), F.lit(m.l)),
                             lambda j: V.kernel_expr(mp, F.col("_pre"), F.array(j.cast("double"))))
            df = df.withColumn("_pre", pre)
        return df.select("vec_id", F.posexplode_outer(kv).alias("sv", "k")).select(
            "vec_id", F.col("sv").cast("int"), F.round("k", 6).alias("k"))
    return q


for _kind in ("linear", "polynomial", "rbf", "sigmoid"):
    register(f"kernel_{_kind}", _svm_sql(_kind, "SELECT vec_id, sv, round(k, 6) AS k FROM kv"))(_kernel_q(_kind))
register("kernel_precomputed", _svm_sql("rbf", "SELECT vec_id, sv, round(k, 6) AS k FROM kv"))(
    _kernel_q("rbf", precomputed=True))

_ONECLASS_DEC = f"""dec AS (SELECT kv.vec_id, sum((l.label - l.mlab) / l.k * kv.k) - {{rho}} AS d
  FROM kv JOIN labs l ON kv.sv = l.sv GROUP BY kv.vec_id)"""


@register("oneclass_score", _svm_sql("rbf", "," + _ONECLASS_DEC.format(rho=SVM_RHO_ONE_CLASS) +
                                     "\nSELECT vec_id AS id, CAST(CASE WHEN d > 0 THEN 1.0 ELSE -1.0 END AS DOUBLE) AS prediction FROM dec"))
def _oneclass_score(spark, sf):
    m = _model(spark, sf, "one_class", "rbf", SVM_RHO_ONE_CLASS)
    dec = V.decision_values_sql(emb(spark, sf).withColumnRenamed("vec_id", "id"), m)
    return dec.select("id", V.predict_from_decisions_sql(F.col("dec"), m).alias("prediction"))


@register("score_batch_arrow", ORACLE["oneclass_score"])
def _score_batch_arrow(spark, sf):
    m = _model(spark, sf, "one_class", "rbf", SVM_RHO_ONE_CLASS)
    return V.score_arrow(emb(spark, sf).withColumnRenamed("vec_id", "id"), m)


@register("score_counters", _svm_sql("rbf", "," + _ONECLASS_DEC.format(rho=SVM_RHO_ONE_CLASS) + """
SELECT count(*) AS n_instances, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive FROM dec"""))
def _score_counters(spark, sf):
    m = _model(spark, sf, "one_class", "rbf", SVM_RHO_ONE_CLASS)
    return V.score_counters(V.score_arrow(emb(spark, sf).withColumnRenamed("vec_id", "id"), m))


@register("svr_score", _svm_sql("linear", "," + _ONECLASS_DEC.format(rho=SVM_RHO_SVR) +
                                "\nSELECT vec_id AS id, round(d, 6) AS prediction FROM dec"))
def _svr_score(spark, sf):
    m = _model(spark, sf, "epsilon_svr", "linear", SVM_RHO_SVR)
    return V.score_arrow(emb(spark, sf).withColumnRenamed("vec_id", "id"), m).select(
        "id", F.round("prediction", 6).alias("prediction"))


_OVO_DEC = """pairs AS (SELECT a.sv AS i, b.sv AS j,
    CAST(a.sv * a.k - a.sv * (a.sv + 1) / 2 + (b.sv - a.sv - 1) AS INTEGER) AS pair
  FROM labs a JOIN labs b ON a.sv < b.sv),
dec AS (SELECT k1.vec_id, p.pair, p.i, p.j, k1.k - k2.k - 0.0 AS d
  FROM kv k1 JOIN kv k2 ON k1.vec_id = k2.vec_id JOIN pairs p ON k1.sv = p.i AND k2.sv = p.j)"""


@register("ovo_decision", _svm_sql("rbf", "," + _OVO_DEC + "\nSELECT vec_id AS id, pair, round(d, 6) AS dec FROM dec"))
def _ovo_decision(spark, sf):
    m = _model(spark, sf)
    dec = V.decision_values_sql(emb(spark, sf).withColumnRenamed("vec_id", "id"), m)
    return dec.select("id", F.posexplode_outer("dec").alias("pair", "dec")).select(
        "id", F.col("pair").cast("int"), F.round("dec", 6).alias("dec"))


@register("ovo_vote", _svm_sql("rbf", "," + _OVO_DEC + """,
votes AS (SELECT vec_id, CASE WHEN d > 0 THEN i ELSE j END AS w, count(*) AS n FROM dec GROUP BY vec_id, w),
best AS (SELECT vec_id, w, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, w) AS r FROM votes)
SELECT b.vec_id AS id, CAST(l.label AS DOUBLE) AS prediction FROM best b JOIN labs l ON b.w = l.sv WHERE r = 1"""))
def _ovo_vote(spark, sf):
    m = _model(spark, sf)
    return V.score_arrow(emb(spark, sf).withColumnRenamed("vec_id", "id"), m)


@register("platt_prob", _svm_sql("rbf", "," + _OVO_DEC + f""",
z AS (SELECT vec_id, pair, d * {PLATT_A} + {PLATT_B} AS z FROM dec)
SELECT vec_id AS id, pair, round(CASE WHEN z >= 0 THEN exp(-z) / (1 + exp(-z)) ELSE 1 / (1 + exp(z)) END, 6) AS prob
FROM z"""))
def _platt_prob(spark, sf):
    m = _model(spark, sf)
    dec = V.decision_values_sql(emb(spark, sf).withColumnRenamed("vec_id", "id"), m)
    return dec.select("id", F.posexplode_outer("dec").alias("pair", "d")).select(
        "id", F.col("pair").cast("int"), F.round(V.platt_probability(F.col("d"), PLATT_A, PLATT_B), 6).alias("prob"))


@register("pairwise_prob")
def _pairwise_prob(spark, sf):
    """V-12 / V-13: coupled class probabilities (iterative; rows-only check)."""
    m = _model(spark, sf)
    npair = len(m.rho)
    m = V.with_probability(m, [PLATT_A] * npair, [PLATT_B] * npair)
    out = V.score_arrow(emb(spark, sf).withColumnRenamed("vec_id", "id"), m, probability=True)
    return out.select("id", "prediction", F.transform("probability", lambda p: F.round(p, 6)).alias("probability"))


# ------------------------------------------------------------- svmlight (IO-5/6, P-4)
@register("svmlight_parse", """
WITH ex AS (SELECT vec_id, label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x
            FROM embeddings)
SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label AS DOUBLE) AS label,
       list(CAST(pos + 1 AS INTEGER) ORDER BY pos) FILTER (WHERE x <> 0) AS idx,
       list(round(x, 6) ORDER BY pos) FILTER (WHERE x <> 0) AS val
FROM ex GROUP BY vec_id, label""")
def _svmlight_parse(spark, sf):
    df = emb(spark, sf)
    idx, val = L.dense_to_sparse(F.col("features"))
    sparse = df.select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("double").alias("label"),
                       idx, val)
    text = L.to_svmlight(sparse, id_col="id").select(F.col("value").alias("line"))
    parsed = L.parse_svmlight(text, with_id=True)
    return parsed.select("id", "label", "idx", F.transform("val", lambda v: F.round(v, 6)).alias("val"))


# -------------------------------------------------------------- preprocessing (T-*)
from kestrel.functions.hashing import h_sql  # noqa: E402
from kestrel.operators import prep as P  # noqa: E402

NOISE_RATE, NOISE_SEED = 0.1, 100


def _orders_missing(spark, sf):
    """orders with missing values injected by key (the driver tables hold none)."""
    o = read_table(spark, sf, "orders")
    return o.select("o_orderkey",
                    F.when(F.col("o_orderkey") % 17 == 0, None).otherwise(F.col("o_totalprice")).alias("price"),
                    F.when(F.col("o_orderkey") % 13 == 0, None).otherwise(F.col("o_orderpriority")).alias("priority"))


_OM_SQL = """om AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS price,
                 CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders)"""


@register("impute", f"""WITH {_OM_SQL},
mp AS (SELECT avg(price) AS m FROM om),
md AS (SELECT priority AS m FROM om WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)
SELECT o_orderkey, round(coalesce(price, (SELECT m FROM mp)), 6) AS price, coalesce(priority, (SELECT m FROM md)) AS priority
FROM om""")
def _impute(spark, sf):
    out = P.replace_missing(_orders_missing(spark, sf), ["price"], ["priority"])
    return out.select("o_orderkey", F.round("price", 6).alias("price"), "priority")


@register("equal_width", f"""WITH {_OM_SQL},
mm AS (SELECT min(price) AS mn, max(price) AS mx FROM om)
SELECT o_orderkey, CAST(CASE WHEN price IS NULL THEN NULL
  ELSE least(floor((price - mn) / ((mx - mn) / 10)), 9) END AS INTEGER) AS price
FROM om, mm""")
def _equal_width(spark, sf):
    return P.equal_width(_orders_missing(spark, sf).select("o_orderkey", "price"), ["price"], 10)


_MDL_SQL = """
WITH RECURSIVE v AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS c, unnest([0, 1, 2, 3]) AS att,
    CAST(unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS DOUBLE) AS x FROM lineitem),
h AS (SELECT att, x, count(*) FILTER (c = 0) AS n0, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2 FROM v GROUP BY att, x),
r AS (SELECT att, x, lead(x) OVER w AS nx, CAST(sum(n0) OVER w AS DOUBLE) AS u0, CAST(sum(n1) OVER w AS DOUBLE) AS u1, CAST(sum(n2) OVER w AS DOUBLE) AS u2
      FROM h WINDOW w AS (PARTITION BY att ORDER BY x)),
seg AS (
  SELECT att, CAST('-inf' AS DOUBLE) AS lo, CAST('inf' AS DOUBLE) AS hi, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2,
    CAST(sum(n0) AS DOUBLE) AS a0, CAST(sum(n1) AS DOUBLE) AS a1, CAST(sum(n2) AS DOUBLE) AS a2, CAST(NULL AS DOUBLE) AS cut FROM h GROUP BY att
  UNION ALL
  SELECT att, unnest([lo, m.x]), unnest([m.x, hi]), unnest([b0, m.u0]), unnest([b1, m.u1]), unnest([b2, m.u2]),
    unnest([m.u0, a0]), unnest([m.u1, a1]), unnest([m.u2, a2]), (m.x + m.nx) / 2
  FROM (
    SELECT *, ln(pow(3, kb) - 2) / ln(2) - (kb * hb - kl * hl - kr * hr) AS delta, hb - (nl * hl + nr * hr) / (nl + nr) AS gain
    FROM (
      SELECT *, {ent_b} AS hb, {ent_l} AS hl, {ent_r} AS hr, {k_b} AS kb, {k_l} AS kl, {k_r} AS kr,
        m.u0 - b0 + m.u1 - b1 + m.u2 - b2 AS nl, a0 - m.u0 + a1 - m.u1 + a2 - m.u2 AS nr
      FROM (
        SELECT att, lo, hi, b0, b1, b2, a0, a1, a2, min({{'e': e, 'x': x, 'nx': nx, 'u0': u0, 'u1': u1, 'u2': u2}}) AS m
        FROM (SELECT seg.*, r.x, r.nx, r.u0, r.u1, r.u2, round({bits_l} + {bits_r}, 9) AS e
              FROM seg JOIN r ON r.att = seg.att AND r.x > seg.lo AND r.nx <= seg.hi) c
        GROUP BY att, lo, hi, b0, b1, b2, a0, a1, a2) g) s) t
  WHERE gain > (ln(nl + nr - 1) / ln(2) + delta) / (nl + nr))
"""


def _mdl_sql(final: str) -> str:
    """T-2 by recursion over segments (lo, hi] with their class counts up to lo (b) and to hi (a)."""
    def bits(parts):
        total = " + ".join(f"({p})" for p in parts)
        return "(" + " + ".join(f"CASE WHEN ({p}) > 0 THEN -({p}) * log2(({p}) / ({total})) ELSE 0 END" for p in parts) + ")"

    def entropy(parts):
        return f"({bits(parts)} / ({' + '.join(f'({p})' for p in parts)}))"

    def kinds(parts):
        return "(" + " + ".join(f"CAST(({p}) > 0 AS INTEGER)" for p in parts) + ")"

    both = [f"a{i} - b{i}" for i in range(3)]
    left, right = [f"m.u{i} - b{i}" for i in range(3)], [f"a{i} - m.u{i}" for i in range(3)]
    return _MDL_SQL.format(ent_b=entropy(both), ent_l=entropy(left), ent_r=entropy(right), k_b=kinds(both), k_l=kinds(left), k_r=kinds(right),
                           bits_l=bits([f"r.u{i} - seg.b{i}" for i in range(3)]), bits_r=bits([f"seg.a{i} - r.u{i}" for i in range(3)])) + final


_MDL_CUTS_SQL = "SELECT CAST(att AS INTEGER) AS att, list_sort(list_filter(list(DISTINCT cut), lambda c: c IS NOT NULL)) AS cuts FROM seg GROUP BY att"


@register("mdl_cuts", _mdl_sql(_MDL_CUTS_SQL))
def _mdl_cuts(spark, sf):
    """T-2 on lineitem: numeric columns, class = return flag."""
    li = read_table(spark, sf, "lineitem")
    return P.mdl_cuts(li.withColumn("cls", F.when(F.col("l_returnflag") == "A", 0)
                                   .when(F.col("l_returnflag") == "N", 1).otherwise(2)),
                      ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "cls", 3)


@register("label_noise", O.with_view("ninst") + f"""
, rk AS (SELECT rid, cls, row_number() OVER (ORDER BY {h_sql(str(NOISE_SEED), 'rid')}, rid) - 1 AS r,
              count(*) OVER () AS n,
              CAST('0x' || substr({h_sql(str(NOISE_SEED), "'c'", 'rid')}, 1, 7) AS BIGINT) AS u FROM ninst)
SELECT rid, CAST(CASE WHEN r < floor(n * {NOISE_RATE}) THEN (cls + 1 + u % 2) % 3 ELSE cls END AS INTEGER) AS cls
FROM rk""")
def _label_noise(spark, sf):
    data = view(spark, sf, "ninst")
    return P.label_noise(data.df.select("rid", "cls"), NOISE_RATE, 3, seed=NOISE_SEED)


@register("class_groups", """
SELECT CAST(label AS INTEGER) AS label, CAST(row_number() OVER (ORDER BY min(vec_id)) - 1 AS INTEGER) AS code,
       count(*) AS count FROM embeddings GROUP BY CAST(label AS INTEGER)""")
def _class_groups(spark, sf):
    return P.class_groups(read_table(spark, sf, "embeddings"), "label", "vec_id")


def _li_sparse(spark, sf):
    """lineitem numeric columns as sparse vectors (zeros dropped), label = line number."""
    from kestrel.sources.svmlight import dense_to_sparse
    li = read_table(spark, sf, "lineitem")
    feats = F.array(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax"))
    idx, val = dense_to_sparse(feats)
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
                     F.col("l_linenumber").cast("double").alias("label"), idx, val)


_LI_SQL = """lrows AS (SELECT row_number() OVER () AS rk, * FROM lineitem),
ex AS (SELECT rk, l_orderkey || '-' || l_linenumber AS id, CAST(l_linenumber AS DOUBLE) AS label,
       unnest([1, 2, 3, 4]) AS att, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lrows),
nrows AS (SELECT count(*) AS n FROM lineitem),
per AS (SELECT att, min(v) FILTER (WHERE v <> 0) AS mn, max(v) FILTER (WHERE v <> 0) AS mx,
               count(*) FILTER (WHERE v <> 0) AS cnt FROM ex GROUP BY att),
params AS (SELECT att, CASE WHEN cnt = 0 THEN 0.0 WHEN cnt < (SELECT n FROM nrows) THEN least(mn, 0.0) ELSE mn END AS fmin,
                       CASE WHEN cnt = 0 THEN 0.0 WHEN cnt < (SELECT n FROM nrows) THEN greatest(mx, 0.0) ELSE mx END AS fmax
           FROM per)"""


@register("scale_fit", f"WITH {_LI_SQL}\nSELECT CAST(att AS INTEGER) AS att, round(fmin, 6) AS fmin, round(fmax, 6) AS fmax FROM params")
def _scale_fit(spark, sf):
    params, _ = P.scale_fit(_li_sparse(spark, sf))
    return params.select("att", F.round("fmin", 6).alias("fmin"), F.round("fmax", 6).alias("fmax"))


_SCALE_APPLY_SQL = f"""WITH {_LI_SQL},
sc AS (SELECT e.rk, e.id, e.label, e.att, CASE WHEN e.v = p.fmin THEN -1.0 WHEN e.v = p.fmax THEN 1.0
                 ELSE -1.0 + 2.0 * (e.v - p.fmin) / (p.fmax - p.fmin) END AS s
       FROM ex e JOIN params p ON e.att = p.att WHERE p.fmin <> p.fmax)
SELECT id, label, list(CAST(att AS INTEGER) ORDER BY att) FILTER (WHERE s <> 0) AS idx,
       list(round(s, 6) ORDER BY att) FILTER (WHERE s <> 0) AS val FROM sc GROUP BY rk, id, label"""


@register("scale_apply", _SCALE_APPLY_SQL)
def _scale_apply(spark, sf):
    df = _li_sparse(spark, sf)
    params, _ = P.scale_fit(df)
    out = P.scale_apply(df, params, -1.0, 1.0)
    return out.select("id", "label", "idx", F.transform("val", lambda v: F.round(v, 6)).alias("val"))


@register("scale_restore", _SCALE_APPLY_SQL)
def _scale_restore(spark, sf):
    """IO-10: parameters saved to the text form, restored, then applied."""
    df = _li_sparse(spark, sf)
    params, _ = P.scale_fit(df)
    text = P.save_scaling_text(params, -1.0, 1.0)
    restored, lower, upper, _ = P.restore_scaling_text(spark, text)
    full = params.select("att").join(restored, "att", "left").fillna(0.0)
    out = P.scale_apply(df, full, lower, upper)
    return out.select("id", "label", "idx", F.transform("val", lambda v: F.round(v, 6)).alias("val"))


@register("scale_target", """
WITH mm AS (SELECT min(l_linenumber) AS mn, max(l_linenumber) AS mx FROM lineitem)
SELECT l_orderkey || '-' || l_linenumber AS id,
       round(CASE WHEN l_linenumber = mn THEN -1.0 WHEN l_linenumber = mx THEN 1.0
             ELSE -1.0 + 2.0 * (l_linenumber - mn) / (mx - mn) END, 6) AS label
FROM lineitem, mm""")
def _scale_target(spark, sf):
    df = _li_sparse(spark, sf)
    _, info = P.scale_fit(df)
    return df.select("id", F.round(P.scale_target(F.col("label"), info["y_min"], info["y_max"], -1.0, 1.0), 6)
                     .alias("label"))


# -------------------------------------------------------------- SVM fitting (W-*)
from kestrel.operators import svm_fit as W  # noqa: E402

NU = 0.5


@register("default_gamma", """
WITH ex AS (SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS att, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v
            FROM lineitem)
SELECT 1.0 / max(att) AS gamma FROM ex WHERE v <> 0""")
def _default_gamma(spark, sf):
    return W.default_gamma(_li_sparse(spark, sf))


@register("param_feasibility", f"""
WITH cc AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT a.label AS label_i, b.label AS label_j, {NU} * (a.n + b.n) / 2 <= least(a.n, b.n) AS feasible
FROM cc a JOIN cc b ON a.label < b.label""")
def _param_feasibility(spark, sf):
    cc = read_table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    return W.nu_feasibility(cc, NU)


@register("laplace_sigma", _svm_sql("linear", "," + _ONECLASS_DEC.format(rho=SVM_RHO_SVR) + """,
res AS (SELECT abs(e.label - d.d) AS r FROM dec d JOIN embeddings e ON d.vec_id = e.vec_id),
m0 AS (SELECT avg(r) AS mae FROM res)
SELECT round(sum(CASE WHEN r > 5 * sqrt(2) * mae THEN 0 ELSE r END)
       / sum(CASE WHEN r > 5 * sqrt(2) * mae THEN 0 ELSE 1 END), 6) AS sigma FROM res, m0"""))
def _laplace_sigma(spark, sf):
    m = _model(spark, sf, "epsilon_svr", "linear", SVM_RHO_SVR)
    pred = V.score_arrow(emb(spark, sf), m, keep=("vec_id", "label"))
    return W.laplace_sigma(pred).select(F.round("sigma", 6).alias("sigma"))


def _binary_decisions(spark, sf):
    """Decision values of the centroid model's first pair for a binary target
    (label below / above the median class) over all embeddings."""
    m = _model(spark, sf)
    dec = V.score_arrow(emb(spark, sf), m, keep=("vec_id", "label"), with_decisions=True)
    return dec.select("vec_id", F.element_at("dec", 1).alias("dec"),
                      F.when(F.col("label") < 5, 1).otherwise(-1).alias("label"))


@register("platt_fit")
def _platt_fit(spark, sf):
    """W-7 (iterative; rows-only check)."""
    a, b = W.platt_fit(_binary_decisions(spark, sf))
    return spark.createDataFrame([(float(a), float(b))], "A DOUBLE, B DOUBLE")


@register("training_summary", _svm_sql("rbf", "," + _OVO_DEC + """
SELECT sum(CASE WHEN y * d <= 1 THEN 1 ELSE 0 END) AS n_sv, sum(CASE WHEN y * d < 1 THEN 1 ELSE 0 END) AS n_inside
FROM (SELECT d.d, CASE WHEN e.label < 5 THEN 1.0 ELSE -1.0 END AS y FROM dec d JOIN embeddings e ON d.vec_id = e.vec_id
      WHERE d.pair = 0) t"""))
def _training_summary(spark, sf):
    return W.training_summary(_binary_decisions(spark, sf)).select(
        F.col("n_sv").cast("long"), F.col("n_inside").cast("long"))


def _fitted(spark, sf):
    return W.csvc_fit(emb(spark, sf), C=1.0)


@register("csvc_fit")
def _csvc_fit(spark, sf):
    """W-1: one-against-one linear C-SVC over all labels (iterative; rows-only check)."""
    m = _fitted(spark, sf)
    pairs = [(i, j) for i in range(m.nr_class) for j in range(i + 1, m.nr_class)]
    rows = [(m.labels[i], m.labels[j], a + 1, float(v)) for p, (i, j) in enumerate(pairs) for a, v in enumerate([*m.sv[p], -m.rho[p]])]
    return spark.createDataFrame(rows, "label_i INT, label_j INT, att INT, weight DOUBLE")


@register("csvc_score")
def _csvc_score(spark, sf):
    """W-1 + IO-9 + V-9: the fitted model written as text, read back, every row scored."""
    path = MIO.scratch_path(spark, "csvc-model")
    spark.createDataFrame([(V.model_to_text(_fitted(spark, sf)),)], "value STRING").coalesce(1).write.text(path)
    return V.score_arrow(emb(spark, sf), V.read_model(spark, path), keep=("vec_id", "label"))


@register("cv_csvc_accuracy")
def _cv_csvc_accuracy(spark, sf):
    """E-4: stratified 5-fold cross-validation of the C-SVC, all folds in one descent."""
    pred = W.csvc_cross_validate(emb(spark, sf), 5, rid="vec_id")
    return pred.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("int")), 6).alias("accuracy"))


@register("rff_map")
def _rff_map(spark, sf):
    """W-6 (random Fourier features of every embedding; rows-only check)."""
    df = emb(spark, sf)
    return W.random_fourier_features(df, "features", 64, 32, gamma=1.0 / 64, seed=0).select("vec_id", "rff")


# ------------------------------------------------------------------- metrics (E-5..7)
@register("metrics_class", O.bayes_score_sql(
    "ninst", _sql_spec(n_dep=0),
    final="""SELECT round(avg(CASE WHEN p.prediction = n.cls THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (
  SELECT rid, cls AS prediction FROM (
    SELECT rid, cls, row_number() OVER (PARTITION BY rid ORDER BY prob DESC, cls) AS r FROM probs) t WHERE r = 1) p
JOIN ninst n USING (rid)"""))
def _metrics_class(spark, sf):
    data = view(spark, sf, "ninst")
    pred = B.score(data.df, B.fit(data, B.ande_spec(data, n_dep=0)), keep=("rid", "cls"))
    return pred.agg(F.round(E.accuracy(F.col("prediction"), F.col("cls")), 6).alias("accuracy"))


@register("metrics_reg", _svm_sql("linear", "," + _ONECLASS_DEC.format(rho=SVM_RHO_SVR) + """,
vy AS (SELECT d.d AS v, CAST(e.label AS DOUBLE) AS y FROM dec d JOIN embeddings e ON d.vec_id = e.vec_id)
SELECT round(avg((v - y) * (v - y)), 6) AS mse,
       round(pow(count(*) * sum(v * y) - sum(v) * sum(y), 2) /
             ((count(*) * sum(v * v) - sum(v) * sum(v)) * (count(*) * sum(y * y) - sum(y) * sum(y))), 6) AS scc
FROM vy"""))
def _metrics_reg(spark, sf):
    m = _model(spark, sf, "epsilon_svr", "linear", SVM_RHO_SVR)
    pred = V.score_arrow(emb(spark, sf), m, keep=("vec_id", "label")).withColumn("label", F.col("label").cast("double"))
    return E.regression_metrics(pred).select(F.round("mse", 6).alias("mse"), F.round("scc", 6).alias("scc"))


# ------------------------------------------------------- baselines (G-5, G-6), IO-12
def _tree_q(kind: str, trees: int = 10):
    def q(spark, sf):
        from kestrel.operators.baselines import fit_predict_tree
        data = view(spark, sf, "ninst")
        return fit_predict_tree(data, kind, trees)
    return q


register("tree_baseline")(_tree_q("tree"))
register("forest10")(_tree_q("forest", 10))
register("forest100")(_tree_q("forest", 100))


@register("synth_binary", """
SELECT CAST(o_orderkey AS BIGINT) AS rid,
       CAST(('0x' || substr(md5(concat_ws('|', '0', CAST(o_orderkey AS VARCHAR), '0')), 1, 1))::INTEGER % 2 AS INTEGER) AS a0,
       CAST(('0x' || substr(md5(concat_ws('|', '0', CAST(o_orderkey AS VARCHAR), '1')), 1, 1))::INTEGER % 2 AS INTEGER) AS a1,
       CAST(('0x' || substr(md5(concat_ws('|', '0', CAST(o_orderkey AS VARCHAR), '2')), 1, 1))::INTEGER % 2 AS INTEGER) AS a2,
       CAST(('0x' || substr(md5(concat_ws('|', '0', CAST(o_orderkey AS VARCHAR), 'c')), 1, 1))::INTEGER % 2 AS INTEGER) AS cls
FROM orders""")
def _synth_binary(spark, sf):
    """IO-12: one synthetic binary instance per order key."""
    return N.synth_binary(read_table(spark, sf, "orders"), "o_orderkey", 3, seed=0).df


# ----------------------------------------------------------- model tables (IO-3, IO-4)
from kestrel.sources import model_io as MIO  # noqa: E402


@register("structure_roundtrip", ORACLE["random_structure_fixed"])
def _structure_roundtrip(spark, sf):
    data = view(spark, sf, "ninst")
    st = S.random_structure_fixed(attributes(data), data.d, size=RBNC_SIZE, max_parents=RBNC_PARENTS, seed=SEED)
    # stored with parents in a scrambled order: the reader restores the radix order
    path = MIO.scratch_path(spark, "structure")
    MIO.write_structure(st.select("component", "att", F.reverse("parents").alias("parents")), path)
    return MIO.read_structure(spark, path)


@register("cpt_sink", ORACLE["rbnc_counts"])
def _cpt_sink(spark, sf):
    path = MIO.scratch_path(spark, "cpt")
    MIO.write_counts(QUERIES["rbnc_counts"](spark, sf), path)
    return MIO.read_counts(spark, path).select("component", "att", "cls", "pidx", "v", "n")


# --------------------------------------------------------------- hidden naive Bayes (G-3)
from kestrel.operators import hnb as H  # noqa: E402


def _hnb_sql(view_name: str) -> str:
    attrs, cards, k = O.meta(view_name)
    d = len(attrs)
    atts = ", ".join(f"({i}, {c})" for i, c in enumerate(cards))
    return O.with_view(view_name, f"""
atts AS (SELECT * FROM (VALUES {atts}) t(att, card)),
cl AS (SELECT CAST(range AS INTEGER) AS c FROM range({k})),
vals AS (SELECT att, card, CAST(unnest(range(card)) AS INTEGER) AS v FROM atts),
lng AS (SELECT rid, cls, weight, CAST(unnest(range({d})) AS INTEGER) AS att, unnest([{', '.join(attrs)}]) AS v FROM {view_name}),
ntot AS (SELECT sum(weight) AS n FROM {view_name}),
fcx AS (SELECT cl.c, coalesce(sum(i.weight), 0) AS fc FROM cl LEFT JOIN {view_name} i ON i.cls = cl.c GROUP BY cl.c),
c1 AS (SELECT cls, att, v, sum(weight) AS n FROM lng GROUP BY cls, att, v),
c2 AS (SELECT x.cls, x.att AS i, x.v AS ai, y.att AS j, y.v AS aj, sum(x.weight) AS n
       FROM lng x JOIN lng y ON x.rid = y.rid AND x.att <> y.att GROUP BY x.cls, x.att, x.v, y.att, y.v),
d1 AS (SELECT cl.c, vals.att, vals.card, vals.v, coalesce(c1.n, 0) AS n FROM cl CROSS JOIN vals
       LEFT JOIN c1 ON c1.cls = cl.c AND c1.att = vals.att AND c1.v = vals.v),
d2 AS (SELECT cl.c, a.att AS i, a.card AS ci, a.v AS ai, b.att AS j, b.card AS cj, b.v AS aj, coalesce(c2.n, 0) AS n
       FROM cl CROSS JOIN vals a JOIN vals b ON a.att <> b.att
       LEFT JOIN c2 ON c2.cls = cl.c AND c2.i = a.att AND c2.ai = a.v AND c2.j = b.att AND c2.aj = b.v),
cmi AS (SELECT d2.i, d2.j, sum(((d2.n + 1) / (ntot.n + {k} * d2.ci * d2.cj)) *
          ln(((d2.n + 1) / (fcx.fc + d2.ci * d2.cj)) / (((p1.n + 1) / (fcx.fc + d2.ci)) * ((p2.n + 1) / (fcx.fc + d2.cj))))) AS m
        FROM d2 JOIN fcx ON fcx.c = d2.c CROSS JOIN ntot
        JOIN d1 p1 ON p1.c = d2.c AND p1.att = d2.i AND p1.v = d2.ai
        JOIN d1 p2 ON p2.c = d2.c AND p2.att = d2.j AND p2.v = d2.aj GROUP BY d2.i, d2.j),
w AS (SELECT i, j, CASE WHEN sum(m) OVER (PARTITION BY i) > 0 THEN m / sum(m) OVER (PARTITION BY i)
                   ELSE 1.0 / {d - 1} END AS w FROM cmi),
cond AS (SELECT c, i, ai, j, aj, (n + 1) / (sum(n) OVER (PARTITION BY c, i, j, aj) + ci) AS p FROM d2),
terms AS (SELECT x.rid, cl.c, x.att AS i, sum(w.w * cond.p) AS s
          FROM lng x JOIN lng y ON x.rid = y.rid AND x.att <> y.att CROSS JOIN cl
          JOIN w ON w.i = x.att AND w.j = y.att
          JOIN cond ON cond.c = cl.c AND cond.i = x.att AND cond.ai = x.v AND cond.j = y.att AND cond.aj = y.v
          GROUP BY x.rid, cl.c, x.att),
lp AS (SELECT t.rid, t.c, sum(ln(t.s)) + ln((fcx.fc + 1) / (ntot.n + {k})) AS lp
       FROM terms t JOIN fcx ON fcx.c = t.c CROSS JOIN ntot GROUP BY t.rid, t.c, fcx.fc, ntot.n),
mx AS (SELECT rid, max(lp) AS m FROM lp GROUP BY rid),
pr AS (SELECT lp.rid, lp.c, exp(lp.lp - mx.m) AS e FROM lp JOIN mx USING (rid))""") + """
SELECT rid, c AS cls, round(e / sum(e) OVER (PARTITION BY rid), 6) AS prob FROM pr"""


@register("hnb_score", _hnb_sql("ninst"))
def _hnb_score(spark, sf):
    data = view(spark, sf, "ninst")
    return B.long_probabilities(H.score_hnb(data.df, H.fit_hnb(data)))


# ------------------------------------------------------------- streaming counts (C-2)
from kestrel.streaming import incremental as INC  # noqa: E402


@register("stream_counts", _ande_counts_sql("ninst", 0))
def _stream_counts(spark, sf):
    """Naive-Bayes counts maintained by a streaming job over instance files that
    arrive in two drops (orders before / from 1998)."""
    data = view(spark, sf, "ninst")
    src = MIO.scratch_path(spark, "stream-src")
    years = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("rid"),
                                                   (F.year("o_orderdate") < 1998).alias("early"))
    rows = data.df.join(years, "rid")
    rows.where("early").drop("early").write.parquet(f"{src}/drop=0")
    rows.where("NOT early").drop("early").write.parquet(f"{src}/drop=1")
    fams = [(c, f) for c, f in C.anDE_families(data.d, 0) if f.att >= 0]
    sink, ckpt = MIO.scratch_path(spark, "stream-sink"), MIO.scratch_path(spark, "stream-ckpt")
    schema = "rid BIGINT, a0 INT, a1 INT, a2 INT, a3 INT, a4 INT, cls INT"
    q = INC.start_count_stream(spark, f"{src}/*", schema, data, fams, sink, ckpt)
    q.awaitTermination()
    return INC.current_counts(spark, sink)


# ------------------------------------------------------- primal SVM fits (W-2..W-5)
def _primal_q(kind: str):
    def q(spark, sf):
        df = emb(spark, sf)
        if kind == "nu_svc":
            df = df.withColumn("label", F.when(F.col("label") < 5, 1.0).otherwise(-1.0))
        theta = W.primal_fit(df, kind)
        return spark.createDataFrame([(i, float(v)) for i, v in enumerate(theta)], "k INT, theta DOUBLE")
    return q


for _k in ("nu_svc", "one_class", "epsilon_svr", "nu_svr"):
    register(f"{_k.replace('_svc', 'svc').replace('_svr', 'svr').replace('one_class', 'oneclass')}_fit")(
        _primal_q(_k))


# --------------------------------------------------- T-7, P-5, IO-8, IO-11
@register("density_report", _SCALE_APPLY_SQL.rsplit("\nSELECT", 1)[0] + """
SELECT (SELECT count(*) FROM ex WHERE v <> 0) AS nz_before, (SELECT count(*) FROM sc WHERE s <> 0) AS nz_after,
       (SELECT count(*) FROM sc WHERE s <> 0) > (SELECT count(*) FROM ex WHERE v <> 0) AS grew""")
def _density_report(spark, sf):
    df = _li_sparse(spark, sf)
    params, _ = P.scale_fit(df)
    return P.density_report(df, P.scale_apply(df, params))


@register("drop_single_valued", O.with_view("linst") + "\nSELECT a0, a1, a2, a3, a4, cls FROM linst")
def _drop_single_valued(spark, sf):
    """With a constant and an all-missing column added, which must go."""
    data = view(spark, sf, "linst")
    df = data.df.select(*data.attrs, "cls", (F.col("a0") * 0 + 7).alias("same"), F.when(F.col("a0") < 0, 1).alias("none"))
    return P.drop_single_valued(df, [*data.attrs, "same", "none"])


@register("prediction_text", _svm_sql("rbf", "," + _OVO_DEC + """,
votes AS (SELECT vec_id, CASE WHEN d > 0 THEN i ELSE j END AS w, count(*) AS n FROM dec GROUP BY vec_id, w),
best AS (SELECT vec_id, w, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, w) AS r FROM votes)
SELECT CAST(b.vec_id AS VARCHAR) || ' ' || CAST(CAST(l.label AS DOUBLE) AS VARCHAR) AS value
FROM best b JOIN labs l ON b.w = l.sv WHERE r = 1"""))
def _prediction_text(spark, sf):
    """IO-8: ``id prediction`` lines of the batch scorer."""
    m = _model(spark, sf)
    pred = V.score_arrow(emb(spark, sf).withColumn("id", F.col("vec_id").cast("string")), m)
    return L.prediction_text(pred)


_RANGE = ("C", "m")


@register("file_range", " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, count(*) AS n_rows FROM {t}" for t in sorted(TABLES) if "c" <= t < "m"))
def _file_range(spark, sf):
    """IO-11: the data sets whose name is in [C, m), case-insensitively, each read."""
    names = N.in_name_range(sorted(TABLES), *_RANGE)
    parts = [read_table(spark, sf, t).agg(F.lit(t).alias("dataset"), F.count(F.lit(1)).alias("n_rows")) for t in names]
    return reduce(DataFrame.union, parts)


@register("oof_platt")
def _oof_platt(spark, sf):
    """W-8 + W-7: 5-fold out-of-fold decision values of a fitted (binary) C-SVC, then
    Platt scaling (iterative; rows-only check)."""
    df = emb(spark, sf).withColumn("label", F.when(F.col("label") < 5, 1).otherwise(-1))

    def fit_fn(train):
        return W.csvc_fit(train, C=1.0)

    a, b = W.probability_fit(df, fit_fn, rid="vec_id")
    return spark.createDataFrame([(float(a), float(b))], "A DOUBLE, B DOUBLE")


def _rbnc_free_sql(view_name: str, size: int, m: int, alpha: float) -> str:
    """B-3 + B-5 oracle: free structure in SQL; class node normalised over classes,
    attributes without the class parent left out (constant in c)."""
    attrs, cards, k = O.meta(view_name)
    d = len(attrs)
    cs = O.cards_sql(view_name)
    tabs = f"""tabs AS (
  SELECT CAST(row_number() OVER (ORDER BY component, att) - 1 AS INTEGER) AS tid, component,
         CASE WHEN att = {d} THEN -1 ELSE att END AS att,
         list_filter(parents, lambda p: p <> {d}) AS ap,
         CAST(list_reduce(list_transform(list_filter(parents, lambda p: p <> {d}), lambda p: {cs}[p + 1]),
                     lambda a, b: a * b, 1) AS INTEGER) AS S,
         CASE WHEN att = {d} THEN 1 ELSE {cs}[att + 1] END AS card, {alpha!r} AS a0, FALSE AS prior,
         att = {d} AS cn
  FROM struct WHERE att = {d} OR list_contains(parents, {d}))"""
    spec = B.BayesSpec(attrs, cards, k, [], size, B.SOFTMAX_AVG, None, {}, None)
    model = O.bayes_model_ctes(view_name, spec)[1:]
    return O.with_view(view_name, O.inst_cte(view_name), O.atts_cte(view_name),
                       *O.structure_free_ctes(d, size, m, SEED), tabs, *model,
                       O.bayes_terms_cte(view_name, spec), *O.bayes_prob_ctes(spec, k)) + \
        "\nSELECT rid, CAST(cls AS INTEGER) AS cls, round(prob, 6) AS prob FROM probs"


@register("rbnc_free_score", _rbnc_free_sql("ninst", RBNC_SIZE, RBNC_PARENTS, 0.5))
def _rbnc_free_score(spark, sf):
    """B-3 structures scored with every class value substituted (B-5, B-6)."""
    data = view(spark, sf, "ninst")
    st = S.random_structure_free(declared_attributes(data), data.d, RBNC_SIZE, RBNC_PARENTS, SEED)
    model = B.fit(data, B.rbnc_spec(data, C.collect_structure(st), alpha=0.5))
    return B.long_probabilities(B.score(data.df, model))


# ------------------------------------------------ P-1, P-2, IO-9, T-2 apply
def _ninst_with_missing(spark, sf):
    """ninst with a missing class (order key % 11 = 0) and a missing attribute
    (order key % 7 = 0) injected, as the driver tables hold no NULLs."""
    data = view(spark, sf, "ninst")
    df = data.df.select("rid", F.when(F.col("rid") % 7 == 0, None).otherwise(F.col("a0")).alias("a0"),
                        "a1", "a2", "a3", "a4",
                        F.when(F.col("rid") % 11 == 0, None).otherwise(F.col("cls")).alias("cls"))
    return data.with_df(df)


@register("drop_missing_class", O.with_view("ninst") + """
SELECT rid, CASE WHEN rid % 7 = 0 THEN NULL ELSE a0 END AS a0, a1, a2, a3, a4, cls FROM ninst WHERE rid % 11 <> 0""")
def _drop_missing_class(spark, sf):
    return N.drop_missing_class(_ninst_with_missing(spark, sf)).df


@register("reject_missing", O.with_view("ninst") + """
SELECT rid, a0, a1, a2, a3, a4, CASE WHEN rid % 11 = 0 THEN NULL ELSE cls END AS cls FROM ninst WHERE rid % 7 <> 0""")
def _reject_missing(spark, sf):
    return N.reject_missing(_ninst_with_missing(spark, sf), on_missing="drop").df


@register("model_text_roundtrip", ORACLE["oneclass_score"])
def _model_text_roundtrip(spark, sf):
    """IO-9: the model written in the text format, read back through Spark, scored."""
    m = _model(spark, sf, "one_class", "rbf", SVM_RHO_ONE_CLASS)
    path = MIO.scratch_path(spark, "svm-model")
    spark.createDataFrame([(V.model_to_text(m),)], "value STRING").coalesce(1).write.text(path)
    back = V.read_model(spark, path)
    return V.score_arrow(emb(spark, sf).withColumnRenamed("vec_id", "id"), back)


def _bin_sql(att: int, col: str) -> str:
    return f"CAST((SELECT len(list_filter(cuts, lambda t: CAST({col} AS DOUBLE) > t)) FROM k WHERE att = {att}) AS INTEGER) AS {col}"


@register("mdl_apply", _mdl_sql(", k AS (" + _MDL_CUTS_SQL + ")\nSELECT l_orderkey, l_linenumber, " + ", ".join(
    _bin_sql(i, c) for i, c in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"])) + " FROM lineitem"))
def _mdl_apply(spark, sf):
    """T-2 applied: lineitem numeric columns replaced by their MDL bin."""
    li = read_table(spark, sf, "lineitem").withColumn(
        "cls", F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2))
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    cuts = {r["att"]: list(r["cuts"]) for r in P.mdl_cuts(li, cols, "cls", 3).collect()}
    return P.mdl_apply(li.select("l_orderkey", "l_linenumber", *cols), cols, cuts)


# ------------------------------------- training jobs (W-1 .. W-12), exact quantiles
from kestrel.operators import svm_train as T  # noqa: E402
from kestrel.operators.quantile import exact_quantiles  # noqa: E402


@register("weighted_median", """
WITH r AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS run, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM r)
SELECT l_returnflag, min(v) FILTER (run >= 0.5 * total) AS lower, min(v) FILTER (run > 0.5 * total) AS upper, any_value(total) AS total
FROM c GROUP BY l_returnflag""")
def _weighted_median(spark, sf):
    """Price that half of the quantity of a return flag lies below, exact and without a sort."""
    q = exact_quantiles(read_table(spark, sf, "lineitem"), F.col("l_extendedprice"), 0.5, ["l_returnflag"], F.col("l_quantity"))
    return q.select("l_returnflag", "lower", "upper", "total")


#: kernels of the feature-map queries
MAP_KERNELS = {"rbf": {}, "polynomial": POLY, "sigmoid": SIGM}
_MAP_COEF = (1.0, -0.5, 0.25)


@register("kernel_map_score", f"""
WITH ex AS (SELECT vec_id, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
g AS (SELECT 1.0 / (max(pos) + 1) AS g FROM ex),
z AS (SELECT row_number() OVER (ORDER BY vec_id) AS lid, vec_id FROM (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 3) t),
raw AS (SELECT e.vec_id, z.lid, any_value(g) AS g, sum(e.x * c.x) AS dot, sum((e.x - c.x) * (e.x - c.x)) AS sq
        FROM ex e JOIN ex c ON e.pos = c.pos JOIN z ON c.vec_id = z.vec_id, g GROUP BY e.vec_id, z.lid),
k AS (SELECT vec_id, lid, unnest(['rbf', 'polynomial', 'sigmoid']) AS kernel,
        unnest([exp(-g * sq), pow(g * dot + {POLY['coef0']}, {POLY['degree']}), tanh(g * dot + {SIGM['coef0']})]) AS k FROM raw)
SELECT vec_id, kernel, round(sum(CASE lid WHEN 1 THEN {_MAP_COEF[0]} WHEN 2 THEN {_MAP_COEF[1]} ELSE {_MAP_COEF[2]} END * k), 6) AS score
FROM k GROUP BY vec_id, kernel""")
def _kernel_map_score(spark, sf):
    """W-6: a function w . phi(x) with w = sum c_j phi(z_j) over three fixed landmarks equals
    sum c_j k(x, z_j): mapped, made a model, written, read back and scored, for each kernel."""
    df = emb(spark, sf)
    marks = np.array([r.features for r in df.orderBy("vec_id").limit(3).collect()])
    parts = []
    for kernel, par in MAP_KERNELS.items():
        kmap = T.map_of_landmarks(marks, kernel, gamma=1.0 / marks.shape[1], **par)
        phi = np.array([r.features for r in kmap.transform(spark.createDataFrame([(m.tolist(),) for m in marks], "features array<double>")).collect()])
        w = np.asarray(_MAP_COEF) @ phi
        base = kmap.base
        m = V.SvmModel("epsilon_svr", kernel, base.sv, (kmap.root @ w)[None, :], [0.0], [], [], base.degree, base.gamma, base.coef0)
        path = MIO.scratch_path(spark, f"map-{kernel}")
        spark.createDataFrame([(V.model_to_text(m),)], "value STRING").coalesce(1).write.text(path)
        scored = V.score_arrow(df, V.read_model(spark, path), keep=("vec_id",))
        parts.append(scored.select("vec_id", F.lit(kernel).alias("kernel"), F.round("prediction", 6).alias("score")))
    return reduce(DataFrame.union, parts)


@register("kernel_csvc_score")
def _kernel_csvc_score(spark, sf):
    """W-1 + W-6 + IO-9: a C-SVC of all label pairs for each kernel on its map, written, read back,
    every row scored (iterative; rows-only check)."""
    df, parts = emb(spark, sf), []
    for kernel, par in MAP_KERNELS.items():
        m, _ = T.train(df, "c_svc", kernel, rid="vec_id", landmarks=64, gamma=1.0, **par)
        path = MIO.scratch_path(spark, f"csvc-{kernel}")
        spark.createDataFrame([(V.model_to_text(m),)], "value STRING").coalesce(1).write.text(path)
        parts.append(V.score_arrow(df, V.read_model(spark, path), keep=("vec_id", "label")).withColumn("kernel", F.lit(kernel)))
    return reduce(DataFrame.union, parts)


@register("oneclass_exact", f"""
WITH o AS (SELECT CAST(l_quantity AS DOUBLE) AS x, row_number() OVER (ORDER BY l_quantity) AS r, count(*) OVER () AS n FROM lineitem),
a AS (SELECT *, greatest(0, least(1, {NU} * n - (r - 1))) AS alpha FROM o),
s AS (SELECT sum(alpha * x) / ({NU} * any_value(n)) AS w, sum(alpha) AS alphas,
        (min(x) FILTER (r >= {NU} * n) + min(x) FILTER (r > {NU} * n)) / 2 AS t FROM a)
SELECT round(w, 6) AS w, round(w * t, 6) AS rho, CAST(round(alphas, 6) AS DOUBLE) AS alphas FROM s""")
def _oneclass_exact(spark, sf):
    """W-3 on one feature, where the optimum is known: w is the mean of the nu n smallest values."""
    df = read_table(spark, sf, "lineitem").select(F.array(F.col("l_quantity").cast("double")).alias("features"))
    m, f = T.train(df, "one_class", nu=NU)
    n = float(f.job.rows.sum()) * NU  # the model is scaled by the sum of its dual weights
    return spark.createDataFrame([(round(float(m.sv[0, 0]) / n, 6), round(m.rho[0] / n, 6), round(n, 6))], "w double, rho double, alphas double")


#: a nu that the two overlapping classes of the one-feature problem can meet with a margin
NU_PAIR = 0.8


@register("nusvc_exact", f"""
WITH o AS (SELECT CAST(l_quantity + 100 * l_discount AS DOUBLE) AS x, l_quantity > 25 AS hi FROM lineitem),
m AS (SELECT CASE WHEN hi THEN x ELSE -x END AS m, hi, count(*) OVER () AS n FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY hi ORDER BY m) AS r, {NU_PAIR} * n / 2 AS goal FROM m),
s AS (SELECT hi, any_value(n) AS n, sum(greatest(0, least(1, goal - (r - 1))) * m) / any_value(n) AS part,
        (min(m) FILTER (r >= goal) + min(m) FILTER (r > goal)) / 2 AS t FROM r GROUP BY hi),
f AS (SELECT -sum(part) AS w, any_value(n) AS n, sum(part) * any_value(t) FILTER (NOT hi) AS t0, sum(part) * any_value(t) FILTER (hi) AS t1 FROM s)
SELECT round(w / ((t0 + t1) / 2), 5) AS w, round((t1 - t0) / 2 / ((t0 + t1) / 2), 5) AS b, round(n * (t0 + t1) / 2, 5) AS inverse_c FROM f""")
def _nusvc_exact(spark, sf):
    """W-2 on one feature, where the optimum is known (the feature is smaller for label 0): the model after
    its rescaling by 1 / rho, and 1 / C."""
    df = read_table(spark, sf, "lineitem").select(F.array((F.col("l_quantity") + 100 * F.col("l_discount")).cast("double")).alias("features"),
                                                  (F.col("l_quantity") > 25).cast("int").alias("label"))
    m, f = T.train(df, "nu_svc", nu=NU_PAIR)
    return spark.createDataFrame([(round(float(m.sv[0, 0]), 5), round(-m.rho[0], 5), round(1 / float(f.reported[0, 0]), 5))], "w double, b double, inverse_c double")


@register("nusvc_pairs")
def _nusvc_pairs(spark, sf):
    """W-2 of all label pairs in one descent, with the reported C (iterative; rows-only check)."""
    m, f = T.train(emb(spark, sf), "nu_svc", rid="vec_id", nu=NU)
    rows = [(f.job.labels[i], f.job.labels[j], float(f.reported[0, p]), float(m.rho[p])) for p, (i, j) in enumerate(f.job.pairs)]
    return spark.createDataFrame(rows, "label_i INT, label_j INT, C DOUBLE, rho DOUBLE")


@register("csvc_probability")
def _csvc_probability(spark, sf):
    """W-7, W-8, IO-8: Platt parameters of every label pair from 5-fold decisions, predictions written
    with their ``labels`` line and read back (iterative; rows-only check)."""
    df = emb(spark, sf)
    m, _ = T.train(df, "c_svc", rid="vec_id", probability=1)
    pred = V.score_arrow(df.withColumn("id", F.col("vec_id").cast("string")), m, probability=True)
    path = MIO.scratch_path(spark, "probabilities")
    L.write_predictions(pred, path, probability="probability", labels=m.labels)
    labels, back = L.read_predictions(spark, path)
    return back.select("id", "prediction", F.explode(F.map_from_arrays(F.array(*[F.lit(lab) for lab in labels]), "probability")).alias("label", "probability"))


@register("svr_cv")
def _svr_cv(spark, sf):
    """E-4, E-6, E-7, W-9 for both regressions: held-out error, squared correlation and noise scale
    (iterative; rows-only check)."""
    df = emb(spark, sf)
    return reduce(DataFrame.union, [T.regression_cv(df, kind, rid="vec_id").withColumn("svm_type", F.lit(kind)) for kind in ("epsilon_svr", "nu_svr")])


@register("svr_fit_score")
def _svr_fit_score(spark, sf):
    """W-4, W-5 + IO-9: both regressions fitted with an RBF map, written, read back, every row scored
    (iterative; rows-only check)."""
    df, parts = emb(spark, sf), []
    for kind in ("epsilon_svr", "nu_svr"):
        m, _ = T.train(df, kind, "rbf", rid="vec_id", landmarks=64, gamma=1.0)
        path = MIO.scratch_path(spark, kind)
        spark.createDataFrame([(V.model_to_text(m),)], "value STRING").coalesce(1).write.text(path)
        parts.append(V.score_arrow(df, V.read_model(spark, path), keep=("vec_id",)).withColumn("svm_type", F.lit(kind)))
    return reduce(DataFrame.union, parts)


@register("training_summary_pairs", _svm_sql("rbf", "," + _OVO_DEC + """
SELECT li.label AS label_i, lj.label AS label_j, count(*) FILTER (m <= 1) AS n_sv, count(*) FILTER (m < 1) AS n_inside
FROM (SELECT d.i, d.j, CASE WHEN e.label = a.label THEN d.d WHEN e.label = b.label THEN -d.d END * 60 AS m
      FROM dec d JOIN embeddings e ON d.vec_id = e.vec_id JOIN labs a ON d.i = a.sv JOIN labs b ON d.j = b.sv) t
JOIN labs li ON t.i = li.sv JOIN labs lj ON t.j = lj.sv WHERE m IS NOT NULL GROUP BY ALL"""))
def _training_summary_pairs(spark, sf):
    """W-12 of every label pair, for the centroid model's decisions times 60 (margins of about 1)."""
    m = _model(spark, sf)
    dec = V.score_arrow(emb(spark, sf), m, keep=("label",), with_decisions=True)
    return T.summary(dec.withColumn("dec", F.transform("dec", lambda v: v * 60)), m.labels)


# ------------------------- fold vectors, noise in training folds, models of any size
from kestrel.operators import bayes_join as BJ  # noqa: E402
from kestrel.operators import crossval as CV  # noqa: E402

NOISE_RATE = 0.1


@register("fold_vectors", O.with_view("ninst", O.inst_cte("ninst"), *O.interleaved_folds_ctes("ninst", CV_REPEATS, CV_FOLDS, CV_SEED)) +
          "\nSELECT rid, CAST(list(fold ORDER BY rep) AS INTEGER[]) AS folds FROM fi GROUP BY rid")
def _fold_vectors(spark, sf):
    """E-1: every row once, with its fold of all repeats."""
    return CV.fold_vectors(view(spark, sf, "ninst"), CV_REPEATS, CV_FOLDS, CV_SEED).data.df.select("rid", "folds")


def _cv_noise_sql(n_dep: int, name: str, rate: float) -> str:
    """As ``O.cv_sql``, the training sets with their first int(n rate) rows relabelled."""
    _, _, nk = O.meta("ninst")
    key = O.h_sql(f"rep + {CV.NOISE_SEED}", "rid")
    u = f"CAST(('0x' || substr({O.h_sql(f'rep + {CV.NOISE_SEED}', chr(39) + 'c' + chr(39), 'rid')}, 1, 7)) AS BIGINT)"
    spec = _sql_spec(n_dep=n_dep)
    ctes = [O.inst_cte("ninst"), *O.interleaved_folds_ctes("ninst", CV_REPEATS, CV_FOLDS, CV_SEED),
            f"""tr0 AS (SELECT fi.rep, fi.rep * {CV_FOLDS} + f.f AS g, fi.rid, fi.cls, fi.weight, fi.xs FROM fi
  CROSS JOIN (SELECT CAST(range AS INTEGER) AS f FROM range({CV_FOLDS})) f WHERE fi.fold <> f.f)""",
            f"tr1 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {key}, rid) AS r, count(*) OVER (PARTITION BY g) AS n FROM tr0)",
            f"""tr AS (SELECT g, rid, CAST(CASE WHEN r <= floor(n * {rate}) THEN (cls + 1 + {u} % {nk - 1}) % {nk} ELSE cls END AS INTEGER) AS cls, weight, xs FROM tr1)""",
            *O.bayes_model_ctes("ninst", spec, inst="tr", keys=("g",)), O.bayes_terms_cte("ninst", spec, inst="fi", keys=("g",)),
            *O.bayes_prob_ctes(spec, nk, keys=("g",), inst="fi"),
            """pred AS (SELECT rid, g, cls AS prediction FROM (
  SELECT rid, g, cls, row_number() OVER (PARTITION BY rid, g ORDER BY prob DESC, cls) AS rn FROM probs) t WHERE rn = 1)""",
            """acc AS (SELECT fi.g, sum(CASE WHEN pred.prediction = fi.cls THEN fi.weight ELSE 0 END) / sum(fi.weight) AS a
  FROM fi JOIN pred ON fi.rid = pred.rid AND fi.g = pred.g GROUP BY fi.g)"""]
    return O.with_view("ninst", *ctes) + f"\nSELECT '{name}' AS model, round(avg(a), 6) AS acc_mean, round(stddev_samp(a), 6) AS acc_std FROM acc"


def _rounded(s: DataFrame) -> DataFrame:
    return s.select("model", F.round("acc_mean", 6).alias("acc_mean"), F.round("acc_std", 6).alias("acc_std"))


@register("cv_noise_accuracy", _cv_noise_sql(0, "nb", NOISE_RATE))
def _cv_noise_accuracy(spark, sf):
    """E-4 + T-8: 10 x 10 cross-validation of naive Bayes with label noise in the training folds."""
    fv = CV.fold_vectors(view(spark, sf, "ninst"), CV_REPEATS, CV_FOLDS, CV_SEED)
    return _rounded(CV.cv_summary(fv, lambda d: B.ande_spec(d, n_dep=0), "nb", noise=NOISE_RATE))


@register("cv_a1de_by_groups", ORACLE["cv_a1de_accuracy"])
def _cv_a1de_by_groups(spark, sf):
    """E-4 of a model whose hundred fold models together exceed the driver's bound: taken in runs of folds."""
    fv = CV.fold_vectors(view(spark, sf, "ninst"), CV_REPEATS, CV_FOLDS, CV_SEED)
    spec = B.ande_spec(fv.data, n_dep=1)
    return _rounded(CV.cv_summary(fv, lambda d: B.ande_spec(d, n_dep=1), "a1de", limit=30 * spec.offsets()[1]))


def _join_score(view_name, spec_fn):
    def q(spark, sf):
        """The bound is set to one cell, so rows and model meet in a shuffle join."""
        data = view(spark, sf, view_name)
        spec = spec_fn(spark, data)
        return B.long_probabilities(BJ.predict(data.df, data, spec, BJ.family_counts(data, spec), limit=1))
    return q


def _rbnc_join_spec(spark, data):
    return B.rbnc_spec(data, C.collect_structure(S.random_structure_shuffled(declared_attributes(data), data.d, RBNC_SIZE, RBNC_PARENTS, SEED)), alpha=0.5)


def _rbnc_free_join_spec(spark, data):
    return B.rbnc_spec(data, C.collect_structure(S.random_structure_free(declared_attributes(data), data.d, RBNC_SIZE, RBNC_PARENTS, SEED)), alpha=0.5)


for _name, _view, _spec in [
    ("a1de_score", "ninst", lambda spark, d: B.ande_spec(d, n_dep=1)),
    ("a2de_score", "linst", lambda spark, d: B.ande_spec(d, n_dep=2)),
    ("freq_limit_score", "linst", lambda spark, d: B.ande_spec(d, n_dep=1, limit=1500.0)),
    ("spnde_norm_score", "linst", lambda spark, d: B.ande_spec(d, n_dep=1, limit=1500.0, joint=False)),
    ("rbnc_score", "ninst", _rbnc_join_spec),
    ("rbnc_free_score", "ninst", _rbnc_free_join_spec),
]:
    register(f"{_name}_join", ORACLE[_name])(_join_score(_view, _spec))


# -------------------------------------------------- IO-1 and IO-2 at any size
@register("nominal_file", O.with_view("ninst") + "\nSELECT a0, a1, a2, a3, a4, cls FROM ninst")
def _nominal_file(spark, sf):
    """IO-1: the nominal view written as text, read from the files with the place of each line as its id."""
    data = view(spark, sf, "ninst")
    path = MIO.scratch_path(spark, "nominal-text")
    N.to_nominal_text(data).select("line").write.text(path)
    return N.read_nominal_text(spark, path, data.cards, data.n_classes).df.select(*data.attrs, "cls")


@register("file_lines", """
SELECT count(*) AS n_lines, count(*) AS n_ids, true AS without_gaps FROM lineitem""")
def _file_lines(spark, sf):
    """IO-1: line numbers of the files run from 0 without gaps, and no id occurs twice."""
    path = MIO.scratch_path(spark, "line-text")
    read_table(spark, sf, "lineitem").select(F.concat_ws(",", "l_orderkey", "l_linenumber", "l_quantity").alias("value")).write.text(path)
    lines = N.numbered_lines(spark, path)
    per_file = N.distinct_ids(lines, "file", "rid", "line_no")
    return per_file.agg(F.sum("n").alias("n_lines"), F.sum("ids").alias("n_ids"), F.bool_and(F.col("last") + 1 == F.col("n")).alias("without_gaps"))


@register("domain_ranks", "SELECT att, name, value, CAST(dense_rank() OVER (PARTITION BY att ORDER BY value) - 1 AS BIGINT) AS code FROM (" + " UNION ".join(
    f"SELECT DISTINCT {i} AS att, '{c}' AS name, CAST(c{i} AS VARCHAR) AS value FROM (SELECT {c} AS c{i} FROM orders)" for i, c in enumerate(("o_custkey", "o_orderkey", "o_orderdate"))) + ") t")
def _domain_ranks(spark, sf):
    """IO-2: domains of high cardinality, ranked by range partitions."""
    return N.domain_ranks(read_table(spark, sf, "orders"), ["o_custkey", "o_orderkey", "o_orderdate"])


# ------------------------------------------------------------ E-9: the evaluation job
from kestrel.operators import evaluation_job as EJ  # noqa: E402

JOB_REPEATS, JOB_FOLDS = 2, 5


def _datasets(spark, sf) -> str:
    """CSV datasets with headers in one folder: two views of the orders, one whose class has a single
    value, and one that the name range leaves out."""
    folder = MIO.scratch_path(spark, "datasets")
    data = view(spark, sf, "ninst")
    text = [F.concat(F.lit("v"), F.lpad(F.col(a).cast("string"), 2, "0")).alias(a) for a in data.attrs]
    status = F.element_at(F.array(*[F.lit(x) for x in ("F", "O", "P")]), F.col("cls") + 1).alias("status")
    rows = data.df.select("rid", *text, status).persist()
    rows.write.csv(f"{folder}/a_orders.csv", header=True)
    rows.select("rid", "a0", "a1", "a2", "status").write.csv(f"{folder}/B_few.csv", header=True)
    rows.select("rid", "a0", F.lit("same").alias("status")).write.csv(f"{folder}/c_single.csv", header=True)
    rows.select("rid", "a0", "status").write.csv(f"{folder}/z_other.csv", header=True)
    rows.unpersist()
    return folder


def _job_sql() -> str:
    parts, lines = [], []
    for name, view_name in (("B_few.csv", "ninst3"), ("a_orders.csv", "ninst")):
        cells = []
        for model, n_dep in (("nb", 0), ("aode", 1)):
            key = f"{model}_{view_name}"
            parts.append(f"{key} AS ({O.cv_sql(view_name, _sql_spec(n_dep=n_dep), model, JOB_REPEATS, JOB_FOLDS, CV_SEED)})")
            cells.append(f"(SELECT CAST(round(acc_mean * 100, 2) AS VARCHAR) || ':' || CAST(round(acc_std * 100, 2) AS VARCHAR) FROM {key})")
        lines.append(f"SELECT '{name}' AS dataset, '{name}, ' || {cells[0]} || ', ' || {cells[1]} || ', ' AS report, false AS failed")
    lines.append("SELECT 'c_single.csv', 'c_single.csv, failed: the class has fewer than two values', true")
    return "WITH " + ",\n".join(parts) + "\n" + " UNION ALL ".join(lines)


@register("evaluation_job", _job_sql())
def _evaluation_job(spark, sf):
    """IO-11, T-1, T-2, P-5, E-1, E-4, E-9, IO-13: datasets [A, D) of a folder, one of which fails."""
    return EJ.evaluate_folder(spark, _datasets(spark, sf), MIO.scratch_path(spark, "report"), ["nb", "aode"], begin="A", end="D",
                              repeats=JOB_REPEATS, folds=JOB_FOLDS, seed=CV_SEED, id_col="rid")


@register("evaluation_noise_models")
def _evaluation_noise_models(spark, sf):
    """The job with all count models and label noise in the training folds, on a dataset with numeric
    columns (rows-only check)."""
    folder = MIO.scratch_path(spark, "datasets")
    read_table(spark, sf, "customer").select("c_mktsegment", F.round("c_acctbal", 0).alias("c_acctbal"), (F.col("c_nationkey") % 5).alias("zone"),
                                             F.when(F.col("c_acctbal") > 4000, "high").otherwise("low").alias("level")).write.csv(f"{folder}/customer.csv", header=True)
    return EJ.evaluate_folder(spark, folder, MIO.scratch_path(spark, "report"), list(EJ.MODELS), repeats=2, folds=3, noise=0.1)


# ------------------------------------------------------------------- C4.5-like tree (G-5)
from kestrel.operators import tree as TR  # noqa: E402

TREE_FOLDS = 5


def _tree_ctes(view_name: str, src: str) -> list[str]:
    return O.c45_ctes(O.meta(view_name)[0], src, TR.MIN_ROWS, TR.CONFIDENCE, TR.SLACK)


@register("tree_model", O.with_view("linst", "whole AS (SELECT 0 AS g, * FROM linst)", *_tree_ctes("linst", "whole")) +
          "\nSELECT node, depth, att, cls, n, errors FROM tree")
def _tree_model(spark, sf):
    """G-5: the pruned nodes of one tree over weighted tuples of the line items."""
    data = view(spark, sf, "linst")
    tree = TR.grow(data.df.withColumn("g", F.lit(0)), data.attrs, data.cls, data.weight)
    return tree.nodes.select("node", "depth", "att", "cls", "n", "errors")


@register("tree_score", O.with_view(
    "ninst", *O.interleaved_folds_ctes("ninst", 1, TREE_FOLDS, CV_SEED, src="ninst"),
    f"""tr AS (SELECT f.f AS g, {', '.join(O.meta('ninst')[0])}, cls, weight FROM fi
  CROSS JOIN (SELECT CAST(range AS INTEGER) AS f FROM range({TREE_FOLDS})) f WHERE fi.fold <> f.f)""",
    *_tree_ctes("ninst", "tr"), *O.c45_walk_ctes(O.meta("ninst")[0], "fi")) +
    "\nSELECT rid, g AS fold, cls, prediction FROM tree_pred JOIN fi USING (rid, g)")
def _tree_score(spark, sf):
    """G-5 with E-4: every row scored by the tree grown without its fold."""
    fv = CV.fold_vectors(view(spark, sf, "ninst"), 1, TREE_FOLDS, CV_SEED)
    return TR.cv_predict(fv).select("rid", "fold", "cls", "prediction")
