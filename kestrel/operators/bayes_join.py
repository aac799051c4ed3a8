"""Count models of any size: scoring by a shuffle join (A-5, A-6, B-4 beyond the driver's bound).

``predict`` chooses by the number of cells, which is known from the domains before any job:
a model that fits is collected and shipped to the batch scorer; several group models (CV
folds) are taken in runs of groups that fit; a single model that does not fit stays a table.
Then every row becomes one record per family, records meet the model on (group, family, parent
code), and the log terms are summed per row.

Where the declared domains allow few different attribute tuples (``COLLAPSE_DOMAIN_LIMIT``), each tuple
of a group is scored once by that join and the rows meet the tuples' scores, which are broadcast: what
is shuffled then follows the domain, not the rows.  Rows with a code outside its domain, and
wider domains, are scored row by row.

Hot keys: a parent code that more than 1/``HOT`` of its family's rows share is dealt to ``HOT``
salts on both sides.  At most ``HOT`` codes of a family can be hot, so the list of hot codes
has a known bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.arrays import MAX_LITERAL_CELLS, argmax_first, const_doubles, const_ints
from kestrel.operators import bayes as B
from kestrel.operators.counts import BROADCAST_MAP_LIMIT, COLLAPSE_DOMAIN_LIMIT, EXPLICIT_FAMILY_LIMIT, _explicit_cells, _hof_cells, count_families
from kestrel.sources.nominal import NominalData

HOT = 32


def family_counts(data: NominalData, spec: B.BayesSpec, keys: tuple[str, ...] = ()) -> DataFrame:
    """The counts a model needs; ``component`` is the table's number."""
    return count_families(data, [(tid, t.family) for tid, t in enumerate(spec.tables)], keys=keys)


def predict(df: DataFrame, data: NominalData, spec: B.BayesSpec, counts: DataFrame, *, group_col: str | None = None, n_groups: int = 1,
            keep: tuple[str, ...] = ("rid",), limit: int = MAX_LITERAL_CELLS) -> DataFrame:
    """(keep..., probability, prediction) of every row of ``df`` by the model of its group, whatever
    the model's size.  ``keep`` must name a row (with the group)."""
    _, size = spec.offsets()
    if size * n_groups <= limit:
        return B.score(df, B.fit(data, spec, group_col=group_col, n_groups=n_groups, counts=counts), group_col=group_col, keep=keep)
    if size <= limit and group_col:
        step, parts = limit // size, []
        counts = counts.persist()  # every run takes its groups from one counting pass
        try:
            for lo in range(0, n_groups, step):
                n = min(step, n_groups - lo)
                here = F.col(group_col).between(lo, lo + n - 1)
                shifted = (F.col(group_col) - lo).cast("int")
                model = B.fit(data, spec, group_col="_g", n_groups=n, counts=counts.where(here).withColumn("_g", shifted))
                parts.append(B.score(df.where(here).withColumn("_g", shifted), model, group_col="_g", keep=keep))
        finally:
            counts.unpersist()
        return reduce(DataFrame.union, parts)
    return score_by_join(df, spec, counts, group_col=group_col, n_groups=n_groups, keep=keep)


def _log(num: Column, den: Column) -> Column:
    """log(num / den) with log 0 = -inf and 0 / 0 = NaN, as the batch estimate has it."""
    return F.when((num == 0) & (den == 0), F.lit(float("nan"))).when(num == 0, F.lit(float("-inf"))).otherwise(F.log(num / den))


class _Meta:
    """Per-family constants as literal arrays, read by the family's number."""

    def __init__(self, spec: B.BayesSpec, tid: Column):
        sizes = spec.sizes()
        self.k = spec.n_classes
        at = (tid + 1).cast("int")
        self.a0 = F.element_at(const_doubles([t.a0 for t in spec.tables]), at)
        self.card = F.element_at(const_doubles([c for _, c in sizes]), at)
        self.cells = F.element_at(const_doubles([s * c for s, c in sizes]), at)
        self.prior = F.element_at(const_ints([int(t.prior) for t in spec.tables]), at) == 1
        self.class_norm = F.element_at(const_ints([int(t.class_norm) for t in spec.tables]), at) == 1
        self.comp = F.element_at(const_ints([t.component for t in spec.tables]), at)

    def denominator(self, of_class: Column, of_all: Column, total: Column) -> Column:
        """``of_class``: rows of the parent code and class, ``of_all``: of the code, ``total``: of the table."""
        return F.when(self.prior, total + self.a0 * self.cells * self.k).when(
            self.class_norm, of_all + self.a0 * self.k * self.card).otherwise(of_class + self.a0 * self.card)


def model_table(counts: DataFrame, spec: B.BayesSpec, group_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, totals).  A record is a (g, tid, pidx) that occurs: its rows, the log estimates of its
    values by class, those of a value that does not occur, and the value's frequencies.  Totals are the
    rows of each (g, prior table)."""
    k = spec.n_classes
    g = F.col(group_col).cast("int") if group_col else F.lit(0)
    by_class = [F.sum(F.when(F.col("cls") == c, F.col("n")).otherwise(0.0)).alias(f"n{c}") for c in range(k)]
    cells = counts.select(g.alias("g"), F.col("component").alias("tid"), "cls", "pidx", "v", "n").groupBy("g", "tid", "pidx", "v").agg(*by_class)
    each = [f"n{c}" for c in range(k)]
    prior = [tid for tid, t in enumerate(spec.tables) if t.prior]
    totals = cells.where(F.col("tid").isin(prior)).groupBy("g", "tid").agg(F.sum(sum((F.col(c) for c in each), F.lit(0.0))).alias("total"))
    codes = cells.groupBy("g", "tid", "pidx").agg(*[F.sum(c).alias(f"d{c[1:]}") for c in each],
                                                  F.collect_list(F.struct("v", F.array(*each).alias("n"))).alias("cells"))
    codes = codes.join(totals, ["g", "tid"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    m = _Meta(spec, F.col("tid"))
    den_of = [F.col(f"d{c}") for c in range(k)]
    rows = sum(den_of, F.lit(0.0))
    den = F.array(*[m.denominator(d, rows, F.col("total")) for d in den_of])
    codes = codes.withColumn("den", den).withColumn("a0", m.a0)
    estimates = F.map_from_entries(F.transform("cells", lambda c: F.struct(c["v"].alias("key"), F.struct(
        F.zip_with(c["n"], F.col("den"), lambda n, d: _log(n + F.col("a0"), d)).alias("lp"),
        F.aggregate(c["n"], F.lit(0.0), lambda a, x: a + x).alias("freq")).alias("value"))))
    return codes.select("g", "tid", "pidx", rows.alias("rows"), estimates.alias("lps"), F.transform("den", lambda d: _log(F.col("a0"), d)).alias("unseen")), totals


def _salted(records: DataFrame, long: DataFrame, n_keys: int, rid: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: hot codes are dealt to ``HOT`` salts."""
    family = records.groupBy("g", "tid").agg((F.sum("rows") / HOT).alias("much"))
    hot = records.select("g", "tid", "pidx", "rows").join(family, ["g", "tid"]).where(F.col("rows") > F.col("much")).select("g", "tid", "pidx")
    marked = hot.withColumn("hot", F.lit(True))
    marked = F.broadcast(marked) if n_keys * HOT <= BROADCAST_MAP_LIMIT else marked
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(HOT - 1))).otherwise(F.array(F.lit(0)))
    records = records.join(marked, ["g", "tid", "pidx"], "left").withColumn("salt", F.explode(salts)).drop("hot")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(rid), F.lit(HOT))).otherwise(0).cast("int")
    return records, long.join(marked, ["g", "tid", "pidx"], "left").withColumn("salt", salt).drop("hot")


def score_by_join(df: DataFrame, spec: B.BayesSpec, counts: DataFrame, *, group_col: str | None = None, n_groups: int = 1,
                  keep: tuple[str, ...] = ("rid",)) -> DataFrame:
    """The scores of :func:`kestrel.operators.bayes.score`, model and rows both distributed."""
    domain = n_groups
    for card in spec.cards:
        domain *= card
    if domain > COLLAPSE_DOMAIN_LIMIT:
        return _score_rows(df, spec, counts, group_col, keep)
    inside = F.lit(True)
    for name, card in [*zip(spec.attrs, spec.cards, strict=True), *([(group_col, n_groups)] if group_col else [])]:
        inside = inside & F.coalesce(F.col(name).between(0, card - 1), F.lit(False))
    by = [*([group_col] if group_col else []), *spec.attrs]
    scored = _score_rows(df.where(inside).select(*by).distinct(), spec, counts, group_col, tuple(by))
    scored = scored.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(by)], "probability", "prediction")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & (F.col(c) == F.col(f"_t{i}"))
    # at most ``domain`` tuples
    met = df.where(inside).join(F.broadcast(scored), same).select(*keep, "probability", "prediction")
    return met.union(_score_rows(df.where(~inside), spec, counts, group_col, keep))


def _score_rows(df: DataFrame, spec: B.BayesSpec, counts: DataFrame, group_col: str | None, keep: tuple[str, ...]) -> DataFrame:
    """One record per row and family, ``keep`` names the row."""
    k = spec.n_classes
    g = F.col(group_col).cast("int") if group_col else F.lit(0)
    fams = [t.family for t in spec.tables]
    rows = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], g.alias("g"), *spec.attrs, F.lit(0).alias("_cls"))
    shape = NominalData(rows, spec.attrs, spec.cards, k, cls="_cls")
    cells = (_explicit_cells if len(fams) <= EXPLICIT_FAMILY_LIMIT else _hof_cells)(shape, fams, False)
    names = [f"_k{i}" for i in range(len(keep))]
    long = rows.select(*names, "g", cells).withColumnRenamed("fid", "tid").withColumn("pidx", F.col("pidx").cast("bigint"))
    records, totals = model_table(counts, spec, group_col)
    records, long = _salted(records, long, len(fams), "_k0")
    met = long.join(records, ["g", "tid", "pidx", "salt"], "left").join(totals, ["g", "tid"], "left")
    m = _Meta(spec, F.col("tid"))
    # a parent code that never occurs: only the pseudo-counts are left
    bare = _log(m.a0, m.denominator(F.lit(0.0), F.lit(0.0), F.coalesce("total", F.lit(0.0))))
    value = F.try_element_at("lps", F.col("v"))
    lp = F.coalesce(value["lp"], F.col("unseen"), F.array_repeat(bare, k))
    met = met.select(*names, "g", "tid", m.comp.alias("comp"), m.prior.alias("prior"), lp.alias("lp"), F.coalesce(value["freq"], F.lit(0.0)).alias("freq"))
    met = met.repartition(*names, "g")
    sums = met.groupBy(*names, "g", "comp").agg(F.array(*[F.sum(F.col("lp")[c]) for c in range(k)]).alias("lp"), F.max(F.when(F.col("prior"), F.col("freq"))).alias("freq"))
    parts = F.array_sort(F.collect_list(F.struct("comp", "lp", "freq")))
    per_row = sums.groupBy(*names, "g").agg(parts.alias("parts"))
    of_class = F.filter("parts", lambda p: p["comp"] < 0)
    per_row = per_row.select(*names, F.when(F.size(of_class) > 0, F.element_at(of_class, 1)["lp"]).otherwise(F.array_repeat(F.lit(0.0), k)).alias("cp"),
                             F.filter("parts", lambda p: p["comp"] >= 0).alias("parts"))
    out = per_row.select(*names, _combined(spec, k).alias("probability"))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "probability", argmax_first(F.col("probability")).alias("prediction"))


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    e = F.transform(logs, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _combined(spec: B.BayesSpec, k: int) -> Column:
    """Class probabilities from ``parts`` (comp, lp, freq) and the class prior ``cp``."""
    limit, zero = F.lit(float(spec.limit or 0.0)), F.array_repeat(F.lit(0.0), k)

    def added(rows: Column) -> Column:
        return F.aggregate(rows, zero, lambda acc, p: F.zip_with(acc, p, lambda a, b: a + b))

    used = F.filter("parts", lambda p: p["freq"] >= limit) if spec.combine != B.SOFTMAX_AVG else F.col("parts")
    if spec.combine == B.JOINT_SUM:
        logs = F.transform(used, lambda p: p["lp"])
        top = F.array_max(F.flatten(logs))
        raw = F.when(F.size(used) == 0, zero).when(top == F.lit(float("-inf")), zero).otherwise(
            added(F.transform(logs, lambda row: F.transform(row, lambda v: F.exp(v - top)))))
    elif spec.combine == B.NORM_SUM:
        raw = added(F.transform(used, lambda p: _softmax(p["lp"])))
    else:
        prior = F.col("cp") if spec.class_prior is not None else zero
        post = F.transform(used, lambda p: _softmax(F.zip_with(p["lp"], prior, lambda a, b: a + b)))
        raw = added(F.filter(post, lambda p: ~F.exists(p, F.isnan)))
    total = F.aggregate(raw, F.lit(0.0), lambda a, y: a + y)
    return F.when(total > 0, F.transform(raw, lambda r: r / total)).otherwise(_softmax(F.col("cp")))
