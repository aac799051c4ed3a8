"""DuckDB SQL builders for the oracle side of the catalogue.

These strings are an independent re-statement of each operator in plain SQL (long
form: joins and group-bys instead of array arithmetic), used only to check the
Spark implementations.  Nothing here runs on Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

from kestrel.functions.hashing import h_sql
from kestrel.sources.tables import VIEW_META, VIEW_SQL


def with_view(view: str, *ctes: str) -> str:
    """``WITH <view ctes>, <more ctes>`` (each extra cte is ``name AS (...)``)."""
    body = VIEW_SQL[view].strip()
    more = ",\n".join(c.strip() for c in ctes if c)
    return "WITH " + body + ((",\n" + more) if more else "")


def meta(view: str):
    attrs, cards, k = VIEW_META[view]
    return attrs, cards, k


def inst_cte(view: str, name: str = "inst") -> str:
    """Instances with an x list (attributes then the class) and weight."""
    attrs, _, _ = meta(view)
    return f"{name} AS (SELECT rid, cls, weight, [{', '.join(attrs)}, cls] AS xs FROM {view})"


def cards_sql(view: str) -> str:
    _, cards, k = meta(view)
    return "[" + ", ".join(str(c) for c in (*cards, k)) + "]"


def atts_cte(view: str) -> str:
    attrs, _, _ = meta(view)
    d = len(attrs)
    return f"atts AS (SELECT DISTINCT CAST(att AS INTEGER) AS att FROM (SELECT unnest(range({d})) AS att FROM {view}) t)"


def structure_fixed_ctes(d: int, size: int, m: int, seed: int) -> list[str]:
    hk = h_sql(str(seed), "component", "att", "p")
    return [
        f"comps AS (SELECT CAST(range AS INTEGER) AS component FROM range({size}))",
        "base AS (SELECT c.component, a.att FROM comps c CROSS JOIN atts a)",
        "cand AS (SELECT component, att, CAST(unnest(range(att)) AS INTEGER) AS p FROM base)",
        f"ranked AS (SELECT component, att, p, row_number() OVER (PARTITION BY component, att ORDER BY {hk}, p) AS r FROM cand)",
        f"picked AS (SELECT component, att, list_sort(list(p)) AS ps FROM ranked WHERE r <= {m} GROUP BY component, att)",
        f"""struct AS (
  SELECT b.component, b.att, CAST(list_append(coalesce(pk.ps, []::INTEGER[]), {d}) AS INTEGER[]) AS parents
  FROM base b LEFT JOIN picked pk ON b.component = pk.component AND b.att = pk.att
  UNION ALL
  SELECT component, {d} AS att, CAST([{d}] AS INTEGER[]) AS parents FROM comps)""",
    ]


def _ordered_ctes(d: int, size: int, seed: int, with_class: bool) -> list[str]:
    nodes = "SELECT att FROM atts" + (f" UNION ALL SELECT {d} AS att" if with_class else "")
    ho = h_sql(str(seed), "component", "'order'", "att")
    return [
        f"comps AS (SELECT CAST(range AS INTEGER) AS component FROM range({size}))",
        f"nodes AS ({nodes})",
        "base AS (SELECT c.component, CAST(n.att AS INTEGER) AS att FROM comps c CROSS JOIN nodes n)",
        f"ord AS (SELECT component, att, row_number() OVER (PARTITION BY component ORDER BY {ho}, att) AS pos FROM base)",
        """cand AS (SELECT o1.component, o1.att, o1.pos, o2.att AS p FROM ord o1
                JOIN ord o2 ON o1.component = o2.component AND o2.pos < o1.pos)""",
    ]


def structure_shuffled_ctes(d: int, size: int, m: int, seed: int) -> list[str]:
    hk = h_sql(str(seed), "component", "att", "p")
    return _ordered_ctes(d, size, seed, False) + [
        f"ranked AS (SELECT component, att, pos, p, row_number() OVER (PARTITION BY component, att ORDER BY {hk}, p) AS r FROM cand)",
        f"picked AS (SELECT component, att, list_sort(list(p)) AS ps FROM ranked WHERE pos - 1 <= {m} OR r <= {m} GROUP BY component, att)",
        f"""struct AS (
  SELECT o.component, o.att, CAST(list_append(coalesce(pk.ps, []::INTEGER[]), {d}) AS INTEGER[]) AS parents
  FROM ord o LEFT JOIN picked pk ON o.component = pk.component AND o.att = pk.att
  UNION ALL
  SELECT component, {d} AS att, CAST([{d}] AS INTEGER[]) AS parents FROM comps)""",
    ]


def structure_free_ctes(d: int, size: int, m: int, seed: int) -> list[str]:
    hk = h_sql(str(seed), "component", "att", "p")
    return _ordered_ctes(d, size, seed, True) + [
        f"ranked AS (SELECT component, att, pos, p, row_number() OVER (PARTITION BY component, att ORDER BY {hk}, p) AS r FROM cand)",
        f"picked AS (SELECT component, att, list_sort(list(p)) AS ps FROM ranked WHERE r <= {m} GROUP BY component, att)",
        """struct AS (
  SELECT o.component, o.att, CAST(coalesce(pk.ps, []::INTEGER[]) AS INTEGER[]) AS parents
  FROM ord o LEFT JOIN picked pk ON o.component = pk.component AND o.att = pk.att)""",
    ]


def count_ctes(view: str, struct: str = "struct", name: str = "cpt", class_digit: bool = False,
               inst: str = "inst", keys: tuple[str, ...] = ()) -> list[str]:
    """Counts of every (component, att, parents) row of ``struct`` over ``inst``."""
    attrs, _, k = meta(view)
    d = len(attrs)
    cards = cards_sql(view)
    digit = f" * {k} + i.cls" if class_digit else ""
    kk = "".join(f"i.{c}, " for c in keys)
    kg = "".join(f"{c}, " for c in keys)
    return [
        f"fam AS (SELECT component, att, list_filter(parents, lambda p: p <> {d}) AS ap FROM {struct})",
        f"""{name}_cells AS (
  SELECT {kk}f.component, f.att, i.cls,
         CAST(list_reduce(f.ap, lambda acc, p: acc * {cards}[p + 1] + i.xs[p + 1], 0){digit} AS BIGINT) AS pidx,
         CAST(i.xs[f.att + 1] AS INTEGER) AS v, i.weight
  FROM {inst} i CROSS JOIN fam f)""",
        f"""{name} AS (SELECT {kg}component, att, cls, pidx, v, sum(weight) AS n
  FROM {name}_cells GROUP BY {kg}component, att, cls, pidx, v)""",
    ]


# ------------------------------------------------------------------ Bayes scoring
@dataclass(frozen=True)
class Ande:
    """An AnDE model as SQL states it: super-parent sets of ``n_dep`` attributes in
    lexicographic order; per set one joint prior table of class and set, and one
    conditional table for each other attribute; one class prior.  Pseudo-counts are 1, or
    with ``m`` are m over the cells of a prior and m over an attribute's cardinality."""

    n_dep: int
    m: float | None = None
    limit: float | None = 1.0
    joint: bool = True
    class_prior = True

    @property
    def combine(self) -> str:
        return "joint_sum" if self.joint else "norm_sum"

    def tabs(self, view: str) -> str:
        attrs, _, k = meta(view)
        d, cards = len(attrs), cards_sql(view)
        sets = {0: "SELECT 0 AS component, []::INTEGER[] AS s",
                1: f"SELECT CAST(range AS INTEGER) AS component, [CAST(range AS INTEGER)] AS s FROM range({d})",
                2: f"""SELECT CAST(row_number() OVER (ORDER BY a.range, b.range) - 1 AS INTEGER) AS component,
    [CAST(a.range AS INTEGER), CAST(b.range AS INTEGER)] AS s FROM range({d}) a JOIN range({d}) b ON a.range < b.range"""}[self.n_dep]

        def size(x):
            return f"CAST(list_reduce(list_transform({x}, lambda p: {cards}[p + 1]), lambda a, b: a * b, 1) AS INTEGER)"

        prior_a0 = "1.0" if self.m is None else f"{self.m!r} / ({k} * {size('s')})"
        cond_a0 = "1.0" if self.m is None else f"{self.m!r} / {cards}[a + 1]"
        return f"""tabs AS (SELECT row_number() OVER (ORDER BY component, prior DESC, att) - 1 AS tid, * FROM (
  WITH sets AS ({sets}), atts_of AS (SELECT component, s, CAST(range AS INTEGER) AS a FROM sets, range({d}))
  SELECT component, CASE WHEN len(s) = 0 THEN -1 ELSE s[len(s)] END AS att, s[1:len(s) - 1] AS ap, {size('s[1:len(s) - 1]')} AS S,
    CASE WHEN len(s) = 0 THEN 1 ELSE {cards}[s[len(s)] + 1] END AS card, CAST({prior_a0} AS DOUBLE) AS a0, TRUE AS prior, FALSE AS cn FROM sets
  UNION ALL
  SELECT component, a, s, {size('s')}, {cards}[a + 1], CAST({cond_a0} AS DOUBLE), FALSE, FALSE FROM atts_of WHERE NOT list_contains(s, a)
  UNION ALL SELECT -1, -1, []::INTEGER[], 1, 1, 1.0, TRUE, FALSE) u)"""


def bayes_model_ctes(view: str, spec, inst: str = "inst", keys: tuple[str, ...] = (),
                     cnt_source: str | None = None) -> list[str]:
    """tabs, cnt (per table cell counts), est (log estimates and value frequencies).
    ``keys`` partition everything (e.g. ``g`` = CV fold model); ``cnt_source`` replaces
    the counting step with an existing (keys..., tid, cls, pidx, v, n) relation."""
    _, _, k = meta(view)
    cards = cards_sql(view)
    kk = "".join(f"{c}, " for c in keys)
    kp = ", ".join(keys)
    pt = f"PARTITION BY {kp + ', ' if keys else ''}"
    ctes = [spec.tabs(view) if isinstance(spec, Ande) else ""]  # other models bring their own ``tabs``
    if cnt_source is None:
        ctes.append(f"""cnt AS (
  SELECT {''.join(f'i.{c}, ' for c in keys)}t.tid, i.cls,
         CAST(list_reduce(t.ap, lambda acc, p: acc * {cards}[p + 1] + i.xs[p + 1], 0) AS INTEGER) AS pidx,
         CAST(CASE WHEN t.att < 0 THEN 0 ELSE i.xs[t.att + 1] END AS INTEGER) AS v, sum(i.weight) AS n
  FROM {inst} i CROSS JOIN tabs t GROUP BY ALL)""")
    else:
        ctes.append(f"cnt AS (SELECT * FROM {cnt_source})")
    groups = (f"grp AS (SELECT DISTINCT {kp} FROM cnt)" if keys else "")
    if groups:
        ctes.append(groups)
    src = "tabs CROSS JOIN grp" if keys else "tabs"
    ctes += [
        f"""dense AS (SELECT {kk}tid, S, card, a0, prior, cn, CAST(unnest(range(S * card * {k})) AS INTEGER) AS idx
  FROM {src})""",
        f"""est0 AS (SELECT d.*, d.idx // (d.S * d.card) AS cls, (d.idx // d.card) % d.S AS pidx, d.idx % d.card AS v
  FROM dense d)""",
        f"""est1 AS (SELECT e.*, coalesce(c.n, 0) AS n FROM est0 e LEFT JOIN cnt c
  USING ({kk}tid, cls, pidx, v))""",
        f"""est AS (SELECT {kk}tid, cls, pidx, v,
  ln((n + a0) / CASE WHEN prior THEN sum(n) OVER ({pt}tid) + a0 * S * card * {k}
                     WHEN cn THEN sum(n) OVER ({pt}tid, pidx) + a0 * {k}
                     ELSE sum(n) OVER ({pt}tid, cls, pidx) + a0 * card END) AS logp,
  sum(n) OVER ({pt}tid, pidx, v) AS freq
  FROM est1)""",
    ]
    return ctes


def bayes_terms_cte(view: str, spec, inst: str = "inst", keys: tuple[str, ...] = ()) -> str:
    _, _, k = meta(view)
    cards = cards_sql(view)
    on = "".join(f" AND e.{c} = i.{c}" for c in keys)
    return f"""terms AS (
  SELECT i.rid, {''.join(f'i.{c}, ' for c in keys)}t.component, t.prior, cl.c, e.logp, e.freq
  FROM {inst} i CROSS JOIN tabs t CROSS JOIN (SELECT CAST(range AS INTEGER) AS c FROM range({k})) cl
  JOIN est e ON e.tid = t.tid AND e.cls = cl.c{on}
   AND e.pidx = list_reduce(t.ap, lambda acc, p: acc * {cards}[p + 1] + i.xs[p + 1], 0)
   AND e.v = CASE WHEN t.att < 0 THEN 0 ELSE i.xs[t.att + 1] END)"""


def bayes_prob_ctes(spec, k: int, keys: tuple[str, ...] = (), inst: str = "inst") -> list[str]:
    """probs(rid, keys..., cls, prob) from terms / est."""
    rk = ", ".join(("rid",) + tuple(keys))
    kk = "".join(f"{c}, " for c in keys)
    pk = f"PARTITION BY {', '.join(keys)}" if keys else ""
    kon = "".join(f" AND x.{c} = y.{c}" for c in keys)
    ctes = [f"cpt AS (SELECT {''.join(f'e.{c}, ' for c in keys)}e.cls AS c, e.logp FROM est e "
            f"JOIN tabs t ON e.tid = t.tid WHERE t.component = -1)",
            f"cpm AS (SELECT {kk}c, exp(logp - max(logp) OVER ({pk})) AS e FROM cpt)",
            f"cpn AS (SELECT {kk}c, e / sum(e) OVER ({pk}) AS p FROM cpm)"]
    if spec.combine == "joint_sum":
        limit = spec.limit if spec.limit is not None else 0.0
        ctes += [
            f"""lp AS (SELECT {rk}, component, c, sum(logp) AS lp, max(CASE WHEN prior THEN freq END) AS f
  FROM terms WHERE component >= 0 GROUP BY {rk}, component, c)""",
            f"act AS (SELECT * FROM lp WHERE f >= {float(limit)!r})",
            f"mx AS (SELECT {rk}, max(lp) AS m FROM act GROUP BY {rk})",
            f"raw AS (SELECT {rk}, c, sum(exp(lp - m)) AS r FROM act JOIN mx USING ({rk}) GROUP BY {rk}, c)",
        ]
    elif spec.combine == "norm_sum":
        limit = spec.limit if spec.limit is not None else 0.0
        ctes += [
            f"""lp AS (SELECT {rk}, component, c, sum(logp) AS lp, max(CASE WHEN prior THEN freq END) AS f
  FROM terms WHERE component >= 0 GROUP BY {rk}, component, c)""",
            f"act AS (SELECT * FROM lp WHERE f >= {float(limit)!r})",
            f"lm AS (SELECT {rk}, component, max(lp) AS m FROM act GROUP BY {rk}, component)",
            f"le AS (SELECT {rk}, component, c, exp(lp - m) AS e FROM act JOIN lm USING ({rk}, component))",
            f"lpost AS (SELECT {rk}, component, c, e / sum(e) OVER (PARTITION BY {rk}, component) AS p FROM le)",
            f"raw AS (SELECT {rk}, c, sum(p) AS r FROM lpost GROUP BY {rk}, c)",
        ]
    else:
        ctes += [
            f"""lp0 AS (SELECT {rk}, component, c, sum(logp) AS lp FROM terms WHERE component >= 0
  GROUP BY {rk}, component, c)""",
            (f"""lp AS (SELECT {', '.join('x.' + c for c in ('rid',) + tuple(keys))}, x.component, x.c, x.lp + y.logp AS lp
  FROM lp0 x JOIN cpt y ON x.c = y.c{kon})""" if spec.class_prior is not None else "lp AS (SELECT * FROM lp0)"),
            f"lm AS (SELECT {rk}, component, max(lp) AS m FROM lp GROUP BY {rk}, component)",
            f"le AS (SELECT {rk}, component, c, exp(lp - m) AS e FROM lp JOIN lm USING ({rk}, component))",
            f"lpost AS (SELECT {rk}, component, c, e / sum(e) OVER (PARTITION BY {rk}, component) AS p FROM le)",
            f"raw AS (SELECT {rk}, c, sum(p) AS r FROM lpost GROUP BY {rk}, c)",
        ]
    ctes.append(f"""probs AS (SELECT {rk}, c AS cls, r / sum(r) OVER (PARTITION BY {rk}) AS prob FROM raw
  UNION ALL
  SELECT {', '.join('x.' + c for c in ('rid',) + tuple(keys))}, y.c AS cls, y.p AS prob FROM {inst} x JOIN cpn y ON TRUE{kon}
  WHERE NOT EXISTS (SELECT 1 FROM raw r WHERE {' AND '.join(f'r.{c} = x.{c}' for c in ('rid',) + tuple(keys))}))""")
    return ctes


def bayes_score_sql(view: str, spec, extra_ctes: list[str] | None = None, final: str | None = None) -> str:
    _, _, k = meta(view)
    ctes = [inst_cte(view), *(extra_ctes or []), *bayes_model_ctes(view, spec),
            bayes_terms_cte(view, spec), *bayes_prob_ctes(spec, k)]
    sel = final or "SELECT rid, CAST(cls AS INTEGER) AS cls, round(prob, 6) AS prob FROM probs"
    return with_view(view, *ctes) + "\n" + sel


# ------------------------------------------------------------------------- folds / CV
def interleaved_folds_ctes(view: str, repeats: int, k: int, seed: int, src: str = "inst") -> list[str]:
    hk = h_sql(f"rep + {seed}", "rid")
    return [
        f"reps AS (SELECT CAST(range AS INTEGER) AS rep FROM range({repeats}))",
        f"ir AS (SELECT r.rep, i.* FROM {src} i CROSS JOIN reps r)",
        f"rk AS (SELECT *, row_number() OVER (PARTITION BY rep, cls ORDER BY {hk}, rid) - 1 AS r FROM ir)",
        "cc AS (SELECT rep, cls, count(*) AS n FROM ir GROUP BY rep, cls)",
        """coff AS (SELECT rep, cls, coalesce(sum(n) OVER (PARTITION BY rep ORDER BY cls
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM cc)""",
        f"fi AS (SELECT rk.*, CAST((r + o) % {k} AS INTEGER) AS fold, "
        f"CAST(rep * {k} + (r + o) % {k} AS INTEGER) AS g FROM rk JOIN coff USING (rep, cls))",
    ]


def cv_sql(view: str, spec, name: str, repeats: int, k: int, seed: int) -> str:
    _, _, nk = meta(view)
    ctes = [inst_cte(view), *interleaved_folds_ctes(view, repeats, k, seed),
            f"""tr AS (SELECT fi.rep * {k} + f.f AS g, fi.rid, fi.cls, fi.weight, fi.xs FROM fi
  CROSS JOIN (SELECT CAST(range AS INTEGER) AS f FROM range({k})) f WHERE fi.fold <> f.f)""",
            *bayes_model_ctes(view, spec, inst="tr", keys=("g",)),
            bayes_terms_cte(view, spec, inst="fi", keys=("g",)),
            *bayes_prob_ctes(spec, nk, keys=("g",), inst="fi"),
            """pred AS (SELECT rid, g, cls AS prediction FROM (
  SELECT rid, g, cls, row_number() OVER (PARTITION BY rid, g ORDER BY prob DESC, cls) AS rn FROM probs) t WHERE rn = 1)""",
            """acc AS (SELECT fi.g, sum(CASE WHEN pred.prediction = fi.cls THEN fi.weight ELSE 0 END) / sum(fi.weight) AS a
  FROM fi JOIN pred ON fi.rid = pred.rid AND fi.g = pred.g GROUP BY fi.g)"""]
    return with_view(view, *ctes) + \
        f"\nSELECT '{name}' AS model, round(avg(a), 6) AS acc_mean, round(stddev_samp(a), 6) AS acc_std FROM acc"


def c45_ctes(attrs: tuple[str, ...], src: str, min_rows: int, cf: float, slack: float) -> list[str]:
    """The C4.5-like trees of ``src`` (g, attributes, cls, weight), levels unrolled: ``tree`` holds
    (g, node, depth, att, cls, n, errors) after pruning."""
    from statistics import NormalDist

    d, cols = len(attrs), ", ".join(attrs)
    z = repr(NormalDist().inv_cdf(1 - cf))
    xlogx = "CASE WHEN {0} > 0 THEN {0} * log2({0}) ELSE 0 END".format
    out = [f"t0 AS MATERIALIZED (SELECT g, {cols}, cls, sum(weight) AS n, '' AS node FROM {src} GROUP BY ALL)"]
    for i in range(d + 1):
        out += [
            f"""c{i} AS MATERIALIZED (SELECT g, node, att, val, cls, sum(n) AS n FROM (
  SELECT g, node, cls, n, unnest({list(range(d))}) AS att, unnest([{cols}]) AS val FROM t{i}) u GROUP BY ALL)""",
            f"k{i} AS MATERIALIZED (SELECT g, node, cls, sum(n) AS nc FROM t{i} GROUP BY ALL)",
            f"w{i} AS MATERIALIZED (SELECT g, node, sum(nc) AS n, max(nc) AS top, sum({xlogx('nc')}) AS bc FROM k{i} GROUP BY ALL)",
            f"m{i} AS (SELECT k.g, k.node, min(cls) AS cls FROM k{i} k JOIN w{i} w ON k.g = w.g AND k.node = w.node AND k.nc = w.top GROUP BY ALL)",
            f"v{i} AS (SELECT g, node, att, val, sum(n) AS nv, sum({xlogx('n')}) AS vc FROM c{i} GROUP BY ALL)",
            f"""p{i} AS (SELECT v.g, v.node, att, w.n, bc, sum({xlogx('nv')}) AS bv, sum(vc) AS bb FROM v{i} v
  JOIN w{i} w ON v.g = w.g AND v.node = w.node GROUP BY ALL HAVING sum(CASE WHEN nv >= {min_rows} THEN 1 ELSE 0 END) >= 2)""",
            f"q{i} AS (SELECT *, round(({xlogx('n')} - bc - bv + bb) / n, 9) AS gain, ({xlogx('n')} - bv) / n AS info FROM p{i})",
            f"z{i} AS (SELECT *, avg(gain) OVER (PARTITION BY g, node) AS mean FROM q{i} WHERE gain > 0)",
            f"""s{i} AS MATERIALIZED (SELECT g, node, att FROM (SELECT *, row_number() OVER (PARTITION BY g, node ORDER BY round(gain / info, 9) DESC, att) AS r
  FROM z{i} WHERE gain >= mean - 0.001) b WHERE r = 1)""",
            f"""l{i} AS MATERIALIZED (SELECT w.g, w.node, s.att, m.cls, w.n, w.n - w.top AS errors FROM w{i} w JOIN m{i} m ON w.g = m.g AND w.node = m.node
  LEFT JOIN s{i} s ON w.g = s.g AND w.node = s.node)""",
            f"""t{i + 1} AS MATERIALIZED (SELECT t.g, {cols}, cls, n, t.node || '/' || s.att || '=' || [{cols}][s.att + 1] AS node FROM t{i} t
  JOIN s{i} s ON t.g = s.g AND t.node = s.node)"""]
    f = "((errors + 0.5) / n)"
    upper = f"(({f} + {z} * {z} / (2 * n) + {z} * sqrt({f} / n - {f} * {f} / n + {z} * {z} / (4 * n * n))) / (1 + {z} * {z} / n))"
    own = f"errors + CASE WHEN errors < 1 THEN n * (1 - pow({cf}, 1 / n)) WHEN errors + 0.5 >= n THEN greatest(n - errors, 0) ELSE {upper} * n - errors END"
    up = "regexp_replace({0}.node, '/[^/]*$', '')".format
    for i in range(d, -1, -1):
        if i == d:
            out.append(f"e{i} AS MATERIALIZED (SELECT *, {own} AS estimate FROM l{i})")
            continue
        out += [f"y{i} AS (SELECT e.g, {up('e')} AS node, sum(estimate) AS parts FROM e{i + 1} e GROUP BY ALL)",
                f"""e{i} AS MATERIALIZED (SELECT g, node, CASE WHEN stays THEN att END AS att, cls, n, errors, CASE WHEN stays THEN parts ELSE own END AS estimate
  FROM (SELECT l.*, own, parts, coalesce(round(own, 9) > round(parts + {slack}, 9), false) AS stays
        FROM (SELECT *, {own} AS own FROM l{i}) l LEFT JOIN y{i} y ON l.g = y.g AND l.node = y.node) j)"""]
    out.append("r0 AS MATERIALIZED (SELECT * FROM e0)")
    out += [f"r{i} AS MATERIALIZED (SELECT e.* FROM e{i} e JOIN r{i - 1} r ON e.g = r.g AND {up('e')} = r.node WHERE r.att IS NOT NULL)" for i in range(1, d + 1)]
    return out + ["tree AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT g, node, {i} AS depth, att, cls, n, errors FROM r{i}" for i in range(d + 1)) + ")"]


def c45_walk_ctes(attrs: tuple[str, ...], src: str) -> list[str]:
    """``tree_pred`` (g, rid, prediction): rows of ``src`` walked down ``tree``."""
    cols = ", ".join(attrs)
    out = [f"x0 AS (SELECT g, rid, {cols}, '' AS node, CAST(NULL AS INTEGER) AS prediction FROM {src})"]
    for i in range(len(attrs) + 1):
        out.append(f"""x{i + 1} AS MATERIALIZED (SELECT x.g, x.rid, {cols}, x.node || '/' || tree.att || '=' || [{cols}][tree.att + 1] AS node,
  coalesce(tree.cls, x.prediction) AS prediction FROM x{i} x LEFT JOIN tree ON x.g = tree.g AND x.node = tree.node)""")
    return out + [f"tree_pred AS (SELECT g, rid, prediction FROM x{len(attrs) + 1})"]
