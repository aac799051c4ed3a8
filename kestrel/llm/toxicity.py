"""Toxicity by a weighted finite-state pattern grammar.

A text is lower-cased, cut into words and clauses (ends: ``.!?;:`` and line ends).  Every word is
read by a lexical transducer: learned insult stems (prefixes with a weight) and closed lists
of insults, targets, negations, verbs of reporting and verbs of harm in four languages turn
it into one of the symbols

    o other   i insult   h harm   t target   n negation   r report   . end of the clause

Four small transducers read those symbols, each the output of the one before, composed to
one table (``GRAMMAR``) when the module is loaded:

* negation: an ``i`` or ``h`` at most ``SCOPE`` words after an ``n`` becomes negated,
* threat: an ``h`` that meets a ``t`` within ``REACH`` words becomes a threat ``H`` there,
* report: what follows an ``r`` in its clause is reported,
* target: an insult at most ``NEAR`` words after a ``t`` is aimed at somebody; a ``t`` at
  most two words after an insult aims it afterwards (``a``).

The weight of a match is its lexical weight times the factor of its output symbol; a clause's
score is the sum of its matches, so an isolated negated or reported word hardly counts.  A
document is scored by a logistic model over its clauses (total, highest, share, length).

Learning.  Labels come from rows that are not held out, at most ``SAMPLE`` rows a class (those with
the smallest hash; the bound is a parameter).  A document counts once for a word, under one
context (its smallest hash of the two neighbours), and equal contexts count once: copies of
a document, however many, are one observation.  Stems are the prefixes whose share of toxic
observations is significant among all tried ones; the logistic model is fitted on clause scores by
stems of the other half of the sample.  Stem counting runs on Spark; what reaches the driver is
the significant stems and four numbers a sampled row.

Defined cases: a null text is empty and scores like a text without matches; a null doc_id is
not held out and has no label; several labels of one doc_id are toxic where any is; other
label values than 0 and 1 teach nothing; without both classes every score is the share of
toxic labels (0 without labels); long texts are read whole; repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import map_batches, text_key
from kestrel.llm.text import ALNUM, buffers, mix, prefix, slices, span_hash, words

SAMPLE = 4000
THRESHOLD = 0.7
SHORTEST, LONGEST = 3, 12
#: a learned lexical weight is at most this
HEAVIEST = 6.0
HARM = 4.0
#: lexical weight of a listed insult that was not learned
SEED = 3.0
SCOPE, REACH, NEAR = 3, 3, 4
CLAUSE_END = np.zeros(256, bool)
CLAUSE_END[[ord(c) for c in ".!?;:\n\r"]] = True

# Closed word lists (English, German, French, Spanish).
TARGETS = ("you your yours yourself he she they him her them those these people "
           "du dich dir ihr euch er sie ihn ihm leute tu te toi vous il elle ils elles eux "
           "usted ustedes él ella ellos ellas gente").split()
NEGATIONS = ("not no never neither nor none without isn aren wasn don doesn didn won "
             "nicht kein keine keinen nie niemals ohne pas jamais aucun sans ne nunca jamás sin ningún").split()
REPORTS = ("said says say told wrote claimed reported quoted called according alleged "
           "sagte sagt schrieb behauptete laut dit disait écrit selon raconte dijo dice escribió según").split()
HARMS = ("kill murder hurt destroy beat shoot stab strangle töten umbringen schlagen vernichten "
         "tuer frapper détruire matar golpear destruir").split()
INSULTS = ("idiot idiots moron morons imbecile stupid dumb fool scum bastard loser jerk "
           "dumm dummkopf trottel arschloch abschaum crétin imbécile connard salaud abruti "
           "estúpido imbécil gilipollas cabrón basura").split()
# End of the fixed values.

Machine = dict  # (state, symbol) -> (state, output symbol); the start state is 0


def _machine(n_states: int, symbols, rule) -> Machine:
    return {(q, a): rule(q, a) for q in range(n_states) for a in symbols}


def outputs(m: Machine) -> set:
    return {out for _, out in m.values()}


def compose(first: Machine, second: Machine) -> Machine:
    """The machine that feeds the output of ``first`` to ``second``; only states that can be reached."""
    alphabet = sorted({a for _, a in first})
    number, todo, out = {(0, 0): 0}, [(0, 0)], {}
    while todo:
        pair = todo.pop()
        for a in alphabet:
            p, mid = first[pair[0], a]
            q, end = second[pair[1], mid]
            if (p, q) not in number:
                number[p, q] = len(number)
                todo.append((p, q))
            out[number[pair], a] = (number[p, q], end)
    return out


def _negation(q, a):
    if a == ".":
        return 0, a
    if a == "n":
        return SCOPE, "o"
    return max(q - 1, 0), a + "-" if q and a in "ih" else a


def _threat(q, a):
    """States: none, then countdown of a harm, then of a negated one."""
    if a == ".":
        return 0, a
    if a in ("h", "h-"):
        return (REACH if a == "h" else 2 * REACH), "o"
    if a == "t" and q:
        return 0, "H" if q <= REACH else "H-"
    return (q - 1 if q not in (0, REACH + 1) else 0), a


def _report(q, a):
    if a == ".":
        return 0, a
    if a == "r":
        return 1, "o"
    return q, a + '"' if q and a[0] in "iH" else a


def _target(q, a):
    """States: none, countdown of a target, then of an insult that nobody is the target of."""
    if a == ".":
        return 0, a
    if a == "t":
        return NEAR, "a" if q > NEAR else "o"
    if a[0] == "i":
        return (NEAR, a + "@") if 0 < q <= NEAR else (NEAR + 2, a)
    return (q - 1 if q not in (0, NEAR + 1) else 0), a


INPUT = "oihtnr."
GRAMMAR = _machine(SCOPE + 1, INPUT, _negation)
for _states, _rule in ((2 * REACH + 1, _threat), (2, _report), (NEAR + 3, _target)):
    GRAMMAR = compose(GRAMMAR, _machine(_states, sorted(outputs(GRAMMAR)), _rule))


def factor(symbol: str) -> float:
    """Weight of an output symbol, times the lexical weight of its word (``a``: of the insult before)."""
    if symbol[0] == "a":
        return 0.5
    if symbol[0] not in "iH":
        return 0.0
    return (1.5 if "@" in symbol else 1.0) * (0.2 if "-" in symbol else 1.0) * (0.4 if '"' in symbol else 1.0)


N_STATES = 1 + max(q for q, _ in GRAMMAR)
#: next state, factor and kind of output by (state, input symbol)
NEXT = np.array([[GRAMMAR[q, a][0] for a in INPUT] for q in range(N_STATES)]).tolist()
FACTOR = [[factor(GRAMMAR[q, a][1]) for a in INPUT] for q in range(N_STATES)]
KIND = [["oiHa".index(GRAMMAR[q, a][1][0]) if GRAMMAR[q, a][1][0] in "iHa" else 0 for a in INPUT] for q in range(N_STATES)]


def clause_score(symbols, weights) -> float:
    """Sum of weighted matches of one clause."""
    q, total, last = 0, 0.0, 0.0
    for a, w in zip(symbols, weights, strict=True):
        kind = KIND[q][a]
        if kind:
            f = FACTOR[q][a]
            total += f * (w if kind == 1 else HARM if kind == 2 else last)
            last = w if kind == 1 else last
        q = NEXT[q][a]
    return total


def _hashes(strings: list[str]) -> np.ndarray:
    data, off = buffers(pa.array(strings, pa.string()))
    h = span_hash(prefix(data), off[:-1], off[1:])
    return mix(h + np.diff(off).astype(np.uint64))


class Reader:
    """Finds the symbols of a batch of texts and scores its clauses; made inside a task from
    ``stems`` (string -> weight)."""

    def __init__(self, stems: dict[str, float]):
        sizes: dict[int, list] = {}
        for s, w in stems.items():
            sizes.setdefault(len(s.encode()), []).append((s, w))
        self.begins = np.zeros(1 << 24, bool)
        self.stems = []
        for size, some in sorted(sizes.items()):
            h = _hashes([s for s, _ in some])
            order = np.argsort(h)
            self.stems.append((size, h[order], np.array([w for _, w in some])[order]))
            for s, _ in some:
                b = s.encode()
                self.begins[b[0] << 16 | b[1] << 8 | b[2]] = True
        closed = [(w, INPUT.index(c)) for c, ws in (("t", TARGETS), ("n", NEGATIONS), ("r", REPORTS)) for w in ws]
        self.closed, self.symbol = self._sorted(closed)
        self.harm, _ = self._sorted([(w, 0) for w in HARMS])
        self.insult, _ = self._sorted([(w, 0) for w in INSULTS])

    @staticmethod
    def _sorted(pairs):
        h = _hashes([w for w, _ in pairs])
        order = np.argsort(h)
        return h[order], np.array([c for _, c in pairs])[order]

    def features(self, col) -> np.ndarray:
        """A row a text: total of the clause scores, highest, matched clauses, words."""
        data, off = buffers(pc.utf8_lower(pc.fill_null(col.cast(pa.string()), "")))
        out = np.zeros((len(off) - 1, 4))
        for i, j in slices(off):
            self._slice(data[off[i] : off[j]], off[i : j + 1] - off[i], out[i:j])
        return out

    def _slice(self, data, off, out) -> None:
        s, e, first = words(data, off, ALNUM)
        out[:, 3] = np.diff(first)
        if not len(s):
            return
        h, size = prefix(data), e - s
        weight = np.zeros(len(s))
        long = np.flatnonzero(size >= 3)
        at = s[long]
        some = long[self.begins[data[at].astype(np.int32) << 16 | data[at + 1].astype(np.int32) << 8 | data[at + 2]]]
        for n, hashes, weights in self.stems:
            some = some[size[some] >= n]
            key = mix(span_hash(h, s[some], s[some] + n) + np.uint64(n))
            pos = np.minimum(np.searchsorted(hashes, key), len(hashes) - 1)
            hit = hashes[pos] == key
            weight[some[hit]] = np.maximum(weight[some[hit]], weights[pos[hit]])
        whole = mix(span_hash(h, s, e) + size.astype(np.uint64))
        listed = np.isin(whole, self.insult)
        weight[listed] = np.maximum(weight[listed], SEED)
        symbol = np.where(weight > 0, INPUT.index("i"), 0)
        symbol[np.isin(whole, self.harm)] = INPUT.index("h")
        found = np.flatnonzero(symbol)
        if not len(found):
            return
        border = CLAUSE_END[data].astype(np.int64)
        np.add.at(border, off[:-1][off[:-1] < len(data)], 1)
        clause = np.cumsum(border)[s]
        hit = np.unique(clause[found])
        lo, hi = np.searchsorted(clause, hit), np.searchsorted(clause, hit, "right")
        doc = np.searchsorted(first, lo, "right") - 1
        for k in range(len(hit)):
            part = slice(lo[k], hi[k])
            sym = symbol[part].copy()
            pos = np.minimum(np.searchsorted(self.closed, whole[part]), len(self.closed) - 1)
            known = (self.closed[pos] == whole[part]) & (sym == 0)
            sym[known] = self.symbol[pos[known]]
            score = clause_score(sym.tolist(), weight[part].tolist())
            row = out[doc[k]]
            row[0] += score
            row[1] = max(row[1], score)
            row[2] += score > 0


def inputs(f: np.ndarray) -> np.ndarray:
    """What the logistic model sees of ``Reader.features``."""
    return np.column_stack([np.log1p(f[:, 0]), np.minimum(f[:, 1], 2 * HEAVIEST), f[:, 0] / np.sqrt(f[:, 3] + 10.0), f[:, 2] > 0])


def held_out(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 3 is 1; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(text, toxic, fold, name): at most about ``sample`` different texts of each class."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = _smallest(known, ["toxic"], F.xxhash64("id"), 2 * sample)
    h1, h2 = text_key(F.col(text))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), h1.alias("h1"), h2.alias("h2"))
    rows = rows.join(F.broadcast(known), "id")  # at most 4 * sample ids
    names = rows.select("toxic", "h1", "h2").distinct()
    names = _smallest(names, ["toxic"], F.xxhash64("h1", "h2"), sample)
    rows = rows.join(F.broadcast(names.distinct()), ["toxic", "h1", "h2"], "left_semi")
    return rows.groupBy("toxic", "h1", "h2").agg(F.first("text").alias("text")).select(
        "text", "toxic", (F.shiftrightunsigned("h1", 7) % 2).cast("int").alias("fold"), F.col("h1").alias("name"))


def _smallest(df: DataFrame, by: list[str], order, n: int) -> DataFrame:
    """About the ``n`` rows of each group with the smallest hash: those below a bound that the
    group's count gives, so no group is sorted."""
    sizes = {r["toxic"]: r["count"] for r in df.groupBy(*by).count().collect()}
    bound = F.lit(0).cast("bigint")
    for k, size in sizes.items():
        bound = F.when(F.col("toxic") == k, F.lit(min(2**63 - 1, 2**63 * n // size))).otherwise(bound)
    return df.where(F.shiftrightunsigned(order, 1) <= bound)


def observations(rows: DataFrame) -> DataFrame:
    """(word, cls, ctx): one row for a word of a text, cls = toxic + 2 * fold."""

    def run(b):
        data, off = buffers(pc.utf8_lower(b.column("text")))
        cls = np.array(b.column("toxic").to_pylist()) + 2 * np.array(b.column("fold").to_pylist())
        names, classes, contexts = [], [], []
        for i, j in slices(off):
            d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
            s, e, first = words(d, o, ALNUM)
            if not len(s):
                continue
            w = mix(span_hash(prefix(d), s, e) + (e - s).astype(np.uint64))
            doc = np.repeat(np.arange(j - i), np.diff(first))
            edge = np.zeros(len(s), bool)
            edge[first[:-1][np.diff(first) > 0]] = True
            left = np.where(edge, np.uint64(1), np.concatenate(([np.uint64(1)], w[:-1])))
            right = np.where(np.concatenate((edge[1:], [True])), np.uint64(2), np.concatenate((w[1:], [np.uint64(2)])))
            ctx = mix(left * np.uint64(0x9E3779B97F4A7C15) + right)
            order = np.lexsort((ctx, w, doc))
            new = np.ones(len(order), bool)
            new[1:] = (w[order][1:] != w[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            keep = order[new]
            keep = keep[(e - s)[keep] >= SHORTEST]
            different, where = np.unique(w[keep], return_index=True)
            texts = [d[s[k] : e[k]].tobytes().decode("utf-8", "replace")[: 4 * LONGEST] for k in keep[where]]
            names.append(pa.array(texts, pa.string()).take(pa.array(np.searchsorted(different, w[keep]))))
            classes.append(cls[i:j][doc[keep]])
            contexts.append(ctx[keep].view(np.int64))
        if not names:
            return None
        return {"word": pa.concat_arrays(names), "cls": pa.array(np.concatenate(classes), pa.int32()), "ctx": pa.array(np.concatenate(contexts), pa.int64())}

    return map_batches(rows, run, "word string, cls int, ctx bigint").distinct()


def stem_counts(rows: DataFrame) -> DataFrame:
    """(stem, n0..n3): observations of every prefix by class."""
    sums = [F.sum((F.col("cls") == k).cast("bigint")).alias(f"n{k}") for k in range(4)]
    by_word = observations(rows).groupBy("word").agg(*sums)
    ends = F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("word")))
    stems = by_word.where(F.length("word") >= SHORTEST).select(
        F.explode(F.transform(ends, lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("stem"), *[f"n{k}" for k in range(4)])
    return stems.groupBy("stem").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)])


def choose(stems: list[str], toxic: np.ndarray, clean: np.ndarray, totals: tuple[float, float], tried: int) -> dict[str, float]:
    """Stems that are significantly toxic, with their log-odds.  The most significant stem comes
    first (of equal ones the longest); its observations no longer count for shorter stems, and
    its extensions are read as it is."""
    t_all, c_all = max(totals[0], 1.0), max(totals[1], 1.0)
    share, need = t_all / (t_all + c_all), 2 * np.log(max(tried, 2)) + 2

    def significance(t, c):
        n = np.maximum(t + c, 1e-9)
        return 2 * (t * np.log(np.maximum(t, 1e-9) / (n * share)) + c * np.log(np.maximum(c, 1e-9) / (n * (1 - share))))

    def odds(t, c):
        return np.log((t + 0.5) / t_all) - np.log((c + 1.0) / c_all)

    g = significance(toxic, clean)
    chosen: dict[str, float] = {}
    taken: dict[str, tuple[float, float]] = {}  # observations of chosen extensions
    for k in sorted(np.flatnonzero((toxic >= 3) & (g > need)), key=lambda k: (-g[k], -len(stems[k]), stems[k])):
        s = stems[k]
        if any(s[:m] in chosen for m in range(SHORTEST, len(s))):
            continue
        gone = taken.get(s, (0.0, 0.0))
        t, c = toxic[k] - gone[0], clean[k] - gone[1]
        if t >= 3 and odds(t, c) > 1 and significance(t, c) > need:
            chosen[s] = float(min(odds(t, c), HEAVIEST))
            for m in range(SHORTEST, len(s)):
                before = taken.get(s[:m], (0.0, 0.0))
                taken[s[:m]] = (before[0] + t, before[1] + c)
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights of the standardised inputs and the constant, by Newton steps."""
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w, damp = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    damp[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(damp), z.T @ (y - p) - damp * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / spread, float(w[-1] - (w[:-1] / spread) @ mean)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> dict:
    """The model: stems with weights, logistic weights and constant (plain values)."""
    rows = training_rows(docs, labels, doc_id, text, sample).persist()
    try:
        classes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
        if len(classes) < 2:
            return {"stems": {}, "weights": np.zeros(4), "constant": None, "share": float(1 in classes)}
        counts = stem_counts(rows).persist()
        total = counts.agg(F.count(F.lit(1)).alias("tried"), *[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)]).first()
        found = counts.where("n1 + n3 >= 3").where(
            (F.col("n1") + F.col("n3")) * (total.n0 + total.n2) > 2 * (F.col("n0") + F.col("n2")) * (total.n1 + total.n3)).collect()
        counts.unpersist()
        names = [r.stem for r in found]
        n = np.array([[r.n0, r.n1, r.n2, r.n3] for r in found], float).reshape(-1, 4)
        t = [total.n0, total.n1, total.n2, total.n3]
        both = choose(names, n[:, 1] + n[:, 3], n[:, 0] + n[:, 2], (t[1] + t[3], t[0] + t[2]), total.tried)
        # rows of one fold are read with the stems of the other
        other = [choose(names, n[:, 3], n[:, 2], (t[3], t[2]), total.tried), choose(names, n[:, 1], n[:, 0], (t[1], t[0]), total.tried)]
        few = min(classes.values()) < 60  # too few to learn stems from a half
        readers: dict[int, Reader] = {}

        def run(b):
            fold = np.array(b.column("fold").to_pylist())
            f = np.zeros((b.num_rows, 4))
            for k in (0, 1):
                if (fold == k).any():
                    if k not in readers:
                        readers[k] = Reader(both if few else other[k])
                    f[fold == k] = readers[k].features(b.column("text").filter(pa.array(fold == k)))
            return {"name": b.column("name"), "toxic": b.column("toxic"), **{f"f{i}": pa.array(f[:, i], pa.float64()) for i in range(4)}}

        got = map_batches(rows, run, "name bigint, toxic int, f0 double, f1 double, f2 double, f3 double").toPandas().sort_values(["name", "toxic"])
    finally:
        rows.unpersist()
    w, constant = logistic(inputs(got[["f0", "f1", "f2", "f3"]].to_numpy(float)), got["toxic"].to_numpy(float))
    return {"stems": both, "weights": w, "constant": constant, "share": classes[1] / sum(classes.values())}


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, clauses): one row per row of ``docs``."""
    made: list[Reader] = []

    def run(b):
        if model["constant"] is None:
            p, n = np.full(b.num_rows, model["share"]), np.zeros(b.num_rows)
        else:
            if not made:
                made.append(Reader(model["stems"]))
            f = made[0].features(b.column("text"))
            p = 1 / (1 + np.exp(-np.clip(inputs(f) @ model["weights"] + model["constant"], -30, 30)))
            n = f[:, 2]
        return {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": pa.array(p, pa.float64()),
                "predicted": pa.array((p >= THRESHOLD).astype(np.int32), pa.int32()), "clauses": pa.array(n.astype(np.int64), pa.int64())}

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, run, f"doc_id {kind}, held_out boolean, score double, predicted int, clauses bigint")
