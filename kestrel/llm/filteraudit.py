"""Audit of how quality filters interact, by count-weighted decision diagrams.

Five filters look at every whole text (null: empty); words are maximal runs of characters
that are not white space.  A document fails

* A with fewer than 50 words,
* B when 100 * different words < 65 * words,
* C when 100 * ``[A-Z]`` characters > 5 * code points,
* D when the text holds one of ``#$%&*|``,
* E when a row with a smaller doc_id has the same text, anywhere in the table.

The documents of a part (a value of ``source``; null counts as the empty string) become a
decision diagram: one level a filter, an edge for passing and one for failing, terminals
that carry counts of (documents, quality = 1, toxic = 1); equal subdiagrams are one node.
The 120 orders are visited by swaps of two adjacent levels (each order differs from the
one before by one swap, as change ringers walk all permutations); a swap rebuilds only the
nodes of its two levels.  In every order the path that passes everything yields the five
steps: what leaves it by a failing edge is removed at that level.

Spark does the work that grows with the table: one projection turns a text into a mask and
a 128-bit name, equal rows are counted before any shuffle, E comes from the smallest doc_id
of each name, and a part arrives at its diagram as at most 128 counts.

Defined cases: rows that repeat a doc_id and text are counted each and are no copies of
each other (the smaller doc_id must be strictly smaller); a null doc_id is a copy of
nothing, has no label and makes no other row a copy; several label rows of one doc_id count as 1
where any holds 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import map_batches, text_key

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT = 65
MAX_UPPER = 5
SYMBOLS = r"[#$%&*|]"
FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{f} bigint" for f in FIELDS)


def text_mask(text):
    """Bits 0..3: the text fails A, B, C, D."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, few = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    fails = [n < MIN_WORDS, 100 * few < MIN_DISTINCT * n, 100 * upper > MAX_UPPER * F.length(text), text.rlike(SYMBOLS)]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): counts of documents by the filters they fail."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2 = text_key(F.col("text"))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), h1.alias("h1"),
                       h2.alias("h2"), text_mask(text).alias("mask"))
    rows = rows.groupBy("id", "part", "h1", "h2", "mask").agg(F.count(F.lit(1)).alias("n"))
    has = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int")).alias("toxic"))
    # rows without an id have no label; a key of their own keeps them from meeting in one task
    none = F.when(F.col("id").isNull(), F.col("h1").bitwiseOR(F.lit(1))).otherwise(F.lit(0))
    rows = rows.withColumn("id0", F.coalesce("id", F.lit(0))).withColumn("none", none.cast("bigint"))
    has = has.select(F.col("id").alias("id0"), F.lit(0).cast("bigint").alias("none"), "good", "toxic")
    rows = rows.join(has, ["id0", "none"], "left").select(
        "id", "part", "h1", "h2", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # one row for each text, part and label pair, with its smallest id and the rows of that id
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    texts = rows.groupBy("h1", "h2", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), first.alias("first"))
    least = texts.groupBy("h1", "h2").agg(F.min("first.id").alias("least"), F.count(F.lit(1)).alias("forms"))
    least = least.where(F.col("forms") > 1).drop("forms")
    texts = texts.join(least, ["h1", "h2"], "left")
    here = F.col("least").isNull() | (F.col("least") == F.col("first.id"))
    passing = F.col("no_id") + F.when(F.col("first.id").isNotNull() & here, F.col("first.n")).otherwise(0)
    both = texts.select("part", "good", "toxic", F.inline(F.array(
        F.struct(F.col("mask").alias("mask"), passing.alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passing).alias("n")))))
    return both.where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


class Diagram:
    """Ordered diagram over five variables with counts at its ends.

    ``level[i]`` maps a node of level i to its (passing, failing) children; nodes of level 5
    are terminals, ``ends[node]`` their counts.  A node is one per pair of children."""

    def __init__(self, counts: dict[int, tuple[int, int, int]]):
        self.order = list(range(len(FILTERS)))
        self.level: list[dict[int, tuple[int, int]]] = [{} for _ in FILTERS]
        self.ends: dict[int, tuple[int, int, int]] = {}
        self.known: dict = {}
        self.weights: dict[int, tuple[int, int, int]] = {}
        self.fresh = 0
        self.root = self._grow(0, 0, counts)

    def _terminal(self, counts):
        if ("end", counts) not in self.known:
            self.known["end", counts] = self.fresh
            self.ends[self.fresh] = counts
            self.fresh += 1
        return self.known["end", counts]

    def _node(self, i: int, passing: int, failing: int) -> int:
        """The one node of level i (and its present variable) with these children."""
        key = (i, passing, failing)
        if key not in self.known:
            self.known[key] = self.fresh
            self.fresh += 1
        self.level[i][self.known[key]] = (passing, failing)
        return self.known[key]

    def _grow(self, i: int, mask: int, counts) -> int:
        if i == len(FILTERS):
            return self._terminal(counts.get(mask, (0, 0, 0)))
        return self._node(i, self._grow(i + 1, mask, counts), self._grow(i + 1, mask | 1 << i, counts))

    def swap(self, i: int) -> None:
        """Exchange the variables of levels i and i + 1; other levels keep their nodes."""
        upper, lower = self.level[i], self.level[i + 1]
        for k in [k for k in self.known if k[0] in (i, i + 1)]:
            del self.known[k]
        self.level[i], self.level[i + 1] = {}, {}
        moved = {}
        for node, (p, f) in upper.items():
            (pp, pf), (fp, ff) = lower[p], lower[f]
            moved[node] = self._node(i, self._node(i + 1, pp, fp), self._node(i + 1, pf, ff))
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]
        if i == 0:
            self.root = moved[self.root]
        else:
            above = self.level[i - 1]
            for k in [k for k in self.known if k[0] == i - 1]:
                del self.known[k]
            for node, (p, f) in above.items():
                above[node] = (moved[p], moved[f])
                self.known[i - 1, moved[p], moved[f]] = node

    def weight(self, node: int, i: int) -> tuple[int, int, int]:
        """Counts below a node."""
        if i == len(FILTERS):
            return self.ends[node]
        if node not in self.weights:
            p, f = self.level[i][node]
            self.weights[node] = tuple(a + b for a, b in zip(self.weight(p, i + 1), self.weight(f, i + 1), strict=True))
        return self.weights[node]

    def steps(self) -> list[tuple[int, int, tuple[int, int, int]]]:
        """(variable, documents still passing, counts removed) along the path that passes."""
        self.weights, node, out = {}, self.root, []
        for i, var in enumerate(self.order):
            p, f = self.level[i][node]
            out.append((var, self.weight(p, i + 1)[0], self.weight(f, i + 1)))
            node = p
        return out


def walk(n: int):
    """Positions of the adjacent swaps that lead through all n! orders (plain changes)."""
    if n < 2:
        return
    inner = list(walk(n - 1))
    down = True
    for k in range(len(inner) + 1):
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if k < len(inner):
            yield inner[k] + 1 if down else inner[k]
        down = not down


WALK = list(walk(len(FILTERS)))


def audit_part(counts: dict[int, tuple[int, int, int]]) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique, good lost, toxic lost, shapley) of all orders."""
    diagram, runs = Diagram(counts), []
    for swap in [None, *WALK]:
        if swap is not None:
            diagram.swap(swap)
        runs.append((list(diagram.order), diagram.steps()))
    # a filter that comes first removes all that fail it; one that comes last, what fails it only
    fails = {run[0][0]: run[0][2][0] for _, run in runs}
    only = {run[-1][0]: run[-1][2][0] for _, run in runs}
    total = dict.fromkeys(range(len(FILTERS)), 0)
    for _, run in runs:
        for var, _, out in run:
            total[var] += out[0]
    return [("".join(FILTERS[v] for v in order), k + 1, kept, out[0], fails[var] - out[0], only[var], out[1], out[2], total[var])
            for order, run in runs for k, (var, kept, out) in enumerate(run)]


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step."""
    masks = failure_masks(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))

    def audit(batch):
        cols: list[list] = [[] for _ in range(3 + len(FIELDS))]
        for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts: dict[int, tuple[int, int, int]] = {}
            for c in cells:
                n, g, t = counts.get(c["mask"], (0, 0, 0))
                counts[c["mask"]] = (n + c["n"], g + c["n"] * c["good"], t + c["n"] * c["toxic"])
            for row in audit_part(counts):
                for col, v in zip(cols, (part, *row), strict=True):
                    col.append(v)
        kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * len(FIELDS)
        return dict(zip(("part", "filter_order", "step", *FIELDS), (pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), strict=True))

    return map_batches(masks, audit, SCHEMA)


_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
AUDIT_SQL = rf"""
WITH lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
             FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up,
        min(doc_id) OVER (PARTITION BY text) AS least FROM t),
f AS (SELECT doc_id, part, map {{
        'A': len(ws) < 50, 'B': 100 * len(list_distinct(ws)) < 65 * len(ws), 'C': 100 * up > 5 * length(text),
        'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)}} AS fails FROM w),
m AS (SELECT part, fails, count(*) AS n, CAST(sum(coalesce(good, 0)) AS BIGINT) AS good, CAST(sum(coalesce(toxic, 0)) AS BIGINT) AS toxic
      FROM f LEFT JOIN lab USING (doc_id) GROUP BY part, fails),
o AS (SELECT col0 AS filter_order, unnest(range(1, 6)) AS step FROM (VALUES {_ORDERS})),
j AS (SELECT part, filter_order, step, n, good, toxic, fails[substr(filter_order, step, 1)] AS here,
        list_bool_or([fails[substr(filter_order, CAST(k AS INTEGER), 1)] FOR k IN range(1, step)]) AS before,
        list_bool_or([fails[x] FOR x IN ['A', 'B', 'C', 'D', 'E'] IF x != substr(filter_order, step, 1)]) AS other
      FROM m, o),
s AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step,
        CAST(sum(n) FILTER (NOT here AND NOT coalesce(before, false)) AS BIGINT) AS kept,
        CAST(sum(n) FILTER (here AND NOT coalesce(before, false)) AS BIGINT) AS removed,
        CAST(sum(n) FILTER (here AND before) AS BIGINT) AS redundant,
        CAST(sum(n) FILTER (here AND NOT other) AS BIGINT) AS unique_fails,
        CAST(sum(good) FILTER (here AND NOT coalesce(before, false)) AS BIGINT) AS good_lost,
        CAST(sum(toxic) FILTER (here AND NOT coalesce(before, false)) AS BIGINT) AS toxic_lost
      FROM j GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
  coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley
FROM s
"""
