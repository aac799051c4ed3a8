"""Repair of damaged conversations by a shortest path with big-integer weights.

Rows are damaged by crc32(``conv_id:turn``) % 20 (0 drops the row, 1 empties its text, 2
removes ``[.!?]``, 3 repeats it next to itself, 4 makes the role ``user``), then judged in
the order of their turns.  The first fault of a row counts: blank, duplicate (role and text
seen earlier in the conversation), truncated (last character that is no white space is not
one of ``.!?``).  The repair keeps (K), re-roles (R), deletes (D) rows and inserts (I) empty
turns so that the role initials read ``(s?(ua)+)?``.

Every partial repair is one integer: high digits hold its cost, then follow W octal digits,
one for each letter of the audit in ASCII order (D I K R = 1 2 3 4), the first letter at the
highest place, zeros behind the last.  The smaller integer is the cheaper repair and, among
equal costs, the one with the smaller audit, so an ordinary minimum over the edges of the
graph (row, state of the pattern) decides everything; the cost and the audit are read off
the digits, and replaying the audit gives the repaired rows.

A conversation is taken in blocks of at most ``BLOCK`` rows, so integers stay short: between
blocks the letters so far are replaced by one digit, the rank of the repair among those
of the (at most four) open states.  That is exact: after a row's letter no audit is the
beginning of another one of the same rows, hence the order of two is settled.  Each open
state carries its own SHA-256, so a conversation is read once, in a stream, and only a
block and the audit itself are held.

Damage and row faults are found before the one shuffle by conv_id; duplicates by a window inside
it.  A SHA-256 over all of a conversation's text can only be taken in order, therefore
rows of one conversation are read by one task, however long it is, in bounded memory.

Defined cases: nulls read as one space (a null turn sorts first); rows of one turn are
ordered by role and text; a role with another initial (or none) can only be re-roled or
deleted; a null conv_id is a conversation; a conversation that loses all rows has zeros, an
empty audit and the hash of the empty string; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
BLOCK_CHARS = 1 << 22
BLANK = " \t\n\x0b\x0c\r"
NONE, BLANK_ROW, DUPLICATE, TRUNCATED = range(4)
#: letters of the audit by digit; 0 ends it
LETTERS = "0DIKR"
#: states of the pattern: nothing yet, after s, after u, after a
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: what an inserted or re-roled row becomes in each state
NEXT_ROLE = {START: "user", SYSTEM: "user", ASSISTANT: "user", USER: "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


@lru_cache(maxsize=1 << 15)
def best_edits(entries: tuple, rows: tuple, last: bool) -> dict:
    """Cheapest edits of a block: ``entries`` are (state, cost, rank of its audit so far),
    ``rows`` (initial, fault).  Returns state -> (cost, place in the order of
    equal costs, letters, entry state), or for the last block the one that ends in an accepting state."""
    width = 4 * len(rows) + 3
    rank_at, cost_at = 3 * width, 3 * width + 3
    now = {q: (cost << cost_at | rank << rank_at, 0, q) for q, cost, rank in entries}

    def add(w, at, cost, letter):
        return w + (cost << cost_at) + (letter << 3 * (width - 1 - at)), at + 1

    def offer(into, q, w, at, origin):
        if q not in into or w < into[q][0]:
            into[q] = (w, at, origin)

    def inserts():
        for _ in range(3):  # more would come back to a state at a higher cost
            for q, (w, at, origin) in list(now.items()):
                offer(now, STEP[q, NEXT_ROLE[q][0]], *add(w, at, 2, 2), origin)

    for initial, fault in rows:
        inserts()
        after: dict = {}
        extra = int(fault == TRUNCATED)
        for q, (w, at, origin) in now.items():
            offer(after, q, *add(w, at, 3, 1), origin)
            if fault not in (BLANK_ROW, DUPLICATE):
                if (q, initial) in STEP:
                    offer(after, STEP[q, initial], *add(w, at, extra, 3), origin)
                offer(after, STEP[q, NEXT_ROLE[q][0]], *add(w, at, 2 + extra, 4), origin)
        now = after
    if last:
        inserts()
        w, at, origin = min(now[q] for q in (START, ASSISTANT) if q in now)
        now = {ASSISTANT: (w, at, origin)}
    out = {}
    for q, (w, _, origin) in now.items():
        digits = format(w & ((1 << rank_at) - 1), "o").zfill(width).rstrip("0")
        out[q] = (w >> cost_at, w & ((1 << cost_at) - 1), "".join(LETTERS[int(d)] for d in digits), origin)
    return out


class _Open:
    """A partial repair: state of the pattern, cost, audit so far (linked pieces), hash."""

    __slots__ = ("cost", "audit", "sha", "lines", "rank")

    def __init__(self, cost=0, audit=None, sha=None, lines=0, rank=0):
        self.cost, self.audit, self.sha, self.lines, self.rank = cost, audit, sha or hashlib.sha256(), lines, rank

    def extended(self, q: int, letters: str, cost: int, rows: list) -> _Open:
        sha, lines, at = self.sha.copy(), self.lines, 0
        for x in letters:
            if x == "I":
                role, text, q = NEXT_ROLE[q], "", STEP[q, NEXT_ROLE[q][0]]
            else:
                role, text, _ = rows[at]
                at += 1
                if x == "D":
                    continue
                if x == "R":
                    role = NEXT_ROLE[q]
                q = STEP[q, role[:1]]
            sha.update((("\n" if lines else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            lines += 1
        return _Open(cost, (self.audit, letters), sha, lines)

    def letters(self) -> str:
        out, link = [], self.audit
        while link:
            link, part = link[0], link[1]
            out.append(part)
        return "".join(reversed(out))


class Conversation:
    """Rows of one conversation in order, taken in blocks."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.chars = conv_id, [], 0
        self.open = {START: _Open()}
        self.faults, self.illegal, self.before = [0, 0, 0, 0], 0, None
        self.first = self.turn = None
        self.turns = 0

    def add(self, turn, role, text, fault) -> None:
        if len(self.rows) >= BLOCK or self.chars >= BLOCK_CHARS:
            self._close(False)
        self.rows.append((role, text, fault))
        self.chars += len(text)
        self.faults[fault] += 1
        if self.before is not None and (self.before, role[:1]) not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1

    def _close(self, last: bool) -> None:
        least = min(o.cost for o in self.open.values())
        entries = tuple(sorted((q, o.cost - least, o.rank) for q, o in self.open.items()))
        got = best_edits(entries, tuple((r[:1], f) for r, _, f in self.rows), last)
        new, order = {}, {}
        for q, (cost, place, letters, origin) in got.items():
            new[q], order[q] = self.open[origin].extended(origin, letters, cost + least, self.rows), place
        for rank, q in enumerate(sorted(order, key=order.get)):
            new[q].rank = rank
        self.open, self.rows, self.chars = new, [], 0

    def result(self) -> tuple:
        self._close(True)
        (end,) = self.open.values()
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, end.cost, end.letters(), end.sha.hexdigest())


SCHEMA = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
          "audit string, repaired_sha256 string")
_KINDS = dict(zip((c.split()[0] for c in SCHEMA.split(", ")), [pa.int64()] * 7 + [pa.string()] * 2, strict=True))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, alive, copy): rows after damage; a dropped row stays as a mark of its conversation."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    h = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), space), F.coalesce(F.col("text"), space)
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), (h != 0).alias("alive"),
        F.when(h == 4, F.lit("user")).when(h != 0, role).alias("role"),
        F.when(h == 1, F.lit("")).when(h == 2, F.regexp_replace(text, "[.!?]", "")).when(h != 0, text).alias("text"),
        F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows with their first fault, dealt by conv_id."""
    body = F.btrim("text", F.lit(BLANK))
    end = F.substring(body, -1, 1)
    rows = rows.withColumn("bare", body == "").withColumn("cut", ~end.isin(".", "!", "?")).withColumn(
        "k1", F.xxhash64("role", "text")).withColumn("k2", F.xxhash64(F.lit(7), "text", F.length("text"), "role"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "alive", "k1", "k2").orderBy(F.col("turn").asc_nulls_first(), "copy"))
    fault = F.when(F.col("bare"), BLANK_ROW).when(seen > 1, DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(NONE)
    return rows.repartition("conv_id").withColumn("fault", fault).drop("bare", "cut", "k1", "k2")


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of the table: faults, cheapest cost, audit and hash of the repaired rows."""
    rows = with_faults(damaged(conversations)).select("conv_id", "turn", "alive", "role", "text", "fault", "copy")
    rows = rows.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "copy")

    def run(batches):
        now, done = None, []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), _KINDS.values(), strict=True)], list(_KINDS))

        for batch in batches:
            for conv, turn, alive, role, text, fault, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.result())
                    now = Conversation(conv)
                if alive:
                    now.add(turn, role, text, fault)
            if done:
                yield flush()
                done.clear()
        if now is not None:
            done.append(now.result())
            yield flush()

    return rows.mapInArrow(run, SCHEMA)


REPAIR_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten([[CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]
        FOR x IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')]),
      lambda a, x : CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 20 AS h
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
f AS (
  SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS c0,
    CASE WHEN body = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM e),
g AS (
  SELECT *, lag(c0) OVER (PARTITION BY conv_id ORDER BY i) AS c1 FROM f),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (c1 IS NOT NULL AND c1 || c0 NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES
  (0, 0, 0, CAST([] AS VARCHAR[])), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']), (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
  (2, 0, 2, []), (2, 1, 3, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 0, 3, []), (3, 1, 2, ['user:']), (3, 2, 3, ['user:', 'assistant:'])
) AS t(q, k, q2, added)),
s AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, q2 AS q, min({'cost': 2 * k, 'audit': repeat('I', k), 'lines': added}) AS v
  FROM n, ins WHERE ins.q = 0 GROUP BY conv_id, q2
  UNION ALL
  SELECT o.conv_id, o.i, ins.q2, min({'cost': o.cost + 2 * k, 'audit': o.audit || repeat('I', k), 'lines': list_concat(o.lines, added)})
  FROM (
    SELECT f.conv_id, f.i, q, v.cost + 3 AS cost, v.audit || 'D' AS audit, v.lines AS lines
    FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1
    UNION ALL
    SELECT f.conv_id, f.i, CASE c0 WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, v.cost + CAST(fault = 3 AS INTEGER), v.audit || 'K', list_append(v.lines, role || ':' || text)
    FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1
    WHERE fault IN (0, 3) AND ((c0 = 's' AND q = 0) OR (c0 = 'u' AND q IN (0, 1, 3)) OR (c0 = 'a' AND q = 2))
    UNION ALL
    SELECT f.conv_id, f.i, CASE q WHEN 2 THEN 3 ELSE 2 END, v.cost + 2 + CAST(fault = 3 AS INTEGER), v.audit || 'R',
      list_append(v.lines, CASE q WHEN 2 THEN 'assistant:' ELSE 'user:' END || text)
    FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1 WHERE fault IN (0, 3)) o
  JOIN ins ON ins.q = o.q GROUP BY o.conv_id, o.i, ins.q2),
z AS (
  SELECT n.*, (SELECT min(v) FROM s WHERE s.conv_id IS NOT DISTINCT FROM n.conv_id AND s.i = n.n AND q IN (0, 3)) AS v FROM n)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(v.cost, 0) AS BIGINT) AS cost, coalesce(v.audit, '') AS audit,
  sha256(coalesce(array_to_string(v.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN z ON a.conv_id IS NOT DISTINCT FROM z.conv_id
"""
