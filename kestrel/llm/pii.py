"""Personal data by base rules and a skip-chain conditional random field.

Base rules: email, ip, card and phone by regular expressions and their checks (parts at most
255; 14 to 19 digits that pass Luhn; 10 to 15 digits); leftmost matches that do not overlap,
per kind; a match that fails its check is dropped and not retried.

The rules miss data that they swallow into a failing match (a phone number followed by a card
number) or that repeats in a form they do not know.  The field labels each candidate token
(a run without white space that holds a digit or ``@``; groups of digits, one space apart, that
together write a card number are one token, see ``units``) as nothing or one of the kinds:

* token potentials: the token's shape (digits as d, letters as a, runs counted) and checks;
* chain potentials between neighbouring tokens that are both candidates, one for each label that
  both have;
* skip potentials between distant tokens of one document that repeat or are similar (the same
  digits, or the same address in lower case): each occurrence is linked with the next, so a
  token that occurs n times gives n - 1 links.

Marginals come from loopy belief propagation (``SWEEPS`` rounds of messages over all links of the
document).  Weights are learned by maximum pseudo-likelihood in NumPy from tokens labelled by the
base rules, leaving out tokens of failing matches, in a sample of at most ``SAMPLE`` documents
(those of smallest hash that have candidates; at most ``SAMPLE_TOKENS`` tokens each).

A run of neighbouring tokens of one kind, each with a marginal of at least ``SURE``, becomes a
span (a phone's run as a whole; of a card's run, parts that pass; else each token) if its text
passes the kind's own check and meets no base span.  Base spans stay.

Defined cases: a null or empty text has no spans; every text is read whole; repeated rows give
equal rows; with no training token the field adds nothing.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import map_batches, shipped, written

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 2000
SAMPLE_TOKENS = 200
SWEEPS = 6
SURE = 0.6

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: the lookbehind only saves time: a match inside a run of digits begins at its first
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
BLANKS = " \t\n\x0b\x0c\r"
BLANK = re.compile(r"[\x20\x09-\x0D]|\Z")
DIGITS = re.compile(r"[^0-9]+")
GROUPED = re.compile(r"[0-9]+(-[0-9]+)*")
_LEAD, _TRAIL = "\"'([{<", ",.;:!?\"')]}>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))


def _card_ok(s: str) -> bool:
    d = DIGITS.sub("", s)
    return 14 <= len(d) <= 19 and luhn(d)


def _phone_ok(s: str) -> bool:
    return 10 <= len(DIGITS.sub("", s)) <= 15


def _emails(text: str):
    """Matches of EMAIL.  The local part has no ``@``, so a match can only begin at the start of
    the run of its characters before an ``@`` (or after the match before)."""
    lo, at = 0, text.find("@")
    while at >= 0:
        s = lo + len(text[lo:at].rstrip(LOCAL))
        m = EMAIL.match(text, s) if s < at else None
        if m:
            yield m.span()
        lo = m.end() if m else at + 1
        at = text.find("@", lo)


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """((start, kind, end) in order, failing matches)."""
    spans, failed = [], []
    if "@" in text:
        spans += [(s, 0, e) for s, e in _emails(text)]
    for kind, pattern, ok, need in ((1, IP, _ip_ok, "."), (2, CARD, _card_ok, ""), (3, PHONE, _phone_ok, "+")):
        if need in text:
            for m in pattern.finditer(text):
                if ok(m.group()):
                    spans.append((m.start(), kind, m.end()))
                elif kind > 1:
                    failed.append(m.span())
    return sorted(spans), failed


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs without white space that hold a digit or ``@``."""
    out, lo, m = [], 0, DIGIT_OR_AT.search(text)
    while m:
        at = m.start()
        s = 1 + max(lo - 1, *(text.rfind(c, lo, at) for c in BLANKS))
        lo = BLANK.search(text, at).start()
        out.append((s, lo))
        m = DIGIT_OR_AT.search(text, lo)
    return out


DIGIT_OR_AT = re.compile("[0-9@]")
_RUN = re.compile(r"d+|a+")


def shape(token: str) -> str:
    """The token without outer punctuation, digits as d and letters as a, runs with their
    length (letters: without), and whether a long number passes Luhn."""
    t = token.strip(",.;:!?\"'")
    if "@" in t:
        return "@" + ("." if "." in t.split("@", 1)[1] else "")
    s = "".join("d" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in t[:64])
    s = _RUN.sub(lambda m: f"d{len(m.group())}" if m.group()[0] == "d" else "a", s)
    d = DIGITS.sub("", t)
    if 14 <= len(d) <= 19 and CARD.fullmatch(t.lstrip(_LEAD).rstrip(_TRAIL)):
        s = "d14+"  # a number that may be a card's: grouped or not, the same shape
    if 13 <= len(d) <= 19:
        s += " luhn" if luhn(d) else " plain"
    elif t.count(".") == 3 and "a" not in s:
        s = "quad" if all(p.isdigit() and int(p) <= 255 for p in t.split(".") if len(p) < 5) else "dots"
    return s


def key(token: str) -> str:
    """Equal for repeated and similar tokens."""
    if "@" in token:
        return token.strip(",.;:!?\"'()<>").lower()
    d = DIGITS.sub("", token)
    return d if len(d) >= 4 else ""


def units(text: str, where: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The candidates, with those that together write one card number as one: neighbours of
    digits, one space apart, in groups of four or more (the last of two or more), whose 14 to 19
    digits pass Luhn.  Of those that overlap, the ones that cover most digits; among equals the
    earlier, or the later if the run follows a phone number's beginning."""
    n = len(where)
    groups, opens, ends, late = [], [], [], []
    for i, (s, e) in enumerate(where):
        body = text[s:e].lstrip(_LEAD)
        core = body.rstrip(_TRAIL)
        groups.append([len(x) for x in core.split("-")] if GROUPED.fullmatch(core) else None)
        opens.append(len(body) == e - s)
        ends.append(len(core) == len(body))
        near = i > 0 and text[where[i - 1][1] : s] == " "
        late.append(near and (late[-1] if groups[i - 1] else any(c in text[slice(*where[i - 1])] for c in "+(")))
    best, take = [0] * (n + 1), [0] * n
    for i in range(n - 1, -1, -1):
        best[i] = best[i + 1]
        j, sizes = i, []
        while groups[j]:
            sizes += groups[j]
            if sum(sizes) > 19 or min(sizes[:-1], default=4) < 4:
                break
            if j > i and sum(sizes) >= 14 and sizes[-1] >= 2:
                got = sum(sizes) + best[j + 1]
                if (got > best[i] or got == best[i] and not late[i]) and luhn(DIGITS.sub("", text[where[i][0] : where[j][1]])):
                    best[i], take[i] = got, j
            if not ends[j] or j + 1 == n or not opens[j + 1] or text[where[j][1] : where[j + 1][0]] != " ":
                break
            j += 1
    out, i = [], 0
    while i < n:
        j = max(i, take[i])
        out.append((where[i][0], where[j][1]))
        i = j + 1
    return out


def edges(tokens: list[str], spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(chain links, skip links) of a document's candidate tokens."""
    chain = [(i, i + 1) for i in range(len(tokens) - 1) if spans[i + 1][0] - spans[i][1] == 1]
    last: dict[str, int] = {}
    skip = []
    for i, t in enumerate(tokens):
        k = key(t)
        if k:
            if k in last:
                skip.append((last[k], i))
            last[k] = i
    return chain, skip


@dataclass
class Field:
    """Potentials: per shape, per pair of neighbours, per pair of similar tokens (logs)."""

    shapes: dict[str, int]
    token: np.ndarray  # shapes (+ 1 unknown) x labels
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, shapes: list[str], chain, skip) -> np.ndarray:
        """Loopy belief propagation over all links of a document."""
        unary = self.token[[self.shapes.get(s, len(self.shapes)) for s in shapes]]
        links = np.array([*chain, *skip], np.int64).reshape(-1, 2)
        if not len(links):
            b = np.exp(unary - unary.max(1, keepdims=True))
            return b / b.sum(1, keepdims=True)
        pot = np.concatenate([np.broadcast_to(p, (n, *p.shape)) for p, n in ((self.chain, len(chain)), (self.skip, len(skip)))])
        a, b = links.T
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        msg = np.zeros((len(src), unary.shape[1]))
        for _ in range(SWEEPS):
            belief = unary.copy()
            np.add.at(belief, dst, msg)
            out = (belief[src] - msg[back])[:, :, None] + pot
            top = out.max(1, keepdims=True)
            new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
            msg = new - new.max(1, keepdims=True)
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _check(kind: int, s: str) -> bool:
    if kind == 0:
        return EMAIL.fullmatch(s) is not None
    if kind == 1:
        return IP.fullmatch(s) is not None and _ip_ok(s)
    d = DIGITS.sub("", s)
    if kind == 2:
        return re.fullmatch(r"[0-9][0-9 -]*[0-9]", s) is not None and 13 <= len(d) <= 19 and luhn(d)
    return re.fullmatch(r"\+?[0-9(][0-9 ().-]*[0-9]", s) is not None and 7 <= len(d) <= 15


def _free(taken, starts, s: int, e: int) -> bool:
    """Whether the span meets none of the sorted spans."""
    k = np.searchsorted(starts, e) - 1 if len(taken) else -1
    return all(taken[x][1] <= s for x in range(max(0, k - 3), k + 1))


def added_spans(text: str, base, field: Field) -> list[tuple[int, int, int]]:
    where = units(text, candidates(text))
    if not where:
        return []
    tokens = [text[s:e] for s, e in where]
    chain, skip = edges(tokens, where)
    p = field.marginals([shape(t) for t in tokens], chain, skip)
    label = np.where(p[:, 1:].max(1) >= SURE, p[:, 1:].argmax(1) + 1, 0)
    out, i = [], 0
    taken = sorted((s, e) for s, _, e in base)
    starts = np.array([s for s, _ in taken])
    near = set(chain)
    while i < len(tokens):
        j = i
        while label[i] and (j, j + 1) in near and label[j + 1] == label[i]:
            j += 1
        kind = int(label[i]) - 1
        before, after = (_LEAD + ",.;:!?", _TRAIL) if kind == 2 else (",.;:!?\"'", ",.;:!?\"')")
        a = i
        while kind >= 0 and a <= j:
            # phones have several tokens, and cards may: the longest part of the run from here that passes
            ends = [j] if kind == 3 else range(min(j, a + 18), a - 1, -1) if kind == 2 else [a]
            done = a
            for b in ends:
                s, e = where[a][0], where[b][1]
                while s < e and text[s] in before:
                    s += 1
                while e > s and text[e - 1] in after:
                    e -= 1
                if _free(taken, starts, s, e) and _check(kind, text[s:e]):
                    out.append((s, kind, e))
                    done = b
                    break
            a = j + 1 if kind == 3 else done + 1
        i = j + 1
    return out


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Field:
    """Learn the potentials from tokens labelled by the base rules."""

    def rows(b):
        keep, shapes, labels, chains, skips = [], [], [], [], []
        for n, t in enumerate(b.column("text").to_pylist()):
            if not t or not DIGIT_OR_AT.search(t):
                continue
            where = units(t, candidates(t)[:SAMPLE_TOKENS])
            spans, failed = base_spans(t)
            tokens = [t[s:e] for s, e in where]
            lab = [0] * len(where)
            for s, kind, e in spans:
                for i, (x, y) in enumerate(where):
                    if x < e and s < y:
                        lab[i] = kind + 1
            for s, e in failed:
                for i, (x, y) in enumerate(where):
                    if x < e and s < y and not lab[i] and y - x < e - s:
                        lab[i] = -1  # swallowed: unknown
            chain, skip = edges(tokens, where)
            keep.append(n)
            shapes.append([shape(x) for x in tokens])
            labels.append(lab)
            chains.append([x for x, _ in chain])
            skips.append([v for pair in skip for v in pair])
        take = pa.array(keep, pa.int64())
        ints = pa.list_(pa.int64())
        return {"o": b.column("o").take(take), "shapes": pa.array(shapes, pa.list_(pa.string())), "labels": pa.array(labels, ints),
                "chain": pa.array(chains, ints), "skip": pa.array(skips, ints)}

    keyed = docs.select(F.xxhash64(doc_id, text).alias("o"), F.col(text).alias("text"))
    got = map_batches(keyed, rows, "o bigint, shapes array<string>, labels array<bigint>, chain array<bigint>, skip array<bigint>")
    got = written(got, "pii-candidates")  # a few numbers for each text with candidates
    # rows below a hash bound, four times as many as wanted, so that few are ranked
    bound = min(2**63 - 1, 2**63 * 4 * SAMPLE // max(1, got.count()))
    got = got.where(F.shiftrightunsigned("o", 1) <= bound).withColumn("o", F.shiftrightunsigned("o", 1))
    got = got.orderBy("o", "shapes").limit(SAMPLE).collect()
    return learn([(r.shapes, r.labels, [(x, x + 1) for x in r.chain], list(zip(r.skip[::2], r.skip[1::2], strict=True))) for r in got])


def learn(rows, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    """Maximum pseudo-likelihood: each token given the labels of those linked with it."""
    k = len(KINDS) + 1
    names = sorted({s for r in rows for s in r[0]})
    shapes = {s: i for i, s in enumerate(names)}
    ids, y, before, after, like = [], [], [], [], []
    for sh, lab, chain, skip in rows:
        prev, nxt = {b: lab[a] for a, b in chain}, {a: lab[b] for a, b in chain}
        sim = np.zeros((len(sh), k))
        for a, b in skip:
            for i, j in ((a, b), (b, a)):
                if lab[j] >= 0:
                    sim[i, lab[j]] += 1
        for i, s in enumerate(sh):
            if lab[i] >= 0:
                ids.append(shapes[s])
                y.append(lab[i])
                before.append(prev.get(i, -1))
                after.append(nxt.get(i, -1))
                like.append(sim[i])
    field = Field(shapes, np.zeros((len(shapes) + 1, k)), np.zeros((k, k)), np.zeros((k, k)))
    field.token[-1, 0] = 3.0  # an unknown shape is nothing, unless its links say otherwise
    if not y:
        field.token[:, 0] = 3.0
        return field
    ids, y, before, after, like = np.array(ids), np.array(y), np.array(before), np.array(after), np.array(like)
    target = np.eye(k)[y]
    hot = lambda x: np.where(x[:, None] >= 0, np.eye(k)[np.maximum(x, 0)], 0)
    pb, pa_ = hot(before), hot(after)
    g2 = [np.ones_like(field.token), np.ones_like(field.chain), np.ones_like(field.skip)]
    prior = np.zeros_like(field.token)
    prior[:, 0] = 1.0  # a rare shape leans to nothing
    for _ in range(rounds):
        f = field.token[ids] + pb @ field.chain + pa_ @ field.chain.T + like @ field.skip
        p = np.exp(f - f.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = target - p
        tok = np.stack([np.bincount(ids, d[:, j], len(shapes) + 1) for j in range(k)], 1)
        sk = like.T @ d
        grads = [tok - 0.05 * (field.token - prior), np.eye(k) * (pb.T @ d + pa_.T @ d - ridge * field.chain), (sk + sk.T) / 2 - ridge * field.skip]
        for name, g, s in zip(("token", "chain", "skip"), grads, g2, strict=True):
            s += g * g
            setattr(field, name, getattr(field, name) + rate * g / np.sqrt(s))
    field.token[-1] = 0
    field.token[-1, 0] = 3.0
    # the rules swallow neighbouring cards, so that the sample holds none is no evidence against them
    field.chain[3, 3] = max(0.0, field.chain[3, 3])
    # similar tokens agree at least this strongly, however few pairs the sample holds
    field.skip = (field.skip + field.skip.T) / 2 + 2.0 * np.eye(k) - np.diag([2.0] + [0.0] * (k - 1))
    return field


def text_spans(text: str | None, field: Field):
    """(base spans, all spans), each (start, kind, end) in order."""
    if not text or not DIGIT_OR_AT.search(text):
        return [], []
    base, _ = base_spans(text)
    return base, sorted(base + added_spans(text, base, field))


def find(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row."""
    sent = shipped(docs.sparkSession, field)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    joined = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def run(b):
        got = [text_spans(t, sent()) for t in b.column("text").to_pylist()]
        out = {"doc_id": b.column("doc_id")}
        for i, kind in enumerate(KINDS):
            out[f"n_{kind}"] = pa.array([sum(k == i for _, k, _ in base) for base, _ in got], pa.int64())
        out["base_sha256"] = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got], pa.string())
        out["spans"] = pa.array([joined(spans) for _, spans in got], pa.string())
        out["n_added"] = pa.array([len(spans) - len(base) for base, spans in got], pa.int64())
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")


def masked(text: str, spans) -> str:
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, field: Field, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; other texts and all other
    columns pass unchanged (``n_chars``, if named, follows the text)."""
    sent = shipped(docs.sparkSession, field)

    def run(batches):
        for b in batches:
            texts = b.column(text).to_pylist()
            new = [masked(t, spans) if (spans := text_spans(t, sent())[1]) else t for t in texts]
            cols = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            if n_chars in cols:
                old = cols[n_chars].to_pylist()
                cols[n_chars] = pa.array([len(x) if x != t else o for x, t, o in zip(new, texts, old, strict=True)], cols[n_chars].type)
            cols[text] = pa.array(new, b.schema.field(text).type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(run, docs.schema)
