"""Language-model scores from a log-bilinear neural model.

Tokens are ``SPACE`` words (A-Z lower-cased), then one end per text.  Corpus counts are
exact and cover every training text: words are counted by a 64-bit hash, partial counts
first in the task, then in the aggregate.

Model.  Symbols are the most frequent tokens (at most ``HEAD``, each at least ``LEAST`` times) and
tail classes: every other token belongs to the class of the first bits of its hash.  There are
about twice as many tail classes as the root of the number of tail tokens, ``KINDS`` at most.
Symbols in order are cut into groups of equal sums of square roots of counts.  With r and q the
context and target vectors of symbols, d the target vectors of groups, c1 and c2 the weights of the
last and the last but one position and a, b biases (log-bilinear, diagonal context weights,
factored):

    h(u, v) = c1 * r_u + c2 * r_v
    p(s | u, v) = p(g | u, v) * p(s | g, u, v)      g the group of symbol s
    p(g | u, v) ~ exp(h . d_g + a_g),  p(s | g, u, v) ~ exp(h . q_s + b_s) over the symbols of g

and every tail token w that occurs ``LEAST`` times has a target vector of its own within its class t:

    p(w | u, v) = p(t | u, v) * p(w | t, u, v),     p(w | t, u, v) ~ exp(h . q_w + b_w) over the words of t

So the vectors grow with the corpus, but what is broadcast does not: the symbols' parameters are
200 bytes each, 10 MB at most, and the words of a tail class live only in the task that holds the class.

Training is NumPy noise-contrastive estimation, the normalisers taken as 1.  Symbols: training
texts fall by a hash of (doc_id, text) into groups of about ``GROUP_TOKENS`` tokens; a task passes
over one group in the order of the hash, in steps that do not depend on Arrow batches, and the changes of
the parameter rows it touched (16-bit floats) are averaged by touches in the order of the groups.  Rows
that repeat are counted first and dealt evenly over the groups.  Tail words: the occurrences of
all tail tokens, with their contexts, go to the part that holds their class; it trains the words
of each class on the training occurrences in a fixed order, and scores all.  A tail token holds
less than one ``HEAD``-th of all tokens, so no class is hot.  The scores are therefore a function
of the table, not of its splits (up to the rounding of 32-bit matrix products).

Scores are normalised exactly: the normalisers of groups by one matrix product a batch of contexts,
of symbols and tail words by one matrix product for each group or class and slice.  Where both context
symbols are among the ``SYMBOLS`` most frequent, exp of the group score is a product of a factor of
(u, g) and one of (v, g), so those normalisers are look-ups in one product of matrices.  Tail tokens that occur
less often share one word of their class and are scored inside it by add-one counts, with
one place for all unseen words, so that the outcomes of each position sum to 1.

Defined cases: null texts are empty (one end token); with no training text every count is 0
and the model is uniform; repeated rows are scored each; a null doc_id is not held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import shipped, written
from kestrel.llm.langid import held_out
from kestrel.llm.text import buffers, slices, word_hashes

SYMBOLS = 1024
LEAST = 10
HEAD = 1 << 15
#: most tail classes; with ``HEAD`` they fit 16-bit symbols
KINDS = 1 << 14
#: training tokens of one task, and tail occurrences of one part
GROUP_TOKENS = 1 << 21
PART_TOKENS = 1 << 21
#: tokens of one call of the trainer
CHUNK = 1 << 17
#: repeated rows that are joined by a broadcast; more take a shuffle join
FEW = 1 << 18
DIM = 24
NOISE = 32
WORD_NOISE = 5
#: occurrences of one step within a tail class
WORD_BATCH = 512
BATCH = 4096
#: rows of equal number that are added place by place
RUN = 8
#: cells of one product of contexts and targets; small enough for a core's cache
CELLS = 1 << 17
#: parameter rows of a record of changes
BLOCK = 1024
RATE = 0.1
SMOOTH = 1.0
ROUNDS = 1
END = np.uint64(0x1CE4E5B9D1342543)  # stands for the end token among word hashes
_MERGE = 1 << 21


def _tokens(col: pa.Array):
    """Per slice: token hashes with an end after every text, and first token of each text."""
    data, off = buffers(col)
    for i, j in slices(off):
        w, first = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
        yield i, np.insert(w, first[1:], END), first + np.arange(len(first))


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, n): how often each token occurs; equal tokens of a task are added up first."""

    def run(batches):
        keys, nums, size = [], [], 0

        def merged():
            k, inv = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(inv, np.concatenate(nums)).astype(np.int64)

        def out(k, n):
            for at in range(0, len(k), 1 << 16):
                yield pa.RecordBatch.from_pydict({"h": k[at : at + (1 << 16)].view(np.int64), "n": n[at : at + (1 << 16)]})

        for b in batches:
            for _, w, _ in _tokens(b.column(0)):
                k, n = np.unique(w, return_counts=True)
                keys.append(k)
                nums.append(n)
                size += len(k)
                if size > _MERGE:
                    k, n = merged()
                    if len(k) > _MERGE // 2:
                        yield from out(k, n)
                        k, n = k[:0], n[:0]
                    keys, nums, size = [k], [n], len(k)
        if keys:
            yield from out(*merged())

    return docs.select(text).mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def _kinds(distinct: int) -> int:
    """Bits of the number of a tail class."""
    return int(min(np.log2(KINDS), max(4, np.ceil(np.log2(2 * np.sqrt(distinct + 1))))))


@dataclass
class Vocabulary:
    """The head of the counts, sums of the tail classes, and totals of all."""

    total: int
    distinct: int
    h: np.ndarray  # sorted hashes of the head
    n: np.ndarray  # their counts
    symbol: np.ndarray  # their symbols, in order of frequency
    unigram: np.ndarray  # counts of the symbols: the head's, then the tail classes'
    bits: int  # of the number of a tail class

    def look(self, w: np.ndarray):
        """(count or 0, symbol, in head) of token hashes."""
        symbol = len(self.h) + self.kind(w)
        if not len(self.h):
            return np.zeros(len(w), np.int64), symbol, np.zeros(len(w), bool)
        at = np.minimum(np.searchsorted(self.h, w), len(self.h) - 1)
        ok = self.h[at] == w
        return np.where(ok, self.n[at], 0), np.where(ok, self.symbol[at], symbol), ok

    def kind(self, w: np.ndarray) -> np.ndarray:
        return (w >> np.uint64(64 - self.bits)).astype(np.int64)


def vocabulary(counts: DataFrame, head: int = HEAD, least: int = LEAST) -> Vocabulary:
    """The head is every token of the highest count classes (eighths of a power of two, ``least`` and
    more) that together hold at most ``head`` tokens, so no task ranks all tokens."""
    level, often = F.floor(F.log2("n") * 8), F.col("n") >= least
    sums = counts.groupBy(often.alias("often"), level.alias("level")).agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    sums = sorted(((r.often, r.level, r.size, r.total) for r in sums.collect()), reverse=True)  # at most 8 * 63 + 1 rows
    total, distinct = sum(c[3] for c in sums), sum(c[2] for c in sums)
    size, lowest = 0, 8 * 64
    for oft, lev, more, _ in sums:
        if not oft or size + more > head:
            break
        size, lowest = size + more, lev
    inside = often & (level >= lowest)
    top = counts.where(inside).toArrow()  # at most ``head`` rows
    h, n = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    best = np.lexsort((h.view(np.int64), -n))
    symbol = np.empty(len(h), np.int64)
    symbol[best] = np.arange(len(h))
    order = np.argsort(h)
    bits = _kinds(distinct - size)
    mass = np.zeros(1 << bits, np.int64)
    tail = counts.where(~inside).groupBy(F.shiftrightunsigned("h", 64 - bits).alias("kind")).agg(F.sum("n").alias("n"))
    for r in tail.collect():  # at most ``KINDS`` rows
        mass[r.kind] = r.n
    return Vocabulary(total, distinct, h[order], n[order], symbol[order], np.concatenate((n[best], mass)).astype(np.int64), bits)


def classes_of(unigram: np.ndarray) -> np.ndarray:
    """First symbol of each class, and the end.  The first symbol is a class of its own; the words behind
    it stand in order of frequency, so frequent words have small classes."""
    k = len(unigram)
    root = np.cumsum(np.sqrt(unigram[1:] + 1.0))
    if not len(root):
        return np.array([0, k])
    n = int(np.ceil(0.6 * np.sqrt(k)))
    part = np.minimum((root - root[0]) / root[-1] * n, n - 1).astype(np.int64)
    return np.concatenate(([0], 1 + np.flatnonzero(np.diff(part, prepend=-1)), [k]))


def _log_sum(s: np.ndarray) -> np.ndarray:
    if s.size:
        with np.errstate(over="ignore"):
            z = np.exp(s) @ np.ones(s.shape[1], s.dtype)
        if z.min() > 1e-20 and z.max() < np.inf:  # neither vanished nor overflowed
            return np.log(z)
    top = s.max(1, keepdims=True)
    s -= top
    return np.log(np.exp(s, out=s).sum(1)) + top[:, 0]


def _rise(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in place of ``x``."""
    np.negative(x, out=x)
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _order(idx: np.ndarray) -> np.ndarray:
    """Stable order; 16-bit numbers are sorted by their digits."""
    return np.argsort(idx.astype(np.uint16) if len(idx) and idx.max() < 1 << 16 else idx, kind="stable")


def _sums(idx: np.ndarray, val: np.ndarray, order: np.ndarray | None = None):
    """Different ``idx``, which are sorted (by ``order``, if given), the sums of the rows of ``val`` over
    each, their first places and their numbers.  Runs of at most ``RUN`` rows are added place by place, all
    runs at once; longer ones each by itself."""
    idx = idx if order is None else idx[order]
    new = np.empty(len(idx), bool)
    new[:1] = True
    np.not_equal(idx[1:], idx[:-1], out=new[1:])
    at = np.flatnonzero(new)
    n = np.diff(at, append=len(idx))
    out = val.take(at if order is None else order[at], 0)
    some, place = np.flatnonzero((n > 1) & (n <= RUN)), 1
    while len(some):
        here = at[some] + place
        out[some] = out.take(some, 0) + val.take(here if order is None else order[here], 0)
        place += 1
        some = some[n[some] > place]
    for i in np.flatnonzero(n > RUN).tolist():
        run = slice(at[i], at[i] + n[i])
        np.add.reduce(val[run] if order is None else val.take(order[run], 0), 0, out=out[i])
    return idx[at], out, at, n


def _merged(one, two):
    """The sums of two (different sorted rows, sums, numbers), those of ``two`` that ``one`` lacks at the end."""
    at = np.minimum(np.searchsorted(one[0], two[0]), len(one[0]) - 1)
    same = one[0][at] == two[0]
    for x, y in zip(one[1:], two[1:], strict=True):
        x[at[same]] += y[same]
    return [np.concatenate([x, y[~same]]) for x, y in zip(one, two, strict=True)]


def _row_sums(idx: np.ndarray, val: np.ndarray, *more):
    """Different ``idx``, and the sums of ``val`` and of ``more`` (one number a row) over each."""
    order = _order(idx)
    rows, out, at, _ = _sums(idx, val, order)
    return rows, out, *(np.add.reduceat(x[order], at) for x in more)


@dataclass
class LogBilinear:
    """Rows of ``m``: context vectors of the symbols, target vectors of the symbols, target vectors
    of the classes (their biases in the last column), the two position weights."""

    m: np.ndarray
    first: np.ndarray  # first symbol of each class, and the end

    @classmethod
    def start(cls, unigram: np.ndarray, dim: int = DIM, seed: int = 7) -> LogBilinear:
        rng, k, first = np.random.default_rng(seed), len(unigram), classes_of(unigram)
        mass = np.add.reduceat(unigram + 1.0, first[:-1])
        m = rng.normal(0, 0.1, (2 * k + len(mass) + 2, dim + 1)).astype(np.float32)
        m[:k, -1] = 0
        m[k : 2 * k, -1] = np.log((unigram + 1) / np.repeat(mass, np.diff(first)))
        m[2 * k : -2, -1] = np.log(mass / mass.sum())
        m[-2:] = 0.7
        return cls(m, first)

    @property
    def k(self) -> int:
        return int(self.first[-1])

    def parts(self):
        """(r, q, b, d, a, c) as views of the rows."""
        k, m = self.k, self.m
        return m[:k, :-1], m[k : 2 * k, :-1], m[k : 2 * k, -1], m[2 * k : -2, :-1], m[2 * k : -2, -1], m[-2:, :-1]

    def class_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def noise(self, unigram: np.ndarray):
        """What the training draws noise from, by ``unigram``."""
        cum = np.cumsum(unigram + 1.0)
        edge = np.concatenate(([0.0], cum))[self.first]
        mass, kinds = np.diff(edge), self.class_of()
        log_class = (np.log(mass / mass.sum()) + np.log(NOISE)).astype(np.float32)
        log_word = (np.log((unigram + 1) / mass[kinds]) + np.log(WORD_NOISE)).astype(np.float32)
        return cum, edge, mass, kinds, log_class, log_word

    def _step(self, rows, g, times, g2, touched, rate) -> None:
        """AdaGrad with one running square a row; ``g`` are gradients of different ``rows``, each the
        sum over ``times`` tokens."""
        g2[rows] += np.einsum("ij,ij->i", g, g) / g.shape[1]
        touched[rows] += times
        g *= (rate / np.sqrt(g2[rows] + SMOOTH))[:, None]
        g += self.m.take(rows, 0)
        self.m[rows] = g

    def train(self, u, v, w, noise, rng, g2: np.ndarray, touched: np.ndarray, rate: float = RATE) -> None:
        """One pass of noise-contrastive estimation over tokens w with contexts (u, v);
        ``noise`` as above, ``g2`` the running squares of the rows, ``touched`` how often each was used.
        A batch stands in order of its words, so of classes too: gradients of targets are sums of runs."""
        k, first, size, m = self.k, self.first, np.diff(self.first), self.m
        words_of, kinds_of, c = m[k : 2 * k], m[2 * k : -2], m[-2:]
        cum, edge, mass, kinds, log_class, log_word = noise
        for at in range(0, len(w), BATCH):
            by_word = at + _order(w[at : at + BATCH])
            uu, vv, ww = u[by_word], v[by_word], w[by_word]
            kk, ru, rv = kinds[ww], m.take(uu, 0), m.take(vv, 0)
            x = ru * c[0]
            x += rv * c[1]
            x[:, -1] = 1  # meets the biases
            # classes: noise shared by the batch
            neg = np.minimum(np.searchsorted(edge[1:], rng.random(NOISE) * edge[-1], "right"), len(mass) - 1)
            dk, dn = kinds_of.take(kk, 0), kinds_of.take(neg, 0)
            dn[:, -1] -= log_class[neg]
            pos = 1 - _rise(np.einsum("ij,ij->i", x, dk) - log_class[kk])
            fake = -_rise(x @ dn.T)
            dk *= pos[:, None]
            g = fake @ dn
            g += dk
            cut = np.flatnonzero(np.diff(kk, prepend=-1, append=-1))
            own, runs = kk[cut[:-1]], list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            pulled = (own, np.stack([pos[lo:hi] @ x[lo:hi] for lo, hi in runs]), np.diff(cut))
            rows = [(2 * k, _merged(pulled, _row_sums(neg, fake.T @ x, np.full(NOISE, len(ww)))))]
            # words: noise shared by the words of a class
            i = np.flatnonzero(size[kk] > 1)
            if len(i):
                x1, t = x.take(i, 0), ww[i]
                cut = np.flatnonzero(np.diff(kk[i], prepend=-1, append=-1))
                own, runs = kk[i[cut[:-1]]], list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
                place = edge[own][:, None] + rng.random((len(own), WORD_NOISE)) * mass[own][:, None]
                no = np.clip(np.searchsorted(cum, place, "right"), first[own][:, None], first[own + 1][:, None] - 1)
                qt, qn = words_of.take(t, 0), words_of.take(no, 0)
                qn[:, :, -1] -= log_word[no]
                p1 = 1 - _rise(np.einsum("ij,ij->i", x1, qt) - log_word[t])
                p0, pull, away = np.empty((len(i), WORD_NOISE), np.float32), np.empty_like(x1), np.empty_like(qn)
                for j, (lo, hi) in enumerate(runs):
                    np.matmul(x1[lo:hi], qn[j].T, out=p0[lo:hi])
                p0 = -_rise(p0)
                for j, (lo, hi) in enumerate(runs):
                    np.matmul(p0[lo:hi], qn[j], out=pull[lo:hi])
                    np.matmul(p0[lo:hi].T, x1[lo:hi], out=away[j])
                qt *= p1[:, None]
                pull += qt
                pull += g.take(i, 0)
                g[i] = pull
                x1 *= p1[:, None]
                noisy = _row_sums(no.ravel(), away.reshape(no.size, -1), np.repeat(np.diff(cut), WORD_NOISE))
                of, sums, _, times = _sums(t, x1)
                rows.append((k, _merged((of, sums, times), noisy)))
            g[:, -1] = 0
            seen, weights = [], []
            for context, vectors, weight in ((uu, ru, c[0]), (vv, rv, c[1])):
                order = _order(context)
                of, sums, first_of, times = _sums(context, g, order)
                weights.append((sums * vectors.take(order[first_of], 0)).sum(0))
                sums *= weight
                seen.append((of, sums, times))
            rows.append((0, _merged(*seen)))
            rows.append((len(m) - 2, (np.arange(2), np.stack(weights), np.full(2, len(uu)))))
            for base, (of, grad, times) in rows:
                self._step(base + of, grad, times, g2, touched, rate)

    def tables(self, most: int = SYMBOLS):
        """(first, second, log normaliser) of the classes, natural logs, for the contexts of the
        ``most`` most frequent symbols: s(k|u,v) = first[u,k] + second[v,k]."""
        r, _, _, d, a, c = self.parts()
        first = (r[:most] * c[0]) @ d.T + a
        second = (r[:most] * c[1]) @ d.T
        x, y = first.max(1, keepdims=True), second.max(1, keepdims=True)
        z = np.exp(first - x) @ np.exp(second - y).T
        return first, second, np.log(z) + x + y.T

    def log_probabilities(self, u, v, w, norm: np.ndarray) -> np.ndarray:
        """Natural logs of p(w | u, v); ``norm`` is the last of ``tables()``."""
        k, m = self.k, self.m
        words_of, kinds_of = m[k : 2 * k], m[2 * k : -2]
        kinds, size, out = self.class_of()[w], np.diff(self.first), np.empty(len(w))
        for at in range(0, len(w), 1 << 16):  # bounds the contexts held at once
            order = at + _order(kinds[at : at + (1 << 16)])  # a class is a run
            uu, vv, ww, kk = (x[order] for x in (u, v, w, kinds))
            ctx = m.take(uu, 0) * m[-2]
            ctx += m.take(vv, 0) * m[-1]
            ctx[:, -1] = 1  # meets the biases
            s = np.einsum("ij,ij->i", ctx, kinds_of.take(kk, 0))
            known = (uu < len(norm)) & (vv < len(norm))
            s[known] -= norm[uu[known], vv[known]]
            far = np.flatnonzero(~known)
            step = max(1, CELLS // len(kinds_of))
            for i in range(0, len(far), step):
                j = far[i : i + step]
                s[j] -= _log_sum(ctx.take(j, 0) @ kinds_of.T)
            cut = np.flatnonzero(np.diff(kk, prepend=-1, append=-1))
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                kind = kk[lo]
                if size[kind] == 1:
                    continue
                x, y = self.first[kind : kind + 2]
                step = max(1, CELLS // (y - x))
                for i in range(lo, hi, step):
                    j = slice(i, min(hi, i + step))
                    s[j] += np.einsum("ij,ij->i", ctx[j], words_of.take(ww[j], 0)) - _log_sum(ctx[j] @ words_of[x:y].T)
            out[order] = s
        return out


def _contexts(sym: np.ndarray, first: np.ndarray, end: int):
    """(last, last but one) symbol before each token; texts begin after two ends."""
    u = np.concatenate(([end], sym[:-1]))
    v = np.concatenate(([end, end], sym[:-2]))[: len(sym)]
    begin = first[:-1]
    u[begin] = end
    v[begin] = end
    v[np.minimum(begin + 1, len(sym) - 1)] = end
    return u, v


def fit_words(x: np.ndarray, t: np.ndarray, mass: np.ndarray, rng) -> np.ndarray:
    """Target vectors (biases in the last column) of the words of one tail class, by noise-contrastive
    estimation on the contexts ``x`` of occurrences of words ``t``; ``mass`` are the words' counts."""
    p = (mass + 1.0) / (mass.sum() + len(mass))
    q = np.zeros((len(mass), x.shape[1] + 1), np.float32)
    q[:, -1] = np.log(p)
    cum, log_noise, g2 = np.cumsum(p), (np.log(p) + np.log(WORD_NOISE)).astype(np.float32), np.zeros(len(mass), np.float32)
    rise = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
    perm = rng.permutation(len(t))
    for at in range(0, len(t), WORD_BATCH):
        i = perm[at : at + WORD_BATCH]
        x1 = np.concatenate([x[i], np.ones((len(i), 1), np.float32)], 1)
        no = np.minimum(np.searchsorted(cum, rng.random(WORD_NOISE) * cum[-1], "right"), len(mass) - 1)
        pos = 1 - rise(np.einsum("ij,ij->i", x1, q[t[i]]) - log_noise[t[i]])
        fake = -rise(x1 @ q[no].T - log_noise[no])
        rows, g = _row_sums(np.concatenate([t[i], no]), np.concatenate([pos[:, None] * x1, fake.T @ x1]))[:2]
        g2[rows] += (g * g).mean(1)
        q[rows] += (RATE / np.sqrt(g2[rows] + SMOOTH))[:, None] * g
    return q


def class_scores(x: np.ndarray, w: np.ndarray, held: np.ndarray, seed: int, least: int = LEAST):
    """For the occurrences of one tail class, sorted by word: (training count, has a vector, natural
    log of p(word | class, context)) of each."""
    inv = np.cumsum(np.diff(w, prepend=w[:1]) != 0) if len(w) else np.zeros(0, np.int64)
    n = np.bincount(inv, ~held).astype(np.int64)
    own = n >= least
    rest, kinds = int(n[~own].sum()), int(((n > 0) & ~own).sum())
    place = np.where(own, np.cumsum(own), 0)  # 0: all words without a vector
    t, lp = place[inv], np.zeros(len(w))
    if own.any():
        learn = np.flatnonzero(~held)
        q = fit_words(x[learn], t[learn], np.concatenate(([rest], n[own])), np.random.default_rng(seed))
        step = max(1, (1 << 20) // len(q))
        for at in range(0, len(w), step):
            s = x[at : at + step] @ q[:, :-1].T + q[:, -1]
            lp[at : at + step] = s[np.arange(len(s)), t[at : at + step]] - _log_sum(s)
    lp += np.where(own[inv], 0, np.log(n[inv] + 1.0) - np.log(rest + kinds + 1.0))
    return n[inv], own[inv], lp


def _binary(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """Binary array whose i-th value is data[off[i]:off[i + 1]]."""
    data = np.ascontiguousarray(data)
    off = (np.asarray(off) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes())])


def _values(col, kind) -> tuple[np.ndarray, np.ndarray]:
    """(values of all, offsets) of a binary column."""
    data, off = [np.frombuffer(x, kind) for x in col.to_pylist()], [0]
    off = np.concatenate(([0], np.cumsum([len(x) for x in data]))).astype(np.int64)
    return (np.concatenate(data) if data else np.zeros(0, kind)), off


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(rid, doc_id, held_out, order, sym, tail) of docs (doc_id, text, held_out): the symbols of a text
    as 16-bit numbers, the hashes of its tail tokens."""
    voc = shipped(docs.sparkSession, vocab)

    def run(batches):
        part, serial = TaskContext.get().partitionId(), 0
        for b in batches:
            for i, w, at in _tokens(b.column("text")):
                m = len(at) - 1
                _, sym, head = voc().look(w)
                far = np.flatnonzero(~head)
                yield pa.RecordBatch.from_arrays([
                    pa.array((np.int64(part) << np.int64(33)) + serial + np.arange(m)),
                    b.column("doc_id").slice(i, m), b.column("held_out").slice(i, m), b.column("order").slice(i, m),
                    _binary(sym.astype(np.uint16), at), _binary(w[far], np.searchsorted(far, at))],
                    names=["rid", "doc_id", "held_out", "order", "sym", "tail"])
                serial += m

    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.withColumn("order", F.xxhash64("doc_id", "text"))
    return docs.mapInArrow(run, f"rid bigint, doc_id {kind}, held_out boolean, order bigint, sym binary, tail binary")


def _grouped(rows: DataFrame, groups: int) -> DataFrame:
    """(g, order, copies, sym): the training rows dealt over groups.  The copies of a row that
    repeats are spread evenly, whatever their number."""
    again = written(rows.groupBy("order").count().where("count > 1").select("order"), "lm-repeated")
    if again.count() <= FEW:
        again = F.broadcast(again)
    once = rows.join(again, "order", "left_anti").select("order", F.lit(1).cast("bigint").alias("copies"), "sym", F.lit(0).cast("bigint").alias("i"))
    more = rows.join(again, "order", "left_semi").groupBy("order", "sym").count()
    more = more.select("order", "count", "sym", F.explode(F.sequence(F.lit(0), F.least("count", F.lit(groups)) - 1)).alias("i"))
    share = F.floor(F.col("count") / groups) + F.when(F.col("i") < F.col("count") % groups, 1).otherwise(0)
    both = once.unionByName(more.select("order", share.alias("copies"), "sym", "i"))
    return both.select(F.pmod(F.pmod("order", F.lit(groups)) + F.col("i"), F.lit(groups)).cast("int").alias("g"), "order", "copies", "sym")


def train(rows: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> LogBilinear:
    """The symbols' parameters from training rows (order, sym) of ``encode``."""
    spark = rows.sparkSession
    model = LogBilinear.start(vocab.unigram)
    end = int(vocab.look(np.array([END]))[1][0])
    groups = max(1, -(-vocab.total // GROUP_TOKENS))
    for turn in range(rounds):
        sent = shipped(spark, (vocab.unigram, model))

        def run(batches):
            unigram, start = sent()
            mine = LogBilinear(start.m.copy(), start.first)
            noise = mine.noise(unigram)
            g2, touched = np.zeros(len(mine.m), np.float32), np.zeros(len(mine.m), np.int64)
            rng, held, size, g = None, [], 0, 0

            def learn():
                sym = np.concatenate(held).astype(np.int64)
                first = np.concatenate(([0], np.cumsum([len(x) for x in held])))
                u, v = _contexts(sym, first, end)
                mine.train(u, v, sym, noise, rng, g2, touched)

            for b in batches:
                for g, n, x in zip(*(b.column(c).to_pylist() for c in ("g", "copies", "sym")), strict=True):
                    rng = rng or np.random.default_rng((turn, g))
                    x = np.frombuffer(x, np.uint16)
                    for _ in range(n):
                        held.append(x)
                        size += len(x)
                        if size >= CHUNK:
                            learn()
                            held, size = [], 0
            if held:
                learn()
            used = np.flatnonzero(touched)
            change = (mine.m[used] - start.m[used]).astype(np.float16)
            cut = np.flatnonzero(np.diff(used // BLOCK, prepend=-1, append=-1))
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                part = [(used[lo:hi] % BLOCK).astype(np.uint16), touched[used[lo:hi]].astype(np.float32), change[lo:hi]]
                yield pa.RecordBatch.from_pydict({"block": [used[lo] // BLOCK], "g": pa.array([g], pa.int32()), **{c: [x.tobytes()] for c, x in zip("inp", part, strict=True)}})

        def mean(batches):
            sums = {}
            for b in batches:
                for block, i, n, p in zip(*(b.column(x).to_pylist() for x in ("block", "i", "n", "p")), strict=True):
                    total = sums.setdefault(block, np.zeros((BLOCK, DIM + 2)))
                    i, n = np.frombuffer(i, np.uint16), np.frombuffer(n, np.float32)[:, None]
                    total[i] += np.concatenate([np.frombuffer(p, np.float16).reshape(len(i), -1) * n, n], 1)
            for block, total in sums.items():
                p = (total[:, :-1] / np.maximum(total[:, -1:], 1)).astype(np.float32)
                yield pa.RecordBatch.from_pydict({"block": [block], "p": [p.tobytes()]})

        dealt = _grouped(rows, groups).repartitionById(groups, F.col("g")).sortWithinPartitions("order", "sym")
        parts = dealt.mapInArrow(run, "block bigint, g int, i binary, n binary, p binary")
        got = parts.repartition("block").sortWithinPartitions("block", "g").mapInArrow(mean, "block bigint, p binary").toArrow()  # the parameters
        m = np.zeros((-(-len(model.m) // BLOCK) * BLOCK, DIM + 1), np.float32)
        for block, p in zip(got["block"].to_pylist(), got["p"].to_pylist(), strict=True):
            m[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(p, np.float32).reshape(BLOCK, -1)
        model = LogBilinear(model.m + m[: len(model.m)], model.first)
    return model


def _tail_sums(rows: DataFrame, vocab: Vocabulary, model: LogBilinear, least: int) -> DataFrame:
    """(rid, known, logs, lp, own): of the tail tokens of each text, how many are known, the sums of
    log10(count + 1) and of log10 p(word | class, context), and how many have vectors.  What one
    batch of texts sends to a part is one row, and what the part gives back; sums are added by block,
    that is by batch of texts."""
    head, bits, n_kinds = len(vocab.h), vocab.bits, 1 << vocab.bits
    r, _, _, _, _, c = model.parts()
    sent = shipped(rows.sparkSession, (r.copy(), c.copy()))
    end = int(vocab.look(np.array([END]))[1][0])
    # both held-out and training texts; their number is not known, but training texts are most of them
    parts = int(min(n_kinds, max(1, -(-int(vocab.unigram[head:].sum()) // PART_TOKENS))))

    def deal(batches):
        for b in batches:
            sym, at = _values(b.column("sym"), np.uint16)
            w, _ = _values(b.column("tail"), np.uint64)
            if not len(w):
                continue
            u, v = _contexts(sym.astype(np.int64), at, end)
            place = np.flatnonzero(sym >= head)
            doc = np.searchsorted(at, place, "right") - 1
            part = (sym[place].astype(np.int64) - head) % parts
            name = b.column("rid").to_numpy() * 2 + b.column("held_out").to_numpy(zero_copy_only=False)
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                j = order[lo:hi]
                ids, of = np.unique(doc[j], return_inverse=True)
                cols = [name[ids], of.astype(np.uint32), u[place[j]].astype(np.uint16), v[place[j]].astype(np.uint16), w[j]]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part[j[0]]], pa.int32()), "block": [name[0] >> 1], **{k: [x.tobytes()] for k, x in zip(("ids", "of", "u", "v", "w"), cols, strict=True)}})

    def score(table: pa.Table) -> pa.Table:
        r, c = sent()
        ids, at = _values(table["ids"], np.int64)
        of, each = _values(table["of"], np.uint32)
        of = of + np.repeat(at[:-1], np.diff(each))
        (u, _), (v, _), (w, _) = (_values(table[k], t) for k, t in (("u", np.uint16), ("v", np.uint16), ("w", np.uint64)))
        held = (ids % 2 == 1)[of]
        order = np.lexsort(((u.astype(np.uint32) << np.uint32(16)) | v, held, w))  # by class, since its number leads the hash
        of, u, v, w, held = of[order], u[order], v[order], w[order], held[order]
        kind = (w >> np.uint64(64 - bits)).astype(np.int64)
        got = np.zeros((4, len(w)))
        cut = np.flatnonzero(np.diff(kind, prepend=-1, append=-1))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            x = r[u[lo:hi]] * c[0] + r[v[lo:hi]] * c[1]
            n, own, lp = class_scores(x, w[lo:hi], held[lo:hi], int(kind[lo]), least)
            got[:, lo:hi] = n > 0, np.log10(n + 1.0), lp * np.log10(np.e), own
        sums = np.stack([np.bincount(of, x, len(ids)) for x in got], 1)
        return pa.table({"block": table["block"], "ids": _binary(ids >> 1, at), "sums": _binary(sums.ravel(), 4 * at)})

    def total(table: pa.Table) -> pa.Table:
        ids, _ = _values(table["ids"], np.int64)
        sums, _ = _values(table["sums"], np.float64)
        rid, of = np.unique(ids, return_inverse=True)
        known, logs, lp, own = (np.bincount(of, x, len(rid)) for x in sums.reshape(-1, 4).T)
        return pa.table({"rid": rid, "known": known.astype(np.int64), "logs": logs, "lp": lp, "own": own.astype(np.int64)})

    dealt = rows.select("rid", "held_out", "sym", "tail").mapInArrow(deal, "part int, block bigint, ids binary, of binary, u binary, v binary, w binary")
    sums = dealt.groupBy("part").applyInArrow(score, "block bigint, ids binary, sums binary")
    return sums.groupBy("block").applyInArrow(total, "rid bigint, known bigint, logs double, lp double, own bigint")


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", of: int = 7, rounds: int = ROUNDS, head: int = HEAD, least: int = LEAST) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, model_tokens)
    of every row; rows whose crc32(doc_id) mod ``of`` is 2 are not learned from."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("held_out", held_out("doc_id", of))
    counts = written(count_tokens(docs.where(~F.col("held_out"))), "token-counts")
    vocab = vocabulary(counts, head, least)
    rows = written(encode(docs, vocab), "lm-texts")
    model = train(rows.where(~F.col("held_out")).select("order", "sym"), vocab, rounds)
    sent = shipped(spark, (vocab.unigram, len(vocab.h), model, model.tables()[2]))
    end = int(vocab.look(np.array([END]))[1][0])
    log10e = float(np.log10(np.e))

    def run(batches):
        unigram, n_head, lbl, norm = sent()
        for b in batches:
            sym, at = _values(b.column("sym"), np.uint16)
            sym = sym.astype(np.int64)
            if not len(sym):
                continue
            u, v = _contexts(sym, at, end)
            inside = sym < n_head
            lp = lbl.log_probabilities(u, v, sym, norm) * log10e
            logs = np.where(inside, np.log10(unigram[sym] + 1.0), 0)
            add = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  every text has its end
            yield pa.RecordBatch.from_arrays([
                b.column("rid"), b.column("doc_id"), b.column("held_out"), pa.array(np.diff(at)),
                pa.array(add(inside.astype(np.int64))), pa.array(add(logs)), pa.array(add(lp))],
                names=["rid", "doc_id", "held_out", "n_tokens", "near", "base", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.select("rid", "doc_id", "held_out", "sym").mapInArrow(run, f"rid bigint, doc_id {kind}, held_out boolean, n_tokens bigint, near bigint, base double, score double")
    tail = _tail_sums(rows, vocab, model, least)
    none = lambda c: F.coalesce(c, F.lit(0))  # noqa: E731  texts without tail tokens
    each = float(np.log10(vocab.total + vocab.distinct + 1))
    return scored.join(tail, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("near") + none("known")).alias("n_known"), F.lit(vocab.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + none("logs") - F.col("n_tokens") * each).alias("base_score"), (F.col("score") + none("lp")).alias("score"),
        (F.col("near") + none("own")).alias("model_tokens"))
