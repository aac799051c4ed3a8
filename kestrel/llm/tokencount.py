"""Token counts of a unigram tokenizer without making the tokens.

Count-only Viterbi.  An Aho-Corasick automaton over the vocabulary enumerates every piece
that ends at a position; dynamic programming keeps, for each position, the best score and
the number of pieces on that best path, nothing else.  Tie rules are those of the
tokenizer: a path replaces another of the same end only if its score is strictly larger,
and paths are offered in order of their last piece's start, so of equal scores the longest
last piece wins.  A character that is no piece of its own is offered as unknown at the
smallest score of the vocabulary less 10; it counts as its UTF-8 bytes (byte fallback) or,
without byte pieces, as one unknown for each run of them.  Scores are doubles.

White space is escaped: a space becomes U+2581 and one is put before a text that does not
begin with one.  Where no piece holds U+2581 after another character (checked when the
vocabulary is loaded), every best path breaks before each run of U+2581, so a text is the
sum of its words and each different word is solved once per Python worker (a bounded
cache); otherwise whole texts are solved.  Both give the same counts.

Defined cases: null and empty texts have 0 tokens and score 0; texts of any length take
memory of the longest word only (or, for vocabularies without the property, of the text).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import map_batches

SPACE = "▁"
VOCAB = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
INF = float("inf")
#: cached words of a worker, and the characters of the longest one that is kept
CACHE_WORDS, CACHE_CHARS = 500_000, 64


def load_vocab(path: str = VOCAB) -> list[tuple[str, float]]:
    """(piece, score) in id order from a sentencepiece file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), float(p.get_score(i))) for i in range(p.get_piece_size())]


@dataclass
class Counter:
    """Count-only Viterbi over a unigram vocabulary."""

    vocab: list[tuple[str, float]]
    cache: dict = field(default_factory=dict)

    def __post_init__(self):
        self.unknown = min((s for _, s in self.vocab), default=0.0) - UNKNOWN_PENALTY
        self.trie = ahocorasick.Automaton()
        for piece, score in self.vocab:
            if piece:
                self.trie.add_word(piece, (len(piece), score))
        if len(self.trie):
            self.trie.make_automaton()
        names = {p for p, _ in self.vocab}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in names)

    def solve(self, s: str) -> tuple[int, float]:
        """(pieces, score) of the best path over an escaped string.  The automaton gives matches
        by end, longest first, so a strictly larger score is all that may replace a path."""
        n, unknown = len(s), self.unknown
        score, count = [-INF] * (n + 1), [0] * (n + 1)
        score[0] = 0.0
        single, known = [False] * (n + 1), [True] * (n + 1)

        def offer_unknown(e):
            v = score[e - 1] + unknown
            if v > score[e]:
                score[e], known[e] = v, False
                # unknown characters are their bytes, or a run of them is one piece
                count[e] = count[e - 1] + (len(s[e - 1].encode()) if self.bytes else known[e - 1])

        f = 1  # ends before f are final
        for e, (size, val) in self.trie.iter(s) if self.vocab else ():
            e += 1
            while f < e:
                if not single[f]:
                    offer_unknown(f)
                f += 1
            v = score[e - size] + val
            if v > score[e]:
                score[e], count[e] = v, count[e - size] + 1
            if size == 1:
                single[e] = True
        while f <= n:
            if not single[f]:
                offer_unknown(f)
            f += 1
        return count[n], score[n]

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        s = text.replace(" ", SPACE)
        if not s.startswith(SPACE):
            s = SPACE + s
        if not self.by_word:
            return self.solve(s)
        n, total, cache = 0, 0.0, self.cache
        for w in s.split(SPACE)[1:]:
            if not w:  # a run of U+2581
                return self.runs(s)
            got = cache.get(w)
            if got is None:
                got = self.keep(w, self.solve(SPACE + w))
            n += got[0]
            total += got[1]
        return n, total

    def keep(self, key, got):
        if len(key if isinstance(key, str) else key[0]) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[key] = got
        return got

    def runs(self, s: str) -> tuple[int, float]:
        """Texts with runs of U+2581: each run belongs to the word after it."""
        n, total, i = 0, 0.0, 0
        while i < len(s):
            j = i
            while j < len(s) and s[j] == SPACE:
                j += 1
            k = s.find(SPACE, j)
            k = len(s) if k < 0 else k
            w = s[i:k]
            key = (w,)
            got = self.cache.get(key)
            if got is None:
                got = self.keep(key, self.solve(w))
            n, total, i = n + got[0], total + got[1], k
        return n, total


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocab: str = VOCAB) -> DataFrame:
    """(doc_id, n_chars, n_tokens, score) of every row.  ``vocab`` is read where the
    tasks run, by each Python worker once."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(b: pa.RecordBatch):
        if vocab not in _COUNTERS:
            _COUNTERS[vocab] = Counter(load_vocab(vocab))
        counter = _COUNTERS[vocab]
        texts = b.column("text").to_pylist()
        got = [counter.count(t) for t in texts]
        return {"doc_id": b.column("doc_id"), "n_chars": np.array([len(t or "") for t in texts], np.int64),
                "n_tokens": np.array([g[0] for g in got], np.int64), "score": np.array([g[1] for g in got], np.float64)}

    return map_batches(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars bigint, n_tokens bigint, score double")
