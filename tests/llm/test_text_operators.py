"""Decontamination, token counts, language ID, LM scores and packing against brute force."""

import collections
import math
import os
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import lower, rows
from pyspark.sql import functions as F

from kestrel.llm import decontaminate, langid, lm, packing, tokencount

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


# -- decontamination ---------------------------------------------------------------------

def brute_contaminated(docs, items):
    out = set()
    for d, t in docs:
        w = ALNUM.findall(lower(t or ""))
        for i, s in items:
            v = ALNUM.findall(lower(s or ""))
            n = min(12, len(v))
            if n < 5:
                continue
            ok = 2 if len(v) >= 12 else 0
            best = min((sum(a != b for a, b in zip(w[p:p + n], v[q:q + n])) for p in range(len(w) - n + 1) for q in range(len(v) - n + 1)), default=99)
            if best <= ok:
                out.add((d, i, best))
    return out


def test_decontamination_finds_every_window_within_two_substitutions(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([12, 13, 20, 30, 7, 5, 4, 11, 2])] + [(9, None), (10, "")]
    docs = []
    for d in range(120):
        text = rng.choices(words, k=rng.randrange(0, 60))
        v = (items[d % 9][1] or "").split()
        part = v[rng.randrange(max(1, len(v) - 11)):][:rng.choice([5, 7, 11, 12, 14, 30])]
        for _ in range(rng.randrange(4)):
            if part:
                part[rng.randrange(len(part))] = "changed"
        at = rng.randrange(len(text) + 1)
        docs.append((d, ", ".join(text[:at] + part + text[at:]).upper()))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.substitutions) for r in got.collect()} == brute_contaminated(docs, items)


def test_decontamination_sql(spark, sf, duck):
    got = decontaminate.contaminated(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert rows(got.drop("first_pos")) == rows(duck.execute(decontaminate.CONTAMINATED_SQL).df())


def test_decontamination_odd_input(spark, odd, none):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog", "x"), (None, "no id at all here", "y"), (3, None, None)], "item_id long, text string, mask string")
    assert rows(decontaminate.contaminated(odd, items), ["doc_id", "item_id", "substitutions"]) == sorted([(0, 1, 0), (1, 1, 0), (None, None, 0)], key=repr)
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0
    left = decontaminate.clean(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count() - 5  # rows 0 (three times), 1 and the text of no id


def test_decontamination_of_string_ids(spark):
    words = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([("x-1", f"before {words} after"), ("x-2", "other words")], "doc_id string, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([("item", words)], "item_id string, text string"))
    assert rows(got, ["doc_id", "item_id", "substitutions"]) == [("x-1", "item", 0)]


def test_decontamination_run_of_one_word(spark):
    docs = spark.createDataFrame([(1, "a " * 5000)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a " * 300)], "item_id long, text string")
    assert rows(decontaminate.contaminated(docs, items), ["doc_id", "item_id", "substitutions"]) == [(1, 7, 0)]


# -- token counts ------------------------------------------------------------------------

def reference_tokenizer(vocab, byte_fallback=True):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(vocab, 0, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    return lambda s: len(t.encode(s, add_special_tokens=False).ids) if s else 0


def test_token_counts_equal_the_tokenizer(spark, sf, odd):
    ref = reference_tokenizer(tokencount.load_vocab())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = tokencount.token_counts(docs).collect()
    assert len(got) == len(text) and all(r.n_tokens == ref(text[r.doc_id]) for r in got)
    more = [r.text for r in odd.collect()]
    assert sorted(r.n_tokens for r in tokencount.token_counts(odd).collect()) == sorted(ref(t) for t in more)


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_viterbi_ties_and_unknown_runs(byte_fallback):
    rng = random.Random(3)
    for trial in range(60):
        pieces = {"<unk>": 0.0, "▁": -1.0}
        if byte_fallback:
            pieces |= {f"<0x{b:02X}>": 0.0 for b in range(256)}
        for _ in range(12):
            s = "".join(rng.choices("ab▁", k=rng.randrange(1, 4)))
            pieces.setdefault(s, float(rng.choice([-1, -2, -3])))  # many ties
        vocab = list(pieces.items())
        ref, mine = reference_tokenizer(vocab, byte_fallback), tokencount.Counter(vocab)
        for _ in range(25):
            s = "".join(rng.choices("abcé  ", k=rng.randrange(0, 14)))
            assert mine.count(s)[0] == ref(s), (vocab, s)


def test_long_words_are_not_cached(monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE_WORDS", 3)
    counter = tokencount.Counter([("<unk>", 0.0), ("a", -1.0), ("aa", -1.5), ("\u2581", -2.0)])
    n, _ = counter.count("a" * 5000)
    assert n == 2501 and not counter.cache
    for i in range(10):
        counter.count("a" * (i + 1) + "  aa")
    assert 0 < len(counter.cache) <= 3 and all(len(k if isinstance(k, str) else k[0]) <= 64 for k in counter.cache)


def test_token_counts_empty(none):
    assert tokencount.token_counts(none).collect() == []


# -- language ID -------------------------------------------------------------------------

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where("not held_out"))
    got = langid.apply(model, docs.where("held_out")).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in docs.collect())


def test_language_kernel_is_the_presence_kernel():
    texts = ["abc abd", "abd!", "zz top", ""]
    letters = np.zeros(0x110000, np.uint8)
    letters[[ord(c) for c in "abcdeoptz"]] = np.arange(1, 10)

    def grams(t):
        ids = [int(letters[ord(c)]) for c in "\n" + t + "\n"]
        return {tuple(ids[i:i + n]) for n in (1, 2, 3) for i in range(len(ids) - n + 1) if any(ids[i:i + n])}

    pieces = list(langid._pieces(texts))
    doc, code, _ = langid._codes(letters, pieces)
    assert [len(set(code[doc == i])) for i in range(4)] == [len(grams(t)) for t in texts]


def test_language_predictions_equal_a_naive_kernel_ridge(spark):
    """The dual form over sets of n-grams, on a table that the sample holds whole."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "substring(text, 1, 400) AS text", "lang", "xxhash64(doc_id, substring(text, 1, 400)) AS place")
    marks = 40
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.apply(langid.fit(docs, landmarks=marks), docs).collect()}

    def grams(t):
        s = [c if c.isalpha() else "" for c in "\n" + t.lower() + "\n"]
        return {tuple(s[i:i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1) if any(s[i:i + n])}

    data = sorted(docs.where("lang IS NOT NULL AND text IS NOT NULL").collect(), key=lambda r: r.place)
    sets = {r.doc_id: grams(r.text) for r in data}
    data = [r for r in data if sets[r.doc_id]]
    assert len({g for s in sets.values() for w in s for g in w}) < langid.ALPHABET - 1
    labels = sorted({r.lang for r in data})
    chosen = [sets[r.doc_id] for lab in labels for r in [x for x in data if x.lang == lab][: marks // len(labels)]]
    known = set().union(*chosen)

    def kernel(rows):
        return np.array([[len(s & m) / np.sqrt(max(len(s & known), 1) * len(m)) for m in chosen] for s in rows])

    k_nm = kernel([sets[r.doc_id] for r in data])
    map_ = np.linalg.pinv(kernel(chosen), rcond=1e-6, hermitian=True) @ k_nm.T
    y = np.array([[1.0 if r.lang == lab else -1.0 for lab in labels] for r in data])
    alpha = np.linalg.solve(k_nm @ map_ + 1 + langid.RIDGE * np.eye(len(data)), y)
    for r in docs.collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        f = ((kernel([grams(r.text)]) @ map_ + 1) @ alpha)[0]
        assert got[r.doc_id][1] == pytest.approx(min(max((f.max() + 1) / 2, 0), 1), abs=2e-3)
        if np.sort(f)[-1] - np.sort(f)[-2] > 5e-3:
            assert got[r.doc_id][0] == labels[f.argmax()]


def test_language_odd_input(spark, odd, none):
    model = langid.fit(odd)
    got = langid.apply(model, odd.select("doc_id", "text")).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")), r
    empty = langid.fit(none)
    assert {(r.lang_pred, r.score) for r in langid.apply(empty, odd.select("text")).collect()} == {("und", 0.0)}
    assert langid.apply(model, none.select("doc_id", "text")).count() == 0


# -- LM scores ---------------------------------------------------------------------------

def test_lm_counts_equal_brute_force(spark, sf, odd):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        got = lm.lm_scores(docs, rounds=1).collect()
        text = [(r.doc_id, r.text) for r in docs.collect()]
        held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
        toks = [(d, [*SPACE.findall(lower(t or "")), None]) for d, t in text]
        c = collections.Counter(w for d, ws in toks if not held(d) for w in ws)
        n, v = sum(c.values()), len(c)
        want = sorted(((d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 3)) for d, ws in toks), key=repr)
        have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got), key=repr)
        assert have == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def _training_rows(docs, vocab):
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lm.held_out("doc_id", 7).alias("held_out"))
    return lm.encode(docs, vocab).where("not held_out").select("order", "sym")


def test_lm_is_normalised_and_beats_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    vocab = lm.vocabulary(lm.count_tokens(docs.where(~lm.held_out("doc_id", 7))))
    model = lm.train(_training_rows(docs, vocab), vocab, rounds=1)
    first, second, z = model.tables()
    p = np.exp(first[3] + second[9] - z[3, 9])  # context (3, 9)
    assert abs(p.sum() - 1) < 1e-3
    got = lm.lm_scores(docs).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_lm_score_does_not_depend_on_the_splits(spark, monkeypatch):
    """Some training groups and many parts; each input split gives the same scores, better than the counts."""
    monkeypatch.setattr(lm, "GROUP_TOKENS", 1 << 18)
    monkeypatch.setattr(lm, "PART_TOKENS", 1 << 15)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.union(docs.where("doc_id < 3")).union(docs.where("doc_id < 2"))  # rows that repeat
    runs = []
    for parts in (2, 16, 64):
        got = lm.lm_scores(docs.repartition(parts), rounds=3, head=2000).collect()
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)
        runs.append(np.array([r.score for r in sorted(got, key=lambda r: (r.doc_id, r.score))]))
    for other in runs[1:]:
        np.testing.assert_allclose(other, runs[0], rtol=1e-6)


def test_lm_vectors_grow_with_the_corpus(spark, sf):
    """Every token that occurs LEAST times has vectors; each context sums to 1 over all symbols."""
    own = {}
    for folder in (sf, "/root/testdata/sf0.01"):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        train = docs.where(~lm.held_out("doc_id", 7))
        vocab = lm.vocabulary(lm.count_tokens(train), head=300)
        c = collections.Counter(w for r in train.collect() for w in [*SPACE.findall(lower(r.text or "")), None])
        got = lm.lm_scores(docs, rounds=1, head=300).where("not held_out").agg({"model_tokens": "sum"}).first()
        own[folder] = sum(n >= lm.LEAST for n in c.values())
        assert got["sum(model_tokens)"] == sum(n for n in c.values() if n >= lm.LEAST)
        assert len(vocab.h) <= 300 and len(vocab.unigram) - len(vocab.h) <= lm.KINDS and vocab.unigram.sum() == sum(c.values())
    assert own["/root/testdata/sf0.01"] > 3 * own[sf]
    model = lm.LogBilinear.start(vocab.unigram)
    model.m += np.random.default_rng(1).normal(0, 0.5, model.m.shape).astype(np.float32)
    k, norm = model.k, model.tables(64)[2]
    for u, v in [(0, 0), (5, 9), (150, 3), (k - 1, 200), (k - 1, k - 1)]:
        p = np.exp(model.log_probabilities(np.full(k, u), np.full(k, v), np.arange(k), norm))
        assert abs(p.sum() - 1) < 1e-4


def test_lm_score_equals_a_naive_one(spark, sf):
    """Each text's score from its tokens one by one: group, symbol, word of the tail class, count."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    vocab = lm.vocabulary(lm.count_tokens(docs.where(~lm.held_out("doc_id", 7))), head=100)
    model = lm.train(_training_rows(docs, vocab), vocab)
    r, q, b, d, a, c = (x.astype(float) for x in model.parts())
    seq, where = {}, collections.defaultdict(list)
    for row in docs.collect():
        w = next(lm._tokens(pa.array([row.text or ""])))[1]
        sym, held = vocab.look(w)[1], row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 7 == 2
        end = int(vocab.look(np.array([lm.END]))[1][0])
        before = [end, end, *sym.tolist()]
        seq[row.doc_id] = 0.0
        for i, s in enumerate(sym.tolist()):
            u, v = before[i + 1], before[i]
            h = r[u] * c[0] + r[v] * c[1]
            g = int(np.searchsorted(model.first, s, "right")) - 1
            lo, hi = model.first[g], model.first[g + 1]
            z = d @ h + a
            y = q[lo:hi] @ h + b[lo:hi]
            seq[row.doc_id] += z[g] - np.log(np.exp(z).sum()) + y[s - lo] - np.log(np.exp(y).sum())
            if s >= len(vocab.h):
                where[s - len(vocab.h)].append((int(w[i]), held, u << 16 | v, row.doc_id))
    for kind, found in where.items():
        found.sort(key=lambda x: x[:3])
        n = collections.Counter(x[0] for x in found if not x[1])
        own = {w: i + 1 for i, w in enumerate(sorted(w for w in n if n[w] >= lm.LEAST))}
        rest = [k for w, k in n.items() if w not in own]
        x = np.array([model.parts()[0][uv >> 16] * model.parts()[5][0] + model.parts()[0][uv & 65535] * model.parts()[5][1] for _, _, uv, _ in found])
        vec = None
        if own:
            learn = [i for i, f in enumerate(found) if not f[1]]
            vec = lm.fit_words(x[learn], np.array([own.get(found[i][0], 0) for i in learn]), np.array([sum(rest), *(n[w] for w in own)]), np.random.default_rng(kind)).astype(float)
        for (w, _, _, doc), h in zip(found, x, strict=True):
            if vec is not None:
                y = vec[:, :-1] @ h + vec[:, -1]
                seq[doc] += y[own.get(w, 0)] - np.log(np.exp(y).sum())
            if w not in own:
                seq[doc] += np.log((n[w] + 1) / (sum(rest) + len(rest) + 1))
    got = {x.doc_id: x.score for x in lm.lm_scores(docs, head=100).collect()}
    assert got.keys() == seq.keys()
    for k, want in seq.items():
        assert got[k] == pytest.approx(want / np.log(10), rel=1e-5)


def test_lm_copies_are_dealt_evenly(spark):
    rows = spark.range(1000).select(F.lit(-5).cast("bigint").alias("order"), F.lit(b"ab").alias("sym"))
    rows = rows.union(spark.range(40).select("id", F.lit(b"cd")))
    got = lm._grouped(rows, 7).collect()
    assert sum(r.copies for r in got) == 1040
    share = [r.copies for r in got if r.order == -5]
    assert len(share) == 7 and max(share) - min(share) <= 1 and {r.g for r in got} == set(range(7))


def test_lm_learns_rare_words_from_their_context():
    """Pairs of words that are all beyond the SYMBOLS most frequent."""
    rng, pairs = np.random.default_rng(3), 2000
    unigram = np.concatenate(([5], np.full(2 * pairs, 40)))
    first = rng.permutation(np.repeat(1 + 2 * np.arange(pairs), 40))
    sym = np.stack([first, first + 1], 1).ravel()
    u, v = np.concatenate(([0], sym[:-1])), np.concatenate(([0, 0], sym[:-2]))
    model = lm.LogBilinear.start(unigram)
    noise, g2, touched = model.noise(unigram), np.zeros(len(model.m), np.float32), np.zeros(len(model.m), np.int64)
    score = lambda: model.log_probabilities(u[1::2], v[1::2], sym[1::2], model.tables()[2]).mean()
    before = score()
    for _ in range(8):
        model.train(u, v, sym, noise, rng, g2, touched)
    assert score() > before + 1 and (touched > 0).sum() > 4 * pairs


def test_lm_empty(spark, none, odd):
    assert lm.lm_scores(none).collect() == []
    held = odd.where(lm.held_out("doc_id", 7))
    got = lm.lm_scores(held).collect()  # nothing to learn from
    assert len(got) == held.count() and all(r.train_tokens == 0 and r.n_known == 0 for r in got)


# -- packing -----------------------------------------------------------------------------

def test_bucket_lengths_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(2)
    for _ in range(30):
        x = np.sort(rng.choice(50, rng.integers(1, 9), replace=False))
        c = rng.integers(1, 20, len(x))
        b = int(rng.integers(1, 5))
        pad = lambda bounds: sum(int(k) * (min(u for u in bounds if u >= v) - int(v)) for v, k in zip(x, c))
        best = min(pad((*s, int(x[-1]))) for s in combinations(x[:-1].tolist(), min(b, len(x)) - 1))
        assert pad(packing.bucket_lengths(x, c, b)) == best


def test_packing_sql_and_budget(spark, sf, duck):
    got = packing.pack(spark.read.parquet(f"{sf}/documents.parquet"))
    assert rows(got) == rows(duck.execute(packing.PACK_SQL).df())


def test_packing_odd_input(odd, none):
    got = packing.pack(odd, max_len=1000, n_buckets=3, budget=3000).collect()
    words = [len(SPACE.findall(r.text or "")) for r in odd.collect()]
    assert sum(r.n_tokens for r in got) == sum(words)
    assert len(got) == sum(max(1, -(-n // 1000)) for n in words)
    assert len({r.bucket_len for r in got}) <= 3 and all(r.n_tokens <= r.bucket_len for r in got)
    sizes = collections.Counter((r.bucket_len, r.batch) for r in got)
    assert all(n <= max(1, 3000 // max(1, b)) for (b, _), n in sizes.items())
    assert len({(r.bucket_len, r.batch, r.slot) for r in got}) == len(got)
    assert packing.pack(none).count() == 0


# -- shipping ----------------------------------------------------------------------------

def test_workers_need_no_copy_of_the_package(sf, tmp_path):
    """Trained models reach workers that cannot import the package."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).parents[2])!r})
from kestrel.llm import langid, lm, pii
from kestrel.session import get_spark
spark = get_spark("local[2]", shuffle_partitions=2)
docs = spark.read.parquet({sf + "/documents.parquet"!r})
n = docs.count()
assert langid.apply(langid.fit(docs), docs).where("score >= 0").count() == n
field = pii.fit(docs)
assert pii.find(docs, field).where("spans is not null").count() == n
assert pii.mask(docs, field).where("text is null or length(text) >= 0").count() == n
assert lm.lm_scores(docs).where("score < 0").count() == n
print("whole")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0 and "whole" in run.stdout, run.stderr[-2000:]
