"""Near-duplicates, top-k, PII, licenses, repeats and the pipeline against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from conftest_llm import lower, rows

from kestrel.llm import licenses, neardup, pii, repeats, topk

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


# -- near-duplicates ---------------------------------------------------------------------

def shingles(t, k):
    w = SPACE.findall(lower(t or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(docs, k, percent=80):
    sets = [shingles(t, k) for _, t in docs]
    comp = list(range(len(docs)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                comp[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, len(s), low.get(root(i)) if s else d, d == (low.get(root(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=repr)


def near_docs(seed=1):
    """Families of edited copies whose members often meet only through others."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([6, 15, 40, 120]))
        for _ in range(rng.choice([1, 3, 12, 40])):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, len(text) // 12))):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs.append(" ".join(text))
    docs += [docs[0], docs[0].upper(), "", None, " \t", "single", "Single", "two words", "a a a a a"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, k):
    docs = near_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_components(docs, k)
    cols = ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in neardup.near_duplicates(df, k=k).select(cols).collect()), key=repr) == want
    monkeypatch.setattr(neardup, "BLOCK", 4)  # many blocks a bucket
    monkeypatch.setattr(neardup, "SET_BLOCK", 3)
    assert sorted((tuple(r) for r in neardup.near_duplicates(df, k=k).select(cols).collect()), key=repr) == want


def test_near_duplicates_odd_input(odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    got = neardup.near_duplicates(odd).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((d, n, c, d == c) for d, n, c, _ in brute_components(docs, 2)), key=repr)
    assert neardup.near_duplicates(none).count() == 0


def test_registers_merge_and_agree_with_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    x, y = a[:2400], a[600:]  # similarity 0.6
    assert (np.maximum(neardup.registers(x), neardup.registers(y)) == neardup.registers(a)).all()
    agree = (neardup.registers(x) == neardup.registers(y)).mean()
    assert 0.45 < agree < 0.75


def test_likelihood_keeps_similar_pairs():
    rng = np.random.default_rng(1)
    for j in (0.8, 0.85, 0.95):
        keep = 0
        for _ in range(200):
            a = rng.integers(0, 2**64, 400, dtype=np.uint64)
            cut = int(400 * (1 - j) / 2)
            x, y = a[: 400 - cut], a[cut:]
            rx, ry = neardup.registers(x), neardup.registers(y)
            keep += neardup.possible(np.array([(rx > ry).sum()]), np.array([(rx < ry).sum()]), np.array([float(len(x))]), np.array([float(len(y))]), 0.8)[0]
        assert keep == 200


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (200, 202), (201, 202)]
    got = {r.node: r.comp for r in neardup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 200: 200, 201: 200, 202: 200}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- top-k -------------------------------------------------------------------------------

def test_top_k_sql(spark, sf, duck):
    got = topk.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"))
    assert rows(got) == rows(duck.execute(topk.TOPK_SQL).df())


def test_top_k_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vec = [[float(v) for v in rng.integers(-2, 3, 24) / 4] for _ in range(400)]  # many ties
    data = [(i, v, "x") for i, v in enumerate(vec)] + [(1000 + i, vec[7], "x") for i in range(60)]
    data += [(2000, None, "n"), (2050, [1.0, None], "n"), (2100, [float("nan")] * 24, "n"), (2150, [float("inf")] * 24, "n"), (2200, [], "e"),
             (2250, [1.0, 2.0], "s"), (2251, [3.0, 1.0], "s"), (None, vec[0], "n"), (2300, [3e6] * 24, "big"), (2301, [1e6] * 24, "big")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score string")
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in ok:
        if q % 50 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    for size in (4096, 64):
        monkeypatch.setattr(topk, "BLOCK", size)
        monkeypatch.setattr(topk, "QUERY_BLOCK", size // 8)
        assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1, 64, 2**20])
def test_top_k_in_bounded_places(spark, monkeypatch, capsys, scale):
    """One shuffle partition, yet neither side of a task grows with the table and no join holds a side."""
    rng = np.random.default_rng(scale % 97)
    v = rng.integers(-20, 21, (700, 40))
    v[300:500] = v[:200]  # equal vectors under other ids
    df = spark.createDataFrame([(int(i), [float(c) * scale / 256 for c in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    score = v.astype(object) * scale
    score = score @ score.T
    want = []
    for q in range(0, 700, 7):
        near = sorted((-score[q, i], i) for i in range(700) if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    for name, value in {"BLOCK": 32, "QUERY_BLOCK": 16, "SIDE_BYTES": 20_000, "LEAST_BYTES": 10_000}.items():
        monkeypatch.setattr(topk, name, value)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        got = topk.top_k(df, every=7)
        assert sorted(tuple(r) for r in got.collect()) == want
        got.explain()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    plan = capsys.readouterr().out
    # 700 vectors of 41 x 8 bytes in 12 slots, 100 queries in 2 parts: 24 places
    assert "Join" not in plan and "24), REPARTITION" in plan.replace("place", "")


def test_top_k_packs_narrow_blocks_of_bounded_bytes(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8 * 50 * 10)
    df = spark.createDataFrame([(i, [float(i % 90) / 256] * 50) for i in range(100)], "vec_id long, embedding array<double>")
    for dim, ids, m in topk._packed(topk.quantised(df, "vec_id", "embedding"), topk.BLOCK).collect():
        ids = np.frombuffer(ids, np.int64)
        assert len(ids) <= 10 and (np.frombuffer(m, np.int8).reshape(dim, -1) == ids % 90).all()


# -- PII ---------------------------------------------------------------------------------

def brute_base(t):
    """The contract's patterns over the whole text."""
    out = []
    for kind, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                              r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t or ""):
            s, d = m.group(), re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in s.split(".")):
                continue
            if kind == 2 and not (14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == 3 and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    parts = ["a@b.c", "x.y+z@mail.example.com", "@", "a@b", "a@b.c@d.e", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "01.002.0003.4", "4532 0151 1283 0366",
             "4532015112830366", "1234-5678-9012-3456", "+1 (679) 555-1339", "+12", "+1 555", "++49 30 123456", "é", " ", "\n", ".", "-", "word", "12", "((", ")", "0" * 30]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=rng.randrange(0, 9)))
        assert pii.base_spans(t)[0] == brute_base(t), t
        assert pii.candidates(t) == [m.span() for m in SPACE.finditer(t) if re.search("[0-9@]", m.group())], t


def test_pii_query_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    field = pii.fit(docs)
    added = 0
    for r in pii.find(docs, field).collect():
        base = brute_base(text[r.doc_id])
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        spans = [x for x in r.spans.split(",") if x]
        assert set(said.split(",")) - {""} <= set(spans) and len(spans) == len(base) + r.n_added
        added += r.n_added
    assert 0 < added < 20
    clean = [t for t in text.values() if not re.search("[0-9@]", t)]
    assert all(pii.text_spans(t, field) == ([], []) for t in clean)
    swallowed = "of +1 (269) 555-3296 4524132264652876 and"
    assert brute_base(swallowed) == []
    assert pii.masked(swallowed, pii.text_spans(swallowed, field)[1]) == "of [PHONE] [CARD] and"


def test_skip_chain_carries_labels():
    """An ambiguous token follows the label of a similar token far away."""
    field = pii.Field({"sure": 0, "open": 1}, np.array([[0, 0, 0, 0, 4.0], [0.5, 0, 0, 0, 0], [3.0, 0, 0, 0, 0]]), np.zeros((5, 5)), 2.0 * np.eye(5))
    alone = field.marginals(["open"], [], [])
    linked = field.marginals(["sure", "open"], [], [(0, 1)])
    assert alone[0].argmax() == 0 and linked[1].argmax() == 4
    exact = np.zeros((5, 5))
    for a in range(5):
        for b in range(5):
            exact[a, b] = np.exp(field.token[0, a] + field.token[1, b] + field.skip[a, b])
    exact /= exact.sum()
    assert np.allclose(linked[0], exact.sum(1)) and np.allclose(linked[1], exact.sum(0))  # exact on a tree


def test_pii_odd_input(spark, odd, none):
    field = pii.fit(odd)
    assert len(pii.find(odd, field).collect()) == odd.count()
    assert pii.find(none, pii.fit(none)).count() == 0
    hidden = pii.mask(odd, field, n_chars="n")
    assert hidden.schema == odd.schema and rows(hidden) == rows(odd)


def test_pii_grouped_cards(spark):
    """Card numbers in groups that the base patterns swallow into a failing match."""
    field = pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    card, other, amex = "4532 0151 1283 0366", "4111 1111 1111 1111", "3782 822463 10005"
    for text, want in [(f"call +1 (269) 555-3296 {card} now", "call [PHONE] [CARD] now"),
                       (f"both {card} {other} end", "both [CARD] [CARD] end"),
                       (f"three ({card} {other} {amex}).", "three ([CARD] [CARD] [CARD])."),
                       (f"hyphens {card.replace(' ', '-')} {other.replace(' ', '-')}", "hyphens [CARD] [CARD]"),
                       (f"mixed {card} 4111111111111111, {other.replace(' ', '-')}.", "mixed [CARD] [CARD], [CARD]."),
                       (f"no card: {card[:-1]}7 {other[:-1]}2", f"no card: {card[:-1]}7 {other[:-1]}2")]:
        base, spans = pii.text_spans(text, field)
        assert base == brute_base(text) and set(base) <= set(spans)
        assert pii.masked(text, spans) == want
    assert pii.units(f"+49 30 1234 5678 {card}", pii.candidates(f"+49 30 1234 5678 {card}"))[-1] == (17, 36)


# -- licenses ----------------------------------------------------------------------------

def test_license_sql(spark, sf, duck, odd):
    got = licenses.scan(spark.read.parquet(f"{sf}/documents.parquet"))
    assert rows(got) == rows(duck.execute(licenses.LICENSE_SQL).df())


def test_license_planted_blocks(spark, none):
    import duckdb

    rng = random.Random(8)
    words = ["the", "of", "work", "under", "license", "and", "all", "cc", "by", "public", "general", "rights", "reserved", "K", "İ", "é"]
    docs = []
    for d in range(80):
        t = rng.choices(words, k=rng.randrange(0, 120))
        if d % 2:
            notice = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randrange(3)):
                notice[rng.randrange(len(notice))] = "other"
            at = rng.randrange(len(t) + 1)
            t[at:at] = notice
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(t).title() if d % 3 else " ".join(t)))
    docs += [(100, None), (101, ""), (102, "CC-BY"), (102, "CC-BY"), (None, "All rights reserved")]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double")
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841  read by name below
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con.register("documents", documents)
    assert rows(licenses.scan(df)) == rows(con.execute(licenses.LICENSE_SQL).df())
    assert licenses.scan(none).count() == 0


def test_license_plan_is_native(spark, sf):
    plan = licenses.scan(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# -- repeats -----------------------------------------------------------------------------

def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = collections.Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if n[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4096, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choices("abé", k=rng.randrange(5, 60))) for _ in range(12)]
    texts = []
    for _ in range(90):
        t = "".join(rng.choice(parts) if rng.random() < 0.4 else "".join(rng.choices("abcdefgh", k=rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6)))
        texts.append(t)
    texts += ["a" * 200, "a" * 19, "ab" * 80, texts[0], texts[0], None, "", texts[1][:25] + "x"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, k1 string")
    monkeypatch.setattr(repeats, "PIECE", 64)  # long texts in pieces
    got = repeats.remove_repeats(df, length=20, q=4, hot=hot).collect()
    want = brute_repeats(texts, 20)
    assert {r.doc_id: tuple(r)[1:] for r in got} == dict(enumerate(want))


def brute_passages(texts, n):
    """(runs, words) covered by n words that also start anywhere else."""
    words = [re.split(r"[\x20\x09-\x0D]+", lower(t or "").strip(" \t\n\x0b\x0c\r")) if (t or "").strip(" \t\n\x0b\x0c\r") else [] for t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])] = seen.get(tuple(w[i : i + n]), 0) + 1
    out = []
    for w in words:
        on = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                on[i : i + n] = [True] * n
        out.append((sum(on[i] and (i == 0 or not on[i - 1]) for i in range(len(on))), sum(on)))
    return out


@pytest.mark.parametrize("hot", [1, 4096])
def test_repeated_passages_of_words_equal_brute_force(spark, monkeypatch, hot):
    rng = random.Random(hot)
    shared = [" ".join(rng.choice("ab cd ef gh ij kl".split()) + str(rng.randint(0, 30)) for _ in range(14)) for _ in range(4)]
    texts = [None, "", " \n", "one two"]
    for _ in range(40):
        parts = [" ".join("w" + str(rng.randint(0, 400)) for _ in range(rng.randint(0, 25))) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 3), rng.choice(shared).upper() if rng.random() < 0.2 else rng.choice(shared))
        texts.append(("\n" if rng.random() < 0.5 else "  ").join(parts))
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, texts[7])], "doc_id bigint, text string")
    monkeypatch.setattr(repeats, "PIECE", 64)
    monkeypatch.setattr(repeats, "WORD_Q", 3)
    got = {r.doc_id: (r.n_passages, r.passage_words) for r in repeats.remove_repeats(df, length=4000, q=16, hot=hot, passage=10).collect()}
    want = brute_passages([*texts, texts[7]], 10)
    assert [got[i] for i in [*range(len(texts)), 99]] == want and sum(w[1] > 0 for w in want) > 10


def test_refined_buckets_name_equal_strings(monkeypatch):
    rng = np.random.default_rng(2)
    for kind in (np.uint8, np.uint64):
        data = rng.integers(0, 2, 3000).astype(kind)
        at = np.arange(3000 - 23)
        b = repeats._refined(data, at, 23, 4)
        names = {}
        for p in at:
            names.setdefault(data[p : p + 23].tobytes(), set()).add(int(b[p]))
        assert all(len(v) == 1 for v in names.values()) and len({next(iter(v)) for v in names.values()}) == len(names)


def test_repeats_odd_input(spark, odd, none):
    got = repeats.remove_repeats(odd, keep_bytes=True).collect()
    want = brute_repeats([r.text for r in odd.collect()], 400)
    assert sorted(tuple(r)[1:5] for r in got) == sorted(want)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert repeats.remove_repeats(none).count() == 0


# -- pipeline ----------------------------------------------------------------------------

def test_pipeline_stages(spark, sf, odd):
    import corpus_pipeline

    from kestrel.llm.common import written

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(10**6, "1234 !!! ...", "en", "s", 12), (10**6 + 1, None, None, None, None), (10**6 + 2, "", "en", "s", 0),
             (10**6 + 3, "Write to some.body@mail.example.com or call +1 (212) 555-0100 for the rest of the story", "en", "s", 1)]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    extra += [(10**6 + 4, f"Before the passage. {item} After the passage.", "en", "s", 1)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = written(stage(spark, docs, sf), name)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if i < 4:
            assert docs.columns == before.columns
        if name == "pii":
            text = {r.doc_id: r.text for r in docs.collect()}
            was = {r.doc_id: r.text for r in before.collect()}
            assert text[10**6 + 3] == "Write to [EMAIL] or call [PHONE] for the rest of the story"
            assert all(text[d] == t for d, t in was.items() if not brute_base(t) and not re.search(r"\d{5}", t))
    ids = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert kept["language_id"] == {*ids, 10**6 + 3, 10**6 + 4}
    assert kept["near_dedup"] - kept["decontaminate"] >= {10**6 + 4}
    sets = brute_components([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], 5)
    assert kept["near_dedup"] & set(ids) == {d for d, _, _, keep in sets if keep}
    assert kept["pii"] == kept["decontaminate"] == kept["packing"]
    assert sum(1 for _ in corpus_pipeline.run(spark, sf).collect()) > 0


def test_stages_keep_user_columns_and_take_empty_tables(spark, sf):
    from kestrel.llm import stages

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    named = ["__lang", "__score", "__row", "__own", "__key", "component_id", "lang_pred"]
    more = docs.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in named])
    for stage in (stages.language_id, stages.near_dedup, stages.decontaminate, stages.pii):
        left = stage(spark, more, sf)
        assert left.columns == more.columns
        kept = left.collect()
        assert kept and all(r[c] == f"{c}{r.doc_id}" for r in kept for c in named)
        assert {r.doc_id for r in kept} == {r.doc_id for r in stage(spark, docs, sf).collect()}
        assert stage(spark, docs.limit(0), sf).collect() == []
    assert stages.packing(spark, docs.limit(0), sf).collect() == []


def test_near_dedup_keeps_one_row_of_each_group(spark):
    """Repeated, shared and null doc_ids: every row is judged by its own text."""
    from kestrel.llm import stages

    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    data = [(3, a), (3, a), (3, a),  # one id and text
            (1, b), (2, b + " more"), (2, c),  # a copy of another document shares its id with a text of its own
            (None, a), (None, d), (None, d), (None, e),  # copies of a document with an id, and of each other
            (7, ""), (7, ""), (8, None), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(data)], "doc_id bigint, text string, n int").repartition(3)
    got = stages.near_dedup(spark, docs, None)
    assert got.columns == docs.columns
    want = [(3, a), (1, b), (2, c), (None, d), (None, e), (7, ""), (8, None), (None, ""), (None, "")]
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=repr) == sorted(want, key=repr)
    ids = near_docs(2)
    docs = spark.createDataFrame(ids, "doc_id bigint, text string")
    kept = {r.doc_id for r in stages.near_dedup(spark, docs, None).collect()}
    assert kept == {i for i, _, _, keep in brute_components(ids, 5) if keep}
