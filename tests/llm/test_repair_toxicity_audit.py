"""Conversation repair, toxicity grammar and filter audit against plain restatements."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import rows
from kestrel.llm import catalog, conversations, filteraudit, toxicity

CONV = "conv_id bigint, turn bigint, role string, text string, score double, copy int, alive boolean"


# ------------------------------------------------------------------ conversation repair
def plain_damage(table):
    out = []
    for c, t, role, text in table:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out += [(c, t, role, text)] * (2 if h == 3 else 1)
    return out


def plain_faults(rs):
    faults, seen = [], set()
    for role, text in rs:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    return faults


def plain_repair(rs):
    """Tuples (cost, audit, lines) kept by the last role initial; no integers."""
    faults = plain_faults(rs)
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def offer(states, q, *v):
        if q not in states or v[:2] < states[q][:2]:
            states[q] = v

    def inserted(states):
        for _ in range(3):
            for q, (c, a, ls) in list(states.items()):
                for role in ("user", "assistant"):
                    if (q, role[0]) in after:
                        offer(states, after[q, role[0]], c + 2, a + "I", [*ls, role + ":"])
        return states

    best = {"": (0, "", [])}
    for (role, text), fault in zip(rs, faults, strict=True):
        new = {}
        for q, (c, a, ls) in inserted(best).items():
            offer(new, q, c + 3, a + "D", ls)
            if fault in (0, 3):
                for r, cost, letter in ((role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")):
                    if (q, r[:1]) in after:
                        offer(new, after[q, r[:1]], c + cost + (fault == 3), a + letter, [*ls, r + ":" + text])
        best = new
    return faults, min((v for q, v in inserted(best).items() if q in ("", "a")), key=lambda v: v[:2])


def every_repair(rs):
    """All edits of all rows, with up to two inserted turns in every gap."""
    faults = plain_faults(rs)
    gaps = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    best = None
    options = [[("D", None, 3)] + ([] if f in (1, 2) else [(x, r, c + (f == 3)) for x, r, c in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2))])
               for (role, _), f in zip(rs, faults, strict=True)]
    for edits in itertools.product(*options):
        for ins in itertools.product(gaps, repeat=len(rs) + 1):
            roles, audit, cost, lines = "", "", 0, []
            for k in range(len(rs) + 1):
                for r in ins[k]:
                    roles, audit, cost, lines = roles + r[0], audit + "I", cost + 2, [*lines, r + ":"]
                if k < len(rs):
                    x, r, c = edits[k]
                    audit, cost = audit + x, cost + c
                    if x != "D":
                        roles, lines = roles + (r[:1] or "?"), [*lines, r + ":" + rs[k][1]]
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def plain_rows(table):
    out = []
    for conv in sorted({r[0] for r in table}, key=repr):
        rs = sorted((r for r in plain_damage(table) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in rs if r[1] is not None]
        faults, (cost, audit, lines) = plain_repair([r[2:] for r in rs]) if rs else ([], (0, "", []))
        ini = [r[2][:1] for r in rs]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
                    sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(ini)), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def some_conversations(n, longest, seed):
    rng = random.Random(seed)
    table = []
    for c in range(n):
        turn = rng.randint(-2, 3)
        for _ in range(rng.randint(1, longest)):
            turn += rng.choice([1, 1, 1, 2])
            table.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]),
                          rng.choice(["Yes.", "No", "What?", " ", None, "", f"Text {rng.random():.3f}.", "é ß. \n"])))
    return table


def test_repair_equals_plain_search(spark):
    table = some_conversations(150, 7, 5) + [(None, 1, "user", "Hi."), (None, None, "assistant", "Hello."), (900, None, None, None)]
    df = spark.createDataFrame([(*r, 1.0, 3, False) for r in table], CONV)
    got = sorted((tuple(r) for r in conversations.repair(df).collect()), key=repr)
    assert got == plain_rows(table)


def test_repair_equals_all_edit_sequences():
    rng = random.Random(4)
    for _ in range(25):
        rs = [(rng.choice(["user", "assistant", "system", "x", ""]), rng.choice(["Yes.", "No", "", "Why?"])) for _ in range(rng.randint(0, 3))]
        c = conversations.Conversation(1)
        for t, ((role, text), f) in enumerate(zip(rs, plain_faults(rs), strict=True)):
            c.add(t, role, text, f)
        cost, audit, lines = every_repair(rs)
        assert plain_repair(rs)[1] == (cost, audit, lines)
        assert c.result()[6:] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_blocks_give_the_same_repair(monkeypatch):
    rng = random.Random(11)
    for _ in range(300):
        rs = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["Yes.", "No", "", "Why?"]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 12))]
        results = set()
        for size in (1, 2, 5, 256):
            monkeypatch.setattr(conversations, "BLOCK", size)
            c = conversations.Conversation(1)
            for t, (role, text, fault) in enumerate(rs):
                c.add(t, role, text, fault)
            results.add(c.result())
        assert len(results) == 1


def test_long_conversation_in_bounded_blocks(spark):
    df = spark.range(20_000).select(F.lit(7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                    F.concat(F.lit("Turn "), F.col("id"), F.lit(".")).alias("text"))
    (r,) = conversations.repair(df).collect()
    table = [(7, t, "assistant" if t % 2 else "user", f"Turn {t}.") for t in range(20_000)]
    ((_, gaps, blank, dup, cut, illegal, cost, audit, sha),) = plain_rows(table)
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == (gaps, blank, dup, cut, illegal, cost, audit, sha)


def test_repair_of_an_empty_table(spark):
    assert conversations.repair(spark.createDataFrame([], CONV)).collect() == []


# ---------------------------------------------------------------------- filter audit
def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    cells = []
    for i, text, source in docs:
        t = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        cells.append((source or "", fails, i in good, i in toxic))
    out = []
    for part in {c[0] for c in cells}:
        mine = [c for c in cells if c[0] == part]
        lines, total = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            live = mine
            for k, f in enumerate(order):
                gone = [c for c in live if c[1][f]]
                early = sum(c[1][f] for c in mine) - len(gone)
                live = [c for c in live if not c[1][f]]
                only = sum(c[1][f] and sum(c[1].values()) == 1 for c in mine)
                lines.append([part, "".join(order), k + 1, len(live), len(gone), early, only, sum(c[2] for c in gone), sum(c[3] for c in gone)])
                total[f] += len(gone)
        out += [(*x, total[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


def test_audit_equals_every_order_applied(spark):
    rng = random.Random(3)
    words = ["alpha", "BETA", "x#", "gamma", "d", "Long"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 49, 50, 70]))) for _ in range(12)] + ["", None, "  \t", " ".join(map(str, range(60)))]
    docs = [(rng.choice([*range(40), None]), rng.choice(texts), rng.choice(["a", "b", "", None])) for _ in range(200)]
    labels = [(rng.choice([*range(45), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(30)]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id bigint, text string, source string, mask int, part string")
    lab = spark.createDataFrame([(*r, 2) for r in labels], "doc_id bigint, quality int, toxic int, n int")
    got = sorted(tuple(r) for r in filteraudit.filter_audit(d, lab).collect())
    assert got == plain_audit(docs, labels)


def test_audit_of_odd_tables(spark, odd, none):
    lab = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filteraudit.filter_audit(none.withColumn("source", F.lit("x")), lab).count() == 0
    assert filteraudit.filter_audit(odd.withColumn("source", F.col("lang")), lab).groupBy("part").count().collect()


def test_adjacent_swaps_visit_every_order():
    order, seen = list(range(5)), {tuple(range(5))}
    for i in filteraudit.WALK:
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.add(tuple(order))
    assert len(filteraudit.WALK) == 119 and len(seen) == 120


def test_equal_subdiagrams_are_one_node():
    d = filteraudit.Diagram(dict.fromkeys(range(32), (1, 0, 0)))
    for i in [None, *filteraudit.WALK]:
        if i is not None:
            d.swap(i)
        assert [len(nodes) for nodes in d.level] == [1] * 5


# -------------------------------------------------------------------------- toxicity
def clause(text, stems):
    """The composed machine over one clause, and the same by running the machines one by one."""
    sym, weight = [], []
    for w in text.split():
        lex = max([v for s, v in stems.items() if w.startswith(s)], default=0.0)
        c = "i" if lex else "h" if w in toxicity.HARMS else "t" if w in toxicity.TARGETS else "n" if w in toxicity.NEGATIONS else "r" if w in toxicity.REPORTS else "o"
        sym.append(toxicity.INPUT.index(c))
        weight.append(lex)
    states, total, last = [0, 0, 0, 0], 0.0, 0.0
    for a, w in zip(sym, weight, strict=True):
        x = toxicity.INPUT[a]
        for m, rule in enumerate((toxicity._negation, toxicity._threat, toxicity._report, toxicity._target)):
            states[m], x = rule(states[m], x)
        f = toxicity.factor(x)
        total += f * (w if x[0] == "i" else toxicity.HARM if x[0] == "H" else last if x[0] == "a" else 0)
        last = w if x[0] == "i" else last
    return toxicity.clause_score(sym, weight), total


STEMS = {"zork": 4.0, "blarg": 2.0}


def test_composed_grammar_equals_its_machines():
    rng = random.Random(1)
    vocab = ["zorky", "blarg", "you", "not", "said", "kill", "the", "tree", "of"]
    for _ in range(2000):
        got, want = clause(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 14))), STEMS)
        assert got == pytest.approx(want)


def test_clauses_not_words_are_scored():
    score = lambda t: clause(t, STEMS)[0]
    assert score("the tree of") == 0
    assert score("you zork") > score("zork") > score("she said zork") > 0
    assert score("not a zork") < score("zork") / 2
    assert score("i will kill you") > 0 == score("i will kill the tree")
    assert score("kill you") > score("never kill you") > 0


def test_reader_finds_the_same_clauses():
    import pyarrow as pa

    texts = ["The tree. You ZORKY! Not a blarg, he said; blargle", None, "", "no match here", "kill you\nkill. you"]
    f = toxicity.Reader(STEMS).features(pa.array(texts))
    first = sum(clause(c, STEMS)[0] for c in ("you zorky", "not a blarg he said", "blargle"))
    assert f[0].tolist() == pytest.approx([first, clause("you zorky", STEMS)[0], 3, 10])
    assert f[1:4, :3].sum() == 0 and f[4, 2] == 1


def toxic_corpus(spark, n=400, copies=40):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ter", "un", "sel"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        toxic = int(i % 5 == 0)
        ws = [word() for _ in range(rng.randint(5, 80))]
        if toxic:
            for _ in range(2):
                ws.insert(rng.randint(0, len(ws)), "grunz" + word())
        docs.append((i, " ".join(ws) + "."))
        labels.append((i, 1, toxic))
    docs += [(n + k, "unique phrase seltsam of one toxic text that was copied") for k in range(copies)]
    labels += [(n + k, 1, 1) for k in range(copies)]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_learned_stems_and_held_out_score(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.fit(docs, labels)
    assert "grunz" in model["stems"] and not any("seltsam".startswith(s) for s in model["stems"])  # copies teach once
    got = toxicity.score(docs, model).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    test = got[got.held_out & (got.doc_id < 400)]
    assert ((test.predicted == 1) == (test.toxic == 1)).mean() > 0.97
    assert ((got.predicted == 1) == (got.score >= 0.7)).all() and got.score.between(0, 1).all()


def test_held_out_labels_teach_nothing(spark):
    docs, labels = toxic_corpus(spark, copies=0)
    other = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, other)
    assert a["stems"] == b["stems"] and np.allclose(a["weights"], b["weights"])


def test_toxicity_of_odd_tables(spark, odd, none):
    docs, labels = toxic_corpus(spark, copies=0)
    model = toxicity.fit(docs, labels)
    assert toxicity.score(none, model).count() == 0
    got = toxicity.score(odd, model).toPandas()
    assert len(got) == odd.count() and got.score.between(0, 1).all()
    for lab in (labels.where("toxic = 1"), labels.limit(0)):
        flat = toxicity.score(odd, toxicity.fit(docs, lab)).toPandas()
        assert flat.score.nunique() == 1
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0))).count() == 0


def test_registered_queries_match_their_sql(spark, sf, duck):
    for name in ("op11_conversation_repair", "op13_filter_audit"):
        for t in ("conversations", "labels"):
            duck.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        got, want = catalog.QUERIES[name](spark, sf), duck.execute(catalog.ORACLE[name]).df()
        assert rows(got) == rows(want)
    out = catalog.QUERIES["op12_toxicity"](spark, sf)
    assert out.count() == duck.execute("SELECT count(*) FROM documents").fetchone()[0]
