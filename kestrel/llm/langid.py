"""Language identification by a string kernel.

Kernel.  Texts are lower-cased; every character is a letter of the alphabet learned from
the sample (the most frequent ``ALPHABET - 2`` letters), another letter, or a boundary.
The blended-spectrum presence kernel of two texts counts the different n-grams, n = 1..3,
that both hold, over the geometric mean of their numbers of different n-grams (among
those of the landmarks: others meet nothing).

Model.  Landmarks are sampled texts of every language.  Nyström: with K_mm and K_nm the
kernel among landmarks and of the sample against them, features are K_nm K_mm^(-1/2);
kernel ridge regression gives one weight vector per language (one versus rest, targets
+1 and -1).  A text is scored by batched matrix products: presence (texts x n-grams) by
landmark presence (n-grams x landmarks) gives kernel rows, these by the folded weights
give one value per language; the largest wins, ties to the smaller label.

The sample is bounded: ``sample`` rows in total, as many from each label, those of the
smallest hash of (doc_id, text); it is used whole, and only the different n-grams of its
texts reach the driver.  Every text is classified whole.

Defined cases: a null text or one without a letter is ``und`` with score 0; with no
labelled text every text is ``und``; a null label teaches nothing; repeated rows are
classified alike; long texts are read in pieces, so memory does not grow with them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from kestrel.llm.common import lists, map_batches, shipped

ALPHABET = 96
ORDERS = 3
SAMPLE = 1600
LANDMARKS = 128
RIDGE = 1e-2
PIECE = 1 << 19
UNDECIDED = "und"
_GRAMS = ALPHABET + ALPHABET**2 + ALPHABET**3


def _pieces(texts: list):
    """(number, piece) with each piece at most PIECE characters; n-grams that span two
    pieces of a text are in the second."""
    for i, t in enumerate(texts):
        t = "\n" + (t or "").lower() + "\n"
        for at in range(0, max(1, len(t) - ORDERS + 1), PIECE):
            yield i, t[at : at + PIECE + ORDERS - 1]


def _codes(letters: np.ndarray, pieces: list[tuple[int, str]]):
    """(text number, n-gram code) of every n-gram, and (text number, letter id)."""
    ids = letters[np.frombuffer("".join(p for _, p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
    size = np.array([len(p) for _, p in pieces])
    doc = np.repeat(np.array([i for i, _ in pieces]), size)
    piece = np.repeat(np.arange(len(pieces)), size)
    out, code, base = [], ids, 0
    for n in range(1, ORDERS + 1):
        if n > 1:
            if len(ids) < n:
                break
            code = code[:-1] * ALPHABET + ids[n - 1 :]
        whole = (piece[: len(code)] == piece[n - 1 :]) & (code > 0)
        out.append((doc[: len(code)][whole], code[whole] + base))
        base += ALPHABET**n
    return np.concatenate([d for d, _ in out]), np.concatenate([c for _, c in out]), doc[ids > 0]


def _groups(texts: list):
    """Runs of pieces of about PIECE characters."""
    run, size = [], 0
    for i, p in _pieces(texts):
        run.append((i, p))
        size += len(p)
        if size >= PIECE:
            yield run
            run, size = [], 0
    if run:
        yield run


@dataclass
class LanguageModel:
    labels: list[str]
    letters: np.ndarray  # code point -> letter id
    feature: np.ndarray  # n-gram code -> row of ``presence``, or -1
    presence: np.ndarray  # n-grams x landmarks, over the square root of the landmark's size
    weights: np.ndarray  # landmarks x labels
    bias: np.ndarray

    def kernel(self, present: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(present.sum(1, keepdims=True), 1))
        return (present @ self.presence) / size

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        labels, scores = [], np.zeros(len(texts))
        for at in range(0, len(texts), 128):
            part = texts[at : at + 128]
            present = np.zeros((len(part), self.presence.shape[0]), np.float32)
            letter = np.zeros(len(part), bool)
            for run in _groups(part):
                doc, code, has = _codes(self.letters, run)
                row = self.feature[code]
                present[doc[row >= 0], row[row >= 0]] = 1
                letter[has] = True
            if not self.labels:
                labels += [UNDECIDED] * len(part)
                continue
            f = self.kernel(present) @ self.weights + self.bias
            top = f.argmax(1)
            labels += [self.labels[k] if ok else UNDECIDED for k, ok in zip(top, letter, strict=True)]
            scores[at : at + len(part)] = np.where(letter, np.clip((f.max(1) + 1) / 2, 0, 1), 0)
        return labels, scores


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE,
        landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Learn from the labelled rows of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    docs = docs.where("label is not null and text is not null")
    sizes = {r.label: r["count"] for r in docs.groupBy("label").count().limit(sample).collect()}
    labels = sorted(sizes)
    empty = LanguageModel([], np.zeros(0x110000, np.uint8), np.full(_GRAMS, -1, np.int32), np.zeros((1, 1), np.float32), np.zeros((1, 0)), np.zeros(0))
    if not labels:
        return _with_letters(empty, {})
    each = max(2, sample // len(labels))
    near = lambda df, by, k: df.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(*by))).where(F.col("r") <= k).drop("r")
    # of a large label only the rows below a hash bound (four times as many as wanted) are ranked
    bound = F.lit(2**63 - 1)
    for lab, n in sizes.items():
        bound = F.when(F.col("label") == lab, F.lit(min(2**63 - 1, 2**63 * 4 * each // n))).otherwise(bound)
    few = docs.select("id", "label").where(F.shiftrightunsigned(F.xxhash64("id"), 1) <= bound)
    ids = near(few, [F.shiftrightunsigned(F.xxhash64("id"), 1), "id"], each).select("id").distinct().collect()  # at most ``sample``
    rows = docs.where(F.col("id").isin([r.id for r in ids])) if ids else docs.limit(0)
    rows = near(rows, [F.xxhash64("id", "text"), "id", "text"], each).persist()

    def letter_counts(b):
        total: dict[str, int] = {}
        for t in b.column("text").to_pylist():
            chars, n = np.unique(np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
            for c, k in zip(chars.tolist(), n.tolist(), strict=True):
                if chr(c).isalpha():
                    total[chr(c)] = total.get(chr(c), 0) + k
        return {"c": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())}

    found = map_batches(rows, letter_counts, "c string, n bigint").groupBy("c").agg(F.sum("n").alias("n"))
    alphabet = [r.c for r in found.orderBy(F.desc("n"), "c").limit(ALPHABET - 2).collect()]
    empty = _with_letters(empty, {c: i + 1 for i, c in enumerate(sorted(alphabet))})
    letters = shipped(spark, empty.letters)

    def grams(b):
        texts = b.column("text").to_pylist()
        sets: list[list] = [[] for _ in texts]
        for run in _groups(texts):
            doc, code, _ = _codes(letters(), run)
            both = np.unique(doc.astype(np.int64) * _GRAMS + code)
            for i in np.unique(both // _GRAMS):
                sets[i].append(both[both // _GRAMS == i] % _GRAMS)
        sets = [np.unique(np.concatenate(s)) if s else np.zeros(0, np.int64) for s in sets]
        off = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        return {"label": b.column("label"), "order": b.column("order"), "grams": lists(np.concatenate(sets) if sets else [], off, pa.int64())}

    got = map_batches(rows.select("label", "text", F.xxhash64("id", "text").alias("order")), grams, "label string, order bigint, grams array<bigint>").collect()
    rows.unpersist()
    got = sorted((r for r in got if r.grams), key=lambda r: (r.order, r.label, r.grams))
    if not got:
        return empty
    labels = sorted({r.label for r in got})
    per = max(1, landmarks // len(labels))
    marks = [r for lab in labels for r in [x for x in got if x.label == lab][:per]]
    vocab = np.unique(np.concatenate([r.grams for r in marks]))
    feature = np.full(_GRAMS, -1, np.int32)
    feature[vocab] = np.arange(len(vocab))

    def presence(rs):
        m = np.zeros((len(rs), len(vocab)), np.float32)
        for i, r in enumerate(rs):
            k = feature[np.array(r.grams)]
            m[i, k[k >= 0]] = 1
        return m

    z = presence(marks)
    z = (z / np.sqrt(z.sum(1, keepdims=True))).T.copy()
    model = LanguageModel(labels, empty.letters, feature, z, np.zeros((z.shape[1], len(labels))), np.zeros(len(labels)))
    k_mm = model.kernel(presence(marks)).astype(float)
    k_nm = np.concatenate([model.kernel(presence(got[i : i + 256])) for i in range(0, len(got), 256)]).astype(float)
    val, vec = np.linalg.eigh((k_mm + k_mm.T) / 2)
    ok = val > 1e-6 * val.max()
    root = vec[:, ok] / np.sqrt(val[ok])
    x = np.hstack([k_nm @ root, np.ones((len(got), 1))])
    y = np.array([[1.0 if r.label == lab else -1.0 for lab in labels] for r in got])
    w = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y)
    model.weights, model.bias = (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)
    return model


def _with_letters(model: LanguageModel, alphabet: dict[str, int]) -> LanguageModel:
    points = [i for i in range(0x110000) if chr(i).isalpha()]
    model.letters[points] = ALPHABET - 1
    for c, i in alphabet.items():
        model.letters[ord(c)] = i
    return model


def apply(model: LanguageModel, docs: DataFrame, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the two columns appended; every other column passes unread."""
    shared = shipped(docs.sparkSession, model)

    def run(batches):
        for b in batches:
            lab, sc = shared().predict(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lab, pa.string()), pa.array(sc, pa.float64())], names=[*b.schema.names, label, score])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(label, StringType()), StructField(score, DoubleType())]))


def held_out(doc_id="doc_id", of: int = 4):
    """crc32(doc_id as text) mod ``of`` is 2; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of == 2, F.lit(False))
