"""Toxicity by multiple-instance learning.

Sentences are the instances, documents the bags. A sentence's score is logistic
in hashed features of its words (the word, its beginnings, its four-letter
pieces), less the logarithm of the number of sentences of its document, so that
a document's prior does not grow with its length; a document's score is the
noisy-or of its sentences. Training and scoring use the same rule. Only document
labels are learned from: the gradient of the document's loss through the
noisy-or trains the sentence scores, which then locate the offending sentences.

Edge cases: a null, empty or word-less text has one sentence score, that of the
bias; a text of any length is scored whole, and is as likely as a short one to
be drawn for training; a null label is never learned from; repeated labels of a
document count once, a conflict as toxic; an id with several texts lends its
label to each; repeated rows are scored each for itself; with no labels of both
classes every score is 0; other columns of either table are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgrisk.llm.common import fold, fold_col, map_rows, sigmoid

SAMPLE_DOCS = 1500  # labelled documents of each class to learn from
SAMPLE_CHARS = 40_000_000  # characters of all of them together, in expectation
FEATURES = 1 << 18
STEPS = 200
SHRINK = 0.002  # of every weight at every step
SENTENCE_ENDS = re.compile(rb"[.!?\n]+")
PUNCTUATION = b",;:\"'()[]{}*#$%&|<>-"
CACHE_WORDS = 400_000
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_sentences long, n_toxic_sentences long, sentences array<struct<start:int,end:int,score:double>>"


def features(word: bytes) -> list[int]:
    """Hashed features of a word; a few repeated hashes do no harm."""
    w = b"^" + word + b"$"
    parts = {b"w" + w} | {b"b" + w[:k] for k in (4, 5, 6, 7) if len(w) > k} | {b"g" + w[i : i + 4] for i in range(len(w) - 3)}
    return [zlib.crc32(p) % FEATURES for p in sorted(parts)]


def sentences(text: str | None) -> list[list[bytes]]:
    """Words of each sentence that has some."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    return [ws for ws in (s.split() for s in SENTENCE_ENDS.split(raw)) if ws]


class Detector:
    def __init__(self, weights: np.ndarray | None, bias: float):
        self.weights, self.bias = weights, bias
        self.cache: dict[bytes, float] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "cache": {}}

    def word(self, w: bytes) -> float:
        bare = w.strip(PUNCTUATION)
        value = self.cache.get(bare)
        if value is None:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            value = float(self.weights[features(bare)].sum()) if bare else 0.0
            self.cache[bare] = value
        self.cache[w] = value
        return value

    def sentence_scores(self, sents: list[list[bytes]]) -> np.ndarray:
        get, word = self.cache.get, self.word
        z = []
        for ws in sents:
            total = self.bias
            for w in ws:
                v = get(w)
                total += word(w) if v is None else v
            z.append(total)
        z = np.array(z if z else [self.bias])
        return sigmoid(z - np.log(len(z)))

    def __call__(self, text: str | None) -> tuple[float, np.ndarray]:
        """Document score and sentence scores."""
        if self.weights is None:
            return 0.0, np.zeros(0)
        p = self.sentence_scores(sentences(text))
        return float(1 - np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), p


def fit(rows: list[tuple[int, str]], steps: int = STEPS) -> Detector:
    """Train on (label, text) pairs: AdaGrad on the documents' log-loss through the noisy-or."""
    vocab: dict[bytes, int] = {}
    word, sent, doc, label = [], [], [], []
    for y, text in rows:
        for ws in sentences(text):
            word += [vocab.setdefault(w.strip(PUNCTUATION), len(vocab)) for w in ws]
            sent += [len(doc)] * len(ws)
            doc.append(len(label))
        label.append(y)
    if not doc or not 0 < sum(label) < len(label):
        return Detector(None, 0.0)
    word, sent, doc, y = np.array(word), np.array(sent), np.array(doc), np.array(label, float)
    feats = [features(w) for w in vocab]
    flat = np.array([f for fs in feats for f in fs])
    owner = np.repeat(np.arange(len(vocab)), [len(f) for f in feats])
    prior = -np.log(np.bincount(doc)[doc])  # of a sentence, by how many its document has
    w, bias = np.zeros(FEATURES), -4.0
    g2, gb2 = np.full(FEATURES, 1e-6), 1e-6
    balance = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    for step in range(steps):
        value = np.bincount(owner, w[flat], len(vocab))
        z = np.clip(np.bincount(sent, value[word], len(doc)) + bias + prior, -30, 30)
        p = sigmoid(z)
        none = np.exp(np.bincount(doc, -np.logaddexp(0, z), len(y)))  # probability that no sentence is toxic
        any_ = np.maximum(1 - none, 1e-9)
        factor = np.where(y == 1, -none / any_, 1.0) * balance / len(y)
        dz = p * factor[doc]
        gw = np.bincount(word, dz[sent], len(vocab))
        grad = np.bincount(flat, gw[owner], FEATURES)
        gb = dz.sum()
        g2 += grad * grad
        gb2 += gb * gb
        # evidence only adds up: a harmless word cannot talk an offending one down
        w = np.maximum(w - 0.25 * grad / np.sqrt(g2) - SHRINK, 0)
        bias -= 0.25 * gb / np.sqrt(gb2)
    return Detector(w.astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, learn_from=None, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Detector:
    """Fit on about ``sample_docs`` labelled documents of each class, picked by a hash of the id.

    The sample is smaller if documents are so long that it would hold more than
    ``sample_chars`` characters; all lengths are drawn alike.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.filter(learn_from) if learn_from is not None else known
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not sizes:
        return fit([])
    mean = slim.agg(F.avg(F.coalesce(F.length("text"), F.lit(0)))).first()[0] or 0.0
    sample_docs = max(1, min(sample_docs, int(sample_chars / (len(sizes) * max(1.0, mean)))))
    limit = F.lit(0)
    for y, n in sizes.items():
        limit = F.when(F.col("toxic") == y, int(1_000_000 * min(1.0, sample_docs / n))).otherwise(limit)
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < limit).limit(4 * sample_docs)
    # at most 4 * sample_docs rows of two numbers: small enough to broadcast at any input size
    rows = slim.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text").distinct().limit(4 * sample_docs).collect()
    return fit([(int(r["toxic"] > 0), r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))])


def spans_of(text: str, scores: np.ndarray) -> list[dict]:
    """Character spans of the sentences whose score is at least one half."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    out, at, k = [], 0, 0
    for m in [*SENTENCE_ENDS.finditer(raw), None]:
        end = m.start() if m else len(raw)
        part = raw[at:end]
        if part.split():
            if scores[k] >= 0.5:
                a = len(raw[:at].decode("utf-8", "replace"))
                out.append({"start": a, "end": a + len(part.decode("utf-8", "replace")), "score": float(scores[k])})
            k += 1
        at = m.end() if m else end
    return out


def score(docs: DataFrame, detector: Detector, hold: tuple[int, int] = (5, 0)) -> DataFrame:
    """One row per document: score, prediction and the offending sentences."""
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    def run(cols):
        detect = shared.value
        out: tuple[list, ...] = tuple([] for _ in range(7))
        for doc, text in zip(*cols):
            s, p = detect(text)
            bad = int((p >= 0.5).sum())
            row = (doc, fold(doc, hold[0]) == hold[1], s, int(s >= 0.5), len(p), bad, spans_of(text, p) if bad and text else [])
            for c, v in zip(out, row):
                c.append(v)
        return out

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, hold: tuple[int, int] = (5, 0)) -> DataFrame:
    return score(docs, train(docs, labels, fold_col("doc_id", hold[0]) != hold[1]), hold)
