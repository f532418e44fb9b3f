"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of each word in both directions, gives every byte
position a distribution over the languages and is trained by backpropagation
through time in numpy on words of a bounded sample of the labelled documents of
each language, so that a rare language is learned at any input size. A
word's distribution is the geometric mean over its positions, a document's the
mean of its words' weighted by their positions, over the whole text. As the
state starts anew at each word, a word seen before is looked up, and only new
words run.

Edge cases: a null text or one without a letter is ``und`` with score 0; a null
lang is never learned from; a word longer than ``MAX_BYTES`` is read in pieces;
repeated rows are labelled each for itself; with nothing to learn from every
text is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgrisk.llm.common import fold, fold_col, map_rows, words

SAMPLE_DOCS = 750  # labelled documents of each language to learn from; all where there are fewer
SAMPLE_WORDS = 40  # words of each
HIDDEN = 16
MAX_BYTES = 24
STEPS = 320
BATCH = 384
SEED = 11
CACHE_WORDS = 400_000
HASHES = 1_000_000_000  # of which a language's share is drawn
PUNCTUATION = b".,;:!?\"'()[]{}*#$%&|<>-"
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_words long"


def _sig(x):
    return 1 / (1 + np.exp(-x))


class ByteGru:
    """Two gated recurrent units (forward, backward) and one output layer."""

    def __init__(self, langs: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        h, k = HIDDEN, len(langs)
        self.langs = langs
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (257, 3 * h)).astype(np.float32)  # by byte; 256 is padding
            self.p["u" + d] = rng.normal(0, 0.25, (h, 3 * h)).astype(np.float32)
        self.p["o"] = rng.normal(0, 0.3, (2 * h, k)).astype(np.float32)
        self.p["c"] = np.zeros(k, np.float32)

    def _run(self, x: np.ndarray, d: str):
        """States after each step, and what the backward pass needs. x: (steps, words)."""
        h, p = HIDDEN, self.p
        state = np.zeros((x.shape[1], h), np.float32)
        states, kept = [], []
        for t in range(len(x)):
            gx, gu = p["x" + d][x[t]], state @ p["u" + d]
            r, z = _sig(gx[:, :h] + gu[:, :h]), _sig(gx[:, h : 2 * h] + gu[:, h : 2 * h])
            n = np.tanh(gx[:, 2 * h :] + r * gu[:, 2 * h :])
            live = (x[t] < 256)[:, None]
            new = np.where(live, (1 - z) * n + z * state, state)
            kept.append((state, r, z, n, gu[:, 2 * h :], live))
            states.append(new)
            state = new
        return np.stack(states), kept

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities (steps, words, languages). x: bytes (steps, words), 256 after the end."""
        return self._forward(x)[0]

    def _forward(self, x: np.ndarray):
        f, kf = self._run(x, "f")
        b, kb = self._run(x[::-1], "b")
        h = np.concatenate([f, b[::-1]], axis=2)
        logit = h @ self.p["o"] + self.p["c"]
        logit -= logit.max(axis=2, keepdims=True)
        return logit - np.log(np.exp(logit).sum(axis=2, keepdims=True)), h, kf, kb

    def _back(self, x: np.ndarray, d: str, dh: np.ndarray, kept: list, grads: dict) -> None:
        """Backpropagation through time of one direction."""
        h, u = HIDDEN, self.p["u" + d]
        du, dx = np.zeros_like(u), np.zeros_like(self.p["x" + d])
        carry = np.zeros((x.shape[1], h), np.float32)
        for t in range(len(x) - 1, -1, -1):
            state, r, z, n, un, live = kept[t]
            g = (dh[t] + carry) * live
            dn = g * (1 - z) * (1 - n * n)
            dz = g * (state - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            gates = np.concatenate([dr, dz, dn * r], axis=1)
            du += state.T @ gates
            np.add.at(dx, x[t], np.concatenate([dr, dz, dn], axis=1))
            carry = g * z + gates @ u.T + (dh[t] + carry) * ~live
        grads["u" + d], grads["x" + d] = du, dx

    def loss_and_grads(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        logp, h, kf, kb = self._forward(x)
        live = x < 256
        n = live.sum()
        dlogit = np.exp(logp)
        dlogit[:, np.arange(len(y)), y] -= 1
        dlogit *= (live / n)[:, :, None]
        grads = {"o": np.einsum("twh,twk->hk", h, dlogit, optimize=True), "c": dlogit.sum(axis=(0, 1))}
        dh = dlogit @ self.p["o"].T
        self._back(x, "f", dh[:, :, :HIDDEN], kf, grads)
        self._back(x[::-1], "b", dh[::-1, :, HIDDEN:], kb, grads)
        loss = -float((logp[:, np.arange(len(y)), y] * live).sum() / n)
        return loss, grads

    def fit(self, xs: np.ndarray, ys: np.ndarray, steps: int = STEPS, seed: int = SEED) -> "ByteGru":
        """Adam on batches drawn with the same share of every language."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(ys == k) for k in range(len(self.langs))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(g, BATCH // len(groups) + 1) for g in groups])
            x = xs[pick]
            x = x[:, : int((x < 256).sum(axis=1).max())].T
            _, grads = self.loss_and_grads(x, ys[pick])
            rate = 0.02 * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


def byte_rows(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each word's pieces, 256 after the end, and the word each piece is of."""
    pieces, owner = [], []
    for i, w in enumerate(ws):
        for at in range(0, len(w), MAX_BYTES):
            pieces.append(w[at : at + MAX_BYTES])
            owner.append(i)
    rows = np.full((len(pieces), MAX_BYTES), 256, np.int16)
    for i, w in enumerate(pieces):
        rows[i, : len(w)] = np.frombuffer(w, np.uint8)
    return rows, np.array(owner, np.int64)


class Labeller:
    """Document labels, with a bounded table of words already read."""

    def __init__(self, net: ByteGru | None):
        self.net = net
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.table = np.zeros((1024, len(self.net.langs) if self.net else 1))
        self.n = 0

    def _learn(self, new: list[bytes]) -> None:
        bare = {w: w.strip(PUNCTUATION) for w in new}
        fresh = sorted({b for b in bare.values() if b not in self.index}, key=len)
        while self.n + len(fresh) + 1 > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for at in range(0, len(fresh), 2048):
            some = fresh[at : at + 2048]
            rows, owner = byte_rows(some)
            total, count = np.zeros((len(some), self.table.shape[1])), np.zeros(len(some))
            if len(rows):
                rows = rows[:, : int((rows < 256).sum(axis=1).max())].T
                live = rows < 256
                logp = (self.net.positions(rows) * live[:, :, None]).sum(axis=0)
                np.add.at(total, owner, logp)
                np.add.at(count, owner, live.sum(axis=0))
            q = np.exp(total / np.maximum(count, 1)[:, None])
            self.table[self.n : self.n + len(some)] = q / q.sum(axis=1, keepdims=True) * count[:, None]
            for w in some:
                self.index[w] = self.n
                self.n += 1
        for w, b in bare.items():
            self.index[w] = self.index[b]

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        if self.net is None:
            return [(UNKNOWN, 0.0, len(words(t))) for t in texts]
        split = [words(t) if t and LETTER.search(t) else [] for t in texts]
        if len(self.index) > CACHE_WORDS:
            self._clear()
        self._learn(list({w for ws in split for w in ws if w not in self.index}))
        index, out = self.index, []
        for text, ws in zip(texts, split):
            if not ws:
                out.append((UNKNOWN, 0.0, len(words(text))))
                continue
            pooled = self.table[np.fromiter((index[w] for w in ws), np.int64, len(ws))].sum(axis=0)
            k = int(pooled.argmax())
            out.append((self.net.langs[k], float(pooled[k] / max(pooled.sum(), 1e-9)), len(ws)))
        return out

    def label_positions(self, text: str) -> list[tuple[bytes, list[str]]]:
        """Each word of a text with the label of each of its bytes."""
        out = []
        for w in words(text):
            rows, _ = byte_rows([w])
            best = self.net.positions(rows.T).argmax(axis=2).T
            out.append((w, [self.net.langs[k] for row, r in zip(best, rows) for k in row[: int((r < 256).sum())]]))
        return out


def train(docs: DataFrame, learn_from=None, sample_docs: int = SAMPLE_DOCS) -> ByteGru | None:
    """Fit on words of about ``sample_docs`` documents of each language, picked by a hash of id and text.

    Equal rows count once, so what is collected stays near that number however often an id occurs.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = labelled.filter(learn_from) if learn_from is not None else labelled
    labelled = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    limits = F.create_map(*[F.lit(v) for k, n in sorted(sizes.items()) for v in (k, math.ceil(HASHES * min(1.0, sample_docs / n)))])
    picked = labelled.filter(F.pmod("h", F.lit(HASHES)) < F.element_at(limits, F.col("lang")))

    def sample(cols):
        out: tuple[list, list, list] = ([], [], [])
        for lang, text, h in zip(*cols):
            ws = [w.strip(PUNCTUATION)[:MAX_BYTES] for w in words(text)]
            ws = [w for w in ws if w]
            if ws:
                rng = np.random.default_rng([SEED, h % (1 << 64)])
                for column, value in zip(out, (lang, h, [ws[i] for i in rng.integers(0, len(ws), min(SAMPLE_WORDS, len(ws)))])):
                    column.append(value)
        return out

    rows = map_rows(picked, sample, "lang string, h long, ws array<binary>").groupBy("lang", "h").agg(F.first("ws").alias("ws")).collect()
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    pairs = sorted((r["lang"], bytes(w)) for r in rows for w in r["ws"])
    xs, _ = byte_rows([w for _, w in pairs])
    return ByteGru(langs).fit(xs, np.array([langs.index(l) for l, _ in pairs]))


def identify(docs: DataFrame, net: ByteGru | None, hold: tuple[int, int] = (4, 2)) -> DataFrame:
    """One row per document: whether it is held out, the label, its probability."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    made: list[Labeller] = []

    def run(cols):
        if not made:
            made.append(Labeller(shared.value))
        got = made[0](cols[1])
        return [cols[0], [fold(d, hold[0]) == hold[1] for d in cols[0]], *([g[i] for g in got] for i in range(3))]

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def language_id(docs: DataFrame, hold: tuple[int, int] = (4, 2)) -> DataFrame:
    return identify(docs, train(docs, fold_col("doc_id", hold[0]) != hold[1]), hold)
