"""Secret scan: fixed patterns, and a character convolutional network over every candidate.

The patterns give the base findings of three kinds (assign, access, hex). The
value of every base finding is a candidate, and so is every run of at least
``MIN_CANDIDATE`` characters of a key alphabet that holds letters and digits or
changes case within; of a run that base findings cover in part, each uncovered
rest of that kind is a candidate for itself. A small convolutional network over
the candidate and its context (numpy) scores all candidates of a slice of
documents at once. A candidate longer than ``BODY`` is read in overlapping
windows, to its end, and has the highest of their scores. Candidates over their
threshold are added as ``cnn``, unless they are base findings, which stay
whatever their score.

The network is trained by gradient descent on labelled findings: first on the
driver on findings made from a seed, with the kinds of secrets that no pattern
knows, as a start that all agree on; then over the cluster on all base findings
(secrets) and all long runs apart from them (harmless) of all documents, made
ones beside them. A quarter of the findings is held out of that. Scores are
calibrated by Platt scaling on all findings held out, and each family of
candidates (hex, alnum, mixed) has the highest threshold that keeps ``RECALL`` of
the held-out secrets; both are read off a histogram, so nothing grows on the driver.

Edge cases: a null text counts as empty and has no findings; findings at the
same start are ordered assign, access, hex, cnn; a text of any length is scanned
whole; repeated rows are scanned each for itself; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import copy
import hashlib
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgrisk.llm.common import map_rows, materialise, sigmoid

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{14,}")
CASE_CHANGES = re.compile("[a-z][A-Z].*[A-Z][a-z]|[A-Z]{2}.*[a-z].*[A-Z]")
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_CANDIDATE = 8, 16, 32, 14
CONTEXT = 96  # characters kept around a finding of a document
MADE = 6000  # made findings, and half as many deep ones
TASK_FINDINGS = 20_000  # of documents, that a task learns from at least
TRAIN_TASKS = 64
PASSES = 8  # at most, over few findings
BATCH, LATER_RATE = 48, 0.1
BLOCK = 16_384  # windows held at once
BINS, MAX_LOGIT = 64, 40  # of the histogram of held-out logits: bins in one unit, and where it ends

LEFT, BODY, RIGHT = 24, 40, 8  # characters of context, candidate, context
STRIDE = 10  # between the windows of a longer candidate: any 31 characters of it lie in one window
KEY_SHARE = 12  # characters of a key that make a window one of a secret
SYMBOLS = "+/_=-.:,;\"'<>()[]{}@#$%&*!? \n\t"
EMBED, FILTERS, WIDTH = 10, 24, 5
RECALL = 0.98
SEED = 20240
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_candidates long, found array<struct<kind:string,start:int,end:int,score:double>>"

_CODE = np.zeros(128, np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + SYMBOLS):
    _CODE[ord(_c)] = _i + 2
CODES = 2 + 62 + len(SYMBOLS)  # 0: nothing there, 1: any other character


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if any(len(w) >= MIN_HEX for w in text.split()):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of key-like runs."""
    if not any(len(w) >= MIN_CANDIDATE for w in text.split()):
        return []
    return [m.span() for m in CANDIDATE.finditer(text) if keyed(m.group())]


def uncovered(start: int, end: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What base findings (by start) leave of a candidate."""
    out = []
    for a, _, b in base:
        if start < min(a, end):
            out.append((start, min(a, end)))
        start = max(start, b)
    return [*out, (start, end)] if start < end else out


def keyed(value: str) -> bool:
    if len(value) < MIN_CANDIDATE or value.islower() and value.isalpha():
        return False
    return bool(re.search("[0-9]", value) and re.search("[A-Za-z]", value) or CASE_CHANGES.search(value))


def value_of(text: str, finding: tuple[int, int, int]) -> tuple[int, int]:
    """The span of a base finding's value."""
    start, kind, end = finding
    return (start + ASSIGN.match(text, start).start(2) - start, end) if kind == 0 else (start, end)


def family(value: str) -> int:
    return 0 if re.fullmatch("[0-9a-fA-F]+", value) else 1 if value.isalnum() else 2


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Character codes of the window around a part of at most BODY characters: context, part, context."""
    row = np.zeros(LEFT + BODY + RIGHT, np.uint8)
    left = text[max(0, start - LEFT) : start]
    body = text[start : min(end, start + BODY)]
    for at, part in ((LEFT - len(left), left), (LEFT, body), (LEFT + BODY, text[end : end + RIGHT])):
        for i, c in enumerate(part):
            row[at + i] = _CODE[ord(c)] if ord(c) < 128 else 1
    return row


def parts(start: int, end: int) -> list[tuple[int, int]]:
    """The windows of a candidate: itself, or overlapping stretches of BODY characters up to its end."""
    if end - start <= BODY:
        return [(start, end)]
    return [(a, a + BODY) for a in [*range(start, end - BODY, STRIDE), end - BODY]]


class CharCnn:
    """Embedding, one convolution, ReLU, maximum and mean over positions, logistic output."""

    def __init__(self, rng: np.random.Generator):
        self.e = rng.normal(0, 0.3, (CODES, EMBED)).astype(np.float32)
        self.w = rng.normal(0, 0.2, (WIDTH * (EMBED + 1), FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.a, self.d = 1.0, 0.0  # calibration: sigmoid(a * logit + d)
        self.limits = np.full(3, 0.5)

    def _windows(self, x: np.ndarray) -> np.ndarray:
        inside = np.zeros(x.shape + (1,), np.float32)
        inside[:, LEFT : LEFT + BODY] = 1
        h = np.concatenate([self.e[x], inside], axis=2)
        return np.lib.stride_tricks.sliding_window_view(h, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), x.shape[1] - WIDTH + 1, -1)

    def forward(self, x: np.ndarray):
        u = self._windows(x)
        z = np.maximum(u @ self.w + self.b, 0)
        top = z.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(z, top[:, None], 1)[:, 0], z.mean(axis=1)], axis=1)
        return u, z, top, pooled, pooled @ self.v + self.c

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> None:
        u, z, top, pooled, logit = self.forward(x)
        n, t, _ = z.shape
        g = ((sigmoid(logit) - y) / n).astype(np.float32)
        dpool = g[:, None] * self.v
        dz = np.repeat(dpool[:, None, FILTERS:] / t, t, axis=1)
        np.put_along_axis(dz, top[:, None], np.take_along_axis(dz, top[:, None], 1) + dpool[:, None, :FILTERS], 1)
        dz *= z > 0
        du = dz @ self.w.T
        self.v -= rate * (g @ pooled)
        self.c -= rate * g.sum()
        self.w -= rate * np.einsum("ntk,ntf->kf", u, dz, optimize=True)
        self.b -= rate * dz.sum(axis=(0, 1))
        du = du.reshape(n, t, WIDTH, EMBED + 1)[..., :EMBED]
        de = np.zeros((n, x.shape[1], EMBED), np.float32)
        for k in range(WIDTH):
            de[:, k : k + t] += du[:, :, k]
        np.subtract.at(self.e, x, rate * de)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 256])[4] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0, np.float32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * self.logits(x) + self.d)

    def best(self, spans: list[tuple[str, int, int]]) -> np.ndarray:
        """The highest score of each (text, start, end) over its windows."""
        return sigmoid(self.a * self.highest(spans) + self.d)

    def highest(self, spans: list[tuple[str, int, int]]) -> np.ndarray:
        """The highest logit of each (text, start, end) over its windows, encoded a block at a time."""
        out = np.full(len(spans), -np.inf)
        rows, owner = [], []

        def flush():
            if rows:
                np.maximum.at(out, owner, self.logits(np.stack(rows)))
                rows.clear(), owner.clear()

        for i, (text, start, end) in enumerate(spans):
            for a, b in parts(start, end):
                rows.append(encode(text, a, b)), owner.append(i)
                if len(rows) == 4096:
                    flush()
        flush()
        return out

    def parameters(self) -> list[np.ndarray]:
        return [self.e, self.w, self.b, self.v, self.c]


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, is a secret), half of each, made from a seed."""
    return [f[:4] for f in made_findings(n, seed)]


def deep_findings(n: int, seed: int) -> list[tuple[str, int, int, int, int, int]]:
    """(text, start, end, is a secret, key start, key end) of long runs of paths, slugs and pairs, half of them
    with a key anywhere in the run; made from a seed."""
    return made_findings(n, seed, deep=True)


def made_findings(n: int, seed: int, deep: bool = False) -> list[tuple[str, int, int, int, int, int]]:
    rng = np.random.default_rng(seed)
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def draw(alphabet: str, k: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))

    syllables = "th in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()

    def word(a: int = 1, b: int = 5) -> str:
        return "".join(syllables[i] for i in rng.integers(0, len(syllables), rng.integers(a, b)))

    def prose(k: int) -> str:
        return " ".join(word() for _ in range(k))

    def secret() -> str:
        kind, k = rng.integers(0, 5), int(rng.integers(18, 44))
        if kind == 0:
            return draw("0123456789abcdef", k)
        if kind == 1:
            return draw(lower + upper + digit, k)
        if kind == 2:
            return draw(lower + upper + digit + "+/_-", k) + "=" * int(rng.integers(0, 3))
        if kind == 3:
            return word(1, 3) + "_" + (word(1, 2) + "_" if rng.random() < 0.5 else "") + draw(lower + upper + digit, k)
        return draw(upper + digit, k)

    def harmless() -> str:
        kind = rng.integers(0, 7)
        if kind == 0:
            return word(6, 10) + draw(digit, int(rng.integers(1, 5)))
        if kind == 1:
            return "-".join(word(1, 4) for _ in range(rng.integers(3, 6))) + "-" + draw(digit, 2)
        if kind == 2:
            return "_".join(word(1, 4) for _ in range(rng.integers(3, 6))) + draw(digit, int(rng.integers(1, 4)))
        if kind == 3:
            return f"{rng.integers(1990, 2040)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{draw(digit, 6)}Z-" + word(1, 3)
        if kind == 4:
            return "/".join(word(1, 4) for _ in range(rng.integers(3, 7))) + "/" + draw(digit, int(rng.integers(1, 4)))
        if kind == 5:
            return draw(digit, int(rng.integers(12, 18))) + word(1, 3)
        return "=".join([word(3, 6), word(3, 6)]) + draw(digit, 2)

    def spoken() -> str:
        if rng.random() < 0.5:
            return word(1, 5)
        pairs = rng.integers(0, (20, 5), (int(rng.integers(1, 5)), 2))
        return "".join("bcdfghjklmnpqrstvwyz"[c] + "aeiou"[v] for c, v in pairs) + ("" if rng.random() < 0.5 else "nrstlkpdy"[rng.integers(0, 9)])

    def stretch(least: int) -> str:
        out, own = "", "/_-="[rng.integers(0, 4)]
        while len(out) < least:
            kind, mark = rng.integers(0, 6), own if rng.random() < 0.7 else "/_-="[rng.integers(0, 4)]
            if kind == 0:
                piece = spoken() + draw(digit, int(rng.integers(1, 5)))
            elif kind == 1:
                piece = f"{rng.integers(1990, 2040)}{mark}{rng.integers(1, 13):02}{mark}{rng.integers(1, 29):02}"
            else:
                piece = mark.join(spoken() for _ in range(rng.integers(1, 4)))
            out += (piece.capitalize() if rng.random() < 0.1 else piece) + (own if rng.random() < 0.7 else "/_-="[rng.integers(0, 4)])
        return out

    lead = ["", "key ", "access key: ", "auth=", "credential ", "Bearer ", "export KEY=", "client-id "]
    plain = ["", "see ", "file ", "page ", "on ", "id ", "chapter ", "in "]
    out = []
    for i in range(n):
        y = i % 2
        if deep:
            before = stretch(int(rng.integers(8, 130)))
            key = secret() if y else ""
            after = stretch(int(rng.integers(4, 60)))[:-1] if not y or rng.random() < 0.3 else ""
            if y and not (re.search("[0-9]", key) and re.search("[A-Za-z]", key)):
                key += "7a"
            value = before + key + ("/" if key and after else "") + (after if y else after + draw(digit, 2))
            head = prose(int(rng.integers(1, 5))) + " "
            at = len(head) + len(before)
            out.append((f"{head}{value} {prose(2)}", len(head), len(head) + len(value), y, at, at + len(key)))
            continue
        value = secret() if y else harmless()
        if not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):
            value += "7a"
        value = value if len(value) >= MIN_CANDIDATE else value + (draw(lower + digit, 16) if y else word(8, 10))
        pick = lead if rng.random() < (0.5 if y else 0.1) else plain
        head = prose(int(rng.integers(1, 5))) + " " + pick[rng.integers(0, len(pick))]
        out.append((f"{head}{value} {prose(2)}", len(head), len(head) + len(value), y, len(head), len(head) + len(value)))
    return out


def labelled_windows(data: list[tuple[str, int, int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows to learn from and whether each shows a key; those with only a little of one are left out."""
    x, y = [], []
    for text, start, end, secret, a, b in data:
        for s, e in parts(start, end):
            shown = (min(e, b) - max(s, a)) * secret
            if shown <= 0 or shown >= min(KEY_SHARE, b - a):
                x.append(encode(text, s, e)), y.append(shown > 0)
    return np.stack(x), np.array(y, np.float32)


def document_findings(docs: DataFrame) -> DataFrame:
    """Findings of all documents, a row each, with a bounded stretch of text around it.

    Values of base findings are secrets, long runs that touch none are not. A
    quarter, by hash, is held out.
    """
    h = F.xxhash64("doc_id", "text")

    def run(cols):
        out: list[tuple] = []
        for h, text in zip(*cols):
            text = text or ""
            base = base_findings(text)
            found = [(*value_of(text, f), 1) for f in base]
            runs = [m.span() for m in CANDIDATE.finditer(text)]
            found += [(a, b, 0) for a, b in runs if uncovered(a, b, base) == [(a, b)]]
            for a, b, y in found:
                left = max(0, a - CONTEXT)
                out.append((h, a, text[left : b + CONTEXT], a - left, b - left, y))
        return [list(c) for c in zip(*out)] if out else [[] for _ in range(6)]

    found = map_rows(docs.select(h.alias("h"), F.col("text").cast("string").alias("text")), run, "h long, place int, t string, a int, b int, y int")
    return found.withColumn("held", F.pmod(F.xxhash64("h", "place", "b"), F.lit(4)) == 0)


def finding_windows(batches):
    """(windows, whether of a secret) of rows of :func:`document_findings`, a block at a time."""
    x, y = [], []
    for batch in batches:
        for t, a, b, secret in zip(*(batch.column(c).to_pylist() for c in ("t", "a", "b", "y"))):
            for s, e in parts(a, b):
                x.append(encode(t, s, e)), y.append(secret)
                if len(x) == BLOCK:
                    yield np.stack(x), np.array(y, np.float32)
                    x, y = [], []
    if x:
        yield np.stack(x), np.array(y, np.float32)


def made_parts(n: int = MADE, seed: int = SEED) -> tuple[list, list]:
    """Made findings to learn from, and those held out."""
    plain, deep = made_findings(n, seed), deep_findings(n // 2, seed + 1)
    return plain[: n * 3 // 4] + deep[: n * 3 // 8], plain[n * 3 // 4 :] + deep[n * 3 // 8 :]


def fit(epochs: int = 8, seed: int = SEED) -> CharCnn:
    """The network, from made findings."""
    rng = np.random.default_rng(seed)
    x, y = labelled_windows(made_parts()[0])
    net = CharCnn(rng)
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            net.step(x[order[i : i + BATCH]], y[order[i : i + BATCH]], 0.6 * 0.8**epoch)
    return net


def learn(net: CharCnn, found: DataFrame, n: int) -> None:
    """A pass over all ``n`` findings (rows of :func:`document_findings`), in each step as many made ones beside them.

    Each task begins with the same network; parameters are then averaged by the
    windows learned from. Tasks, and so the result, depend on the findings alone.
    """
    passes = max(1, min(PASSES, TASK_FINDINGS // n))
    tasks = max(1, min(TRAIN_TASKS, n // TASK_FINDINGS))
    shared = found.sparkSession.sparkContext.broadcast((net, *labelled_windows(made_parts()[0])))

    def run(batches):
        from pyspark import TaskContext

        start, made_x, made_y = shared.value
        own, learned = copy.deepcopy(start), 0
        rng = np.random.default_rng(SEED + TaskContext.get().partitionId())
        for x, y in finding_windows(batches):
            for _ in range(passes):
                order = rng.permutation(len(x))
                for i in range(0, len(x), BATCH // 2):
                    part = order[i : i + BATCH // 2]
                    beside = rng.integers(0, len(made_x), BATCH // 2)
                    own.step(np.concatenate([x[part], made_x[beside]]), np.concatenate([y[part], made_y[beside]]), LATER_RATE)
            learned += len(x)
        if learned:
            vals = np.concatenate([p.ravel() for p in own.parameters()]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([learned]), pa.array([vals.tobytes()], pa.binary())], names=["task", "n", "vals"])

    dealt = found.repartition(tasks, "h", "place").sortWithinPartitions("h", "place", "b", "y")
    rows = sorted(dealt.mapInArrow(run, "task long, n long, vals binary").collect(), key=lambda r: r["task"])
    weight = np.array([r["n"] for r in rows], float)
    mean = weight @ np.stack([np.frombuffer(r["vals"], np.float32) for r in rows]).astype(float) / weight.sum()
    at = 0
    for p in net.parameters():
        p[...] = mean[at : at + p.size].reshape(p.shape)
        at += p.size


def histogram(net: CharCnn, held: DataFrame) -> list[tuple[int, int, int]]:
    """(key, bin, n) over all held-out findings: logits of windows by class (key 0, 1), and the
    highest logit of each secret by family (key 2 to 4)."""
    shared = held.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net, seen = shared.value, Counter()
        for batch in batches:
            for x, y in finding_windows([batch]):
                seen.update(zip(y.astype(int).tolist(), binned(net.logits(x))))
            rows = zip(*(batch.column(c).to_pylist() for c in ("t", "a", "b", "y")))
            good = [(t, a, b) for t, a, b, secret in rows if secret]
            seen.update(zip((2 + family(t[a:b]) for t, a, b in good), binned(net.highest(good))))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen]), pa.array([b for _, b in seen]), pa.array(list(seen.values()))], names=["key", "bin", "n"])

    out = held.mapInArrow(run, "key long, bin long, n long").groupBy("key", "bin").agg(F.sum("n").alias("n")).collect()
    return sorted((r["key"], r["bin"], r["n"]) for r in out)


def binned(logit: np.ndarray) -> list[int]:
    return np.floor(np.clip(logit, -MAX_LOGIT, MAX_LOGIT) * BINS).astype(int).tolist()


def calibrate(net: CharCnn, counts: list[tuple[int, int, int]]) -> CharCnn:
    """Platt scaling and thresholds from held-out made findings and the histogram of those of documents.

    Findings of documents weigh at most as much as the made ones together.
    """
    made = made_parts()[1]
    x, y = labelled_windows(made)
    rows = np.array(counts, float).reshape(-1, 3)

    def joined(values, own):
        """Values and weights of made findings and of documents' ones, these at the lower edge of their bin."""
        w = own[:, 2] * min(1.0, len(values) / max(1.0, own[:, 2].sum()))
        return np.concatenate([values, own[:, 1] / BINS]), np.concatenate([np.ones(len(values)), w])

    own = rows[rows[:, 0] < 2]
    logit, weight = joined(net.logits(x).astype(float), own)
    y = np.concatenate([y, own[:, 0]])
    weight /= weight.sum()
    net.a, net.d = 1.0, 0.0
    for _ in range(500):  # Platt scaling
        p = sigmoid(net.a * logit + net.d)
        net.a -= 0.5 * float(weight @ ((p - y) * logit)) / max(1.0, float(weight @ logit**2))
        net.d -= 0.5 * float(weight @ (p - y))
    best = net.highest([f[:3] for f in made]).astype(float)
    y = np.array([f[3] for f in made])
    kinds = np.array([family(t[a:b]) for t, a, b, *_ in made])
    for k in range(3):
        good, weight = joined(best[(y == 1) & (kinds == k)], rows[rows[:, 0] == 2 + k])
        if len(good):
            order = np.argsort(good)
            upto = np.cumsum(weight[order])
            net.limits[k] = sigmoid(net.a * good[order[np.searchsorted(upto, (1 - RECALL) * upto[-1], side="right")]] + net.d)
    return net


@lru_cache(maxsize=1)
def trained() -> CharCnn:
    """From made findings alone; the same on every call."""
    return calibrate(fit(), [])


def train(docs: DataFrame) -> CharCnn:
    """From made findings and all findings of the documents."""
    net = copy.deepcopy(trained())
    found = materialise(document_findings(docs), "findings")
    n = {r["held"]: r["n"] for r in found.groupBy("held").agg(F.count("*").alias("n")).collect()}
    if n.get(False):
        learn(net, found.filter(~F.col("held")), n[False])
    return calibrate(net, histogram(net, found.filter("held")))


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(texts: list[str | None], net: CharCnn) -> list[tuple[list, list, int, dict]]:
    """Per text: base findings, all findings, candidates, score by (start, kind, end)."""
    spans, base, owners = [], [], []
    counts, scored = [0] * len(texts), [{} for _ in texts]
    for i, text in enumerate(texts):
        text = text or ""
        base.append(base_findings(text))
        for f in base[i]:
            spans.append((text, *value_of(text, f)))
            owners.append((i, f, None))
        counts[i] += len(base[i])
        for start, end in candidates(text):
            for a, b in uncovered(start, end, base[i]):
                if keyed(text[a:b]):
                    counts[i] += 1
                    spans.append((text, a, b))
                    owners.append((i, (a, 3, b), family(text[a:b])))
    score = net.best(spans)
    extra: list[list] = [[] for _ in texts]
    for (i, span, kind), s in zip(owners, score):
        scored[i][span] = float(s)
        if kind is not None and s >= net.limits[kind]:
            extra[i].append(span)
    return [(f, sorted(f + x), n, s) for f, x, n, s in zip(base, extra, counts, scored)]


def scan(docs: DataFrame, net: CharCnn | None = None) -> DataFrame:
    """One row per document with its findings."""
    shared = docs.sparkSession.sparkContext.broadcast(net or train(docs))

    def run(cols):
        out: tuple[list, ...] = tuple([] for _ in range(8))
        for doc, (base, spans, n, score) in zip(cols[0], find(cols[1], shared.value)):
            kinds = [k for _, k, _ in base]
            row = (
                doc, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans), n,
                [{"kind": KINDS[k], "start": a, "end": b, "score": score[a, k, b]} for a, k, b in spans],
            )
            for c, v in zip(out, row):
                c.append(v)
        return out

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each finding replaced by its kind; touching findings are replaced once."""
    if not spans:
        return text
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """All documents with their columns, secrets replaced in the text."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    at = docs.columns.index("text")
    has_count = "n_chars" in docs.columns

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            new = []
            for i in range(0, len(texts), 512):
                part = texts[i : i + 512]
                new += [redacted(t, found[1]) for t, found in zip(part, find(part, shared.value))]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if has_count else out
