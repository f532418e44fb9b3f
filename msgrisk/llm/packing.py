"""Best-fit packing by a configuration linear program over the length histogram.

The histogram (at most ``capacity`` rows, whatever the input size) goes to the
driver. A configuration is a multiset of lengths that fit in one sequence; the
program covers every length as often as it occurs with the fewest sequences.

* Multiplicative weights: a length's price is its size times a weight that
  falls exponentially with its coverage. An unbounded knapsack by dynamic
  programming prices all configurations at once; the round takes, for each
  length, a configuration that holds it and is filled by lengths drawn by their
  supply as long as the knapsack's table says that the best value (almost) stays
  in reach, and adds a fractional amount of it, the more the more valuable it
  is. The prices over the best value are a feasible dual solution, so each round
  gives a lower bound. A phase of ``ROUNDS`` rounds ends with amounts that use
  nothing more often than it occurs; the next phase works on what is left
  uncovered, until the fractional value is within ``GAP`` of the bound.
* Rounding: amounts are rounded down, and then up, largest fractions first,
  while all pieces of a configuration are there. Only configurations that the
  dual prices call (nearly) tight are used. The program is solved again for what
  rounding leaves, until that places next to nothing.
* What is left then is packed by best fit on the histogram.

The plan is joined to the pieces by their rank within their length.

Edge cases: a null or empty text is one piece holding only the end id; a text
longer than ``capacity`` is cut into full pieces and a rest, whatever its
length; repeated rows are packed each for itself, and equal rows without an id
too; other columns are not read; an empty table gives an empty result; a null
doc_id is kept.
"""

from __future__ import annotations

import logging
import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgrisk.llm.common import map_rows, materialise
from msgrisk.llm.tokens import codec, vocabulary_path

CAPACITY = 2048
END_ID = 0
ROUNDS = 24  # of multiplicative weights in a phase
PHASES, MORE_PHASES = 10, 3  # at most, each on what the phases before it leave uncovered; after the first rounding
GAP = 0.01  # between the fractional value and the dual bound at which phases end
DECAY = 2.0  # exponent of a length's weight by the share covered
STEP = 0.05  # most of a length's occurrences covered in a round
TEMPERATURE = 0.05  # slack at which a configuration gets 1/e of the share of the best
DRAWS, LOSS = 4, 0.0005  # draws of a filling's next length; value a draw may cost
TIGHT = 0.004  # slack of a configuration at the dual prices for it to be used
BIG_FIRST = 1.07  # power of the size in the first prices: large pieces first among equally full configurations
STAGES = 5  # solutions and roundings, at most
SEED = 11
RANK_GROUP = 20_000  # pieces of one length ranked together

LOG = logging.getLogger(__name__)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids as little-endian uint32."""
    n = len(ids) // 4
    out = []
    for k, start in enumerate(range(0, n, capacity)):
        part = ids[4 * start : 4 * min(n, start + capacity)]
        out.append((k, start, len(part) // 4, zlib.crc32(part)))
    return out


def document_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    path = tokenizer_path or vocabulary_path()
    end = END_ID.to_bytes(4, "little")

    def run(cols):
        ids, texts = cols
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc, raw in zip(ids, codec(path).encode(texts)):
            for piece in cut_pieces(raw + end, capacity):
                for column, value in zip(out, (doc, *piece)):
                    column.append(value)
        return out

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECES, rows=2048)


@dataclass
class Solution:
    """A plan and what it is known to be worth."""

    plan: list[tuple[dict[int, int], int]]  # (configuration, sequences)
    lower_bound: float  # dual bound of the linear program: no packing has fewer sequences
    fractional: float  # value of the fractional solution
    rounds: int = 0
    from_program: int = 0  # sequences of rounded configurations
    from_best_fit: int = 0
    full: int = 0  # pieces that fill a sequence alone
    stages: list[tuple[int, int]] = field(default_factory=list)  # sequences rounded, pieces left

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.plan)


def price_configurations(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value of every room, and the length taken first for it (0: none).

    ``price[l]`` is the price of length ``l``, minus infinity where there is none.
    """
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        value = price[1 : room + 1] + best[room - 1 :: -1]
        # the longest of equals: position 0 of the reversed values is the whole room
        k = room - int(value[::-1].argmax())
        if value[k - 1] > best[room - 1] + 1e-12:
            best[room], take[room] = value[k - 1], k
        else:
            best[room], take[room] = best[room - 1], 0 if room == 1 else -1  # as the room one less
    return best, take


def fillings(price: np.ndarray, best: np.ndarray, take: np.ndarray, supply: np.ndarray, first: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For each length of ``first``: it and a filling of the rest, a row of lengths (0: none), longest first.

    At each step a length is drawn by its supply and taken if the knapsack's
    table says that the rest can still be filled to (almost) the best value;
    otherwise, after ``DRAWS`` draws, the table's own choice is taken. So equally
    good configurations are mixed as the supply asks for.
    """
    capacity = len(best) - 1
    drawn = np.cumsum(supply)  # by length
    room, out = capacity - first, [first]
    while True:
        t = take[room]
        while (t < 0).any():
            room = np.where(t < 0, room - 1, room)
            t = take[room]
        if not t.any():
            break
        open_ = t > 0
        for _ in range(DRAWS):
            try_ = np.searchsorted(drawn, rng.random(len(room)) * drawn[room], side="right")
            try_ = np.minimum(try_, room)
            good = open_ & (supply[try_] > 0) & (price[try_] + best[room - try_] >= best[room] - LOSS * best[capacity])
            t = np.where(good, try_, t)
            open_ &= ~good
        out.append(t)
        room = room - t
    return np.sort(np.stack(out, axis=1), axis=1)[:, ::-1]


class Program:
    """The fractional program over one histogram."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int):
        self.lengths, self.n, self.capacity = lengths, counts.astype(float), capacity
        self.at = np.full(capacity + 1, len(lengths))  # the last place stands for no length
        self.at[lengths] = np.arange(len(lengths))
        self.rng = np.random.default_rng(SEED)
        self.amount: dict[tuple, float] = {}
        self.rest = self.n.copy()  # not covered yet
        self.prices, self.value, self.rounds = lengths / capacity, math.inf, 0
        self.bound = float(self.n @ self.prices)  # by size, the first dual solution

    def per_length(self, which: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.bincount(which.ravel(), np.repeat(x, which.shape[1]), len(self.lengths) + 1)[:-1]

    def phase(self, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Multiplicative weights on what is not covered: configurations (rows) and their amounts."""
        n = np.maximum(self.rest, 1e-12)
        base = self.prices * (self.lengths / self.capacity) ** (BIG_FIRST - 1)
        pressure = np.zeros(len(n))  # share of a length covered in this phase: what prices answer to
        supply = np.zeros(self.capacity + 1)
        supply[self.lengths] = self.rest
        price = np.full(self.capacity + 1, -np.inf)
        rows, amounts = [], []
        for k in range(rounds):
            y = base * np.exp(-DECAY * (pressure - pressure.min()))
            price[self.lengths] = y
            best, take = price_configurations(price, self.capacity)
            self.rounds += 1
            if self.n @ y / best[self.capacity] > self.bound:
                self.bound, self.prices = float(self.n @ y / best[self.capacity]), y / best[self.capacity]
            filled = fillings(price, best, take, supply, self.lengths, self.rng)
            which = self.at[filled]
            slack = 1 - np.append(y, 0.0)[which].sum(axis=1) / best[self.capacity]
            # no length is covered by more than STEP, and no configuration is held back by lengths that are
            # not its own; the more valuable a configuration is, the more of it
            crowd = np.append(self.per_length(which, n) / n, 0.0)[which].max(axis=1)
            x = n * STEP / crowd * np.exp(-slack / TEMPERATURE)
            pressure += self.per_length(which, x) / n
            if 2 * k >= rounds:  # those at early prices are forgotten
                rows.append(filled)
                amounts.append(x)
        width = max(r.shape[1] for r in rows)
        return np.concatenate([np.pad(r, ((0, 0), (0, width - r.shape[1]))) for r in rows]), np.concatenate(amounts)

    def solve(self, rounds: int = ROUNDS, phases: int = PHASES, gap: float = GAP) -> "Program":
        """Phases until the fractional value is within ``gap`` of the bound.

        Each phase adds amounts of tight configurations that cover nothing more
        than it occurs; the value counts the rest at what this phase's own
        configurations need to cover it.
        """
        for _ in range(phases):
            rows, x = self.phase(rounds)
            which = self.at[rows]
            tight = np.append(self.prices, 0.0)[which].sum(axis=1) >= 1 - TIGHT
            held = sum(self.amount.values())
            level = self.per_length(which, x) / np.maximum(self.rest, 1e-12)
            completion = float((x / np.append(level, np.inf)[which].min(axis=1)).sum())
            self.value = min(self.value, held + completion)
            rows, which, x = rows[tight], which[tight], x[tight]
            if len(x):
                level = self.per_length(which, x) / np.maximum(self.rest, 1e-12)
                x = x / np.append(level, 0.0)[which].max(axis=1)
                self.rest = np.maximum(self.rest - self.per_length(which, x), 0.0)
                for row, k, v in zip(rows.tolist(), (rows > 0).sum(axis=1).tolist(), x.tolist()):
                    key = tuple(row[:k])
                    self.amount[key] = self.amount.get(key, 0.0) + v
            # what is left, each length by itself
            alone = float((self.rest / (self.capacity // self.lengths)).sum())
            self.value = min(self.value, sum(self.amount.values()) + alone)
            if self.value <= self.bound * (1 + gap):
                break
        return self


def rounded(amount: dict[tuple, float], left: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Whole sequences: amounts rounded down, then up, largest fractions first, while supplies last.

    ``left`` is the supply by length; what is used is taken from it.
    """
    plan: dict[tuple, int] = {}
    counts = {c: [(l, c.count(l)) for l in dict.fromkeys(c)] for c in amount}

    def use(c: tuple, times: int) -> None:
        for l, k in counts[c]:
            left[l] -= k * times
        plan[c] = plan.get(c, 0) + times

    for c, x in amount.items():
        times = min(int(x + 1e-9), min(int(left[l]) // k for l, k in counts[c]))
        if times > 0:
            use(c, times)
    for c, x in sorted(amount.items(), key=lambda p: (int(p[1]) - p[1], p[0])):
        if all(left[l] >= k for l, k in counts[c]):
            use(c, 1)
    return [(dict(counts[c]), n) for c, n in plan.items()]


def best_fit(lengths: list[int], supply: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing on a histogram; equal sequences stay one entry."""
    by_room: dict[int, dict[tuple, int]] = {}
    for l in sorted(lengths, reverse=True):
        left = supply.get(l, 0)
        while left:
            room = min((r for r in by_room if r >= l), default=None)
            if room is None:
                per = min(capacity // l, left)
                whole = left // per
                by_room.setdefault(capacity - per * l, {}).setdefault(((l, per),), 0)
                by_room[capacity - per * l][((l, per),)] += whole
                left -= whole * per
                continue
            pattern, n = by_room[room].popitem()
            if not by_room[room]:
                del by_room[room]
            per = min(room // l, left)
            use = min(n, left // per)
            if n > use:
                by_room.setdefault(room, {})[pattern] = by_room.get(room, {}).get(pattern, 0) + n - use
            key = (*pattern, (l, per))
            rest = by_room.setdefault(room - per * l, {})
            rest[key] = rest.get(key, 0) + use
            left -= use * per
    return [(dict(p), n) for group in by_room.values() for p, n in group.items()]


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, gap: float = GAP) -> Solution:
    """A plan that uses each length exactly as often as it occurs, with the bound of the linear program."""
    full = histogram.get(capacity, 0)
    plan: list[tuple[dict[int, int], int]] = [({capacity: 1}, full)] if full else []
    left = np.zeros(capacity + 1, np.int64)
    for l, n in histogram.items():
        if 0 < l < capacity:
            left[l] = n
    out = Solution(plan, float(full), float(full), full=full)
    for stage in range(STAGES):
        lengths = np.flatnonzero(left)
        if not len(lengths):
            break
        program = Program(lengths, left[lengths], capacity).solve(rounds, MORE_PHASES if stage else PHASES, gap)
        if stage == 0:
            out.lower_bound, out.fractional = full + program.bound, full + program.value
        out.rounds += program.rounds
        whole = rounded(program.amount, left)
        out.stages.append((sum(n for _, n in whole), int(left.sum())))
        out.from_program += out.stages[-1][0]
        plan += whole
        if out.stages[-1][0] < 0.01 * out.from_program:
            break
    rest = best_fit(np.flatnonzero(left).tolist(), {int(l): int(left[l]) for l in np.flatnonzero(left)}, capacity)
    out.from_best_fit = sum(n for _, n in rest)
    plan += rest
    return out


def slots(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, per sequence, first sequence, first offset), by length and rank."""
    rows, sequence, rank = [], 0, {}
    for pattern, times in plan:
        at = 0
        for l, per in pattern.items():
            rows.append((l, rank.get(l, 0), per, sequence, at))
            rank[l] = rank.get(l, 0) + per * times
            at += l * per
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the ``rank``-th piece of a length."""
    big = int(max(table[:, 1].max(initial=0), rank.max(initial=0))) + 1
    row = table[np.searchsorted(table[:, 0] * big + table[:, 1], length * big + rank, side="right") - 1]
    nth = rank - row[:, 1]
    return row[:, 3] + nth // row[:, 2], row[:, 4] + nth % row[:, 2] * length


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """Adds ``rank``: the piece's place among those of its length, from 0.

    Pieces of one length are dealt into groups by a hash of the row, ranked there,
    and the groups' sizes give each group's first rank, so a length that holds a
    third of all pieces is ranked by many tasks, equal rows included.
    """
    groups = max(16, math.ceil(total / RANK_GROUP))
    keyed = pieces.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
    sizes = keyed.groupBy("length", "grp").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "grp").orderBy("row")
    return (
        keyed.withColumn("nth", F.row_number().over(within) - 1)
        .join(sizes, ["length", "grp"])
        .withColumn("rank", F.col("base") + F.col("nth"))
        .drop("grp", "nth", "base", "row")
    )


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece with its sequence and offset; see the module's text."""
    pieces = materialise(document_pieces(docs, tokenizer_path, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    solution = solve(histogram, capacity, rounds)
    LOG.info("%d sequences, bound %.1f, fractional %.1f, %d from the program, %d from best fit, %d full", solution.sequences, solution.lower_bound, solution.fractional, solution.from_program, solution.from_best_fit, solution.full)
    table = pieces.sparkSession.sparkContext.broadcast(slots(solution.plan))

    def run(batches):
        for b in batches:
            cols = {n: b.column(n) for n in b.schema.names}
            length, rank = cols["length"].to_numpy(), cols["rank"].to_numpy()
            sequence, offset = place(table.value, length, rank)
            yield pa.RecordBatch.from_arrays(
                [cols["doc_id"], cols["piece"], cols["start"], cols["length"], cols["ids_crc32"], pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked(pieces, sum(histogram.values())).mapInArrow(run, f"{PIECES}, sequence_id long, offset long")
