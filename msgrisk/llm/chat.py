"""Chat formatting: roles of transcript lines by a hidden Markov model.

A transcript is a conversation's text in ordered parts, each of one or more
lines. Hidden states are role and place: the first line of a turn or a later
one, for each of three roles. A line is observed as one code made of its
speaker marker (by family of marker, none being one), whether it is blank,
whether the line before it was, whether it asks, and its length class. Start,
transition and emission probabilities are smoothed counts over the labelled
conversations of the whole table; only the counts, of bounded size, reach the
driver. Viterbi finds the likeliest states; each run of lines is rendered as
``<|role|>\\n...`` with the markers removed and ``<|end|>\\n`` after each turn.

A conversation may be of any length and its parts may bear any numbers. Rows are
sorted over the cluster by conversation, part and text (and a hash of the row, so
that equal rows are spread as well) in ranges, and each range is cut into chunks
of at most ``CHUNK_ROWS`` rows of one conversation. A chunk is summed up as a
table of best scores from each entry to each exit state (max-plus products are
associative), one pass over these tables fixes the states at the chunk borders,
and the chunks are decoded independently. No task ever holds the lines of a whole
conversation; the pass over the tables holds seven small numbers a chunk.

Edge cases: a null text is one blank line; a null role is never learned from; a
null part counts as part -1, parts with equal numbers are ordered by text; all
rows with a null conv_id are one conversation; repeated rows are parts of their
own; a text of any length is one part, read whole; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from msgrisk.llm.common import map_rows, materialise

ROLES = ("system", "user", "assistant")
STATES = len(ROLES) * 2  # role * 2 + (0 first line of a turn, 1 later)
START = STATES
CHUNK_ROWS = 512
SMOOTH = 0.1

MARKERS = (
    ("system", re.compile(r"^\s*(?:<\|(?:im_start\|>)?\s*system\b(?:\|>)?|\[system\]|#+\s*system\b:?|system(?:\s+prompt)?\s*:|context\s*:|instructions?\s*:)\s*", re.IGNORECASE)),
    ("user", re.compile(r"^\s*(?:<\|(?:im_start\|>)?\s*user\b(?:\|>)?|\[user\]|#+\s*(?:user|human)\b:?|(?:user|human|q|customer|me)\s*:)\s*", re.IGNORECASE)),
    ("assistant", re.compile(r"^\s*(?:<\|(?:im_start\|>)?\s*assistant\b(?:\|>)?|\[assistant\]|#+\s*(?:assistant|bot)\b:?|(?:assistant|bot|ai|a|agent|model)\s*:)\s*", re.IGNORECASE)),
    ("name", re.compile(r"^\s*[A-Z][a-z]{1,14}\s?:\s*")),
)
CODES = 5 * 2 * 2 * 2 * 4

TURNS = "conv_id long, part long, seg int, role string, begins boolean, n_lines int, text string, rendered string, known_role string"


def observe(lines: list[str]) -> tuple[list[int], list[str]]:
    """Code and bare text of each line."""
    codes, bare = [], []
    was_blank = 0
    for line in lines:
        marker = 0
        rest = line
        for k, (_, pattern) in enumerate(MARKERS, 1):
            if m := pattern.match(line):
                marker, rest = k, line[m.end() :]
                break
        blank = int(not line.strip())
        asks = int(rest.rstrip().endswith("?"))
        size = len(rest)
        length = 0 if size < 40 else 1 if size < 160 else 2 if size < 480 else 3
        codes.append((((marker * 2 + blank) * 2 + was_blank) * 2 + asks) * 4 + length)
        bare.append(rest)
        was_blank = blank
    return codes, bare


def parts_of(transcripts: DataFrame) -> DataFrame:
    """Transcript parts with codes. Columns conv_id, part, text, and role where known."""
    role = F.col("role").cast("string") if "role" in transcripts.columns else F.lit(None).cast("string")
    rows = transcripts.select(F.col("conv_id").cast("long"), F.coalesce(F.col("part").cast("long"), F.lit(-1)).alias("part"), F.col("text").cast("string"), role.alias("role"))

    def run(cols):
        codes = [observe((t or "").split("\n"))[0] for t in cols[2]]
        return [*cols, codes]

    return map_rows(rows, run, "conv_id long, part long, text string, role string, codes array<int>")


class Hmm:
    """Log-probabilities: ``move`` from each state (or START) to each state, ``emit`` by state and code."""

    def __init__(self, move: np.ndarray, emit: np.ndarray):
        move = move + SMOOTH
        # the first line of a turn follows any line; a later line follows a line of the same role
        for i in range(STATES + 1):
            for j in range(STATES):
                if j % 2 and (i == START or i // 2 != j // 2):
                    move[i, j] = 0
        emit = emit + SMOOTH
        with np.errstate(divide="ignore"):
            self.move = np.log(move / move.sum(axis=1, keepdims=True))
            self.emit = np.log(emit / emit.sum(axis=1, keepdims=True))

    def table(self, codes: list[int]) -> np.ndarray:
        """Best score from each entry state (START included) to each exit state."""
        best = None
        for c in codes:
            step = self.move + self.emit[:, c]
            best = step if best is None else (best[:, :, None] + step[None, :STATES]).max(axis=1)
        return best

    def decode(self, codes: list[int], entry: int, leave: int | None = None) -> list[int]:
        """Viterbi path after ``entry``, to ``leave`` if given."""
        score = self.move[entry] + self.emit[:, codes[0]]
        back = []
        for c in codes[1:]:
            all_ = score[:, None] + self.move[:STATES]
            back.append(all_.argmax(axis=0))
            score = all_.max(axis=0) + self.emit[:, c]
        state = int(score.argmax()) if leave is None else leave
        path = [state]
        for b in reversed(back):
            state = int(b[state])
            path.append(state)
        return path[::-1]


def train(parts: DataFrame, learn_from=None) -> Hmm:
    """Counts over all labelled parts; the joins and sums are Spark's."""
    known = parts.filter(F.col("role").isin(*ROLES))
    known = known.filter(learn_from) if learn_from is not None else known
    lines = known.select("role", F.posexplode("codes").alias("at", "code")).groupBy("role", (F.col("at") > 0).cast("int").alias("later"), "code").agg(F.count("*").alias("n")).collect()
    slim = known.select("conv_id", "part", "role", F.size("codes").alias("k"))
    # neighbours meet by number, so a long conversation is spread over tasks
    after = slim.select("conv_id", (F.col("part") - 1).alias("part"), F.col("role").alias("next"))
    pairs = slim.join(after, ["conv_id", "part"]).groupBy("role", "next", (F.col("k") > 1).alias("long")).agg(F.count("*").alias("n")).collect()
    insides = slim.groupBy("role").agg(F.sum((F.col("k") > 1).cast("long")).alias("enter"), F.sum(F.greatest(F.col("k") - 2, F.lit(0))).alias("stay")).collect()
    firsts = slim.groupBy("conv_id").agg(F.min(F.struct("part", "role")).alias("m")).groupBy(F.col("m.role").alias("role")).agg(F.count("*").alias("n")).collect()
    move, emit = np.zeros((STATES + 1, STATES)), np.zeros((STATES, CODES))
    for r in lines:
        emit[ROLES.index(r["role"]) * 2 + r["later"], r["code"]] += r["n"]
    for r in pairs:
        move[ROLES.index(r["role"]) * 2 + int(r["long"]), ROLES.index(r["next"]) * 2] += r["n"]
    for r in insides:
        k = ROLES.index(r["role"]) * 2
        move[k, k + 1] += r["enter"]
        move[k + 1, k + 1] += r["stay"]
    for r in firsts:
        move[START, ROLES.index(r["role"]) * 2] += r["n"]
    return Hmm(move, emit)


def groups_of(batches, keys: int):
    """Runs of rows with equal first ``keys`` columns, as lists of rows; input is sorted by them."""
    at, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != at:
                if held:
                    yield at, held
                at, held = row[:keys], []
            held.append(row)
    if held:
        yield at, held


def render(path: list[int], bare: list[str], first: bool) -> list[tuple]:
    """(role, begins, lines, text, rendered) of each run of lines of one turn."""
    out = []
    for state, line in zip(path, bare):
        if state % 2 == 0 or not out or out[-1][0] != state // 2:
            out.append([state // 2, state % 2 == 0, [line]])
        else:
            out[-1][2].append(line)
    rows = []
    for k, (role, begins, lines) in enumerate(out):
        text = "\n".join(lines)
        head = ("" if first and k == 0 else "<|end|>\n") + f"<|{ROLES[role]}|>\n" if begins else "\n"
        rows.append((ROLES[role], begins, len(lines), text, head + text))
    return rows


def sorted_chunks(parts: DataFrame) -> DataFrame:
    """The parts in order, written once, with ``chunk`` and ``pos``: numbers that grow along each conversation."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("part"), F.col("text").asc_nulls_first(), F.col("salt")]
    salted = parts.withColumn("salt", F.rand(7))
    dealt = salted.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    schema = T.StructType([*dealt.schema.fields, T.StructField("chunk", T.LongType()), T.StructField("pos", T.IntegerType())])

    def cut(batches):
        from pyspark import TaskContext

        chunk, pos, last = (TaskContext.get().partitionId() << 33) - 1, CHUNK_ROWS, ()
        for b in batches:
            chunks, places = [], []
            for conv in b.column(0).to_pylist():
                if pos >= CHUNK_ROWS or last != (conv,):
                    chunk, pos, last = chunk + 1, 0, (conv,)
                chunks.append(chunk)
                places.append(pos)
                pos += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chunks, pa.int64()), pa.array(places, pa.int32())], names=schema.names)

    return materialise(dealt.mapInArrow(cut, schema), "chunks")


def format_chat(transcripts: DataFrame, learn_from=None) -> DataFrame:
    """One row per run of lines of a turn, in the order of conv_id, part, seg.

    A turn that goes on in the next part has ``begins`` false there. The
    ``rendered`` texts of a conversation, concatenated in order, with a last
    ``<|end|>\\n``, are its canonical form. ``known_role`` is the role the part
    came with; it takes no part in decoding.
    """
    spark = transcripts.sparkSession
    parts = materialise(parts_of(transcripts), "parts")
    model = spark.sparkContext.broadcast(train(parts, learn_from))
    rows = sorted_chunks(parts)

    def sum_up(batches):
        for (chunk,), group in groups_of(batches, 1):
            table = model.value.table([c for r in group for c in r[2]])
            yield pa.RecordBatch.from_arrays([pa.array([group[0][1]], pa.int64()), pa.array([chunk], pa.int64()), pa.array([table.ravel().tolist()], pa.list_(pa.float64()))], names=["conv_id", "chunk", "best"])

    def borders(batches):
        """Entry and exit state of each chunk; holds one small table per chunk of a conversation."""
        for _, group in groups_of(batches, 1):
            score = np.full(STATES + 1, -np.inf)
            score[START] = 0
            back = []
            for _, _, best in group:
                step = score[:, None] + np.array(best).reshape(STATES + 1, STATES)
                back.append(step.argmax(axis=0).astype(np.int8))
                score = np.append(step.max(axis=0), -np.inf)
            leave = [int(score[:STATES].argmax())]
            for b in reversed(back):
                leave.append(int(b[leave[-1]]))
            leave.reverse()  # entry of the first, then the exits
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in group], pa.int64()), pa.array(leave[:-1], pa.int32()), pa.array(leave[1:], pa.int32())], names=["chunk", "enter", "leave"])

    by_chunk = lambda df: df.repartition("chunk").sortWithinPartitions("chunk", "pos")
    tables = by_chunk(rows.select("chunk", "conv_id", "codes", "pos")).mapInArrow(sum_up, "conv_id long, chunk long, best array<double>")
    by_conv = tables.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "chunk")
    ends = materialise(by_conv.mapInArrow(borders, "chunk long, enter int, leave int"), "borders")
    joined = rows.join(ends, "chunk").select("chunk", "pos", "conv_id", "part", "text", "codes", "enter", "leave", "role")

    arrow = to_arrow_schema(T._parse_datatype_string(TURNS))

    def decode(batches):
        for _, group in groups_of(batches, 1):
            path = model.value.decode([c for r in group for c in r[5]], group[0][6], group[0][7])
            out, at, last, seg = [], 0, None, 0
            for r in group:
                k = len(r[5])
                seg = seg if r[3] == last else 0
                for row in render(path[at : at + k], observe((r[4] or "").split("\n"))[1], at == 0 and r[6] == START):
                    out.append((r[2], r[3], seg, *row, r[8]))
                    seg += 1
                at, last = at + k, r[3]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return by_chunk(joined).mapInArrow(decode, TURNS)


def transcripts_from(conversations: DataFrame) -> DataFrame:
    """Raw transcripts of the conversations table: each conversation in one of six styles.

    In the last style a turn may have no marker at all, only a blank line before it.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(6))
    role, text = F.col("role"), F.coalesce("text", F.lit(""))
    title = F.initcap(role)
    short = F.when(role == "user", "Q").when(role == "assistant", "A").otherwise("Context")
    human = F.when(role == "user", "Human").when(role == "assistant", "Bot").otherwise("System")
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) == 0
    raw = (
        F.when(style == 0, F.concat(title, F.lit(": "), text))
        .when(style == 1, F.concat(F.lit("### "), human, F.lit("\n"), text))
        .when(style == 2, F.concat(F.lit("["), role, F.lit("] "), text))
        .when(style == 3, F.concat(short, F.lit(": "), text))
        .when(style == 4, F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text))
        .otherwise(F.when(bare, F.concat(F.lit("\n"), text)).otherwise(F.concat(F.lit("\n"), human, F.lit(": "), text)))
    )
    return conversations.select("conv_id", F.col("turn").alias("part"), F.coalesce(raw, text).alias("text"), "role")
