"""SimHash near-duplicates with pivot distance tables.

Fingerprints: 64 bits voted by the XXH64 of three-word shingles. Equal
fingerprints are one class. Every class gets its Hamming distances to
``PIVOTS`` reference fingerprints once. Classes that can be within ``RADIUS``
bits agree on one of three bit blocks. By the triangle inequality two linked
classes differ by at most ``RADIUS`` in every pivot coordinate, so a block of
more than ``GROUP`` members is dealt by its next coordinate into overlapping
cells (``CELL`` wide, repeated ``RADIUS`` before each border), over the cluster
and again and again until groups are small or the pivots are used up. Within a
group members are sorted by one coordinate, pairs whose coordinates differ by
more than ``RADIUS`` anywhere are discarded, and the survivors are verified bit
by bit, a stretch of members at a time. A group gives at most a spanning forest
of its links, never all pairs.

Groups that no pivot takes apart hold fingerprints of one narrow ball. They are
linked exactly in linear work: two fingerprints are within two bits if and only
if they share a string at distance one or less, so each member meets the others
at itself and its 64 one-bit neighbours, and one neighbour has at most 65.

Edge cases: a null or word-less text has fingerprint zero and links like any
other; a text of one or two words is one shingle; a text of any length is read
whole; repeated rows share their fingerprint; a null doc_id takes part but never
names a component unless all its documents lack one (then null); ids that occur
with several texts are rows of their own; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgrisk.llm.common import map_rows, materialise, words
from msgrisk.llm.graph import components

SHINGLE = 3
SEED = 42
RADIUS = 2
BLOCK_BITS = ((0, 21), (21, 21), (42, 22))  # RADIUS + 1 blocks: one is equal within RADIUS bits
PIVOTS = 16
PIVOT_SEED = 7
GROUP = 4096  # members compared in one task; larger groups are dealt into cells by the next pivot
CELL = 6  # width of a cell in distances
STRETCH = 2_000_000  # candidate pairs held at once
ONE = np.uint64(1)
BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def pivots() -> np.ndarray:
    return np.random.default_rng(PIVOT_SEED).integers(0, 2**64, PIVOTS, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash, unsigned."""
    from xxhash import xxh64_intdigest

    ws = words(text)
    n = len(ws)
    if not n:
        return 0
    line = b" ".join(ws)
    if n <= SHINGLE:
        hashes = [xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, n) + 1) - 1
        starts = [0, *(ends[: n - SHINGLE] + 1).tolist()]
        hashes = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())]
    lanes = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    votes = np.concatenate([np.bincount(lanes[:, i], minlength=256) @ BIT_OF_BYTE for i in range(8)])
    return int(np.bitwise_or.reduce((2 * votes > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)))


def fingerprints(docs: DataFrame, more: dict | None = None) -> DataFrame:
    """(doc_id, fp) and the columns of ``more`` (longs): the fingerprint as a signed long."""
    more = more or {}

    def run(cols):
        return cols[0], np.array([fingerprint(t) for t in cols[1]], np.uint64).view(np.int64), *cols[2:]

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(c.alias(n) for n, c in more.items()))
    return map_rows(slim, run, "doc_id long, fp long" + "".join(f", {n} long" for n in more))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members that are not the least of their component, and that least member."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(n))
    return rest, label[rest]


def pivot_pairs(fp: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among the members of a group."""
    n = len(fp)
    order = np.argsort(table[:, 0], kind="stable")
    t, f = table[order].astype(np.int16), fp[order]
    # sorted by the first coordinate: candidates of a member are a range after it
    stop = np.searchsorted(t[:, 0], t[:, 0] + RADIUS, side="right")
    count = stop - np.arange(1, n + 1)
    upto = np.cumsum(count)
    found_i, found_j, a = [], [], 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + STRETCH, side="right")))
        own = count[a:b]
        i = np.repeat(np.arange(a, b), own)
        j = np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + i + 1
        for k in range(1, PIVOTS):
            keep = np.abs(t[i, k] - t[j, k]) <= RADIUS
            i, j = i[keep], j[keep]
        near = np.bitwise_count(f[i] ^ f[j]) <= RADIUS
        found_i.append(order[i[near]])
        found_j.append(order[j[near]])
        a = b
    return (np.concatenate(found_i), np.concatenate(found_j)) if n else (np.zeros(0, int), np.zeros(0, int))


def block_links(fp: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, j = pivot_pairs(fp, table)
    a, b = forest(len(fp), i, j)
    return fp[a], fp[b]


def mixed(group: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """A 64-bit name for the cell of a group."""
    with np.errstate(over="ignore"):
        x = (group.view(np.uint64) ^ (cell.astype(np.uint64) + ONE)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def distances(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ pivots()).astype(np.uint8)


KEYED = "grp long, fp long"


def keyed_blocks(classes: DataFrame) -> DataFrame:
    """Each class under the name of each of its bit blocks; a clash of names only adds candidates."""

    def keys(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for k, (shift, bits) in enumerate(BLOCK_BITS):
                block = (fp >> np.uint64(shift)) & np.uint64(2**bits - 1)
                yield pa.RecordBatch.from_arrays([pa.array(mixed(block.view(np.int64), np.full(len(fp), k))), b.column(0)], names=["grp", "fp"])

    return classes.select("fp").mapInArrow(keys, KEYED)


def dealt_cells(members: DataFrame, level: int) -> DataFrame:
    """Members of large groups under the names of their cells of pivot ``level``, and of the next cell near a border."""

    def deal(batches):
        for b in batches:
            grp, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = np.bitwise_count(fp.view(np.uint64) ^ pivots()[level]).astype(np.int64)
            near = at % CELL >= CELL - RADIUS
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([mixed(grp, at // CELL), mixed(grp[near], at[near] // CELL + 1)])), pa.array(np.concatenate([fp, fp[near]]))], names=["grp", "fp"]
            )

    return members.mapInArrow(deal, KEYED)


def compared(groups: DataFrame) -> DataFrame:
    """(u, v) forest edges of each group of at most GROUP members."""
    edge = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(batches):
        held: list[np.ndarray] = []
        at = None

        def flush():
            if held and sum(map(len, held)) > 1:
                fp = np.unique(np.concatenate(held)).view(np.uint64)
                u, v = block_links(fp, distances(fp))
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=edge)

        for b in batches:
            grp, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero(grp[1:] != grp[:-1]) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
                if s < e:
                    if grp[s] != at:
                        yield from flush()
                        held, at = [], grp[s]
                    held.append(fp[s:e])
        yield from flush()

    return groups.repartition("grp").sortWithinPartitions("grp").mapInArrow(compare, "u long, v long")


def neighbour_links(members: DataFrame) -> DataFrame:
    """(u, v) edges of groups that pivots leave whole, through shared one-bit neighbours."""
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(int(np.uint64(1 << b).view(np.int64)))) for b in range(64)])
    met = members.select("fp").distinct().select("fp", F.explode(flips).alias("key")).groupBy("key").agg(F.collect_set("fp").alias("m")).filter(F.size("m") > 1)
    return met.select(F.array_min("m").alias("u"), F.explode("m").alias("v")).filter("u <> v")


def links(classes: DataFrame) -> DataFrame:
    """(u, v) edges that connect exactly the classes reachable within RADIUS bits."""
    now, found = keyed_blocks(classes), []
    for level in range(PIVOTS + 1):
        now = materialise(now, "groups")
        large = materialise(now.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select("grp"), "large")
        if large.isEmpty():
            found.append(compared(now))
            break
        found.append(compared(now.join(large, "grp", "left_anti")))
        rest = now.join(large, "grp", "left_semi")
        if level == PIVOTS:
            found.append(neighbour_links(rest))
        else:
            now = dealt_cells(rest, level)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def components_of(fps: DataFrame) -> DataFrame:
    """Adds ``root``, a fingerprint that names the component, to rows with ``fp``."""
    classes = materialise(fps.select("fp").distinct(), "classes")
    roots = components(links(classes)).withColumnRenamed("vertex", "fp")  # classes with a link only
    return fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprint (signed long) and component."""
    fps = materialise(fingerprints(docs), "fingerprints")
    classes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    roots = components(links(classes)).withColumnRenamed("vertex", "fp")
    member = classes.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = member.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


MARKS_BROADCAST = 2_000_000  # rows of three numbers; more are joined by a shuffle


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component stays: that of the smallest doc_id (null last), then of the smallest key.

    A row's key is two hashes of its id and text, so rows that share an id but
    not a text are told apart, and only keys, fingerprints and ids are shuffled.
    Texts stay where they lie: the keys of rows that go are filtered out of the
    documents, by broadcast while their number is under ``MARKS_BROADCAST``.
    Kept rows that are repeated to the letter are the only ones to be shuffled.
    """
    tag = uuid.uuid4().hex  # names that no column of the documents has
    k1, k2, what = f"k1_{tag}", f"k2_{tag}", f"what_{tag}"
    one, two = F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(SEED), "text", "doc_id")
    fps = materialise(fingerprints(docs, {"k1": one, "k2": two}), "fingerprints")
    rows = components_of(fps).groupBy("root", "doc_id", "k1", "k2").agg(F.count("*").alias("n"))
    rows = materialise(rows, "rows")
    rank = F.struct(F.col("doc_id").isNull().alias("b"), "doc_id", "k1", "k2")
    best = rows.groupBy("root").agg(F.min(rank).alias("m")).select("root", F.col("m.k1").alias("w1"), F.col("m.k2").alias("w2"))
    wins = (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))
    marks = rows.join(best, "root").select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.when(~wins, 0).when(F.col("n") > 1, 1).alias(what)).filter(F.col(what).isNotNull())
    marks = materialise(marks, "marks")
    sizes = {r[0]: r[1] for r in marks.groupBy(what).count().collect()}
    if sum(sizes.values()) <= MARKS_BROADCAST:
        marks = F.broadcast(marks)
    marked = docs.withColumn(k1, one).withColumn(k2, two).join(marks, [k1, k2], "left")
    out = marked.filter(F.col(what).isNull()).select(docs.columns)
    if sizes.get(1):
        out = out.union(marked.filter(F.col(what) == 1).dropDuplicates([k1, k2]).select(docs.columns))
    return out
