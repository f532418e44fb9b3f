"""Benchmark decontamination with one Aho-Corasick automaton.

Every window of eight normalised words of a test item is a pattern, with a
space at each end so that it matches whole words only. Each document is
normalised the same way, scanned once, and the matches are mapped back to word
positions and, on request, to character spans of the original text.

A benchmark of up to ``max_block_chars`` characters (measured: 185 bytes of
automaton a character) is one automaton, built in each Python worker from a
broadcast of that size. A larger one is dealt by a hash of the item into blocks
of that size; each block is a scan of its own with one automaton alive, its
hits are written to the shared folder before the next block is read, and the
hits of a document are then united.

Edge cases: a null or word-less document has no words and no hits; a null or
word-less item is never found; an item of fewer than eight words is one window;
items that share a window are all counted; repeated rows are judged each for
itself; a document of any length is scanned whole, as one line; only the columns
named here are read, whatever others the tables have; empty tables give empty
results or no hits.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgrisk.llm.common import map_rows, materialise, slices

WINDOW = 8
MIN_ITEMS = 2
MAX_BLOCK_CHARS = 1_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_WORD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8: bytes of other characters separate them."""
    return (text or "").encode("utf-8", "surrogatepass").translate(ASCII_WORD).split()


def windows_of(items: list[tuple[object, str | None]], window: int = WINDOW) -> dict[str, tuple[int, list[str]]]:
    """Pattern -> (words in it, ids of the items that hold it, an id perhaps again if its rows are apart)."""
    out: dict[str, tuple[int, list[str]]] = {}
    for item, text in items:
        ws = normal_words(text)
        size = min(window, len(ws))
        for i in range(len(ws) - size + 1) if ws else ():
            key = " " + b" ".join(ws[i : i + size]).decode("utf-8", "replace") + " "
            held = out.setdefault(key, (size, []))[1]
            if not held or held[-1] != str(item):  # a window may be shared by very many items
                held.append(str(item))
    return out


def automaton(patterns: dict[str, tuple[int, list[str]]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for key, (size, held) in patterns.items():
        a.add_word(key, (len(key), size, held))
    if patterns:
        a.make_automaton()
    return a


class Scanner:
    """Scans texts with the automaton of one block of items."""

    def __init__(self, patterns: dict):
        self.some, self.automaton = len(patterns) > 0, automaton(patterns)

    def __call__(self, text: str | None) -> tuple[list[bytes], list[tuple[int, int]], list[str]]:
        """The words, the (first word, words) of each window found, and the items found."""
        ws = normal_words(text)
        if not (self.some and ws):
            return ws, [], []
        found: set[str] = set()
        ranges = set()
        for end, (length, size, held) in self.automaton.iter(" " + b" ".join(ws).decode("utf-8", "replace") + " "):
            found.update(held)
            ranges.add((end - length + 1, size))
        if not ranges:
            return ws, [], []
        # the space before word k of the scanned line
        leads = np.cumsum([0] + [len(w.decode("utf-8", "replace")) + 1 for w in ws[:-1]])
        return ws, [(int(np.searchsorted(leads, at)), size) for at, size in sorted(ranges)], sorted(found)


def hit_words(n: int, ranges: list[tuple[int, int]]) -> np.ndarray:
    """Which of ``n`` words lie in a window."""
    edge = np.zeros(n + 1, np.int64)
    for at, size in ranges:
        edge[at] += 1
        edge[at + size] -= 1
    return np.cumsum(edge[:-1]) > 0


def original_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as character spans of the original text."""
    lowered = text.translate({c: c + 32 for c in range(0x41, 0x5B)})
    spans: list[list[int]] = []
    last = -2
    for k, m in enumerate(WORD.finditer(lowered)):
        if hit[k]:
            if last == k - 1:
                spans[-1][1] = m.end()
            else:
                spans.append([m.start(), m.end()])
            last = k
    return [tuple(s) for s in spans]


def benchmark_blocks(benchmark: DataFrame, max_block_chars: int = MAX_BLOCK_CHARS) -> list[DataFrame]:
    """The items in blocks of about ``max_block_chars`` characters, dealt by a hash of the item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(chars) // max_block_chars))
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items for k in range(n)]


def patterns_of(block: DataFrame) -> bytes:
    """The windows of one block, for a broadcast; equal strings are stored once."""
    return pickle.dumps(windows_of([tuple(r) for r in block.toLocalIterator()]))


def united_hits(rows: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """(rid, found): the windows and items found in ``rows(rid, text)``, one block after the other."""
    sc = rows.sparkSession.sparkContext
    parts = []
    for block in blocks:
        shared = sc.broadcast(patterns_of(block))

        def scan(cols, shared=shared, made=[]):  # noqa: B006  one scanner per worker
            if not made:
                made.append(Scanner(pickle.loads(shared.value)))
            rids, found = [], []
            for rid, text in zip(*cols):
                _, ranges, items = made[0](text)
                if ranges:
                    rids.append(rid)
                    found.append({"at": [a for a, _ in ranges], "size": [k for _, k in ranges], "items": items})
            return rids, found

        parts.append(materialise(map_rows(rows.select("rid", "text"), scan, "rid long, found struct<at:array<int>,size:array<int>,items:array<string>>"), "hits"))
        shared.destroy()
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole.groupBy("rid").agg(F.collect_list("found").alias("found"))  # at most one row of each block


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, max_block_chars: int = MAX_BLOCK_CHARS) -> DataFrame:
    """One row per document: words, hits, items and the spans of hit passages."""

    def row_of(doc, text, ws, ranges, items):
        hit = hit_words(len(ws), ranges)
        spans = [{"start": a, "end": b} for a, b in original_spans(text, hit)] if ranges else []
        return doc, len(ws), int(hit.sum()), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), len(items) >= min_items, spans

    def columns(rows):
        rows = list(rows)
        return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(7)]

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = benchmark_blocks(benchmark, max_block_chars)
    if len(blocks) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(patterns_of(blocks[0]))
        made: list[Scanner] = []

        def run(cols):
            if not made:
                made.append(Scanner(pickle.loads(shared.value)))
            return columns(row_of(doc, text, *made[0](text)) for doc, text in zip(*cols))

        return map_rows(slim, run, SCHEMA)

    def unite(cols):
        def one(doc, text, found):
            found = found or []
            ranges = sorted({r for f in found for r in zip(f["at"], f["size"])})
            return row_of(doc, text, normal_words(text), ranges, sorted({i for f in found for i in f["items"]}))

        return columns(one(*r) for r in zip(*cols))

    # written once: row ids must not change between the scans
    rows = materialise(slim.withColumn("rid", F.monotonically_increasing_id()), "scanned")
    return map_rows(rows.join(united_hits(rows, blocks), "rid", "left").select("doc_id", "text", "found"), unite, SCHEMA)


def leaked(sizes: list[int], n_items: int, window: int = WINDOW, min_items: int = MIN_ITEMS) -> bool:
    """A passage of a whole window, or enough items too short for one."""
    return any(k >= window for k in sizes) or n_items >= min_items


def clean(docs: DataFrame, benchmark: DataFrame, max_block_chars: int = MAX_BLOCK_CHARS) -> DataFrame:
    """The documents without a passage of the benchmark, with all their columns.

    A document goes if it holds a whole window of some item, or ``MIN_ITEMS``
    items of fewer words: one short item may be an ordinary phrase.
    """
    import pyarrow as pa

    blocks = benchmark_blocks(benchmark, max_block_chars)
    if len(blocks) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(patterns_of(blocks[0]))
        at = docs.columns.index("text")

        def run(batches):
            scan = Scanner(pickle.loads(shared.value))
            for b in batches:
                for part in slices(b):
                    good = []
                    for text in part.column(at).cast(pa.string()).to_pylist():
                        _, ranges, items = scan(text)
                        good.append(not leaked([k for _, k in ranges], len(items)))
                    yield part.filter(pa.array(good, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    rid = f"rid_{uuid.uuid4().hex}"  # a name that no column of the documents has
    rows = materialise(docs.withColumn(rid, F.monotonically_increasing_id()), "scanned")
    found = united_hits(rows.select(F.col(rid).alias("rid"), F.col("text").cast("string").alias("text")), blocks)
    sizes = F.flatten(F.transform("found", lambda f: f["size"]))
    items = F.size(F.array_distinct(F.flatten(F.transform("found", lambda f: f["items"]))))
    bad = found.filter((F.array_max(sizes) >= WINDOW) | (items >= MIN_ITEMS)).select(F.col("rid").alias(rid))
    return rows.join(bad, rid, "left_anti").select(docs.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
p AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(8, len(ws)) AS size, unnest(range(1, len(ws) - least(8, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM p),
g AS (
  SELECT rid, i, size, array_to_string(ws[i:i + size - 1], ' ') AS g
  FROM (SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)),
h AS (SELECT g.rid, g.i, g.size, p.item_id FROM g JOIN p ON g.g = p.g AND g.size = p.size),
hit AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS k FROM h) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
