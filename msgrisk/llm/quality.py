"""Quality rules by repetition coverage.

Words of a document become small integers; a polynomial rolling hash over them
gives every n-gram of several lengths its hash in a few numpy operations. A
word is covered if some n-gram that holds it occurs twice or more, and the
coverage is the share of the words' characters that is covered. Repeated lines
are measured the same way. A document fails if a coverage passes its limit.

Edge cases: a null, empty or blank text has no words, zero counts and fails the
base rule; a text of fewer words than an n-gram has no such n-gram; repeated
rows are judged each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgrisk.llm.common import map_rows

#: Largest share of characters in words covered by duplicated n-grams, by n.
NGRAM_LIMITS = {5: 0.50, 8: 0.45, 12: 0.40}
#: Largest share of characters in lines equal to an earlier line.
LINE_LIMIT = 0.50
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, "
    + ", ".join(f"dup{n}_chars long" for n in NGRAM_LIMITS)
)


def covered(start_is_dup: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in an n-gram whose start is marked."""
    edge = np.zeros(words + 1, np.int64)
    edge[: len(start_is_dup)] += start_is_dup
    edge[n : n + len(start_is_dup)] -= start_is_dup
    return np.cumsum(edge[:words]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def rolling(values: np.ndarray, powers: np.ndarray, inverse: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every n-gram: prefix sums of value * BASE**i, shifted back to i = 0."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[: len(values)], dtype=np.uint64)])
    return (sums[n:] - sums[:-n]) * inverse[: len(values) - n + 1]


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base, np.uint64)]), dtype=np.uint64)


class Measure:
    """Measures documents one by one; keeps the tables of powers between them."""

    def __init__(self):
        self.size = 0
        self._grow(4096)

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = 2 * n
            self.powers = _powers(int(BASE), self.size)
            self.inverse = _powers(pow(int(BASE), -1, 2**64), self.size)

    def __call__(self, text: str | None) -> tuple:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        n = len(words)
        ids_of: dict[bytes, int] = {}
        ids = np.fromiter((ids_of.setdefault(w, len(ids_of)) for w in words), np.int64, n)
        chars_of = np.fromiter((len(w.decode("utf-8", "replace")) for w in ids_of), np.int64, len(ids_of))
        chars = chars_of[ids] if n else ids
        word_chars = int(chars.sum())
        n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))

        seen: set[bytes] = set()
        n_dup_lines = line_chars = dup_line_chars = 0
        for line in raw.split(b"\n"):
            if line and not line.isspace():
                long = len(line)
                line_chars += long
                if line in seen:
                    n_dup_lines += 1
                    dup_line_chars += long
                else:
                    seen.add(line)

        n_repeat = 0
        if n >= 3:
            v = len(ids_of)
            pair = ids[:-1] * v + ids[1:]
            if v >= 2_000_000:  # keep three ids exact in 64 bits
                pair = np.unique(pair, return_inverse=True)[1]
            n_repeat = int(covered(repeated(pair[:-1] * v + ids[2:]), 3, n).sum())

        self._grow(n + 1)
        values = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        values ^= values >> np.uint64(31)
        dup_chars = []
        for k in NGRAM_LIMITS:
            dup_chars.append(int(chars[covered(repeated(rolling(values, self.powers, self.inverse, k)), k, n)].sum()) if n > k else 0)

        base_failed = n < MIN_WORDS or 100 * n_repeat > 50 * n
        kept = not base_failed and all(c <= limit * word_chars for c, limit in zip(dup_chars, NGRAM_LIMITS.values())) and dup_line_chars <= LINE_LIMIT * line_chars
        return (n, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, kept, dup_line_chars, *dup_chars)


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: counts, coverages and the verdict."""

    def run(cols):
        measure = Measure()
        return [cols[0], *map(list, zip(*[measure(t) for t in cols[1]]))] if cols[0] else [[] for _ in range(9 + len(NGRAM_LIMITS))]

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns, in one pass over the text."""
    import pyarrow as pa

    def run(batches):
        measure = Measure()
        at = list(docs_columns).index("text")
        for b in batches:
            mask = pa.array([measure(t)[6] for t in b.column(at).to_pylist()], pa.bool_())
            yield b.filter(mask)

    docs_columns = docs.columns
    return docs.mapInArrow(run, docs.schema)


ORACLE_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
w AS (
  SELECT rid, i, ws[i] AS w, len(ws[i]) AS c, len(ws) AS n
  FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM base)),
cov AS (
  {coverage}),
cs AS (
  SELECT rid, k, sum(c) AS chars, count(*) AS nw FROM cov GROUP BY rid, k),
ln AS (
  SELECT rid, line, pos FROM (
    SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lc AS (
  SELECT rid, sum(strlen(line)) AS line_chars,
         sum(CASE WHEN rn > 1 THEN strlen(line) ELSE 0 END) AS dup_line_chars,
         count(*) FILTER (WHERE rn > 1) AS n_dup_lines
  FROM (SELECT rid, line, row_number() OVER (PARTITION BY rid, line ORDER BY pos) AS rn FROM ln) GROUP BY rid),
m AS (
  SELECT b.doc_id, len(b.ws) AS n_words,
         coalesce(wc.chars, 0) AS word_chars,
         len(b.text) - len(regexp_replace(b.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(lc.n_dup_lines, 0) AS n_dup_lines,
         coalesce(c3.nw, 0) AS n_repeat_words,
         coalesce(lc.line_chars, 0) AS line_chars, coalesce(lc.dup_line_chars, 0) AS dup_line_chars,
         {dup_columns}
  FROM base b LEFT JOIN lc USING (rid) LEFT JOIN (SELECT rid, sum(c) AS chars FROM w GROUP BY rid) wc USING (rid) LEFT JOIN cs c3 ON c3.rid = b.rid AND c3.k = 3 {dup_joins})
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < {min_words} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < {min_words} OR 100 * n_repeat_words > 50 * n_words) AND {verdict}
         AND dup_line_chars <= {line_limit} * line_chars AS kept,
       CAST(dup_line_chars AS BIGINT) AS dup_line_chars, {dup_casts}
FROM m
"""


def oracle_sql() -> str:
    """The same in DuckDB, with n-grams joined as text in place of hashes."""
    def cov(k: int) -> str:
        gram = " || ' ' || ".join(f"lead(w, {j}) OVER o" if j else "w" for j in range(k))
        return (
            f"SELECT rid, {k} AS k, c FROM (SELECT rid, i, c, max(d) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS hit "
            f"FROM (SELECT rid, i, c, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY rid, g) > 1 THEN 1 ELSE 0 END AS d "
            f"FROM (SELECT rid, i, c, {gram} AS g FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)))) WHERE hit = 1"
        )

    ks = list(NGRAM_LIMITS)
    return ORACLE_SQL.format(
        coverage=" UNION ALL ".join(cov(k) for k in (3, *ks)),
        dup_columns=", ".join(f"coalesce(c{k}.chars, 0) AS dup{k}_chars" for k in ks),
        dup_joins=" ".join(f"LEFT JOIN cs c{k} ON c{k}.rid = b.rid AND c{k}.k = {k}" for k in ks),
        verdict=" AND ".join(f"dup{k}_chars <= {v} * word_chars" for k, v in NGRAM_LIMITS.items()),
        dup_casts=", ".join(f"CAST(dup{k}_chars AS BIGINT) AS dup{k}_chars" for k in ks),
        min_words=MIN_WORDS, line_limit=LINE_LIMIT,
    )
