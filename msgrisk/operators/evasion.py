"""Evasion simulator: six ways to obscure a message, picked by a hash of seed and row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
LEET = ("aeios", "43105")
HOMOGLYPHS = ("aeopcyxi", "аеорсухі")
# End of fixed values.
WIDE_FROM = " " + "".join(chr(c) for c in range(0x21, 0x7F))
WIDE_TO = "　" + "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
DUPLICATE_RATE, INVISIBLE_RATE = 0.05, 0.08


def chance(seed: int, *parts: Column) -> Column:
    """A number in 0..1 that depends on seed and parts alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1_000_003)) / F.lit(1_000_003.0)


def _letters(text: Column, key: Column, seed: int, rate: float, add) -> Column:
    chars = F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike(r"\p{L}") & (chance(seed, key, i) < rate), add(c)).otherwise(c))
    return F.array_join(chars, "")


def leet(text: Column, key: Column, seed: int = 0) -> Column:
    return _letters(F.translate(text, *LEET), key, seed, DUPLICATE_RATE, lambda c: F.concat(c, c))


def homoglyph(text: Column) -> Column:
    return F.translate(text, *HOMOGLYPHS)


def fullwidth(text: Column) -> Column:
    return F.translate(text, WIDE_FROM, WIDE_TO)


def zero_width(text: Column, key: Column, seed: int = 0) -> Column:
    return _letters(text, key, seed, INVISIBLE_RATE, lambda c: F.concat(c, F.lit("​")))


def defang(text: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(r"https?://\S+|(?s:.)"), F.lit(0))
    one = lambda p: F.when(p.rlike("^https?://."), F.replace(F.regexp_replace(p, "^http(s?)://", "hxxp$1://"), F.lit("."), F.lit("[.]"))).otherwise(p)
    return F.array_join(F.transform(pieces, one), "")


def space_out(text: Column, key: Column, seed: int = 0) -> Column:
    """Sets the letters of one word of four or more apart, at its first place."""
    found = F.regexp_extract_all(text, F.lit("[A-Za-z]{4,}"), F.lit(0))
    word = F.try_element_at(found, (F.floor(chance(seed, key) * F.size(found)) + 1).cast("int"))
    at = F.when(F.size(found) > 0, F.regexp_instr(text, F.concat(F.lit(r"\b"), word, F.lit(r"\b"))))
    spaced = F.concat(F.substring(text, F.lit(1), at - 1), F.regexp_replace(word, "(?<=.)(?=.)", " "), F.substring(text, at + F.length(word), F.length(text)))
    return F.when(at > 0, spaced).otherwise(text)


def obfuscate(df: DataFrame, text: str, key: str, seed: int = 42) -> DataFrame:
    """Adds ``technique`` (0..5) and ``obscured``."""
    t, k = F.col(text), F.col(key)
    pick = F.pmod(F.xxhash64(F.lit(seed), k), F.lit(6))
    ways = [leet(t, k, seed), homoglyph(t), fullwidth(t), zero_width(t, k, seed), defang(t), space_out(t, k, seed)]
    out = F.when(pick == 0, ways[0])
    for i, w in enumerate(ways[1:], 1):
        out = out.when(pick == i, w)
    return df.withColumn("technique", pick.cast("int")).withColumn("obscured", out)


def augment(df: DataFrame, text: str, key: str, label: str, rate: float = 0.15, seed: int = 42) -> DataFrame:
    """The rows and obscured copies of a share of the fraud rows, with their label and group.

    The exact share is met: the cut is the rank of a hash, found by its quantile count.
    """
    fraud = df.filter(F.col(label) != "legit")
    n = int(fraud.count() * rate)
    chosen = fraud.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
    copies = obfuscate(chosen, text, key, seed).withColumn(text, F.col("obscured")).drop("technique", "obscured")
    return df.unionByName(copies)
