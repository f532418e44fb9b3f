"""Canonical text: fold what hides a message's words from patterns but not from readers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The fold table, the invisible characters, the defanged forms and the vocabulary.
CONFUSABLE_FROM = "аеорсухіѕһԁᴏɡⅼАЕОРСУХІЅНВМКТοαρεντι‐‑‒–—‛’“”"
CONFUSABLE_TO = "aeopcyxishdoglAEOPCYXISHBMKToapevti-----''\"\""
INVISIBLE = "[\u200B-\u200F\u2060\uFEFF\u00AD\u180E]"
DEFANGED = [
    (r"(?i)\bh(?:xx|\*\*|__)p(s?)\s*:\s*//", "http$1://"),
    (r"\[\s*\.\s*\]|\(\s*\.\s*\)|\{\s*\.\s*\}", "."),
    (r"(?i)\s+(?:dot|d0t)\s+", "."),
    (r"\[\s*:\s*\]|\(\s*:\s*\)", ":"),
    (r"\[\s*/\s*\]", "/"),
]
FOLDABLE = r"[^\x00-\x7F]|[\[({]|//|\s[dD][oO0][tT]\s"
LEET_FROM, LEET_TO = "013457$@", "oleastsa"
LEET_WORDS = """
ecocash onemoney netone econet telecel zipit innbucks steward stewardbank zimra potraz zesa mukuru cbz nostro
account accounts password passcode pin otp code login logon signin verify verification validate confirm confirmed authenticate
secure security help support service customer care blocked block suspend suspended locked lock deactivate deactivated
unlock unblock reactivate activate restore reset update upgrade balance wallet transfer transaction reversal reverse refund
claim prize winner won win bonus promo reward voucher urgent immediately expire expires expiring final warning alert notice
card bank cash money airtime bundle token units agent parcel delivery courier customs fee charge payment
""".split()
# End of fixed values.

_ONE = r"(?<=(?<![A-Za-z])[A-Za-z])"
SPACED = rf"(?<=(?<![A-Za-z])[A-Za-z][ \t][A-Za-z])[ \t](?=[A-Za-z](?![A-Za-z]))|{_ONE}[ \t](?=[A-Za-z][ \t][A-Za-z](?![A-Za-z]))"


@F.pandas_udf(StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatible(text: Column) -> Column:
    """Unicode compatibility composition; only texts beyond ASCII are sent to Python."""
    return F.coalesce(_compatible(F.when(text.rlike("[^\\x00-\\x7F]"), text)), text)


def fold(text: Column) -> Column:
    """Drop invisible characters, fold lookalikes, undo defanged links."""
    out = F.translate(F.regexp_replace(text, INVISIBLE, ""), CONFUSABLE_FROM, CONFUSABLE_TO)
    for pattern, to in DEFANGED:
        out = F.regexp_replace(out, pattern, to)
    # without any of these no step changes a text
    return F.when(text.rlike(FOLDABLE), out).otherwise(text)


def deleet(text: Column) -> Column:
    """Replace digits and signs by letters in tokens that then are in the vocabulary."""

    def token(t: Column) -> Column:
        plain = F.translate(t, LEET_FROM, LEET_TO)
        return F.when((F.length(t) >= 3) & t.rlike("[0-9@$]") & F.lower(plain).isin(LEET_WORDS), plain).otherwise(t)

    pieces = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9@$]+|[^A-Za-z0-9@$]+"), F.lit(0)), token)
    # the interpreted branch runs for texts with a mixed token only
    return F.when(text.rlike("[A-Za-z][0-9@$]|[0-9@$][A-Za-z]"), F.array_join(pieces, "")).otherwise(text)


def unspace(text: Column) -> Column:
    """Join runs of three or more single letters set apart by single blanks."""
    return F.regexp_replace(text, SPACED, "")


def canonical(text: Column) -> Column:
    return unspace(deleet(fold(compatible(text))))
