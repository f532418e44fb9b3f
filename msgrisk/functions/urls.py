"""Links and hosts as column expressions.

A suffix set is a parameter. The default is built by rule: the generic suffixes
below, the two-letter country codes the Java runtime knows, and compounds of a
second-level label with a country code. A file of suffixes, one to a line, may
be given instead; the pattern then stays one alternation of its single labels
and membership of compounds is an array lookup.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from msgrisk.functions import lexicons as L

GENERIC = "com net org info biz edu gov mil int name pro mobi app dev xyz top site online store shop club help link live click work icu vip me io co tv cc ly gle".split()
SECOND = "co com net org gov ac edu or ne go gob mil".split()
EXTRA_COUNTRIES = "uk eu ac su".split()
MAX_LINES = 50_000
# Fixed value: the shape of a host's label.
LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
# End of fixed values.


@dataclass(frozen=True)
class Suffixes:
    single: tuple[str, ...]
    compound: tuple[str, ...]
    labels: tuple[str, ...] = field(default=())

    @staticmethod
    def of(names: list[str]) -> "Suffixes":
        names = sorted({n.strip().lower().lstrip(".") for n in names if n.strip() and not n.startswith("//")})
        single = tuple(n for n in names if "." not in n)
        return Suffixes(single, tuple(n for n in names if n.count(".") == 1), tuple(sorted({l for n in names for l in n.split(".")})))

    @staticmethod
    def default(spark: SparkSession) -> "Suffixes":
        codes = {c.lower() for c in spark._jvm.java.util.Locale.getISOCountries()} | set(EXTRA_COUNTRIES)
        return Suffixes.of([*GENERIC, *codes, *(f"{s}.{c}" for s in SECOND for c in sorted(codes))])

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Suffixes":
        lines = [r["value"] for r in spark.read.text(path).limit(MAX_LINES + 1).collect()]
        if len(lines) > MAX_LINES:
            raise ValueError(f"a list of suffixes of more than {MAX_LINES} lines")
        return Suffixes.of(lines)


def bare_domain(s: Suffixes) -> str:
    # a compound ends in a single suffix that is listed too, so single labels suffice for the match;
    # compounds whose last label is no suffix of its own are added
    ends = [*s.single, *(c for c in s.compound if c.split(".")[1] not in s.single)]
    return rf"(?<![\w.@-])(?:{LABEL}\.)+(?:{'|'.join(L.quoted(e) for e in sorted(ends, key=lambda e: -len(e)))})(?![a-zA-Z0-9-])(?:/\S*)?"


def url_pattern(s: Suffixes) -> str:
    return rf"(?iu)https?://\S+|www\.\S+|{bare_domain(s)}"


def hosts(text: Column, s: Suffixes) -> Column:
    """Hosts of all links, in order, with repeats.

    A name without a scheme that itself begins with ``http`` has no host, as
    published; an address in an unclosed bracket has none either.
    """

    def host(u: Column) -> Column:
        low = F.lower(u)
        rest = F.when(low.startswith("http"), F.regexp_extract(low, "^https?://(.*)$", 1)).otherwise(low)
        place = F.regexp_extract(rest, r"^([^/?#]*)", 1)
        place = F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":.*$", "")
        name = F.regexp_replace(F.regexp_replace(F.when(place.contains("["), "").otherwise(place), r"^www\.", ""), r"\.+$", "")
        return name

    found = F.regexp_extract_all(text, F.lit(url_pattern(s)), F.lit(0))
    return F.filter(F.transform(found, host), lambda h: h != "")


def official(host: Column) -> Column:
    exact = "|".join(L.quoted(d) for d in L.OFFICIAL_DOMAINS)
    ends = "|".join(L.quoted(d) for d in L.OFFICIAL_SUFFIXES)
    return host.rlike(rf"(?:^|\.)(?:{exact})$|(?:{ends})$")


def deceptive(host: Column, s: Suffixes) -> Column:
    """A suffix label stands in the middle of the host, before the registrable name."""
    parts = F.split(host, r"\.")
    last_two = F.concat_ws(".", F.slice(parts, -2, 2))
    tail = F.when((F.size(parts) >= 2) & last_two.isin(list(s.compound)), 2).otherwise(1)
    inner = F.slice(parts, 1, F.greatest(F.size(parts) - tail - 1, F.lit(0)))
    return F.exists(inner, lambda l: l.isin(list(s.labels)))
