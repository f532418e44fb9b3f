"""Import flow: first of equal texts, anti-join with what is there, label mapping, checks, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgrisk.functions.lexicons import SOURCE_TYPES


def read_import(spark: SparkSession, path: str) -> DataFrame:
    """(pos, text, sms_type) of a Parquet file with ``sms_text`` and ``smishing_type``; pos follows the file's order."""
    raw = spark.read.parquet(path)
    return raw.select(F.monotonically_increasing_id().alias("pos"), F.col("sms_text").alias("text"), F.col("smishing_type").alias("sms_type"))


def first_of_each(df: DataFrame, key: str, position: str) -> DataFrame:
    """The first row of each key by position; the minimum is combined before the shuffle."""
    rest = [c for c in df.columns if c not in (key, position)]
    best = df.groupBy(key).agg(F.min(F.struct(position, *rest)).alias("_b"))
    return best.select(key, "_b.*").select(df.columns)


def unmapped(df: DataFrame, kind: str, mapping: dict[str, str] = SOURCE_TYPES) -> DataFrame:
    """Distinct types that no label is known for; a null type is one."""
    return df.select(kind).distinct().filter(F.col(kind).isNull() | ~F.col(kind).isin(list(mapping)))


def with_label(df: DataFrame, kind: str, mapping: dict[str, str] = SOURCE_TYPES) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for p in mapping.items() for x in p])
    return df.withColumn("label", F.try_element_at(pairs, F.col(kind)))


def new_rows(df: DataFrame, existing: DataFrame, text: str) -> DataFrame:
    return df.join(existing.select(F.col(text)).distinct(), text, "left_anti")


def import_messages(raw: DataFrame, existing: DataFrame, position: str, source: str = "import") -> DataFrame:
    """Rows to append; raises ValueError if a type has no label."""
    bad = [r[0] for r in unmapped(raw, "sms_type").limit(20).collect()]
    if bad:
        raise ValueError(f"types without a label: {bad}")
    rows = new_rows(first_of_each(raw, "text", position), existing, "text")
    return with_label(rows, "sms_type").select("text", "label", F.lit(source).alias("source"))


def label_counts(df: DataFrame, key: str = "label") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def group_split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Adds ``part``: whole groups go to a part by a hash of their key; the last part takes the rest.

    A hash needs no count of groups, no shuffle and no join, and a group's part
    does not change when other groups come.
    """
    at = F.conv(F.substring(F.md5(F.concat(F.col(key), F.lit(f"#{seed}"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    part, upto = None, 0.0
    for name, share in list(shares.items())[:-1]:
        upto += share
        part = F.when(at < upto, name) if part is None else part.when(at < upto, name)
    last = list(shares)[-1]
    return df.withColumn("part", part.otherwise(last) if part is not None else F.lit(last))

