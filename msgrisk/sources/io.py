"""Readers and writers of messages, models and reports."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("text", T.StringType(), False), T.StructField("label", T.StringType()), T.StructField("source", T.StringType(), False),
    T.StructField("template_id", T.StringType()), T.StructField("predicted_class", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("created_at", T.TimestampType(), False),
])


@dataclass(frozen=True)
class Config:
    database_url: str = field(default_factory=lambda: os.environ.get("DATABASE_URL", ""))
    model_path: str = field(default_factory=lambda: os.environ.get("MODEL_PATH", ""))
    review_key: str = field(default_factory=lambda: os.environ.get("REVIEW_KEY", ""))
    review_model: str = field(default_factory=lambda: os.environ.get("REVIEW_MODEL", ""))


def session(config: Config | None = None, name: str = "message-risk") -> SparkSession:
    """A session; tables under ``database_url``, if set, are found by name."""
    config = config or Config()
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    return (builder.config("spark.sql.warehouse.dir", config.database_url) if config.database_url else builder).getOrCreate()


class UploadError(ValueError):
    """A refused upload; the message says why."""


def labelled(df: DataFrame) -> DataFrame:
    """text, label, grp of labelled rows; a row without a template is a group of its own."""
    return df.filter(F.col("label").isNotNull()).select("id", "text", "label", "template_id", F.coalesce("template_id", F.concat(F.lit("row_"), F.col("id"))).alias("grp"))


def read_upload(spark: SparkSession, path: str, limit: int = 500) -> DataFrame:
    """First column of a header-less CSV: (pos, text); blank cells dropped, first ``limit`` rows by position."""
    if not path.lower().endswith(".csv"):
        raise UploadError("the upload is not a .csv file")
    whole = spark.read.format("binaryFile").load(path).select("content")
    if whole.filter(~F.is_valid_utf8(F.col("content").cast("string"))).limit(1).count():
        raise UploadError("the upload is not encoded as UTF-8")
    cells = spark.read.option("header", False).option("multiLine", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    # one file in one partition: ids follow the file's order
    rows = cells.select(F.monotonically_increasing_id().alias("pos"), F.col(cells.columns[0]).alias("text")) if cells.columns else spark.createDataFrame([], "pos long, text string")
    rows = rows.filter(F.regexp_replace("text", r"(?U)^\s+|\s+$", "") != "").orderBy("pos").limit(limit)
    if rows.isEmpty():
        raise UploadError("the upload holds no message")
    return rows


def read_requests(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON requests ``{"text": ...}``: the accepted texts of 1 to 2000 characters, and the rest."""
    parsed = lines.withColumn("text", F.from_json(F.col(column), "text string")["text"])
    good = F.coalesce(F.length("text").between(1, 2000), F.lit(False))
    return parsed.filter(good).select("text"), parsed.filter(~good).select(column)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("source").parquet(path)


def delete_source(spark: SparkSession, path: str, source: str) -> None:
    """Delete one source's rows: its partition is overwritten by nothing else than its removal."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/source={source}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_metrics(spark: SparkSession, metrics: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(metrics, default=float),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_cases(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_corpus_csv(df: DataFrame, path: str) -> None:
    df.select("id", "label", "family", "text", "note").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def settled(df: DataFrame, tag: str) -> DataFrame:
    """The rows without the plan that made them: written to the checkpoint folder and read again.

    The files are deleted when the session's file system closes. Outside local
    mode with no such folder the rows are cached, with their plan.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or ("file:///tmp/checkpoints" if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local" else None)
    if root is None:
        return df.persist()
    path = f"{root.rstrip('/')}/msgrisk/{tag}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
