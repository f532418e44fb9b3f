"""Helpers shared by the training-data operators.

Every operator reads only the columns it is told to, so extra columns with
clashing names never matter, and every per-row function runs inside
``mapInArrow`` over slices of a batch. A slice ends at ``SLICE_ROWS`` rows or
``SLICE_BYTES`` bytes, whichever comes first, but holds at least one row, so
memory is bounded by these and by the longest text.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_ROWS = 512
SLICE_BYTES = 32 << 20
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share; a local one only in local mode with none configured."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = LOCAL_CHECKPOINTS
    return f"{root.rstrip('/')}/msgrisk"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared one; it is deleted when the session's file system closes."""
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def materialise(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read the files back."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs begun inside hand at most ``rows`` rows at once to a Python worker: a batch of whole texts is held by the
    JVM, twice while it grows, and by the worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of a batch of at most ``rows`` rows and about ``size`` bytes, of one row at least."""
    if batch.get_total_buffer_size() <= size:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        return
    held = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            held += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(held), 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        k = max(1, min(rows, upto - at))
        yield batch.slice(at, k)
        at += k


def map_rows(df: DataFrame, fn: Callable[[list[list]], list], schema: str | T.StructType, rows: int = SLICE_ROWS) -> DataFrame:
    """Apply ``fn(columns) -> output columns`` to slices of at most ``rows`` rows.

    ``fn`` gets one Python list per input column and returns one list or array
    per output column.
    """
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows):
                cols = fn([c.to_pylist() for c in part.columns])
                arrays = [pa.array(c, type=f.type, from_pandas=False) for c, f in zip(cols, arrow)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, out)


def fold(doc_id: int | None, mod: int) -> int:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def fold_col(col: str, mod: int):
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % mod


def words(text: str | None) -> list[bytes]:
    """Lower-case A-Z and split at space and 0x09-0x0D, as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))
