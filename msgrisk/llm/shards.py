"""Training-order materialisation into fixed-stride shards.

Documents become sequences of at most ``length`` ids. Sequence number ``i`` of
``n`` gets the slot ``permute(i)``: a Feistel network keyed by the epoch's key,
walked along its cycle until the value is below ``n``, so slots are a keyed
permutation of 0..n-1 that needs no table and no sort. Shard ``s`` holds slots
``s * per_shard`` onwards, each record ``2 * length + 1`` bytes: unsigned 16-bit
little-endian ids, the rest filled with 0xFFFF, and a final newline byte. A
reader finds a slot by arithmetic, and resumes from any slot.

Slots are dealt by range: shards are contiguous ranges of slots, and each is
written by one task through Spark's own text sink, so any store and a lost
executor's retry are safe. Ids travel compressed, grouped by shard.

Edge cases: a null or empty text is one sequence of the end id alone; repeated
rows are sequences of their own; a text of any length is cut into as many
sequences as it needs; a null doc_id is kept; an empty table writes
nothing and gives an empty index.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgrisk.llm.common import batch_rows, materialise, shared_path, slices
from msgrisk.llm.tokens import codec, vocabulary_path

LENGTH = 256
PER_SHARD = 16_384
KEY = 0x5EED_0F_0DE5
ROUNDS = 6
END_ID = 0
FILL = 0xFFFF  # not an id: a larger vocabulary is refused
LEVEL = 5
SLICE, SLICE_BYTES = 2048, 2 << 20  # documents encoded together, at most
BATCH_ROWS = 1024  # documents that Spark hands to a worker at once

INDEX = "doc_id long, piece int, slot long, shard long, byte_offset long, n_tokens long, ids_crc32 long"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(i: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slot of each sequence number below ``n``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key))
    x = np.asarray(i).astype(np.uint64)
    walk = np.arange(len(x))
    while len(walk):
        left, right = x[walk] >> np.uint64(half), x[walk] & low
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & low)
        x[walk] = (left << np.uint64(half)) | right
        walk = walk[x[walk] >= n]
    return x.astype(np.int64)


def stride(length: int) -> int:
    return 2 * length + 1


def encode_pieces(batches, task: int, length: int, path: str):
    """Batches of the rows that ``tokenise`` gives, from batches of (doc_id, text)."""
    pos = 0
    for b in batches:
        for part in slices(b, SLICE, SLICE_BYTES):
            ids, bounds = codec(path).encode_flat(part.column(1).to_pylist())
            # the end id after each document
            wide = np.full(len(ids) + part.num_rows, END_ID, "<u4")
            own = np.ones(len(wide), bool)
            own[bounds[1:] + np.arange(part.num_rows)] = False
            wide[own] = ids
            size = np.diff(bounds) + 1
            pieces = -(-size // length)
            doc = np.repeat(np.arange(part.num_rows), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = (np.cumsum(size) - size)[doc] + piece * length
            n = np.minimum(length, size[doc] - piece * length)
            raw, edges = wide.tobytes(), (4 * begin).tolist()
            crc = [zlib.crc32(raw[a : a + 4 * k]) for a, k in zip(edges, n.tolist())]
            offsets = np.append(2 * begin, 2 * len(wide)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(doc), task, np.int32)), pa.array(pos + np.arange(len(doc))), part.column(0).take(pa.array(doc)),
                    pa.array(piece.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(crc, pa.int64()),
                    pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(wide.astype("<u2"))]),
                ],
                names=["task", "pos", "doc_id", "piece", "n", "crc", "ids"],
            )
            pos += len(doc)
        pa.default_memory_pool().release_unused()


def tokenise(docs: DataFrame, length: int, path: str) -> DataFrame:
    """Rows (task, pos, doc_id, piece, n, crc, ids); task and pos number the sequences of each output file."""

    def run(batches):
        from pyspark import TaskContext

        return encode_pieces(batches, TaskContext.get().partitionId(), length, path)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "task int, pos long, doc_id long, piece int, n int, crc long, ids binary")


def write_shards(docs: DataFrame, path: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, tokenizer_path: str | None = None) -> DataFrame:
    """Write the shards under ``path`` and return the index, one row per sequence."""
    import zstandard

    spark, tokenizer_path = docs.sparkSession, tokenizer_path or vocabulary_path()
    if codec(tokenizer_path).tokenizer.get_vocab_size() > FILL:
        raise ValueError(f"ids of 16 bits cannot hold a vocabulary of more than {FILL}")
    with batch_rows(spark, BATCH_ROWS):
        seqs = materialise(tokenise(docs, length, tokenizer_path), "sequences", **{"parquet.enable.dictionary": "false"})
    # one row per file of the table above: its first sequence number
    sizes = sorted((r["task"], r["n"]) for r in seqs.groupBy("task").agg(F.count("*").alias("n")).collect())
    first, n = {}, 0
    for task, size in sizes:
        first[task] = n
        n += size
    shared = spark.sparkContext.broadcast(first)

    def slots_of(task: np.ndarray, pos: np.ndarray) -> np.ndarray:
        base = np.zeros(int(task.max()) + 1 if len(task) else 1, np.int64)
        for t in np.unique(task).tolist():
            base[t] = shared.value[t]
        return permute(base[task] + pos, n, key)

    def deal(batches):
        """Ids of a batch grouped by shard: (shard, compressed slots and records)."""
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            slot = slots_of(b.column(0).to_numpy(), b.column(1).to_numpy())
            ids = b.column(2)
            edges = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
            flat = np.frombuffer(ids.buffers()[2], np.uint8)[edges[0] : edges[-1]].view("<u2")
            filled = np.full((len(ids), length), FILL, "<u2")
            filled[np.arange(length) < (np.diff(edges) // 2)[:, None]] = flat
            records = np.full((len(ids), stride(length)), 10, np.uint8)
            records[:, :-1] = filled.view(np.uint8)
            order = np.argsort(slot // per_shard, kind="stable")
            cuts = np.flatnonzero(np.diff((slot // per_shard)[order])) + 1
            shard, blob = [], []
            for part in np.split(order, cuts):
                if len(part):
                    shard.append(int(slot[part[0]] // per_shard))
                    blob.append(pack.compress(len(part).to_bytes(4, "little") + slot[part].tobytes() + records[part].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(blob, pa.binary())], names=["shard", "blob"])

    def lay(batches):
        """One value per shard, records by slot; the sink adds the last newline byte."""
        unpack = zstandard.ZstdDecompressor()
        size = stride(length)
        at, buffer, top = None, None, 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([buffer[: top * size - 1].tobytes()], pa.binary())], names=["shard", "value"])

        for b in batches:
            for shard, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if shard != at:
                    if at is not None:
                        yield flush()
                    at, buffer, top = shard, np.zeros(min(per_shard, n - shard * per_shard) * size, np.uint8), 0
                raw = unpack.decompress(blob)
                k = int.from_bytes(raw[:4], "little")
                slot = np.frombuffer(raw, np.int64, k, 4) - shard * per_shard
                buffer.reshape(-1, size)[slot] = np.frombuffer(raw, np.uint8, k * size, 4 + 8 * k).reshape(k, size)
                top = max(top, int(slot.max()) + 1)
        if at is not None:
            yield flush()

    n_shards = -(-n // per_shard) if n else 1
    dealt = seqs.select("task", "pos", "ids").mapInArrow(deal, "shard long, blob binary")
    laid = dealt.repartition(n_shards, "shard").sortWithinPartitions("shard").mapInArrow(lay, "shard long, value binary")
    laid.select("shard", F.col("value").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(path)

    def index(batches):
        for b in batches:
            slot = slots_of(b.column(0).to_numpy(), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [b.column(2), b.column(3), pa.array(slot), pa.array(slot // per_shard), pa.array(slot % per_shard * stride(length)), b.column(4).cast(pa.int64()), b.column(5)],
                names=["doc_id", "piece", "slot", "shard", "byte_offset", "n_tokens", "ids_crc32"],
            )

    return seqs.select("task", "pos", "doc_id", "piece", "n", "crc").mapInArrow(index, INDEX)


def read_shards(spark: SparkSession, path: str, length: int = LENGTH, per_shard: int = PER_SHARD, from_slot: int = 0, with_ids: bool = True) -> DataFrame:
    """(slot, ids, stored_crc32) of every record from ``from_slot`` on, shard by shard; ids as 32-bit, null if not wanted."""

    def run(batches):
        kind = np.dtype([("ids", "<u2", (length,)), ("end", "u1")])
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = int(name.rsplit("shard=", 1)[1].split("/")[0])
                skip = max(0, from_slot - shard * per_shard)
                rows = np.frombuffer(raw, kind)["ids"][skip:]
                size = (rows != FILL).sum(axis=1)
                for at in range(0, len(rows), 4096):
                    some, k = rows[at : at + 4096].astype("<u4"), size[at : at + 4096]
                    whole = some.tobytes()
                    parts = [whole[i : i + 4 * m] for i, m in zip(range(0, len(whole), 4 * length), k.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(len(some)) + shard * per_shard + skip + at), pa.array(parts if with_ids else [None] * len(some), pa.binary()), pa.array(map(zlib.crc32, parts), pa.int64())],
                        names=["slot", "ids", "stored_crc32"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    first = from_slot // per_shard
    wanted = files.filter(F.regexp_extract("path", "shard=([0-9]+)", 1).cast("long") >= first)
    return wanted.select("path", "content").mapInArrow(run, "slot long, ids binary, stored_crc32 long")


def materialise_order(docs: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Write the shards to the shared folder, read them back and return the index with what was read."""
    spark = docs.sparkSession
    path = shared_path(spark, "shards")
    index = write_shards(docs, path, length, per_shard)
    if index.isEmpty():
        return index.withColumn("stored_crc32", F.lit(None).cast("long"))
    back = read_shards(spark, path, length, per_shard, with_ids=False).select("slot", "stored_crc32")
    return index.join(back.hint("shuffle_hash"), "slot", "left").select("doc_id", "piece", "slot", "shard", "byte_offset", "n_tokens", "ids_crc32", "stored_crc32")
