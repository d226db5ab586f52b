"""Token ids as files of patched frame-of-reference blocks.

A table folder written by ``write_ids`` holds parquet part files whose rows are *segments*: a run of whole documents in
ascending ``doc_id`` order with their ids as one binary payload. A payload is a header, an index of block starts and
the blocks. Each block of ``block`` ids subtracts its minimum, packs the low bits at the width that the ``percentile``-th
part of its ids needs, and keeps the ids that need more (exceptions) in a list of positions and high bits.
Any block can be decoded alone through the index.

Payload layout, little endian: ``PFR1``, u64 number of ids, u32 block size, u32 number of blocks, u64 start of each block
and of the end; each block: u32 minimum, u32 number of exceptions, u8 width, u8 width of the high parts, packed low bits,
packed positions, packed high parts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm import storage
from tallyloom.llm.subword import Encoder, tokenizer_path

BLOCK = 2048
PERCENTILE = 90.0
# A segment is closed when it has so many ids; a longer document is a segment of its own.
SEGMENT = 1 << 18
_HEAD = struct.Struct("<4sQII")
_BLOCK = struct.Struct("<IIBB")


def _bits(x: int) -> int:
    return int(x).bit_length()


def _pack(values: np.ndarray, width: int) -> bytes:
    if not width or not len(values):
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def _packed_size(n: int, width: int) -> int:
    return (n * width + 7) // 8


def _unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, dtype=np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(ids.min())
    values = (ids - np.uint32(low)).astype(np.uint32)
    kth = min(len(values) - 1, int(np.ceil(percentile / 100 * len(values))) - 1)
    width = _bits(np.partition(values, max(kth, 0))[max(kth, 0)])
    over = np.flatnonzero(values >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    high = values[over] >> np.uint32(min(width, 31))
    high_width = _bits(high.max()) if len(over) else 0
    mask = np.uint32((1 << width) - 1)
    return (
        _BLOCK.pack(low, len(over), width, high_width)
        + _pack(values & mask, width)
        + _pack(over.astype(np.uint32), _bits(len(ids) - 1))
        + _pack(high, high_width)
    )


def decode_block(data: bytes, n: int) -> np.ndarray:
    low, n_over, width, high_width = _BLOCK.unpack_from(data)
    at = _BLOCK.size
    parts = []
    for count, bits in ((n, width), (n_over, _bits(n - 1)), (n_over, high_width)):
        size = _packed_size(count, bits)
        parts.append(_unpack(data[at : at + size], count, bits))
        at += size
    values, over, high = parts
    values[over] |= high << np.uint32(min(width, 31))
    return values + np.uint32(low)


def encode_ids(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    ids = ids.astype(np.uint32, copy=False)
    blocks = [encode_block(ids[k : k + block], percentile) for k in range(0, len(ids), block)]
    sizes = np.fromiter(map(len, blocks), dtype=np.uint64, count=len(blocks))
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8") + np.uint64(_HEAD.size + 8 * (len(blocks) + 1))
    return b"".join([_HEAD.pack(b"PFR1", len(ids), block, len(blocks)), starts.tobytes(), *blocks])


def decode_ids(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive), from the blocks that hold them only."""
    magic, n, block, n_blocks = _HEAD.unpack_from(payload)
    if magic != b"PFR1":
        raise ValueError("not a payload of patched frame-of-reference blocks")
    last = n if last is None else min(last, n)
    starts = np.frombuffer(payload, "<u8", n_blocks + 1, _HEAD.size).tolist()
    which = range(first // block, -(-last // block)) if first < last else range(0)
    parts = [decode_block(payload[starts[k] : starts[k + 1]], min(block, n - k * block)) for k in which]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return ids[first - which.start * block : last - which.start * block]


_SEGMENTS = "shard int, segment int, start long, n_ids long, doc_ids array<long>, n_tokens array<long>, payload binary"


def write_ids(
    docs: DataFrame,
    path: str,
    *,
    tokenizer: str | None = None,
    end_id: int = 2,
    block: int = BLOCK,
    percentile: float = PERCENTILE,
) -> None:
    """Encode every whole text and write the ids in ascending ``doc_id`` order to ``path``.

    Each range partition is one shard. ``start`` of a segment counts ids within its shard. NULL or empty texts have the
    end id only; NULL ``doc_id`` sorts first; rows of one ``doc_id`` are ordered by text; further columns are ignored.
    """
    tokenizer = tokenizer or tokenizer_path()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder = TaskContext.get().partitionId(), Encoder.of(tokenizer)
        start = segment = size = 0
        doc_ids: list = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            payload = encode_ids(np.concatenate(parts), block, percentile)
            columns = [[shard], [segment], [start], [size], [doc_ids], [lengths], [payload]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["shard", "segment", "start", "n_ids", "doc_ids", "n_tokens", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for e in encoder.encode(batch.column(1)):
                for i in range(len(e.bounds) - 1):
                    ids = np.append(e.ids[e.bounds[i] : e.bounds[i + 1]], np.uint32(end_id))
                    if parts and size + len(ids) > SEGMENT:
                        yield close()
                        start, segment, size = start + size, segment + 1, 0
                        doc_ids, lengths, parts = [], [], []
                    doc_ids.append(keys[e.first + i])
                    lengths.append(len(ids))
                    parts.append(ids)
                    size += len(ids)
        if parts:
            yield close()

    storage.prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # The payload is packed already; a general codec would only cost time.
    ordered.mapInArrow(segments, _SEGMENTS).write.option("compression", "none").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start`` counted over all shards."""
    found = spark.read.schema(_SEGMENTS).parquet(path)
    # One row per shard, that is per partition of the writer.
    sizes = found.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("shard", before.alias("_before")))
    return found.join(offsets, "shard").withColumn("start", F.col("start") + F.col("_before")).drop("_before")


def read_ids(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, the ``ids``."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, keys, sizes, payload = (batch.column(c)[row].as_py() for c in range(4))
                ids = decode_ids(payload)
                bounds = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))])
                cuts = [ids[a:b].astype("<u4") for a, b in zip(bounds[:-1], bounds[1:])]
                columns = [
                    pa.array(keys, pa.int64()),
                    pa.array(start + bounds[:-1], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(c.tobytes()) for c in cuts], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([c.tolist() for c in cuts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    storage.prepare(spark)
    return read_segments(spark, path).select("start", "doc_ids", "n_tokens", "payload").mapInArrow(documents, schema)
