"""Documents packed into sequences of a fixed number of tokens by bulk-synchronous best fit.

Documents are tokenised where they lie; only their pieces (key, length, checksum) travel. The pieces are range-sorted by
length, longest first, which gives each a rank within its length by counts of its own and of earlier partitions. Equal
lengths are interchangeable, and so are equal gaps: the matching itself is a sweep over *classes* (length, count) and
(gap, count), of which there are no more than a sequence has tokens, whatever the number of documents. A superstep takes
the longest length left, finds its successors (the smallest gaps that hold it), gives each gap as many pieces as fit,
resolves the claims of equal pieces by rank, updates the gaps and repeats; where no gap is left, sequences are opened. The
distributed part then turns (length, rank) into a place by a lookup in the list of claims.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm import storage
from tallyloom.llm.subword import Encoder, tokenizer_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, *, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each whole text with its end id; the first piece takes the odd length.

    NULL or empty texts give one piece with the end id alone. Repeated rows and keys are packed as often as they occur.
    """
    tokenizer = tokenizer or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            keys = batch.column(0)
            for e in encoder.encode(batch.column(1)):
                rows: tuple[list, ...] = ([], [], [], [], [])
                for i in range(len(e.bounds) - 1):
                    ids = np.append(e.ids[e.bounds[i] : e.bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    odd = len(ids) % capacity
                    edges = [*([0] if odd else []), *range(odd, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                        for column, value in zip(rows, (e.first + i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                            column.append(value)
                at = pa.array(rows[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(at),
                        pa.array(rows[1], pa.int32()),
                        *(pa.array(r, pa.int64()) for r in rows[2:]),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    storage.prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


class Gaps:
    """Open sequences by gap: runs of consecutive sequences with equal gaps, found by successor."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.sizes: list[int] = []  # sorted gaps that have runs
        self.runs: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, number)
        self.opened = 0

    def put(self, gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in self.runs:
                insort(self.sizes, gap)
                self.runs[gap] = []
            self.runs[gap].append((first, number))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """A run of the smallest gap that holds ``least``."""
        at = bisect_left(self.sizes, least)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        first, number = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap], self.sizes[at]
        return gap, first, number

    def open(self, number: int) -> tuple[int, int, int]:
        first, self.opened = self.opened, self.opened + number
        return self.capacity, first, number


def match_classes(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Claims as rows (length, first rank, pieces each, first sequence, first offset), sorted by length and rank.

    ``counts`` has one entry per piece length, at most ``capacity`` of them.
    """
    gaps, claims = Gaps(capacity), []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            gap, first, number = gaps.take(length) or gaps.open(-(-left // (capacity // length)))
            each = gap // length
            full = min(number, left // each)
            claims.append((length, rank, each, first, capacity - gap))
            placed, used = full * each, full
            if full < number and placed < left:  # the last sequence takes what is left
                gaps.put(gap - (left - placed) * length, first + full, 1)
                placed, used = left, full + 1
            gaps.put(gap - each * length, first, full)
            gaps.put(gap, first + used, number - used)
            rank, left = rank + placed, left - placed
    return np.array(sorted(claims), dtype=np.int64).reshape(-1, 5)


def _ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``_rank`` from 0 among those of equal length, by doc_id and piece."""
    names = pieces.columns
    schema = pa.schema([("_part", pa.int32()), ("_local", pa.int64())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            if not len(length):
                continue
            change = np.concatenate([[length[0] != last], length[1:] != length[:-1]])
            begin = np.maximum.accumulate(np.where(change, np.arange(len(length)), 0))
            rank = np.arange(len(length)) - begin
            if not change[0]:
                rank[begin == 0] += seen
            last, seen = length[-1], int(rank[-1]) + 1
            extra = [pa.array(np.full(len(length), part, np.int32)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, *schema.names])

    ordered = pieces.repartitionByRange(F.desc("length"), "doc_id", "piece")
    ordered = ordered.sortWithinPartitions(F.desc("length"), "doc_id", "piece")
    kept = storage.stored(ordered.mapInArrow(local, f"{PIECES}, _part int, _local long"), "ranked")
    # At most one row per partition and one per length.
    sizes = kept.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        kept.join(sizes, ["_part", "length"])
        .withColumn("_rank", F.col("_local") + F.col("_before"))
        .drop("_part", "_local", "_before")
    )


def pack(docs: DataFrame, *, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; every sequence is filled from 0 without a hole.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Best fit for longest pieces first. NULL
    ``doc_id`` and repeated rows are packed like others; empty input gives no rows; further columns are ignored.
    """
    pieces = storage.stored(token_pieces(docs, capacity=capacity, end_id=end_id, tokenizer=tokenizer), "pieces")
    # Counts by length: no more rows than a sequence has tokens.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    claims = match_classes(counts, capacity)
    # (length, rank) as one sorted number per claim; ranks fit in 50 bits, lengths in 13.
    keys = (claims[:, 0] << 50) | claims[:, 1]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in (3, 5))
            claim = claims[np.searchsorted(keys, (length << 50) | rank, side="right") - 1]
            at = rank - claim[:, 1]
            extra = [pa.array(claim[:, 3] + at // claim[:, 2]), pa.array(claim[:, 4] + at % claim[:, 2] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *extra], [*names, "sequence_id", "offset"])

    return _ranked(pieces).select(*names, "_rank").mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
