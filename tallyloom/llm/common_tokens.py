"""Tokens (64-bit hashes) that many sets have, counted exactly over all sets, and sets whose tokens others have, too.

Each task sorts its distinct tokens and sends them as compressed differences, range by range of the hashes, with the number of each
token's set within the task's chunk, some five bytes a token together. A range is counted where all its parts meet, and says which
numbers had a token that occurs twice or more. Hashes are cut to 40 bits: two tokens that are taken for one are taken so everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import textbytes

BITS = 40
# Tokens of a range on average; the parts of one range are counted together.
RANGE_TOKENS = 1 << 20
# Tokens that a task sorts at a time.
_SORTED = 1 << 22


def places(tokens: np.ndarray) -> np.ndarray:
    return tokens >> np.uint64(64 - BITS)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 as compressed byte planes."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _from_planes(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * count, codec="zstd", asbytes=True), np.uint8).reshape(4, count)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def packed(sorted_: np.ndarray) -> bytes:
    """Sorted numbers below 2 ** 32 as compressed byte planes of their differences."""
    return _planes(np.diff(sorted_, prepend=np.uint64(0)))


def unpacked(data: bytes, count: int) -> np.ndarray:
    return np.cumsum(_from_planes(data, count), dtype=np.uint64)


def ranges(texts: DataFrame) -> int:
    """A power of two of ranges, by the number of characters: a token for every five at most."""
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    return 1 << max(BITS - 32, int(total / 5 / RANGE_TOKENS).bit_length())


_COUNTED = "place long, chunk long, count long, data binary, names binary"


def _rows(schema: str, *columns: list | np.ndarray | pa.Array) -> pa.RecordBatch:
    """A batch of ``schema`` by its leading columns; the others are NULL."""
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    arrays = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)]
    arrays += [pa.nulls(len(arrays[0]), kinds[kind]) for _, kind in fields[len(columns) :]]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def counted(
    texts: DataFrame, sets: Callable[[textbytes.Slice], tuple[np.ndarray, np.ndarray, np.ndarray]], least: int, n_ranges: int
) -> DataFrame:
    """Rows with a place: the tokens that at least ``least`` sets have. The others, by chunk, are for ``matched``.

    ``sets`` gives the tokens, bounds and names of a slice's sets; a task counts a name once, and so do tasks each.
    """
    low = BITS - (n_ranges - 1).bit_length()
    sent = "part long, chunk long, count long, data binary, owners binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        given, waiting, size, chunk = np.zeros(0, np.int64), [], 0, TaskContext.get().partitionId() << 32

        def rows() -> pa.RecordBatch:
            names, sizes, tokens = (np.concatenate(x) for x in zip(*waiting))
            # Equal tokens stay side by side: a step of zero.
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], np.repeat(np.arange(len(sizes)), sizes)[order]
            part = (tokens >> np.uint64(low)).astype(np.int64)
            at = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
            inner, spans = tokens & np.uint64((1 << low) - 1), list(zip(at[:-1].tolist(), at[1:].tolist()))
            # The names of the chunk's sets take the place of a range below zero.
            return _rows(
                sent,
                [-1 - (chunk * 0x9E3779B1 >> 16) % n_ranges, *part[at[:-1]].tolist()],
                [chunk] * (1 + len(spans)),
                [len(names), *np.diff(at).tolist()],
                [_planes(sizes), *(packed(inner[a:b]) for a, b in spans)],
                [names.astype("<i8").tobytes(), *(_planes(owner[a:b]) for a, b in spans)],
            )

        for batch in batches:
            for part in textbytes.slices(batch.column(0)):
                tokens, bounds, names = sets(part)
                new, at = np.unique(names, return_index=True)
                at = at[~np.isin(new, given)]
                given = np.union1d(given, new)
                sizes = np.diff(bounds)[at]
                waiting.append((names[at], sizes, places(tokens[textbytes.ragged(bounds[at], sizes)])))
                size += int(sizes.sum())
                if size >= _SORTED:
                    yield rows()
                    waiting, size, chunk = [], 0, chunk + 1
        if waiting:
            yield rows()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting = None, []

        def found() -> Iterator[pa.RecordBatch]:
            chunks, sizes, inner, owners = (list(x) for x in zip(*waiting))
            each, which, n = np.unique(np.concatenate(inner), return_inverse=True, return_counts=True)
            out = (np.uint64(key) << np.uint64(low)) | each[n >= least]
            yield _rows(_COUNTED, out.view(np.int64))
            again = np.split(n[which] > 1, np.cumsum(sizes)[:-1])
            met = [np.sort(own[mask]).astype(np.uint64) for own, mask in zip(owners, again)]
            kept = [i for i, own in enumerate(met) if len(own)]
            yield _rows(_COUNTED, [None] * len(kept), [chunks[i] for i in kept], [len(met[i]) for i in kept], [packed(met[i]) for i in kept])

        for batch in batches:
            for part, chunk, size, data, owners in zip(*(c.to_pylist() for c in batch.columns)):
                if part < 0:
                    yield _rows(_COUNTED, [None], [chunk], [size], [data], [owners])
                    continue
                if part != key:
                    if waiting:
                        yield from found()
                    key, waiting = part, []
                waiting.append((chunk, size, unpacked(data, size), _from_planes(owners, size)))
        if waiting:
            yield from found()

    rows = texts.select("text").mapInArrow(send, sent)
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(count, _COUNTED)


def common(
    texts: DataFrame, sets: Callable[[textbytes.Slice], tuple[np.ndarray, np.ndarray, np.ndarray]], least: int, n_ranges: int
) -> DataFrame:
    """(place) of the tokens that at least ``least`` sets have, as in ``counted``."""
    return counted(texts, sets, least, n_ranges).where("place is not null").select("place")


def matched(counted: DataFrame, percent: int) -> DataFrame:
    """(name) of the sets of which ``percent`` of the tokens at least occur a second time; ``counted`` as stored.

    A set whose intersection with another one is that share of their union is among them: the other set has these tokens.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head, waiting = None, None, []

        def found() -> pa.RecordBatch:
            names, sizes = head
            again = np.zeros(len(names), np.int64)
            for own in waiting:
                again += np.bincount(own.astype(np.int64), minlength=len(names))
            return pa.RecordBatch.from_arrays([pa.array(names[(sizes > 0) & (100 * again >= percent * sizes)])], ["name"])

        for batch in batches:
            for chunk, size, data, names in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk != key:
                    if head:
                        yield found()
                    key, head, waiting = chunk, None, []
                if names is None:
                    waiting.append(unpacked(data, size))
                else:
                    head = np.frombuffer(names, "<i8"), _from_planes(data, size).astype(np.int64)
        if head:
            yield found()

    rows = counted.where("chunk is not null").drop("place")
    return rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(judge, "name long").distinct()
