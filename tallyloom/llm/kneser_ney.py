"""Interpolated modified Kneser-Ney models over the bytes of words.

An event is a byte with the bytes before it, packed into one number: the byte itself lowest, then its predecessors back
to the space before the word (``within_words``) or to the text's start, eight bytes in all at most. A gram of order m is
an event cut to m bytes; shorter histories keep their full length. Counts, continuation counts, discounts, context totals
and probabilities are joins and aggregates of count tables, dealt by gram.

A model of up to ``MODEL_ROWS`` grams of the highest order, counted first, is given to all tasks, which back off by themselves. For a larger one
the texts are packed into slices of bounded size; each slice asks once for each of its distinct grams, the answers are
joined by exact gram and meet the texts again by slice. Results are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import storage, textbytes

_ODD = 0x9E3779B97F4A7C15
_TRAIN_SLICE = 4 << 20
# Grams of the highest order of a model that is given to all tasks; with its shorter grams and contexts some 60 bytes each.
MODEL_ROWS = 1 << 21


def events(
    part: textbytes.Slice, inside: np.ndarray, within_words: bool, distinct: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Packed events of a slice and the bounds of each text's events; every word ends with a space.

    ``distinct``: a word counts once in a text, where it comes first.
    """
    data = textbytes.lowered(part.data)
    starts, ends, at = textbytes.find_words(data, part.bounds, inside)
    if distinct:
        owner = np.repeat(np.arange(len(part)), np.diff(at)).astype(np.uint64)
        keys = textbytes.mix64(textbytes.hash_words(data, starts, ends) + owner * np.uint64(_ODD))
        first = np.sort(np.unique(keys, return_index=True)[1])
        starts, ends, at = starts[first], ends[first], np.searchsorted(first, at)
    n_words = np.diff(at)
    sizes = ends - starts
    # Each text: a space, then each word with a space after it; a text without words has nothing.
    owner = np.repeat(np.arange(len(part)), n_words)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] + np.cumsum(n_words > 0)[owner]
    bounds = np.concatenate([[0], np.cumsum((n_words > 0) + np.bincount(owner, sizes + 1, len(part)).astype(np.int64))])
    stream = np.full(bounds[-1], 0x20, dtype=np.uint64)
    if len(sizes):
        offset = np.concatenate([[0], np.cumsum(sizes)])
        inner = np.arange(offset[-1])
        stream[inner + np.repeat(begin - offset[:-1], sizes)] = data[inner + np.repeat(starts - offset[:-1], sizes)]
    packed = stream.copy()
    for shift in (1, 2, 4):
        packed[shift:] |= packed[:-shift] << np.uint64(8 * shift)
    place = np.arange(len(stream))
    if within_words:
        last = np.maximum.accumulate(np.where(stream == 0x20, place, 0))
        first = np.concatenate([[0], last[:-1]])
    else:
        first = np.repeat(bounds[:-1], np.diff(bounds))
    back = place - first  # bytes of history
    short = back < 7
    packed[short] &= (np.uint64(1) << (np.uint64(8) * (back[short] + 1).astype(np.uint64))) - np.uint64(1)
    real = np.ones(len(stream), dtype=bool)
    real[bounds[:-1][n_words > 0]] = False  # the space before a text is no event
    return packed[real], bounds - np.concatenate([[0], np.cumsum(n_words > 0)])


def count_events(
    texts: DataFrame, inside: np.ndarray, within_words: bool, order: int, distinct: bool = False
) -> DataFrame:
    """(gram, n0, n1) over all rows of (text, class 0 or 1): how often each gram occurs in either class."""
    mask = np.uint64((1 << 8 * order) - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(1).to_numpy(zero_copy_only=False)
            for part in textbytes.slices(batch.column(0), _TRAIN_SLICE):
                packed, bounds = events(part, inside, within_words, distinct)
                kind = np.repeat(kinds[part.first : part.first + len(part)], np.diff(bounds))
                grams, inverse = np.unique(packed & mask, return_inverse=True)
                both = np.bincount(inverse, minlength=len(grams))
                ones = np.bincount(inverse, kind, len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams.view(np.int64)), pa.array(both - ones), pa.array(ones)], ["gram", "n0", "n1"]
                )

    rows = texts.mapInArrow(work, "gram long, n0 long, n1 long")
    return rows.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _cut(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 8 * order) - 1)) if order < 8 else gram


def _longer(gram: Column, order: int) -> Column:
    """The gram has more than ``order`` bytes."""
    return F.shiftrightunsigned(gram, 8 * order) != 0


def discounts(counts: DataFrame, n: str = "n") -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney, from the counts of counts 1 to 4."""
    row = counts.agg(*(F.count(F.when(F.col(n) == k, 1)) for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = (max(1, x) for x in row)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3)))


def _discount(n: Column, d: tuple[float, float, float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).when(n >= 3, d[2]).otherwise(0.0)


def contexts(counts: DataFrame, n: str, d: tuple[float, float, float]) -> DataFrame:
    """(context, total, gamma): occurrences of a context and the share of its mass that is left to backing off."""
    count = F.col(n)
    return (
        counts.where(count > 0)
        .groupBy(F.shiftrightunsigned("gram", 8).alias("context"))
        .agg(F.sum(count).alias("total"), (F.sum(_discount(count, d)) / F.sum(count)).alias("gamma"))
    )


def levels(counts: DataFrame, orders: list[int]) -> list[tuple[int, int, DataFrame]]:
    """(order, next lower order, (gram, n)) from the highest order down; n counts occurrences at the top and different
    left neighbours below, except for grams whose history is the whole word or text, which have none. Grams with n = 0 are
    asked for only: they count nowhere."""
    out, grams = [], counts.select("gram", "n")
    for order, lower in zip(orders, [*orders[1:], 0]):
        if order != orders[0]:
            n = F.when(_longer(F.col("gram"), order), (F.col("n") > 0).cast("int")).otherwise(F.col("n"))
            grams = grams.groupBy(_cut(F.col("gram"), order).alias("gram")).agg(F.sum(n).alias("n"))
        grams = storage.stored(grams, f"order{order}")
        out.append((order, lower, grams.where(_longer(F.col("gram"), lower)) if lower else grams))
    return out


def probabilities(counts: DataFrame, orders: list[int]) -> list[tuple[int, DataFrame, DataFrame]]:
    """(order, (gram, p), (context, gamma)) from the lowest order up, of (gram, n) counts at the highest order.

    Grams with n = 0 get what backing off gives them; a context that nothing follows leaves all to the shorter gram.
    """
    out: list[tuple[int, DataFrame, DataFrame]] = []
    below: DataFrame | None = None
    for order, lower, grams in reversed(levels(counts, orders)):
        d = discounts(grams)
        context = contexts(grams, "n", d)
        joined = grams.withColumn("context", F.shiftrightunsigned("gram", 8)).join(context, "context", "left")
        if below is None:
            low = F.lit(1 / 256)
        else:
            joined = joined.withColumn("low", _cut(F.col("gram"), lower)).join(
                below.select(F.col("gram").alias("low"), F.col("p").alias("low_p")), "low"
            )
            low = F.col("low_p")
        p = (F.col("n") - _discount(F.col("n"), d)) / F.col("total") + F.col("gamma") * low
        level = storage.stored(joined.select("gram", F.coalesce(p, low).alias("p")), f"p{order}")
        out.append((order, level, context.select("context", "gamma")))
        # The next level may cut to any gram up to this order.
        below = level if below is None else level.unionAll(below)
    return out


def pack(
    texts: DataFrame, inside: np.ndarray, within_words: bool, order: int, distinct: bool = False
) -> DataFrame:
    """(slice, grams, payload) of (key columns, text): the distinct grams of a slice of rows, and the rows, compressed.

    Stored, so that a slice has the same rows whenever it is read.
    """
    mask = np.uint64((1 << 8 * order) - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            for part in textbytes.slices(batch.column(batch.num_columns - 1), _TRAIN_SLICE):
                packed, _ = events(part, inside, within_words, distinct)
                grams = np.unique(packed & mask).view(np.int64)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                    out.write_batch(batch.slice(part.first, len(part)))
                row = [
                    pa.array([number]),
                    pa.ListArray.from_arrays(pa.array([0, len(grams)], pa.int32()), pa.array(grams)),
                    pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(row, ["slice", "grams", "payload"])
                number += 1

    return storage.stored(texts.mapInArrow(work, "slice long, grams array<long>, payload binary"), "slices")


class Values:
    """Values of a slice's grams."""

    def __init__(self, grams: np.ndarray, values: np.ndarray, order: int) -> None:
        place = np.argsort(grams)
        self.grams, self.values = grams[place], values[place]
        self.mask = np.uint64((1 << 8 * order) - 1)

    def of(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each event, 0 where it has none, and whether it has one."""
        grams = packed & self.mask
        if not len(self.grams):
            return np.zeros(len(grams)), np.zeros(len(grams), dtype=bool)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        has = self.grams[at] == grams
        return np.where(has, self.values[at], 0.0), has


def gather(
    slices: DataFrame, values: DataFrame, order: int, score: Callable[[pa.RecordBatch, Values], pa.RecordBatch], schema: str
) -> DataFrame:
    """``score`` of the rows of each of ``slices`` and the ``values`` (gram, v) of its grams; a gram is a key of ``values`` once."""
    asked = slices.select(F.col("slice").alias("of"), F.explode("grams").alias("gram"))
    found = asked.join(values.select("gram", F.col("v").cast("double").alias("v")), "gram").select("of", "gram", "v")

    def work(rows: pa.Table, known: pa.Table) -> pa.Table:
        grams, v = (known.column(name).to_numpy() for name in ("gram", "v"))
        table = Values(grams.view(np.uint64), v, order)
        out = []
        for payload in rows.column("payload").to_pylist():
            with pa.ipc.open_stream(payload) as reader:
                out += [score(batch, table) for batch in reader]
        return pa.Table.from_batches(out)

    dealt = slices.select("slice", "payload").groupBy("slice").cogroup(found.groupBy("of"))
    return dealt.applyInArrow(work, schema)


class Sorted:
    """Values by sorted numbers."""

    def __init__(self, numbers: np.ndarray, values: np.ndarray) -> None:
        place = np.argsort(numbers.view(np.uint64))
        self.numbers, self.values = numbers.view(np.uint64)[place], values[place]

    @classmethod
    def of_rows(cls, rows: DataFrame) -> Sorted:
        """All of (number, value): the caller has counted them."""
        table = rows.toArrow()
        return cls(*(c.to_numpy() for c in table.columns))

    def find(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each number, 0 where it has none, and whether it has one."""
        if not len(self.numbers):
            return np.zeros(len(numbers)), np.zeros(len(numbers), dtype=bool)
        at = np.minimum(np.searchsorted(self.numbers, numbers), len(self.numbers) - 1)
        has = self.numbers[at] == numbers
        return np.where(has, self.values[at], 0.0), has


class Known:
    """Values of grams of one order that a task has by itself."""

    def __init__(self, order: int, table: Sorted) -> None:
        self.mask, self.table = np.uint64((1 << 8 * order) - 1), table

    def of(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        grams, which = np.unique(packed & self.mask, return_inverse=True)
        values, has = self.find(grams)
        return values[which], has[which]

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.table.find(grams)


class Backing(Known):
    """Log probabilities of any gram by the tables of all orders, from the lowest up."""

    def __init__(self, levels: list[tuple[int, Sorted, Sorted]]) -> None:
        super().__init__(levels[-1][0], levels[-1][1])
        self.levels = levels

    @classmethod
    def of_model(cls, model: list[tuple[int, DataFrame, DataFrame]]) -> Backing:
        return cls(
            [
                (order, Sorted.of_rows(p.select("gram", F.log("p"))), Sorted.of_rows(c.select("context", F.log("gamma"))))
                for order, p, c in model
            ]
        )

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lower, out = 0, np.full(len(grams), np.log(1 / 256))
        for order, table, contexts_ in self.levels:
            part = grams & np.uint64((1 << 8 * order) - 1)
            found, seen = table.find(part)
            backed = out + contexts_.find(part >> np.uint64(8))[0]  # an unknown context leaves all to the shorter gram
            longer = (part >> np.uint64(8 * lower)) != 0 if lower else np.ones(len(part), dtype=bool)
            out = np.where(longer, np.where(seen, found, backed), out)
            lower = order
        return out, np.ones(len(grams), dtype=bool)


def in_place(
    texts: DataFrame, known: Known, score: Callable[[pa.RecordBatch, Known], pa.RecordBatch], schema: str
) -> DataFrame:
    """``score`` of (key columns, text) by what every task knows."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield score(batch, shared.value)

    return texts.mapInArrow(work, schema)


def is_small(counts: DataFrame) -> bool:
    return counts.limit(MODEL_ROWS + 1).count() <= MODEL_ROWS
