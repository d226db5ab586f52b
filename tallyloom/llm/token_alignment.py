"""Alignment of two tokenizers' tokens over the same texts.

1. Each text, with a space before it, is encoded by both. A text takes part where both give back its very bytes.
2. Tokens have byte ranges. ``merge_asof`` finds for each token's start the other side's covering token; positions run on through
   the texts of a batch, and so hold the text as well. The union of both directions are all overlaps; overlaps with equal
   ends are links, and cut the tokens into groups.
3. Batches are stored with their links as numbers of the batch's distinct id pairs, whose counts are summed over the corpus.
4. Counts go back to the batches: those of the most frequent pairs, ``HEAD`` at most, are broadcast; the others, if there are any, are
   joined by pair to the batches that ask for them. Results do not depend on ``HEAD``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import storage, subword, textbytes

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Bytes of texts that are aligned at a time; a longer text is aligned as a whole.
SLICE = 1 << 19
# Pairs whose counts are given to all tasks: 17 bytes each.
HEAD = 1 << 20


class Entries:
    """Byte strings by number, end to end."""

    def __init__(self, strings: list[bytes]) -> None:
        self.sizes = np.array([len(s) for s in strings], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[textbytes.ragged(self.starts[ids], self.sizes[ids])]


class Sides:
    """Both encoders, the bytes of their ids, and all numbers in decimal; one per worker and pair of files."""

    _made: dict[tuple[str, str], Sides] = {}

    @classmethod
    def of(cls, first: str, second: str) -> Sides:
        if (first, second) not in cls._made:
            cls._made[first, second] = cls(first, second)
        return cls._made[first, second]

    def __init__(self, first: str, second: str) -> None:
        self.encoders = (subword.Encoder.of(first, added=False), subword.SpacedPieces.of(second))
        self.entries = tuple(Entries(e.vocabulary()) for e in self.encoders)
        self.decimal = Entries([str(i).encode() for i in range(max(len(e.sizes) for e in self.entries))])


@dataclass
class Alignment:
    """Tokens of a slice of texts that take part; arrays with two entries are those of either side."""

    texts: int
    ids: tuple[np.ndarray, np.ndarray]
    bounds: tuple[np.ndarray, np.ndarray]  # of each text's tokens
    ends: tuple[np.ndarray, np.ndarray]  # bytes up to the end of a token
    overlaps: np.ndarray  # pairs of token numbers, by place
    links: np.ndarray  # those of the overlaps that end together

    def text_of(self, side: int, tokens: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds[side], tokens, side="right") - 1

    def groups(self, side: int) -> np.ndarray:
        """The number of each token's group, over all texts."""
        return np.searchsorted(self.ends[0][self.links[:, 0]], self.ends[side])


def _faithful(part: textbytes.Slice, encoded: subword.Encoded, entries: Entries) -> np.ndarray:
    """Whether a text's tokens have the text's bytes."""
    total = np.concatenate([[0], np.cumsum(entries.sizes[encoded.ids])])[encoded.bounds]
    sizes = np.diff(part.bounds)
    out = np.diff(total) == sizes
    chosen = np.flatnonzero(out)
    ids = encoded.ids[textbytes.ragged(encoded.bounds[chosen], np.diff(encoded.bounds)[chosen])]
    wrong = entries.joined(ids) != part.data[textbytes.ragged(part.bounds[chosen], sizes[chosen])]
    out[chosen[np.searchsorted(np.cumsum(sizes[chosen]), np.flatnonzero(wrong), side="right")]] = False
    return out & (sizes > 0)


def align_slice(part: textbytes.Slice, sides: Sides) -> Alignment:
    encoded = [e.encode_slice(part) for e in sides.encoders]
    ok = np.logical_and(*(_faithful(part, e, v) for e, v in zip(encoded, sides.entries)))
    ids, bounds, starts, ends = [], [], [], []
    for e, entries in zip(encoded, sides.entries):
        n = np.where(ok, np.diff(e.bounds), 0)
        ids.append(e.ids[textbytes.ragged(e.bounds[:-1], n)].astype(np.int64))
        bounds.append(np.concatenate([[0], np.cumsum(n)]))
        ends.append(np.cumsum(entries.sizes[ids[-1]]))
        starts.append(ends[-1] - entries.sizes[ids[-1]])
    frames = [pd.DataFrame({"start": s, f"token{k}": np.arange(len(s))}) for k, s in enumerate(starts)]
    under = pd.merge_asof(frames[0], frames[1], on="start")
    over = pd.merge_asof(frames[1], frames[0], on="start")
    pairs = np.concatenate([under[["token0", "token1"]].to_numpy(np.int64), over[["token0", "token1"]].to_numpy(np.int64)])
    # Tokens that start together are found from both sides.
    twice = np.zeros(len(pairs), dtype=bool)
    twice[len(under) :] = starts[0][pairs[len(under) :, 0]] == starts[1][pairs[len(under) :, 1]]
    pairs = pairs[~twice]
    pairs = pairs[np.argsort((pairs[:, 0] << 32) | pairs[:, 1])]
    links = pairs[ends[0][pairs[:, 0]] == ends[1][pairs[:, 1]]]
    return Alignment(len(part), tuple(ids), tuple(bounds), tuple(ends), pairs, links)


def written(found: Alignment, decimal: Entries) -> list[bytes]:
    """The groups of each text as ``a1,a2|b1;a3|b2,b3``."""
    n_groups = len(found.links)
    groups = [found.groups(side) for side in (0, 1)]
    counts = [np.bincount(g, minlength=n_groups) for g in groups]
    upto = [np.cumsum(c) for c in counts]
    # First the first side's tokens of a group, then the second's.
    places = [
        np.arange(len(groups[0])) + (upto[1] - counts[1])[groups[0]],
        np.arange(len(groups[1])) + upto[0][groups[1]],
    ]
    ids = np.zeros(len(groups[0]) + len(groups[1]), dtype=np.int64)
    after = np.full(len(ids), ord(","), dtype=np.uint8)
    for side in (0, 1):
        ids[places[side]] = found.ids[side]
        after[places[side][upto[side] - 1]] = ord("|;"[side])
    sizes = decimal.sizes[ids] + 1
    stops = np.cumsum(sizes)
    out = np.empty(int(sizes.sum()), dtype=np.uint8)
    out[stops - 1] = after
    out[textbytes.ragged(stops - sizes, sizes - 1)] = decimal.joined(ids)
    text, edges = out.tobytes(), np.concatenate([[0], stops])[found.bounds[0] + found.bounds[1]].tolist()
    return [text[a : max(a, b - 1)] for a, b in zip(edges, edges[1:])]


def _prefixed(docs: DataFrame) -> DataFrame:
    """doc_id and the text with a space before it; NULL for texts that have no tokens anyway."""
    text = F.when(F.length("text") > 0, F.concat(F.lit(" "), "text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def _files(first: str | None, second: str | None) -> tuple[str, str]:
    return first or subword.tokenizer_path(FIRST), second or subword.tokenizer_path(SECOND)


def align(docs: DataFrame, *, first: str | None = None, second: str | None = None) -> DataFrame:
    """doc_id, a_ids, b_ids, overlaps and links (pairs of token numbers within the document) of every document.

    Edge cases as in ``summarise``.
    """
    files = _files(first, second)
    storage.prepare(docs.sparkSession)

    def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.astype(np.int32)))

    def pairs(found: Alignment, chosen: np.ndarray) -> pa.Array:
        text = found.text_of(0, chosen[:, 0])
        bounds = np.searchsorted(text, np.arange(found.texts + 1))
        sides = [pa.array((chosen[:, k] - found.bounds[k][text]).astype(np.int32)) for k in (0, 1)]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(sides, ["a", "b"]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Sides.of(*files)
        for batch in batches:
            for part in textbytes.slices(batch.column(1), SLICE):
                found = align_slice(part, sides)
                columns = [
                    batch.column(0).slice(part.first, len(part)),
                    *(lists(i, b) for i, b in zip(found.ids, found.bounds)),
                    pairs(found, found.overlaps),
                    pairs(found, found.links),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a_ids", "b_ids", "overlaps", "links"])

    link = "array<struct<a: int, b: int>>"
    return _prefixed(docs).mapInArrow(work, f"doc_id long, a_ids array<int>, b_ids array<int>, overlaps {link}, links {link}")


_SLICES = (
    "slice long, doc_id array<long>, n_a array<long>, n_b array<long>, n_links array<long>, groups_sha256 array<string>, "
    "pairs array<long>, times array<long>, which binary"
)


def _slices(docs: DataFrame, files: tuple[str, str]) -> DataFrame:
    """One row per slice of documents: figures of each, the distinct id pairs of its links, and the pair number of every link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sides, number = Sides.of(*files), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in textbytes.slices(batch.column(1), SLICE):
                found = align_slice(part, sides)
                codes = (found.ids[0][found.links[:, 0]] << 32) | found.ids[1][found.links[:, 1]]
                pairs, which, times = np.unique(codes, return_inverse=True, return_counts=True)
                n_links = np.bincount(found.text_of(0, found.links[:, 0]), minlength=len(part))
                sums = [hashlib.sha256(t).hexdigest() if t else "" for t in written(found, sides.decimal)]
                row = [
                    batch.column(0).slice(part.first, len(part)).to_pylist(),
                    *(np.diff(b) for b in found.bounds),
                    n_links,
                    sums,
                    pairs,
                    times,
                ]
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 2
                columns = [pa.array([r], pa.list_(k)) for r, k in zip(row, kinds)]
                narrow = which.astype("<u2" if len(pairs) <= 1 << 16 else "<u4").tobytes()
                columns = [pa.array([number]), *columns, pa.array([narrow], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in _SLICES.split(", ")])
                number += 1

    return _prefixed(docs).mapInArrow(work, _SLICES)


def pair_counts(slices: DataFrame) -> DataFrame:
    """(pair, n, best): links that hold an id pair, and whether no other pair of its second id has more."""
    rows = slices.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    counts = rows.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    counts = storage.stored(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))), "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _least_of_head(counts: DataFrame, size: int) -> int:
    """The least power of two so that at most ``size`` pairs have as high a count."""
    power = F.floor(F.log2("n")).cast("int")
    rows = counts.groupBy(power.alias("power")).agg(F.count("*").alias("pairs")).collect()  # one row per power
    total, least = 0, 62
    for r in sorted(rows, reverse=True):
        total += r["pairs"]
        if total > size:
            break
        least = r["power"]
    return 1 << least


_FIGURES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _figures(rows: pa.RecordBatch | pa.Table, pairs: np.ndarray, n: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Figures of the documents of slices, from the counts of sorted ``pairs``."""
    for k in range(rows.num_rows):
        row = {name: rows.column(name)[k] for name in rows.schema.names}
        doc_id, n_a, n_b, n_links, sums, asked = (
            row[c].values for c in ("doc_id", "n_a", "n_b", "n_links", "groups_sha256", "pairs")
        )
        asked = asked.to_numpy()
        which = np.frombuffer(row["which"].as_py(), "<u2" if len(asked) <= 1 << 16 else "<u4")
        at = np.searchsorted(pairs, asked)
        if len(asked) and (at.max(initial=0) >= len(pairs) or (pairs[at] != asked).any()):
            raise ValueError("a pair of a batch has no count")
        edges = np.concatenate([[0], np.cumsum(n_links.to_numpy())])

        def summed(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values[at][which])]) if len(asked) else np.zeros(1, np.int64)
            return np.diff(total[edges]).astype(np.int64)

        columns = [doc_id, n_a, n_b, n_links, n_links, pa.array(summed(best.astype(np.int64))), pa.array(summed(n)), sums]
        yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in _FIGURES.split(", ")])


def summarise(docs: DataFrame, *, first: str | None = None, second: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    NULL and empty texts, and texts that one of the tokenizers does not give back byte for byte, have no tokens, zeros and an empty
    ``groups_sha256``. Added tokens' strings in texts are plain text. Repeated rows are counted and returned one by one;
    ``doc_id`` is read as a long and may be NULL; further columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    storage.prepare(spark)
    slices = storage.stored(_slices(docs, _files(first, second)), "aligned")
    counts = storage.stored(pair_counts(slices), "pair-counts")
    every = counts.limit(head + 1).count() <= head
    least = 0 if every else _least_of_head(counts, head)
    table = counts.where(F.col("n") >= least).toArrow().sort_by("pair")
    known = tuple(table.column(c).to_numpy() for c in ("pair", "n", "best"))
    shared = spark.sparkContext.broadcast(known)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _figures(batch, *shared.value)

    if every:
        return slices.mapInArrow(answer, _FIGURES)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                asked = batch.column(1)[k].values.to_numpy()
                rest = np.setdiff1d(asked, shared.value[0], assume_unique=True)
                columns = [pa.array(np.full(len(rest), batch.column(0)[k].as_py())), pa.array(rest)]
                yield pa.RecordBatch.from_arrays(columns, ["of", "pair"])

    def combine(rows: pa.Table, rare: pa.Table) -> pa.Table:
        tables = [np.concatenate([a, rare.column(c).to_numpy()]) for a, c in zip(shared.value, ("pair", "n", "best"))]
        order = np.argsort(tables[0])
        parts = _figures(rows.combine_chunks(), *(t[order] for t in tables))
        return pa.Table.from_batches(parts, rows.schema if not rows.num_rows else None)

    asked = slices.select("slice", "pairs").mapInArrow(ask, "of long, pair long")
    rare = asked.join(counts.where(F.col("n") < least), "pair")
    return slices.groupBy("slice").cogroup(rare.groupBy("of")).applyInArrow(combine, _FIGURES)
