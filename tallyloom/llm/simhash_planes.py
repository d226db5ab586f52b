"""Near duplicates by 64-bit similarity fingerprints, compared bit plane by bit plane.

1. A text's fingerprint has a bit where more than half of the hashes of its word shingles have it. Texts with equal fingerprints are
   one *print*.
2. Two prints within the radius agree on whole parts of the 64 bits: of ``radius + KEY_PARTS`` parts at most ``radius`` differ, so
   that every choice of ``KEY_PARTS`` parts gives an exact join key. Keys of one print only are dropped by their counts.
3. The prints of a key are cut into chunks of bounded size; every pair of chunks is a unit of work, dealt out by key and pair.
4. In a unit, 64 prints make a block that is stored vertically: a word per bit plane. A print is compared with the 64 prints of a block
   at once. Their distances are counted by carry-save adders over bit-sliced counters, plane after plane, and a block is
   abandoned once all of its distances exceed the radius. A unit returns a star per component, never all pairs.
5. Components of the stars name the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import storage, textbytes
from tallyloom.llm.components import components

BITS = 64
# Parts of a fingerprint that a key is made of: keys have about BITS * KEY_PARTS / (radius + KEY_PARTS) bits.
KEY_PARTS = 2
# Prints of a chunk; a unit has two chunks at most.
CHUNK = 4096
# Comparisons of a print with a block that are under way at the same time, and planes between two looks at them.
CELLS, LOOK = 1 << 15, 8
_BLOCK = 1 << 16


def shingle_hashes(words: list[bytes], n: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``n`` words joined by spaces; fewer words are one run, none have none."""
    digest = xxhash.xxh64_intdigest
    if len(words) < n:
        runs = [digest(b" ".join(words), seed)] if words else []
    else:
        runs = [digest(b" ".join(words[i : i + n]), seed) for i in range(len(words) - n + 1)]
    return np.array(runs, dtype=np.uint64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Bits of each number as a row of 64, lowest first."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), _BLOCK):
        ones += _bits(hashes[k : k + _BLOCK]).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, print) of every document; NULL and wordless texts have print 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbytes.slices(batch.column(1)):
                data = textbytes.lowered(part.data)
                starts, ends, at = textbytes.find_words(data, part.bounds, textbytes.SPACED)
                raw = data.tobytes()
                words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
                found = [majority(shingle_hashes(words[a:b], n, seed)) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                columns = [batch.column(0).slice(part.first, len(part)), pa.array(np.array(found, np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(work, "doc_id long, print long")


def part_keys(column: Column, radius: int) -> Column:
    """The join keys of a print: the number of a choice of parts and the bits of these parts."""
    parts = radius + KEY_PARTS
    edges = [round(BITS * k / parts) for k in range(parts + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    chosen = combinations(masks, KEY_PARTS)
    return F.array(
        *(
            F.struct(F.lit(k).cast("byte").alias("choice"), column.bitwiseAND(F.lit(signed(sum(m)))).alias("bits"))
            for k, m in enumerate(chosen)
        )
    )


def planes(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of blocks of 64 prints as rows of 64 words, and a word per block that marks the lanes in use."""
    blocks = -(-len(prints) // 64)
    lanes = np.zeros((blocks * 64, BITS), dtype=np.uint8)
    lanes[: len(prints)] = _bits(prints)
    vertical = lanes.reshape(blocks, 64, BITS).transpose(0, 2, 1)
    words = np.packbits(np.ascontiguousarray(vertical), axis=2, bitorder="little").view("<u8").reshape(blocks, BITS)
    used = np.packbits(np.arange(blocks * 64) < len(prints), bitorder="little").view("<u8")
    return words, used


def near_lanes(query: np.ndarray, words: np.ndarray, open_: np.ndarray, radius: int) -> np.ndarray:
    """For each print and the planes of its block (a row of ``words``): the lanes within the radius, of those that are open."""
    out = np.zeros(len(query), dtype=np.uint64)
    alive = np.flatnonzero(open_)
    beyond = ~open_[alive]
    size = radius.bit_length()
    counters = [np.zeros(len(alive), dtype=np.uint64) for _ in range(size)]
    # Lanes whose counter holds all the bits of the radius are full: one more difference is beyond it.
    for first in range(0, BITS, LOOK):
        for plane in range(first, first + LOOK):
            # All ones where the print has the bit.
            own = np.uint64(0) - ((query[alive] >> np.uint64(plane)) & np.uint64(1))
            carry = words[alive, plane] ^ own
            full = carry.copy()
            for bit, counter in enumerate(counters):
                full &= counter if radius >> bit & 1 else ~counter
            beyond |= full
            for bit, counter in enumerate(counters):
                counters[bit], carry = counter ^ carry, counter & carry
        keep = np.flatnonzero(~beyond)  # a block whose lanes are all beyond the radius is abandoned
        if len(keep) < len(alive):
            alive, beyond = alive[keep], beyond[keep]
            counters = [c[keep] for c in counters]
        if not len(alive):
            return out
    out[alive] = ~beyond
    return out


class Stars:
    """Least numbers that links reach, kept up link by link."""

    def __init__(self, count: int) -> None:
        self.least = np.arange(count)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.least[a], self.least[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.least, np.maximum(x, y), np.minimum(x, y))
            while (nearer := self.least[self.least]).tobytes() != self.least.tobytes():
                self.least = nearer


def unit_stars(prints: np.ndarray, groups: np.ndarray, first_side: np.ndarray, crossed: np.ndarray, radius: int) -> np.ndarray:
    """For each print the number of the least one that links within its unit reach.

    Units are runs of ``prints`` that begin at ``groups``; in ``crossed`` ones only pairs of the first ``first_side`` prints with the others are compared.
    """
    stars = Stars(len(prints))
    bounds = np.append(groups, len(prints))
    block_words, block_used, block_start, block_unit = [], [], [], []
    for unit, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        low = a + int(first_side[unit]) if crossed[unit] else a
        words, used = planes(prints[low:b])
        block_words.append(words)
        block_used.append(used)
        block_start.append(low + 64 * np.arange(len(used)))
        block_unit.append(np.full(len(used), unit))
    words, used, start, unit = map(np.concatenate, (block_words, block_used, block_start, block_unit))
    # A print meets the blocks that hold later prints of its unit.
    own = np.searchsorted(groups, np.arange(len(prints)), side="right") - 1
    place = np.arange(len(prints)) - groups[own]
    begin, end = np.searchsorted(unit, own), np.searchsorted(unit, own, side="right")
    begin = np.where(crossed[own], np.where(place < first_side[own], begin, end), begin + place // 64)
    cells = end - begin
    total = np.concatenate([[0], np.cumsum(cells)])
    at = 0
    while at < len(prints):
        upto = max(at + 1, int(np.searchsorted(total, total[at] + CELLS, side="right")) - 1)
        query = np.repeat(np.arange(at, upto), cells[at:upto])
        block = np.repeat(begin[at:upto] - total[at:upto] + total[at], cells[at:upto]) + np.arange(len(query))
        later = query - start[block]  # lanes up to the print itself are no partners
        open_ = used[block] & ~np.where(later < 0, np.uint64(0), (np.uint64(2) << np.clip(later, 0, 63).astype(np.uint64)) - np.uint64(1))
        found = near_lanes(prints[query], words[block], open_, radius)
        hit = np.flatnonzero(found)
        lanes = _bits(found[hit])
        which, lane = np.nonzero(lanes)
        stars.add(query[hit][which], start[block[hit]][which] + lane)
        at = upto
    return stars.least


def _unit_links(rows: DataFrame, radius: int) -> DataFrame:
    """Stars of the links of each unit; ``rows``: choice, bits, i, j, chunk, print, clustered by the first four and sorted by all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []  # units not yet compared, the last one perhaps not yet whole

        def compare(table: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(table), dtype=bool)
            new[1:] = (table[1:, :4] != table[:-1, :4]).any(axis=1)
            groups = np.flatnonzero(new)
            crossed = table[groups, 2] != table[groups, 3]
            first_side = np.add.reduceat((table[:, 4] == table[:, 2]).astype(np.int64), groups)
            prints = table[:, 5].copy()
            least = unit_stars(prints.view(np.uint64), groups, first_side, crossed, radius)
            moved = np.flatnonzero(least != np.arange(len(prints)))
            return pa.RecordBatch.from_arrays([pa.array(prints[moved]), pa.array(prints[least[moved]])], ["a", "b"])

        for batch in batches:
            kept.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if sum(map(len, kept)) < 2 * CHUNK:
                continue
            table = np.concatenate(kept)
            last = np.flatnonzero((table[:, :4] != table[-1, :4]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield compare(table[:cut])
            kept = [table[cut:]]
        if sum(map(len, kept)):
            yield compare(np.concatenate(kept))

    return rows.mapInArrow(work, "a long, b long")


def near_prints(prints: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``print`` within the radius."""
    keys = prints.select("print", F.explode(part_keys(F.col("print"), radius)).alias("key")).select("key.*", "print")
    sizes = keys.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("choice", "bits", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    dealt = keys.join(sizes, ["choice", "bits"]).withColumn("chunk", F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int"))
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "choice", "bits", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "print"
    )
    unit = ["choice", "bits", "i", "j"]
    return _unit_links(units.repartition(*unit).sortWithinPartitions(*unit, "chunk", "print"), radius)


def near_duplicates(docs: DataFrame, *, n: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id reachable by links) of every document.

    Words stand between ASCII white space, A-Z in lower case. Documents link when their fingerprints differ in at most ``radius``
    bits. NULL texts and texts without words have fingerprint 0 and link like any other; repeated rows link to each other; a NULL
    doc_id counts only where a class has no other, whose component_id is then NULL. ``doc_id`` is read as a long; further
    columns are ignored; an empty table gives no rows.
    """
    storage.prepare(docs.sparkSession)
    seen = storage.stored(fingerprints(docs, n, seed), "fingerprints")
    prints = storage.stored(seen.groupBy("print").agg(F.min("doc_id").alias("first")), "prints")
    groups = components(near_prints(prints.select("print"), radius)).withColumnRenamed("node", "print")
    placed = prints.join(groups, "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "component").select("print", "component_id")
    return seen.join(named, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
