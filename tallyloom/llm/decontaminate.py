"""Benchmark passages found in documents by a prefix-filtered join of word shingles.

An item is the set of its windows of ``window`` consecutive words; a shorter item is one window. A document contains a
window only if it contains all the window's shingles, so one shingle is prefix enough: shingles are ordered by their
number of occurrences in all documents, and only the rarest of each window is joined. A candidate gives the place where the window must
begin; places outside the document drop out (length and positional bounds), and the words themselves are compared.

Documents pass twice through a filter of fixed size (a bit per hash value): once to count the benchmark's shingles, once to
pick candidates with the few words around them. Only hits of the filter leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm import storage, textbytes

# Bits of the filter; a benchmark that fills it only lets more candidates through.
FILTER_BITS = 1 << 20


def _bits(hashes: DataFrame) -> np.ndarray:
    """The filter of a column ``h``: at most FILTER_BITS numbers reach the driver."""
    rows = hashes.select(F.pmod("h", F.lit(FILTER_BITS)).cast("int").alias("bit")).distinct().collect()
    out = np.zeros(FILTER_BITS, dtype=bool)
    out[[r["bit"] for r in rows]] = True
    return np.packbits(out)


def _passes(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return np.flatnonzero((packed[at >> 3] >> (7 - (at & 7))) & 1)


def windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item_id, words, n, size, hashes): each window's words joined by spaces and the hashes of its shingles."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), ([], [], [], [], [])
            for part in textbytes.slices(batch.column(1)):
                data = textbytes.lowered(part.data)
                starts, ends, at = textbytes.find_words(data, part.bounds, textbytes.ALNUM)
                hashes = textbytes.hash_words(data, starts, ends)
                for i in range(len(part)):
                    a, b = int(at[i]), int(at[i + 1])
                    n = min(window, b - a)
                    size = min(shingle, n)
                    if not n:
                        continue
                    chained = textbytes.chain(hashes[a:b], size).view(np.int64)
                    words = [bytes(data[starts[k] : ends[k]]).decode() for k in range(a, b)]
                    for k in range(b - a - n + 1):
                        row = (ids[part.first + i], " ".join(words[k : k + n]), n, size, chained[k : k + n - size + 1].tolist())
                        for column, value in zip(rows, row):
                            column.append(value)
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            names = ["item_id", "words", "n", "size", "hashes"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    return items.mapInArrow(cut, "item_id string, words string, n int, size int, hashes array<long>")


def _occurrences(texts: DataFrame, packed: np.ndarray, sizes: list[int]) -> DataFrame:
    """How often each hash that passes the filter occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for part in textbytes.slices(batch.column(1)):
                data = textbytes.lowered(part.data)
                starts, ends, _ = textbytes.find_words(data, part.bounds, textbytes.ALNUM)
                hashes = textbytes.hash_words(data, starts, ends)
                for size in sizes:
                    chained = textbytes.chain(hashes, size)
                    found.append(chained[_passes(packed, chained)])
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("occurrences"))


def _candidates(texts: DataFrame, packed: np.ndarray, sizes: list[int], window: int) -> DataFrame:
    """Every document with its number of words and the places whose shingle passes the filter, with words around."""
    place = pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("before", pa.int32()), ("around", pa.string())])
    schema = "row long, doc_id string, n_words long, places array<struct<h:long,pos:int,before:int,around:string>>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            places: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            for part in textbytes.slices(batch.column(1)):
                data = textbytes.lowered(part.data)
                starts, ends, at = textbytes.find_words(data, part.bounds, textbytes.ALNUM)
                hashes = textbytes.hash_words(data, starts, ends)
                n_words[part.first : part.first + len(part)] = np.diff(at)
                for size in sizes:
                    chained = textbytes.chain(hashes, size)
                    hits = _passes(packed, chained)
                    which = np.searchsorted(at, hits, side="right") - 1
                    for k, i in zip(hits.tolist(), which.tolist()):
                        first, last = int(at[i]), int(at[i + 1])
                        if k + size > last:
                            continue
                        a, b = max(first, k - window + size), min(last, k + window)
                        around = " ".join(bytes(data[starts[j] : ends[j]]).decode() for j in range(a, b))
                        places[part.first + i].append(
                            {"h": int(chained[k].view(np.int64)), "pos": k - first, "before": k - a, "around": around}
                        )
            columns = [
                pa.array(np.arange(row, row + batch.num_rows)),
                batch.column(0),
                pa.array(n_words),
                pa.array(places, pa.list_(place)),
            ]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_words", "places"])

    return texts.mapInArrow(find, schema)


def find_passages(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, shingle: int = 3) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted texts), contaminated.

    Words are runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII characters. ``n_hit`` counts the words inside
    any occurrence of a window, each once. NULL and empty texts have no words; NULL or empty items none; repeated rows
    are judged one by one; repeated item ids add their windows. ``doc_id`` keeps its type; further columns are ignored.
    """
    spark = docs.sparkSession
    storage.prepare(spark)
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    items = storage.stored(windows(benchmark, window, shingle), "windows")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # 1 to ``shingle``
    shingles = items.dropDuplicates(["words"]).select("words", "n", "size", F.posexplode("hashes").alias("at", "h"))
    counts = _occurrences(texts, _bits(shingles), sizes)
    # The necessary prefix of a window: its rarest shingle. Windows without any occurrence need no join at all.
    rarest = shingles.join(counts, "h", "left").groupBy("words", "n").agg(
        F.min(F.struct(F.coalesce("occurrences", F.lit(0)).alias("occurrences"), "h", "at")).alias("rarest")
    )
    prefix = storage.stored(
        rarest.where("rarest.occurrences > 0").select("words", "n", "rarest.h", "rarest.at"), "prefixes"
    )
    seen = storage.stored(_candidates(texts, _bits(prefix), sizes, window), "candidates")

    first = F.col("place.pos") - F.col("at")
    within = F.col("place.before") - F.col("at")
    hits = (
        seen.where(F.size("places") > 0)
        .select("row", "n_words", F.explode("places").alias("place"))
        .join(prefix, F.col("place.h") == prefix["h"])
        .where((first >= 0) & (first + F.col("n") <= F.col("n_words")) & (within >= 0))
        .where(F.array_join(F.slice(F.split("place.around", " "), within + 1, F.col("n")), " ") == F.col("words"))
        .select("row", first.alias("first"), (first + F.col("n")).alias("last"), "words")
    )
    hits = storage.stored(hits, "hits")
    # Words covered by windows that may overlap: each adds what lies beyond all earlier ones of its document.
    earlier = Window.partitionBy("row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("row", "first", "last").distinct()
    reach = F.coalesce(F.max("last").over(earlier), F.lit(0))
    covered = (
        spans.select("row", F.greatest(F.lit(0), F.col("last") - F.greatest("first", reach)).alias("new"))
        .groupBy("row")
        .agg(F.sum("new").alias("n_hit"))
    )
    found = (
        hits.select("row", "words")
        .distinct()
        .join(items.select("words", "item_id").distinct(), "words")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    return (
        seen.select("row", F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_words")
        .join(covered.join(found, "row"), "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """``docs`` without rows whose text contains a window of the benchmark, whatever their ``doc_id``."""
    name = F.sha2("text", 256)  # NULL texts have none, and stay
    found = find_passages(docs.select(name.alias("doc_id"), "text"), benchmark, window=window).where("contaminated")
    (gone_,) = storage.unused_names(docs, "gone")
    gone = found.select(F.col("doc_id").alias(gone_)).distinct()
    return docs.join(gone, name == F.col(gone_), "left_anti")
