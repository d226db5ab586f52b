"""Language of texts by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A run of three symbols (letters in lower case; anything else is a gap) is
the product of its letters' vectors, rotated by their places; a text is the sum of its runs, a language the sum of its
texts, and a text has the language whose sum is nearest by cosine. Letter vectors come from a hash of the code point, so that every task
makes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import storage, textbytes

DIMENSIONS = 1024
UNKNOWN = "und"
# More labels than this are no language names; a table of prototypes has this many rows at most.
MAX_LANGUAGES = 10_000
_SLICE = 256 << 10
_TRAIN_SLICE = 2 << 20


class Letters:
    """Symbols of code points and their vectors, found once per worker and dimension."""

    _made: dict[int, Letters] = {}

    @classmethod
    def of(cls, dimensions: int) -> Letters:
        if dimensions not in cls._made:
            cls._made[dimensions] = cls(dimensions)
        return cls._made[dimensions]

    def __init__(self, dimensions: int) -> None:
        self.dimensions = dimensions
        self.symbol = np.full(0x110000, -1, dtype=np.int32)
        self.row = np.zeros(0x110000, dtype=np.int32)
        self.vectors = np.zeros((0, dimensions), dtype=np.int8)
        self._add(0)
        self.symbol[0] = 0

    def _add(self, point: int) -> None:
        words = np.arange(self.dimensions // 64, dtype=np.uint64) + np.uint64(point) * np.uint64(1 << 20)
        bits = np.unpackbits(textbytes.mix64(textbytes.mix64(words)).view(np.uint8))
        self.row[point] = len(self.vectors)
        self.vectors = np.vstack([self.vectors, (1 - 2 * bits.astype(np.int8))[None, :]])

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Lower-case letters of code points, 0 for anything else."""
        out = self.symbol[points]
        if (out < 0).any():
            for p in np.unique(points[out < 0]).tolist():
                letter = chr(p)
                low = letter.lower()
                self.symbol[p] = (ord(low) if len(low) == 1 else p) if letter.isalpha() else 0
                if self.symbol[p] and not self.row[self.symbol[p]]:
                    self._add(int(self.symbol[p]))
            out = self.symbol[points]
        return out

    def runs(self, runs: np.ndarray) -> np.ndarray:
        """Vectors of packed runs of three symbols, as float32 rows."""
        a, b, c = (self.row[(runs >> shift) & 0x1FFFFF] for shift in (42, 21, 0))
        out = np.roll(self.vectors, 2, axis=1)[a] * np.roll(self.vectors, 1, axis=1)[b] * self.vectors[c]
        return out.astype(np.float32)


def text_runs(part: textbytes.Slice, letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """Packed runs of three symbols with the number of their text; a gap stands at both ends of a text."""
    lead = (part.data & 0xC0) != 0x80  # bytes that begin a character
    points = np.frombuffer(part.data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    bounds = np.concatenate([[0], np.cumsum(lead)])[part.bounds]
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(part)), n + 2)
    symbols = np.zeros(len(owner), dtype=np.int64)
    symbols[np.repeat(2 * np.arange(len(part)) + 1, n) + np.arange(len(points))] = letters.symbols(points)
    keep = np.ones(len(symbols), dtype=bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0) | (owner[1:] != owner[:-1])
    symbols, owner = symbols[keep], owner[keep]
    runs = (symbols[:-2] << 42) | (symbols[1:-1] << 21) | symbols[2:]
    whole = owner[:-2] == owner[2:]
    return runs[whole], owner[:-2][whole]


def prototypes(texts: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The bundled vector of each label of (text, lang): one row per language reaches the driver."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters.of(dimensions), {}
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), dtype=object)
            names = sorted(set(labels))
            which = np.array([names.index(x) for x in labels])
            for part in textbytes.slices(batch.column(0), _TRAIN_SLICE):
                runs, owner = text_runs(part, letters)
                distinct, inverse = np.unique(runs, return_inverse=True)
                if not len(distinct):
                    continue
                at = which[part.first + owner] * len(distinct) + inverse
                counts = np.bincount(at, minlength=len(names) * len(distinct)).reshape(len(names), -1)
                for k in range(0, len(distinct), 4096):
                    found = counts[:, k : k + 4096].astype(np.float32) @ letters.runs(distinct[k : k + 4096])
                    for name, vector in zip(names, found):
                        sums[name] = sums.get(name, 0) + vector.astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
            ["lang", "vector"],
        )

    sums = texts.where("text is not null and lang is not null").select("text", "lang")
    sums = sums.mapInArrow(bundle, "lang string, vector array<double>")
    total = sums.groupBy("lang").agg(vector_to_array(Summarizer.sum(array_to_vector("vector"))).alias("vector"))
    rows = total.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct labels are no languages")
    return {r["lang"]: np.array(r["vector"]) for r in sorted(rows, key=lambda r: r["lang"])}


def nearest(
    texts: DataFrame,
    profiles: dict[str, np.ndarray],
    dimensions: int = DIMENSIONS,
    *,
    keep_text: bool = False,
    names_out: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """(key columns, text) with the text replaced or followed by the nearest language and the cosine, 0 at least."""
    keys = texts.columns[:-1]
    kept = len(keys) + keep_text
    columns_out = [*texts.columns[:kept], *names_out]
    names = list(profiles)
    unit = np.array([v / (np.linalg.norm(v) or 1.0) for v in profiles.values()]).reshape(-1, dimensions).T

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters.of(dimensions)
        for batch in batches:
            found = np.full(batch.num_rows, -1)
            scores = np.zeros(batch.num_rows)
            for part in textbytes.slices(batch.column(len(keys)), _SLICE):
                runs, owner = text_runs(part, letters)
                if not len(runs) or not names:
                    continue
                distinct, inverse = np.unique(runs, return_inverse=True)
                vectors = np.zeros((len(part), dimensions), dtype=np.float32)
                counts = np.bincount(owner * len(distinct) + inverse, minlength=len(part) * len(distinct))
                counts = counts.reshape(len(part), -1).astype(np.float32)
                for k in range(0, len(distinct), 4096):
                    vectors += counts[:, k : k + 4096] @ letters.runs(distinct[k : k + 4096])
                vectors = vectors.astype(np.float64)
                norms = np.linalg.norm(vectors, axis=1)
                cosines = (vectors @ unit) / np.where(norms > 0, norms, 1.0)[:, None]
                has = np.bincount(owner, minlength=len(part)) > 0
                best = cosines.argmax(axis=1)
                rows = np.arange(part.first, part.first + len(part))
                found[rows] = np.where(has, best, -1)
                scores[rows] = np.where(has, np.clip(cosines[np.arange(len(part)), best], 0.0, 1.0), 0.0)
            langs = pa.array([names[k] if k >= 0 else UNKNOWN for k in found.tolist()], pa.string())
            columns = [*batch.columns[:kept], langs, pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, columns_out)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:kept]]
    return texts.mapInArrow(judge, ", ".join([*kinds, f"`{names_out[0]}` string", f"`{names_out[1]}` double"]))


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """Rows that nothing is learned from: the checksum of the key's text is a multiple of ``folds``; NULL keys too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(True))


def identify(docs: DataFrame, *, dimensions: int = DIMENSIONS, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Profiles are bundled from text and ``lang`` of documents that are not held out. A NULL text or one without a letter
    is ``und`` with score 0, as is every text where nothing could be learned. Ties go to the first label by name; repeated
    rows are judged alike; rows without ``lang`` teach nothing; further columns are ignored.
    """
    storage.prepare(docs.sparkSession)
    profiles = prototypes(docs.where(~held_out(folds=folds)).select("text", "lang"), dimensions)
    return nearest(docs.select("doc_id", held_out(folds=folds).alias("held_out"), "text"), profiles, dimensions)


def keep_known(docs: DataFrame, *, dimensions: int = DIMENSIONS, folds: int = 5) -> DataFrame:
    """``docs`` without rows whose text has no letter, which are those that ``identify`` calls ``und``; row by row.

    Nearness is no ground to go: short texts of a known language are as far from it as those of others. A NULL ``lang`` becomes the language found. Where nothing could be learned, only texts without a letter go.
    """
    storage.prepare(docs.sparkSession)
    profiles = prototypes(docs.where(~held_out(folds=folds)).select("text", "lang"), dimensions)
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    found_, near_ = storage.unused_names(docs, "found", "near")
    found = nearest(docs.select(*others, "text"), profiles, dimensions, keep_text=True, names_out=(found_, near_))
    if not profiles:
        found = found.where(F.col("text").rlike(r"\p{L}"))
    else:
        found = found.where(F.col(found_) != UNKNOWN)
        found = found.withColumn("lang", F.coalesce("lang", found_))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns))
