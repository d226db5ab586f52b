"""Toxicity of texts by two Kneser-Ney models that share what they back off to.

The models give a byte of a word after the bytes before it, up to eight with the space before the word. Either class has
counts of its own at the highest order; both back off to one model of all labelled texts, so that rare expressions are
judged alike: an event that neither class has seen says nothing. A word counts once in a text. A text's score compares its
log-likelihoods per word in both models, over the whole text and in its most toxic passages of some lengths; a logistic
fit on labelled texts that were not counted maps these to 0..1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import kneser_ney as kn
from tallyloom.llm import storage, textbytes
from tallyloom.llm.hyperlang import held_out

ORDERS = [8, 6, 4, 2, 1]
# Words of a passage.
PASSAGES = (1, 4, 16)
FEATURES = ["per_word", *(f"passage{n}" for n in PASSAGES)]
# Weight of the squares of the coefficients of standardised features.
PENALTY = 1e-4
# Bytes of texts that are scored at a time.
SLICE = 2 << 20


def class_ratios(labelled: DataFrame) -> DataFrame:
    """(gram, v): log P(event | toxic) / P(event | ordinary) of each event of (text, toxic 0 or 1)."""
    counts = storage.stored(kn.count_events(labelled, textbytes.ALNUM, True, ORDERS[0], distinct=True), "counts")
    shared = kn.probabilities(counts.select("gram", (F.col("n0") + F.col("n1")).alias("n")), ORDERS)
    pooled = shared[0][1]
    for _, level, _ in shared[1:]:
        pooled = pooled.unionAll(level)
    rows = counts.join(pooled, "gram").withColumn("context", F.shiftrightunsigned("gram", 8))
    for n in ("n0", "n1"):
        d = kn.discounts(counts, n)
        context = kn.contexts(counts, n, d).select(
            "context", F.col("total").alias(f"total_{n}"), F.col("gamma").alias(f"gamma_{n}")
        )
        seen = F.greatest(F.col(n) - kn._discount(F.col(n), d), F.lit(0.0))
        rows = rows.join(context, "context", "left").withColumn(
            f"p_{n}",
            F.when(F.col(f"total_{n}").isNull(), F.col("p")).otherwise(
                seen / F.col(f"total_{n}") + F.col(f"gamma_{n}") * F.col("p")
            ),
        )
    return rows.select("gram", F.log(F.col("p_n1") / F.col("p_n0")).alias("v"))


def compare(texts: DataFrame, ratios: DataFrame) -> DataFrame:
    """(key columns, text) with the text replaced by ``FEATURES``: log ratios of likelihood per word."""
    keys = texts.columns[:-1]

    def score(batch: pa.RecordBatch, known: kn.Known | kn.Values) -> pa.RecordBatch:
        out = np.zeros((len(FEATURES), batch.num_rows))
        for part in textbytes.slices(batch.column(len(keys)), SLICE):
            packed, bounds = kn.events(part, textbytes.ALNUM, True, distinct=True)
            if not len(packed):
                continue
            values, _ = known.of(packed)
            ends = np.flatnonzero((packed & np.uint64(0xFF)) == 0x20) + 1  # a word ends with its space
            total = np.concatenate([[0.0], np.cumsum(values)])
            words = np.diff(total[np.concatenate([[0], ends])])
            at = np.searchsorted(ends, bounds, side="right")
            n = np.diff(at)
            sums = np.concatenate([[0.0], np.cumsum(words)])
            rows = np.arange(part.first, part.first + len(part))
            out[0, rows] = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(n, 1)
            # The best run of so many words within a text; a shorter text is one passage.
            full = np.flatnonzero(n > 0)
            for k, passage in enumerate(PASSAGES, 1):
                lead = np.minimum(np.repeat(at[1:], n), np.arange(len(words)) + passage)
                out[k, rows[full]] = np.maximum.reduceat((sums[lead] - sums[:-1]) / passage, at[:-1][full])
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, out)], [*keys, *FEATURES])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1]]
    schema = ", ".join([*kinds, *(f"{f} double" for f in FEATURES)])
    if kn.is_small(ratios):
        return kn.in_place(texts, kn.Known(ORDERS[0], kn.Sorted.of_rows(ratios.select("gram", "v"))), score, schema)
    slices = kn.pack(texts, textbytes.ALNUM, True, ORDERS[0], distinct=True)
    return kn.gather(slices, ratios, ORDERS[0], score, schema)


def calibrate(rows: DataFrame, steps: int = 30) -> tuple[list[float], float]:
    """Coefficients of ``FEATURES`` and the intercept of a logistic fit to all (label, ``FEATURES``), by Newton's method.

    Tasks sum losses, gradients and curvatures; the driver gets these sums only. Without both labels: no evidence either way.
    """
    size = len(FEATURES) + 1

    def sums(beta: np.ndarray | None, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + size + size * size)
            for batch in batches:
                y, *x = (c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns)
                x = np.column_stack([*((v - c) / s for v, c, s in zip(x, centre, scale)), np.ones(len(y))])
                if beta is None:  # number of ones, sums, squares
                    total += np.concatenate([[y.sum()], x.sum(0), (x.T @ x).ravel()])
                else:
                    z = np.clip(x @ beta, -500, 500)
                    p = 1 / (1 + np.exp(-z))
                    total += np.concatenate(
                        [[np.sum(np.logaddexp(0, z) - y * z)], x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()]
                    )
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total))), pa.array(total)], ["place", "part"])

        found = rows.select("label", *FEATURES).mapInArrow(work, "place long, part double")
        out = np.zeros(1 + size + size * size)
        for r in found.groupBy("place").agg(F.sum("part").alias("part")).collect():
            out[r["place"]] = r["part"]
        return out

    first = sums(None, np.zeros(size - 1), np.ones(size - 1))
    ones, n = first[0], first[size]
    if not 0 < ones < n:
        return [1.0] * (size - 1), -1.0
    centre = first[1:size] / n
    spread = np.diag(first[1 + size :].reshape(size, size))[:-1] / n - centre**2
    scale = np.sqrt(np.where(spread > 1e-12, spread, 1.0))
    ridge = np.full(size, PENALTY)
    ridge[-1] = 0.0

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        found = sums(beta, centre, scale) / n
        curve = found[1 + size :].reshape(size, size) + np.diag(ridge + 1e-9)
        return found[0] + 0.5 * float(ridge @ beta**2), found[1 : 1 + size] + ridge * beta, curve

    beta = np.zeros(size)
    beta[-1] = np.log(ones / (n - ones))
    loss, slope, curve = at(beta)
    for _ in range(steps):
        step = np.linalg.solve(curve, slope)
        tried = at(beta - step)
        while tried[0] > loss and np.abs(step).max() > 1e-6:
            step /= 4
            tried = at(beta - step)
        gain = loss - tried[0]
        if gain > 0:
            beta, (loss, slope, curve) = beta - step, tried
        if gain < 1e-7:
            break
    weights = beta[:-1] / scale
    return weights.tolist(), float(beta[-1] - weights @ centre)


def score(docs: DataFrame, labels: DataFrame, *, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every document.

    Only documents with a label (0 or 1 in ``toxic``; others are no labels) that are not held out teach: of ``folds`` parts by key, part 0 is
    held out, the last calibrates and the others are counted. Empty, NULL and wordless texts get the score of no evidence.
    With one class only or no label at all, every score is the share of toxic labels, or 0. Repeated rows are scored alike;
    a document with several labels teaches each; further columns are ignored.
    """
    spark = docs.sparkSession
    storage.prepare(spark)
    known = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    part = F.crc32(F.col("doc_id").cast("string")) % folds
    taught = docs.where(~held_out(folds=folds)).select("doc_id", "text").join(storage.small_side(known.where(part != 0)), "doc_id")
    taught = taught.where("text is not null").withColumn("part", part)
    shares = {r["toxic"]: r["n"] for r in known.where(part != 0).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = docs.select("doc_id", held_out(folds=folds).alias("held_out"), "text")
    if len(shares) < 2:
        share = F.lit(float(shares.get(1, 0) > 0))
        out = rows.select("doc_id", "held_out", share.alias("score"))
    else:
        taught = storage.stored(taught, "taught")
        counted = taught.where(F.col("part") != folds - 1).select("text", "toxic")
        ratios = storage.stored(class_ratios(counted), "ratios")
        tried = taught.where(F.col("part") == folds - 1).select("toxic", "text")
        fit = compare(tried, ratios).withColumnRenamed("toxic", "label")
        weights, intercept = calibrate(storage.stored(fit, "calibration"))
        x = sum((F.lit(w) * F.col(f) for w, f in zip(weights, FEATURES)), F.lit(intercept))
        out = compare(rows, ratios).select("doc_id", "held_out", (1 / (1 + F.exp(-x))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
