"""Quality of texts by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The model gives a byte after up to four bytes before it, spaces between words included. N-gram counts of all trusted texts
are dealt by n-gram and joined with their contexts and their shorter n-grams, order by order; n-grams of the texts to be scored that
trusted text has not back off. Thresholds are quantiles of the perplexities of trusted texts that were not counted, by language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm import kneser_ney as kn
from tallyloom.llm import storage, textbytes

ORDERS = [5, 4, 3, 2, 1]
QUANTILE = 0.995
# Perplexities are compared in steps of this size, which makes quantiles sums of counts.
STEP = 0.001
# Bytes of texts that are scored at a time.
SLICE = 2 << 20


def count(trusted: DataFrame, orders: list[int] = ORDERS) -> DataFrame:
    """(gram, n) of the texts of the column ``text``."""
    rows = trusted.where("text is not null").select("text", F.lit(0).alias("kind"))
    counts = kn.count_events(rows, textbytes.SPACED, False, orders[0])
    return storage.stored(counts.select("gram", F.col("n0").alias("n")), "counts")


def log_probabilities(counts: DataFrame, asked: DataFrame, orders: list[int] = ORDERS) -> DataFrame:
    """(gram, v): log probability of each of the grams ``asked`` and of those of ``counts``, each gram once."""
    counts = counts.unionAll(asked.select("gram", F.lit(0).cast("long").alias("n"))).groupBy("gram").agg(F.sum("n").alias("n"))
    first, *rest = (level for _, level, _ in kn.probabilities(storage.stored(counts, "asked"), orders))
    for level in rest:
        first = first.unionAll(level)
    return first.select("gram", F.log("p").alias("v"))


def perplexities(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """The key columns of (key columns, text) and ``perplexity`` per byte, NULL for texts without words."""
    keys = [f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields[:-1]]
    names = [*texts.columns[:-1], "perplexity"]

    def score(batch: pa.RecordBatch, known: kn.Known | kn.Values) -> pa.RecordBatch:
        out = np.full(batch.num_rows, np.nan)
        for part in textbytes.slices(batch.column(len(keys)), SLICE):
            packed, bounds = kn.events(part, textbytes.SPACED, False)
            v, has = known.of(packed)
            if not has.all():
                raise ValueError("a gram of a text has no probability")
            total = np.concatenate([[0.0], np.cumsum(v)])
            n = np.diff(bounds)
            mean = (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(n, 1)
            out[part.first : part.first + len(part)] = np.where(n > 0, np.exp(-mean), np.nan)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, mask=np.isnan(out))], names)

    schema = ", ".join([*keys, "perplexity double"])
    if kn.is_small(counts):
        return kn.in_place(texts, kn.Backing.of_model(kn.probabilities(counts, ORDERS)), score, schema)
    slices = kn.pack(texts, textbytes.SPACED, False, ORDERS[0])
    asked = slices.select(F.explode("grams").alias("gram")).distinct()
    return kn.gather(slices, log_probabilities(counts, asked), ORDERS[0], score, schema)


def thresholds(rows: DataFrame, quantile: float) -> DataFrame:
    """(lang, threshold): the step that holds the quantile of (lang, perplexity); NULL is a language, '*' all together."""
    step = F.ceil(F.col("perplexity") / STEP)
    counts = rows.where("perplexity is not null").groupBy("lang", step.alias("step")).agg(F.count("*").alias("n"))
    every = counts.groupBy("step").agg(F.sum("n").alias("n")).select(F.lit("*").alias("lang"), "step", "n")
    counts = counts.unionAll(every)
    up_to = Window.partitionBy("lang").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.sum("n").over(up_to) / F.sum("n").over(Window.partitionBy("lang"))
    held = counts.withColumn("share", share).where(F.col("share") >= quantile)
    return held.groupBy("lang").agg((F.min("step") * STEP).alias("threshold"))


def judge(docs: DataFrame, labels: DataFrame, *, quantile: float = QUANTILE, folds: int = 5) -> DataFrame:
    """doc_id, lang, perplexity, threshold, kept of every document.

    Trusted are documents with ``quality`` 1 in ``labels``; those of fold 0 by key are not counted but set the thresholds. A language
    without any takes the threshold of all trusted texts, and without trusted texts nothing is kept. NULL, empty and wordless texts
    have no perplexity and are not kept. Repeated rows are judged alike; further columns are ignored.
    """
    spark = docs.sparkSession
    storage.prepare(spark)
    known = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    part = F.crc32(F.col("doc_id").cast("string")) % folds
    trusted = storage.stored(docs.join(storage.small_side(known), "doc_id").select("lang", part.alias("part"), "text"), "trusted")
    # Held trusted texts and all documents are scored in one go.
    held = trusted.where("part = 0").select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "lang", F.lit(True).alias("held"), "text")
    texts = docs.select("doc_id", "lang", F.lit(False).alias("held"), "text").unionAll(held)
    counts = count(trusted.where("part <> 0").select("text"))
    scored = storage.stored(perplexities(texts, counts), "perplexities")
    # One row per language.
    limits = storage.stored(thresholds(scored.where("held"), quantile), "thresholds")
    scored = scored.where("not held").withColumn("_lang", F.col("lang"))
    every = limits.where("lang = '*'").select(F.max("threshold").alias("every")).first()["every"]
    own = limits.where("lang is null or lang <> '*'").select(F.col("lang").alias("_of"), "threshold")
    joined = scored.join(F.broadcast(own), F.col("_lang").eqNullSafe(F.col("_of")), "left")
    threshold = F.coalesce(F.col("threshold"), F.lit(every).cast("double"))
    return joined.select("doc_id", "lang", "perplexity", threshold.alias("threshold")).withColumn(
        "kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))
    )
