"""Quality rules on whole texts and a log-likelihood ratio of hashed word n-grams, in built-in functions only.

Two multinomials over hash buckets of single words and word pairs are counted: one over trusted documents (a label says
so), one over all documents. A document's score is the mean log ratio of its n-grams, and a fixed threshold decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
BUCKETS = 1 << 14
THRESHOLD = -0.1
# Trusted keys up to this number are sent to every executor (some 40 MB); more are joined by shuffling.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def neighbours(runs: Column, apart: int) -> Column:
    """A hash of each element with the one so many places after it."""
    left = F.greatest(F.size(runs) - apart, F.lit(0))
    return F.zip_with(F.slice(runs, 1, left), F.slice(runs, apart + 1, left), lambda a, b: F.xxhash64(a, b))


def window_hashes(pairs: Column, window: int) -> Column:
    """A hash of each window of so many words, by doubling the hashes of two: 4, 8 words from neighbouring halves."""
    runs, size = pairs, 2
    while size < window:
        runs, size = neighbours(runs, size), 2 * size
    return runs


def measures(docs: DataFrame, window: int = 8) -> DataFrame:
    """The rows of ``docs`` as (doc_id, _hashes, _pairs, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    if window < 2 or window & (window - 1):
        raise ValueError("the window must be a power of two, 2 at least")
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select("doc_id", text.alias("_text"))
    step = step.select(
        "doc_id",
        words(F.col("_text")).alias("_words"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    step = step.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    step = step.withColumn("_pairs", neighbours(F.col("_hashes"), 1))
    step = step.withColumn("_runs", window_hashes(F.col("_pairs"), window))
    # Windows that occur again are found by sorting (hash, place); most texts repeat nothing and need no sort.
    step = step.withColumn(
        "_placed",
        F.when(
            F.size(F.array_distinct("_runs")) < F.size("_runs"),
            F.sort_array(F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    step = step.withColumn(
        "_again",
        F.sort_array(
            F.filter(
                F.transform(
                    "_placed",
                    lambda x, k: F.when(
                        (F.get("_placed", k - 1)["h"] == x["h"]) | (F.get("_placed", k + 1)["h"] == x["h"]), x["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            )
        ),
    )
    covered = F.aggregate(
        F.transform(
            "_again", lambda i, k: F.least(F.lit(window), F.coalesce(F.get("_again", k + 1) - i, F.lit(window)))
        ),
        F.lit(0),
        lambda total, n: total + n,
    )
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_runs", "_placed", "_again")


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log P(bucket | trusted) / P(bucket | all) with one added to every count; ``buckets`` numbers reach the driver."""
    ids = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("_trusted", F.lit(1))
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    hashes = F.transform(words(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w))
    grams = docs.select("doc_id", hashes.alias("_hashes"))
    grams = grams.select("doc_id", F.concat("_hashes", neighbours(F.col("_hashes"), 1)).alias("_grams"))
    rows = grams.join(ids, "doc_id", "left").select("_trusted", F.explode("_grams").alias("h"))
    rows = rows.select("_trusted", _bucket(F.col("h"), buckets).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count("_trusted").alias("t")).collect()
    n, t = [1] * buckets, [1] * buckets
    for r in counts:
        n[r["bucket"]] += r["n"]
        t[r["bucket"]] += r["t"]
    shift = math.log(sum(n) / sum(t))
    return [math.log(b / a) + shift for a, b in zip(n, t)]


def judge(
    docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, buckets: int = BUCKETS, window: int = 8
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept of every document.

    Words stand between ASCII white space. Trusted are documents with ``quality`` 1 in ``labels``. ``base_failed``: under 20 words, or over
    30 of 100 words in repeated windows. ``llr`` is the mean log ratio of a text's n-grams, 0 without any; ``kept``
    means that the base rules hold and ``llr`` reaches the threshold. NULL and empty texts have no words and fail; repeated
    rows are judged alike; without trusted documents every ratio is the same; further columns are ignored.
    """
    weights = log_ratios(docs, labels.where("quality = 1"), buckets)
    table = F.split(F.lit(",".join(f"{w:.6f}" for w in weights)), ",").cast("array<double>")
    step = measures(docs, window).withColumn("_grams", F.concat("_hashes", "_pairs"))
    total = F.aggregate("_grams", F.lit(0.0), lambda sum_, h: sum_ + F.get(table, _bucket(h, buckets)))
    step = step.withColumn("llr", F.coalesce(total / F.nullif(F.size("_grams"), F.lit(0)), F.lit(0.0)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return step.withColumn("base_failed", failed).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "llr",
        (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"),
    )
