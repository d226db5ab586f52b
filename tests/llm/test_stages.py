"""The pipeline's stages on planted rows."""

from __future__ import annotations

import random

import corpus_pipeline
from tallyloom.llm import decontaminate, hyperlang, jaccard_groups
from test_llm import brute_classes

ROWS = "doc_id long, text string"


def prose(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randint(0, 999)}" for _ in range(n)]


def test_near_copies_of_five_words(spark, sf_dir):
    rng = random.Random(4)
    rows = []
    for k in range(0, 40, 2):
        words = prose(rng, 200)
        changed = [*words[:60], *prose(rng, 6 + k // 2), *words[66 + k // 2 :]]
        rows += [(k, " ".join(words)), (k + 1, " ".join(changed))]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, ROWS), sf_dir)
    got = {r["doc_id"] for r in kept.collect()}
    assert got == {d for d, _, c in brute_classes(rows, n=5, percent=80) if d == c}
    assert got != {d for d, _, c in brute_classes(rows) if d == c}


def test_short_texts_of_known_languages_stay(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    short = ["Avec.", "A.", "A. All rights reserved.", "12 34", None]
    docs = given.unionAll(spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(short)], f"{ROWS}, lang string"))
    kept = {r["doc_id"] for r in hyperlang.keep_known(docs).collect()}
    assert kept == {r["doc_id"] for r in hyperlang.identify(docs).where("lang_pred <> 'und'").collect()}
    assert {-1, -2, -3} <= kept and not {-4, -5} & kept


def test_missing_and_repeated_keys(spark):
    rng = random.Random(6)
    a, b, c, d = (" ".join(prose(rng, 40)) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (1, a), (2, a), (2, c), (2, c), (3, d), (3, ""), (3, ""), (None, None)]
    docs = spark.createDataFrame(rows, ROWS)
    got = sorted(map(tuple, jaccard_groups.keep_one(docs).collect()), key=str)
    assert got == sorted([(1, a), (None, b), (2, c), (3, d), (3, ""), (None, None)], key=str)
    items = spark.createDataFrame([(1, a)], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.keep_clean(docs, items).collect()), key=str)
    assert got == sorted([r for r in rows if r[1] != a], key=str)
