"""The pipeline's stages on the given documents, each held against brute force on its own input."""

from __future__ import annotations

import corpus_pipeline
from tallyloom.llm import pii, storage
from test_llm import brute_classes, brute_passages, brute_spans, check_packing


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "benchmark", "personal_data", "packed"]

    def step(name, docs):
        out = storage.stored(stages[name](spark, docs, sf_dir), name)
        rows = {r["doc_id"]: r["text"] for r in out.collect()} if name != "packed" else out.collect()
        if name != "packed":
            assert out.columns == docs.columns
        return out, rows

    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    docs, rows = step("language", docs)
    assert rows == {k: t for k, t in before.items() if any(c.isalpha() for c in t or "")}
    classes = brute_classes(sorted(rows.items()), n=5, percent=80)
    docs, kept = step("near_duplicates", docs)
    assert kept == {d: rows[d] for d, _, c in classes if d == c}
    dirty = {r[0] for r in brute_passages(kept.items(), items) if r[5]}
    docs, clean = step("benchmark", docs)
    assert clean == {d: t for d, t in kept.items() if d not in dirty}
    docs, masked = step("personal_data", docs)
    assert masked.keys() == clean.keys()
    assert not any(brute_spans(t) for t in masked.values())
    assert all(masked[d] == t for d, t in clean.items() if not pii._SIGNS.search(t))
    _, pieces = step("packed", docs)
    used = check_packing(masked.items(), pieces, 2048)
    assert used <= -(-sum(r["length"] for r in pieces) // 2048) + 1
