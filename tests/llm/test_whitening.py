"""Whitening against numpy's own decomposition and exact whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import whitening

ROWS = "vec_id long, embedding array<float>"


def brute(rows, components=8):
    """Fit by definition: {position: (deviation, absolute whitened values)}, explained shares."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    y = np.array(x) - np.array(sums) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    return exact, y @ (vectors[:, :k] / np.sqrt(values[:k])), values[:k] / values.sum()


def test_equals_the_definition(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    good = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    got = whitening.whiten(table.withColumn("key", F.lit("x")).withColumn("n", F.lit(1))).collect()
    exact, white, explained = brute(good)
    assert len(got) == len(good) * 8 and {r["n"] for r in got} == {len(good)}
    place = {r[0]: k for k, r in enumerate(good)}
    signs = {}
    for r in got:
        k, c = place[r["vec_id"]], r["component"] - 1
        assert r["deviation"] == exact[k]
        assert r["explained"] == pytest.approx(explained[c], rel=1e-10)
        assert r["identity_error"] < 1e-9
        signs.setdefault(c, np.sign(r["whitened"] * white[k, c]))
        assert r["whitened"] == pytest.approx(signs[c] * white[k, c], abs=1e-7)


@pytest.mark.parametrize("size", [1, 2, 3, 9, 40])
def test_decomposition(size):
    rng = np.random.default_rng(size)
    for values in (rng.random(size) * 10, np.repeat(rng.random(size)[: -(-size // 3)], 3)[:size], np.ones(size), np.zeros(size)):
        q, _ = np.linalg.qr(rng.standard_normal((size, size)))
        a = (q * values) @ q.T
        a = (a + a.T) / 2
        found, vectors = whitening.eigen(a, 8)
        scale = max(np.abs(values).max(), 1e-300)
        assert found == pytest.approx(np.sort(values)[::-1][:8], abs=1e-12 * scale)
        assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-12
        assert np.abs(a @ vectors.T - vectors.T * found).max() <= 1e-12 * scale


def test_diagonal_and_clustered_covariances():
    for a in (np.diag([5.0, 5, 5, 1, 1, 0]), np.diag(np.arange(20.0)), np.ones((12, 12)) + np.eye(12)):
        found, vectors = whitening.eigen(a, 8)
        assert found == pytest.approx(np.linalg.eigvalsh(a)[::-1][:8], abs=1e-12)
        assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-12


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    good = [(k if k % 7 else None, rng.standard_normal(3).round(4).tolist()) for k in range(40)]
    good += [good[4]] * 3
    bad = [(100, None), (101, [nan, 0.0, 0.0]), (102, [inf, 0.0, 0.0]), (103, [None, 1.0, 2.0]), (104, []), (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0])]
    got = whitening.whiten(spark.createDataFrame(good + bad, ROWS).repartition(5)).collect()
    typed = [(k, np.array(v, dtype=np.float32).tolist()) for k, v in good]
    exact, white, explained = brute(typed)
    assert len(got) == 3 * len(good) and all(r["identity_error"] < 1e-9 for r in got)
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(exact)
    for c in range(3):
        mine = sorted(abs(r["whitened"]) for r in got if r["component"] == c + 1)
        assert mine == pytest.approx(sorted(np.abs(white[:, c])), abs=1e-9)
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(k, [0.5, 0.25]) for k in range(5)]):
        assert whitening.whiten(spark.createDataFrame(rows, ROWS)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 1.0, 2.0 * k]) for k in range(9)], ROWS)).collect()
    assert {r["component"] for r in flat} == {1} and flat[0]["explained"] == pytest.approx(1)


def test_deviations_beyond_a_long():
    at = whitening.Centre(2, [0, 0])
    assert at.deviations(np.array([[1 << 30, 0], [1 << 31, 5], [-(1 << 40), 1]])) == [1 << 62, None, None]
    assert at.deviations(np.array([[3, -4]])) == [100]
