"""Mixtures of several sizes fitted together."""

import numpy as np
import pytest
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tallyloom.operators import em, k_sweep
from tallyloom.operators import mixture_sweep as ms


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(7)
    centres = np.array([[0.0, 0.0], [6.0, 1.0], [-3.0, 7.0]])
    x = np.vstack([rng.normal(c, [0.5, 1.0], (400, 2)) for c in centres])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)]
    rows += [(5000, None, 1.0), (5001, float("nan"), 1.0), (5002, 1.0, float("inf"))]
    return spark.createDataFrame(rows, "id int, x double, y double"), x


def plain_em(x, model, max_iter, tol):
    """EM over all rows at once, by definition."""
    w, m, c = model.weights.copy(), model.means.copy(), model.covariances.copy()
    ridge = ms.RIDGE * np.diag(c[0]).mean()
    history = []
    for step in range(max_iter + 1):
        dens = np.empty((len(x), len(w)))
        for j in range(len(w)):
            diff = x - m[j]
            power = np.einsum("ni,ij,nj->n", diff, np.linalg.inv(c[j]), diff)
            dens[:, j] = w[j] * np.exp(-0.5 * power) / np.sqrt((2 * np.pi) ** x.shape[1] * np.linalg.det(c[j]))
        history.append(np.log(dens.sum(axis=1)).sum())
        if step == max_iter or (step and abs(history[-1] - history[-2]) <= tol):
            return history, m
        share = dens / dens.sum(axis=1, keepdims=True)
        mass = share.sum(axis=0)
        m = (share.T @ x) / mass[:, None]
        c = np.array([np.cov(x.T, aweights=share[:, j], bias=True) + ridge * np.eye(x.shape[1]) for j in range(len(w))])
        w = mass / mass.sum()
    return history, m


def test_equals_plain_em_and_single_fits(points):
    df, x = points
    together = ms.fit_together(df.repartition(5), ["x", "y"], ["id"], [2, 3, 4], max_iter=30)
    start = ms.starts(df.where("x < 100 AND y < 100"), ["x", "y"], ["id"], [2, 3, 4])
    for k, model in together.items():
        history, means = plain_em(x, start[k], 30, 0.01)
        assert model.history == pytest.approx(history, rel=1e-9)
        assert model.means == pytest.approx(means, rel=1e-6, abs=1e-9)
        assert model.n_rows == len(x)
        assert all(b >= a - 1e-6 for a, b in zip(model.history, model.history[1:]))
        # One more fit, alone, from the same start.
    alone = ms.starts(df.where("x < 100 AND y < 100"), ["x", "y"], ["id"], [2, 3, 4])[3]
    while not alone.done:
        sums = ms._pass(df.where("x < 100 AND y < 100").coalesce(1), ["x", "y"], {3: alone})[3]
        ms._improve(alone, sums, len(x), ms.RIDGE * np.diag(start[3].covariances[0]).mean(), 0.01, 30)
    assert alone.bic == pytest.approx(together[3].bic, rel=1e-9)


def test_one_pass_serves_all_sizes(points, monkeypatch):
    df, _ = points
    calls = []
    once = ms._pass
    monkeypatch.setattr(ms, "_pass", lambda rows, features, models: calls.append(sorted(models)) or once(rows, features, models))
    models = ms.fit_together(df, ["x", "y"], ["id"], [1, 2, 3], max_iter=6)
    assert len(calls) == max(len(m.history) for m in models.values())
    assert calls[0] == [1, 2, 3] and all(set(b) <= set(a) for a, b in zip(calls, calls[1:]))


def test_edges(spark):
    same = spark.range(50).select("id", F.lit(2.0).alias("x"), F.col("id").cast("double").alias("y"))
    models = ms.fit_together(same, ["x", "y"], ["id"], [1, 3], max_iter=5)
    assert all(np.isfinite(m.log_likelihood) for m in models.values())
    assert models[1].means[0] == pytest.approx([2.0, 24.5])
    one = ms.fit_together(same.limit(1), ["y"], ["id"], [2], max_iter=3)[2]
    assert one.n_rows == 1 and np.isfinite(one.bic)
    with pytest.raises(ValueError, match="no rows"):
        ms.fit_together(same.limit(0), ["x"], ["id"], [2])


def test_all_components_in_one_product():
    """As by definition, also far from the origin, and many times faster than a pass per component."""
    rng = np.random.default_rng(3)
    x = rng.normal(1000.0, 3.0, (5000, 4))
    models = {}
    for k in (2, 5):
        half = rng.normal(0, 1, (k, 4, 4))
        models[k] = ms.Mixture(np.full(k, 1 / k), rng.normal(1000.0, 3.0, (k, 4)), half @ half.transpose(0, 2, 1) + 0.1 * np.eye(4))
    sums = ms._Sums({k: (m.weights, m.means, m.covariances) for k, m in models.items()})
    for part in np.array_split(x, 3):
        sums.add(part)
    for k, got in sums.about_means():
        m = models[k]
        dens = np.empty((len(x), k))
        for j in range(k):
            diff = x - m.means[j]
            power = np.einsum("ni,ij,nj->n", diff, np.linalg.inv(m.covariances[j]), diff)
            dens[:, j] = np.log(m.weights[j]) - 0.5 * power - 0.5 * np.linalg.slogdet(2 * np.pi * m.covariances[j])[1]
        top = dens.max(axis=1, keepdims=True)
        total = top + np.log(np.exp(dens - top).sum(axis=1, keepdims=True))
        share = np.exp(dens - total)
        want = [total.sum(), *share.sum(axis=0)]
        for j in range(k):
            diff = x - m.means[j]
            want += [*(share[:, j] @ diff), *((diff * share[:, j : j + 1]).T @ diff).ravel()]
        assert got == pytest.approx(np.array(want), rel=1e-8, abs=1e-6)


def test_k_sweep_makes_the_fits_of_spark_ml_in_shared_passes(points, monkeypatch):
    """As many passes as the slowest fit, none of them Spark ML's own, and its results."""
    df, x = points
    whole = df.where("id < 5000")
    passes, once = [], em._sums
    monkeypatch.setattr(em, "_sums", lambda rows, models, centre: passes.append(len(models)) or once(rows, models, centre))
    fits = k_sweep(whole, ["x", "y"], ["id"], [2, 3, 4], max_iter=12, tol=1.0, partitions=3)
    assert len(passes) == max(f.iterations for f in fits) <= 12 and passes[0] == 3
    vectors = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(whole.repartition(3, "id").sortWithinPartitions("id"))
    vectors = vectors.select("id", "features").cache()
    for fit in fits:
        alone = GaussianMixture(k=fit.k, seed=42, maxIter=12, tol=1.0).fit(vectors)
        assert (fit.iterations, fit.n_rows) == (alone.summary.numIter, len(x))
        assert fit.log_likelihood == pytest.approx(alone.summary.logLikelihood, rel=1e-9)
        assert fit.model.weights == pytest.approx(alone.weights, rel=1e-6)
        for a, b in zip(fit.model.gaussians, alone.gaussians):
            assert a.mean.toArray() == pytest.approx(b.mean.toArray(), rel=1e-6, abs=1e-9)
            assert a.cov.toArray() == pytest.approx(b.cov.toArray(), rel=1e-6, abs=1e-9)
        assert fit.model.getMaxIter() == 12 and fit.model.getFeaturesCol() == "features"
    vectors.unpersist()
    flat = whole.withColumn("x", F.lit(2.0))  # a variance of zero has no inverse
    one, other = k_sweep(flat, ["x", "y"], ["id"], [1 + 1], max_iter=4, partitions=3)[0], GaussianMixture(k=2, seed=42, maxIter=4)
    vectors = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(flat.repartition(3, "id").sortWithinPartitions("id"))
    assert one.log_likelihood == pytest.approx(other.fit(vectors.select("id", "features")).summary.logLikelihood, rel=1e-6)
    with pytest.raises(Exception, match="NaN"):
        k_sweep(df.where("id < 5000 OR id = 5002"), ["x", "y"], ["id"], [2], partitions=2)
