"""Gaussian mixtures of several sizes fitted together: one pass over the rows per iteration for all of them."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixture import bic

# Tasks get these functions themselves, so that executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows that a component's start is made of.
START_ROWS = 5
# Added to the diagonal of every covariance, as a share of the features' mean variance.
RIDGE = 1e-9


@dataclass
class Mixture:
    """Weights, means and covariances of one mixture, and how its fit went."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    n_rows: int = 0
    iterations: int = 0
    log_likelihood: float = -np.inf
    done: bool = False
    history: list[float] = field(default_factory=list)

    @property
    def k(self) -> int:
        return len(self.weights)

    @property
    def bic(self) -> float:
        return bic(self.log_likelihood, self.k, self.means.shape[1], self.n_rows)


# Rows that are worked on together: their scores of all components stay in a core's cache.
BLOCK = 1024


def _roots(covariances: np.ndarray) -> np.ndarray:
    """Per component the transposed inverse of its covariance's Cholesky factor."""
    return np.array([np.linalg.inv(np.linalg.cholesky(c)).T for c in covariances])


def log_densities(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> np.ndarray:
    """(components, rows): log of weight times density, of all components in one product."""
    (k, d), roots = means.shape, _roots(covariances)
    # Rows of the product: first the first coordinates of all components, then the second ones.
    z = roots.transpose(2, 0, 1).reshape(d * k, d) @ np.ascontiguousarray(x.T)
    z -= np.einsum("kd,kde->ek", means, roots).reshape(d * k, 1)
    z *= z
    halves = np.log(np.diagonal(roots, axis1=1, axis2=2)).sum(axis=1)
    constants = np.log(np.maximum(weights, 1e-300)) + halves - 0.5 * d * log(2 * np.pi)
    out = z.reshape(d, k, len(x)).sum(axis=0)
    out *= -0.5
    out += constants[:, None]
    return out


class _Sums:
    """What a task adds up for several mixtures: their components lie one below the other in every matrix."""

    def __init__(self, models: Mapping[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """``models``: weights, means and covariances of each."""
        self.sizes = [(k, len(weights)) for k, (weights, _, _) in models.items()]
        self.weights, self.means, self.covariances = (np.concatenate(parts) for parts in zip(*models.values()))
        # Rows are taken about one centre, which keeps the products small.
        self.centre = np.mean([weights @ means for weights, means, _ in models.values()], axis=0)
        d = len(self.centre)
        self.total, self.moments = np.zeros(len(self.sizes)), np.zeros((len(self.means), 1 + d + d * d))

    def add(self, rows: np.ndarray) -> None:
        for start in range(0, len(rows), BLOCK):
            x = rows[start : start + BLOCK] - self.centre
            share = log_densities(x, self.weights, self.means - self.centre, self.covariances)
            at = 0
            for i, (_, size) in enumerate(self.sizes):
                own = share[at : at + size]
                top = own.max(axis=0)
                own -= top
                np.exp(own, out=own)
                mass = own.sum(axis=0)
                own /= mass
                self.total[i] += top.sum() + np.log(mass).sum()
                at += size
            products = [a * b for a in x.T for b in x.T]
            self.moments += share @ np.stack([np.ones(len(x)), *x.T, *products]).T

    def about_means(self) -> Iterator[tuple[int, np.ndarray]]:
        """Per mixture the log-likelihood, the sums of responsibilities, then per component those of rows and of products about its mean."""
        d, at = len(self.centre), 0
        for i, (k, size) in enumerate(self.sizes):
            mass, own = self.moments[at : at + size, 0], self.moments[at : at + size]
            mean, first = self.means[at : at + size] - self.centre, own[:, 1 : 1 + d]
            second = own[:, 1 + d :].reshape(size, d, d)
            shift = first - mass[:, None] * mean
            # Sum of w (x - m)(x - m)' by the sums of w, w x and w x x'.
            spread = second - mean[:, :, None] * first[:, None, :] - shift[:, :, None] * mean[:, None, :]
            yield k, np.concatenate([[self.total[i]], mass, np.hstack([shift, spread.reshape(size, d * d)]).ravel()])
            at += size


def _pass(rows: DataFrame, features: Sequence[str], models: Mapping[int, Mixture]) -> dict[int, np.ndarray]:
    """Statistics of all ``models`` from one reading of ``rows``: tasks add up their rows, a fold adds up the tasks."""
    # Arrays only: the class of the models refers to other modules of the package.
    parameters = {k: (m.weights, m.means, m.covariances) for k, m in models.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(parameters)
        for batch in batches:
            if batch.num_rows:
                sums.add(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
        for k, values in sums.about_means():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values), k), pa.int32()), pa.array(np.arange(len(values)), pa.int32()), pa.array(values, pa.float64())],
                ["k", "place", "value"],
            )

    parts = rows.select(*features).mapInArrow(work, "k int, place int, value double")
    # A few hundred numbers per mixture, however many rows there are.
    folded = parts.groupBy("k", "place").agg(F.sum("value").alias("value")).collect()
    out = {k: np.zeros(1 + m.k * (1 + m.means.shape[1] + m.means.shape[1] ** 2)) for k, m in models.items()}
    for r in folded:
        out[r["k"]][r["place"]] = r["value"]
    return out


def _improve(model: Mixture, sums: np.ndarray, n_rows: int, ridge: float, tol: float, max_iter: int) -> None:
    """One step of EM, or the end of it."""
    k, d = model.means.shape
    model.log_likelihood, model.n_rows = float(sums[0]), n_rows
    model.history.append(model.log_likelihood)
    if model.iterations >= max_iter or (len(model.history) > 1 and abs(model.history[-1] - model.history[-2]) <= tol):
        model.done = True
        return
    mass = np.maximum(sums[1 : 1 + k], 1e-300)
    blocks = sums[1 + k :].reshape(k, d + d * d)
    for j in range(k):
        if mass[j] < 1e-9:  # a component without rows stays where it is
            continue
        shift = blocks[j, :d] / mass[j]
        spread = blocks[j, d:].reshape(d, d) / mass[j] - np.outer(shift, shift)
        model.means[j] = model.means[j] + shift
        model.covariances[j] = (spread + spread.T) / 2 + ridge * np.eye(d)
    model.weights = mass / mass.sum()
    model.iterations += 1


def starts(rows: DataFrame, features: Sequence[str], key: Sequence[str], ks: Iterable[int], seed: int = 42) -> dict[int, Mixture]:
    """Starting points: each component from the mean of its own few rows, all with the rows' variances and equal weight.

    The rows are those with the smallest hash of ``key`` and seed, ``START_ROWS``
    times the largest k, so they do not depend on the partitioning; a smaller k
    takes the first of them. Fewer rows than that are used in turns.
    """
    ks = sorted(set(ks))
    moments = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("v", F.var_pop), ("m", F.avg))]).first()
    variance = np.array([moments[f"v{i}"] or 0.0 for i in range(len(features))])
    digest = F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))
    drawn = rows.select(digest.alias("_digest"), *features).orderBy("_digest", *features).limit(START_ROWS * ks[-1])
    picked = np.array([[float(r[c]) for c in features] for r in drawn.collect()]).reshape(-1, len(features))
    if not len(picked):
        raise ValueError("no rows to fit")
    floor = RIDGE * max(variance.mean(), 1e-12)
    out = {}
    for k in ks:
        means = np.array([picked[np.arange(j * START_ROWS, (j + 1) * START_ROWS) % len(picked)].mean(axis=0) for j in range(k)])
        out[k] = Mixture(np.full(k, 1 / k), means, np.array([np.diag(variance + floor)] * k))
    return out


def fit_together(
    df: DataFrame,
    features: Sequence[str],
    key: Sequence[str],
    ks: Iterable[int] = range(2, 11),
    seed: int = 42,
    max_iter: int = 100,
    tol: float = 0.01,
) -> dict[int, Mixture]:
    """One mixture of full covariances per number of components, by EM, all from the same readings of ``df``.

    An iteration reads the rows once and returns the sufficient statistics of
    every mixture that still moves; a mixture stops when its log-likelihood
    changes by ``tol`` or less, or after ``max_iter`` steps, so a sweep takes as
    many passes as its slowest mixture, not the sum of all. Each ends where it
    would end alone. Sums are taken about the present means. Rows with a NULL,
    NaN or infinite feature are left out; no rows are an error. Give it a stored
    stage: nothing is cached, and lost tasks read their part again.
    """
    values = [F.col(c).cast("double").alias(c) for c in features]
    whole = df.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(key)], *values)
    for c in features:
        whole = whole.where(F.abs(F.col(c)) < F.lit(float("inf")))
    models = starts(whole, features, [f"_key{i}" for i in range(len(key))], ks, seed)
    n_rows = whole.count()
    ridge = RIDGE * max(float(np.mean([np.diag(m.covariances[0]).mean() for m in models.values()])), 1e-12)
    while moving := {k: m for k, m in models.items() if not m.done}:
        for k, sums in _pass(whole, features, moving).items():
            _improve(models[k], sums, n_rows, ridge, tol, max_iter)
    return models


def sweep_summary(spark: SparkSession, models: Mapping[int, Mixture]) -> DataFrame:
    """One row per mixture: k, n_rows, iterations, log_likelihood, bic."""
    rows = [(k, m.n_rows, m.iterations, m.log_likelihood, m.bic) for k, m in sorted(models.items())]
    return spark.createDataFrame(rows, "k int, n_rows bigint, iterations int, log_likelihood double, bic double")
