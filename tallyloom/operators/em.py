"""Passes of expectation-maximisation for several Gaussian mixtures at a time, each as Spark ML's ``GaussianMixture`` makes it.

Spark ML works row by row and component by component, in passes of its own for every mixture. Here a task works out blocks of rows
against the components of all mixtures, and one reading of the rows serves all of them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import log, pi

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# Tasks get these functions themselves, so that executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What Spark ML adds to every weighted density, and its measure of eigenvalues that count as zero.
EPSILON = float(np.finfo(float).eps)
# Multiplications of a matrix product, at most: its rows stay in a core's cache, and the product in the task's own thread, for as many
# threads as cores in every task were measured to take ten times as long.
PRODUCT = 1 << 18


@dataclass
class Gaussians:
    """Weights, means and covariances of one mixture, and how its fit went."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    iterations: int = 0
    log_likelihood: float = -sys.float_info.max
    before: float = 0.0


def _roots(covariances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per component the root of its covariance's pseudo-inverse and the log of its pseudo-determinant."""
    values, vectors = np.linalg.eigh(covariances)
    kept = values > EPSILON * values.max(axis=1, keepdims=True) * values.shape[1]
    safe = np.where(kept, values, 1.0)
    return np.where(kept, safe**-0.5, 0.0)[:, :, None] * vectors.transpose(0, 2, 1), np.log(safe).sum(axis=1)


def _sums(rows: DataFrame, models: Sequence[Gaussians], centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From one reading of ``rows`` the log-likelihood of every mixture and, per component of all, one below the other, the sums of
    responsibilities, of rows about ``centre`` and of their products (upper triangle)."""
    sizes = [len(m.weights) for m in models]
    count, d = sum(sizes), len(centre)
    roots, log_dets = _roots(np.concatenate([m.covariances for m in models]))
    means = np.concatenate([m.means for m in models]) - centre
    # Rows of the product: first the first coordinates of all components, then the second ones; the last column is for a row's one.
    turn = roots.transpose(1, 0, 2).reshape(d * count, d)
    turn = np.hstack([turn, -np.einsum("kij,kj->ik", roots, means).reshape(d * count, 1)])
    constants = (np.log(np.concatenate([m.weights for m in models])) - 0.5 * (d * log(2 * pi) + log_dets))[:, None]
    upper = np.triu_indices(d)
    first, owner = np.cumsum([0, *sizes[:-1]]), np.repeat(np.arange(len(sizes)), sizes)
    block = min(max(PRODUCT // turn.size, 128), 1024)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, moments = np.zeros(len(sizes)), np.zeros((count, 1 + d + len(upper[0])))
        for batch in batches:
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - centre[:, None]
            for start in range(0, batch.num_rows, block):
                x = values[:, start : start + block]
                x = np.vstack([x, np.ones(x.shape[1])])
                z = turn @ x
                z *= z
                share = z.reshape(d, count, -1).sum(axis=0)
                share *= -0.5
                share += constants
                np.exp(share, out=share)
                share += EPSILON
                mass = np.add.reduceat(share, first, axis=0)
                total += np.log(mass).sum(axis=1)
                share /= mass[owner]
                moments += share @ np.vstack([x[d:], x[:d], x[upper[0]] * x[upper[1]]]).T
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total, moments.ravel()]).tobytes()])], ["sums"])

    # A few numbers per component and task, however many rows there are.
    parts = [np.frombuffer(r["sums"]) for r in rows.mapInArrow(work, "sums binary").collect()]
    whole = np.sum(parts, axis=0)
    return whole[: len(sizes)], whole[len(sizes) :].reshape(count, -1)


def _improve(model: Gaussians, log_likelihood: float, moments: np.ndarray, centre: np.ndarray) -> None:
    d, mass = len(centre), moments[:, 0]
    away = moments[:, 1 : 1 + d] / mass[:, None]
    products = np.zeros((len(mass), d, d))
    rows, columns = np.triu_indices(d)
    products[:, rows, columns] = products[:, columns, rows] = moments[:, 1 + d :] / mass[:, None]
    model.weights, model.means = mass / mass.sum(), away + centre
    model.covariances = products - away[:, :, None] * away[:, None, :]
    model.before, model.log_likelihood = model.log_likelihood, log_likelihood
    model.iterations += 1


def fit_all(rows: DataFrame, models: Sequence[Gaussians], max_iter: int, tol: float) -> None:
    """Fit ``models`` from where they stand to ``rows``, cached columns of doubles without NULL, NaN and infinity.

    A mixture stops as in Spark ML: after ``max_iter`` passes, or when a pass changed its log-likelihood by ``tol`` or less.
    """
    centre = np.mean([m.weights @ m.means for m in models], axis=0) if models else None
    while moving := [m for m in models if m.iterations < max_iter and abs(m.log_likelihood - m.before) > tol]:
        totals, moments = _sums(rows, moving, centre)
        parts = np.split(moments, np.cumsum([len(m.weights) for m in moving])[:-1])
        for model, total, part in zip(moving, totals.tolist(), parts):
            _improve(model, total, part, centre)
