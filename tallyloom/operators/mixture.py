"""Gaussian-mixture clustering of wide rows with Spark ML's starts and models.

EM makes one distributed pass per iteration for all mixtures of a sweep; what
reaches the driver is a task's sums for k weights, means and covariance
matrices, whose size depends on the number of features only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from math import ceil, log

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import GaussianMixture, GaussianMixtureModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import persisted
from .em import Gaussians, fit_all


@dataclass(frozen=True)
class MixtureFit:
    """A fitted pipeline with the figures of its training run."""

    pipeline: PipelineModel
    k: int
    n_features: int
    n_rows: int
    iterations: int
    log_likelihood: float
    partitions: int

    @property
    def model(self) -> GaussianMixtureModel:
        return self.pipeline.stages[-1]

    @property
    def bic(self) -> float:
        return bic(self.log_likelihood, self.k, self.n_features, self.n_rows)

    def assign(self, df: DataFrame) -> DataFrame:
        """Every row of ``df`` with ``features``, ``probability`` and ``prediction``; also rows not trained on.

        A model fitted with ``invalid="skip"`` leaves the three NULL where a feature is NULL or NaN.
        """
        assembler = self.pipeline.stages[0]
        if assembler.getHandleInvalid() != "skip":
            return self.pipeline.transform(df)
        whole = reduce(
            Column.__and__,
            [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in assembler.getInputCols()],
        )
        done = self.pipeline.transform(df.where(whole))
        added = [f for f in done.schema.fields if f.name not in df.columns]
        rest = df.where(~whole).withColumns({f.name: F.lit(None).cast(f.dataType) for f in added})
        return done.unionByName(rest)


def bic(log_likelihood: float, k: int, d: int, n: int) -> float:
    """Bayesian information criterion of a full-covariance mixture; smaller is better."""
    parameters = (k - 1) + k * d + k * d * (d + 1) // 2
    return -2.0 * log_likelihood + parameters * log(n)


def feature_stages(features: Sequence[str], scaled: bool, invalid: str) -> list:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid=invalid)
    if not scaled:
        return [assembler]
    return [
        assembler,
        StandardScaler(inputCol="features", outputCol="features_scaled", withMean=False, withStd=True),
    ]


def standard_scale(df: DataFrame, features: Sequence[str], keep: Sequence[str], invalid: str = "error") -> DataFrame:
    """``keep`` and each feature divided by its sample standard deviation, not centred.

    The moments take one pass over the data; the projection uses them as constants.
    """
    scaled = Pipeline(stages=feature_stages(features, True, invalid)).fit(df).transform(df)
    values = vector_to_array("features_scaled")
    return scaled.select(*keep, *[values[i].alias(f"{f}_scaled") for i, f in enumerate(features)])


# Rows per partition: enough work for a task, and cached vectors well within memory. A pass of EM has two tasks per
# partition, whose results all reach the driver, so beyond a number that keeps many cores busy partitions grow instead.
ROWS_PER_PARTITION, MANY_PARTITIONS, MOST_ROWS_PER_PARTITION = 20_000, 32, 250_000


def partitions_for(n_rows: int, rows_per_partition: int | None = None) -> int:
    if rows_per_partition is not None:
        return max(1, ceil(n_rows / rows_per_partition))
    most = max(MANY_PARTITIONS, ceil(n_rows / MOST_ROWS_PER_PARTITION))
    return max(1, min(ceil(n_rows / ROWS_PER_PARTITION), most))


def arrange(
    df: DataFrame, key: Sequence[str], partitions: int | None = None, rows_per_partition: int | None = None
) -> DataFrame:
    """Fix the partitioning and row order by key, on which EM's starting points depend.

    With a unique key the same rows then give the same model, up to the order in
    which the partial sums of tasks are added. The number of partitions follows
    from the number of rows alone if it is not given, whatever the session says.
    """
    if partitions is None:
        partitions = partitions_for(df.count(), rows_per_partition)
    return df.repartition(partitions, *key).sortWithinPartitions(*key)


@contextmanager
def _vectors(
    df: DataFrame, features: Sequence[str], key: Sequence[str], scaled: bool, invalid: str, partitions: int | None
) -> Iterator[tuple[PipelineModel, DataFrame]]:
    narrow = arrange(df.select(*dict.fromkeys([*key, *features])), key, partitions)
    preparation = Pipeline(stages=feature_stages(features, scaled, invalid)).fit(narrow)
    with persisted(preparation.transform(narrow).drop(*features)) as vectors:
        yield preparation, vectors


def _start(estimator: GaussianMixture, vectors: DataFrame) -> tuple[GaussianMixtureModel, Gaussians]:
    """Spark ML's model before its first pass, and the same as arrays."""
    start = estimator.copy({estimator.maxIter: 0}).fit(vectors)
    gaussians = start.gaussians
    means, covariances = [g.mean.toArray() for g in gaussians], [g.cov.toArray() for g in gaussians]
    return start, Gaussians(np.array(start.weights), np.array(means), np.array(covariances))


def _model(spark: SparkSession, estimator: GaussianMixture, start: GaussianMixtureModel, fitted: Gaussians) -> GaussianMixtureModel:
    """``fitted`` as a model of Spark ML with the settings of ``estimator``."""
    context, jvm = spark.sparkContext, spark.sparkContext._jvm
    package, k = jvm.org.apache.spark.ml, len(fitted.weights)
    weights = context._gateway.new_array(jvm.double, k)
    gaussians = context._gateway.new_array(package.stat.distribution.MultivariateGaussian, k)
    for i in range(k):
        mean, covariance = fitted.means[i], fitted.covariances[i]
        dense = DenseMatrix(*covariance.shape, covariance.ravel(order="F"))
        weights[i] = float(fitted.weights[i])
        gaussians[i] = package.stat.distribution.MultivariateGaussian(_py2java(context, DenseVector(mean)), _py2java(context, dense))
    model = GaussianMixtureModel(package.clustering.GaussianMixtureModel(start.uid, weights, gaussians))
    return estimator._copyValues(model)


def k_sweep(
    df: DataFrame,
    features: Sequence[str],
    key: Sequence[str],
    ks: Iterable[int] = range(2, 11),
    seed: int = 42,
    max_iter: int = 100,
    tol: float = 0.01,
    scaled: bool = False,
    invalid: str = "error",
    partitions: int | None = None,
) -> list[MixtureFit]:
    """One fit per number of clusters, over one cached arrangement of the feature columns.

    Starts, steps and end of each fit are those of Spark ML's ``GaussianMixture``,
    but one pass over the rows serves all fits that still move. Give it a stored
    stage rather than a long plan: a lost executor then re-reads its part of
    ``df`` only. ``invalid`` says what a NULL feature does: ``error`` or ``skip``
    the row.
    """
    ks = list(ks)
    with _vectors(df, features, key, scaled, invalid, partitions) as (preparation, vectors):
        n_rows = vectors.count()
        n_partitions = vectors.rdd.getNumPartitions()
        column = "features_scaled" if scaled else "features"
        estimators = [GaussianMixture(featuresCol=column, k=k, seed=seed, maxIter=max_iter, tol=tol) for k in ks]
        starts, fitted = zip(*(_start(e, vectors) for e in estimators)) if ks else ((), ())
        values = vector_to_array(column)
        with persisted(vectors.select(*[values[i].alias(f"v{i}") for i in range(len(features))])) as rows:
            fit_all(rows, fitted, max_iter, tol)
        return [
            MixtureFit(
                pipeline=PipelineModel(stages=[*preparation.stages, _model(df.sparkSession, e, start, f)]),
                k=e.getK(),
                n_features=len(features),
                n_rows=n_rows,
                iterations=f.iterations,
                log_likelihood=f.log_likelihood,
                partitions=n_partitions,
            )
            for e, start, f in zip(estimators, starts, fitted)
        ]


def fit_mixture(df: DataFrame, features: Sequence[str], key: Sequence[str], k: int = 4, **options) -> MixtureFit:
    """Fit one mixture of ``k`` Gaussians; ``options`` as in ``k_sweep``."""
    return k_sweep(df, features, key, [k], **options)[0]


def mixture_sizes(predictions: DataFrame, group: str = "prediction") -> DataFrame:
    return predictions.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))


def mixture_summary(spark: SparkSession, fits: Iterable[MixtureFit]) -> DataFrame:
    """One row of training figures per fit."""
    rows = [(f.k, f.n_features, f.n_rows, f.iterations, f.log_likelihood, f.bic, f.partitions) for f in fits]
    return spark.createDataFrame(
        rows,
        "k int, n_features int, n_rows bigint, iterations int, log_likelihood double, bic double, partitions int",
    )


def save_mixture(fit: MixtureFit, path: str) -> None:
    fit.pipeline.write().overwrite().save(path)


def load_mixture(path: str) -> PipelineModel:
    return PipelineModel.load(path)
