"""Feature vectors, scaling and the Gaussian mixture."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import floor_positive_columns
from ..operators import (
    MixtureFit,
    fit_mixture,
    fit_together,
    k_sweep,
    load_mixture,
    mixture_sizes,
    mixture_summary,
    save_mixture,
    standard_scale,
    sweep_summary,
)
from ..operators.mixture import feature_stages
from ..plans import standin
from ..plans.standin import with_sections
from ..sources import StageStore
from .registry import query

FLOORED = {"a_share": "a_feature", "r_share": "r_feature", "n_share": "n_feature"}
FEATURES = [*FLOORED.values(), "quantity"]
K = 4


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = floor_positive_columns(standin.sections(spark, sf_dir), FLOORED)
    total = F.col("a_votes") + F.col("r_votes") + F.col("n_votes")
    return rows.select("order_id", *FLOORED.values(), (total / F.lit(100.0)).alias("quantity"))


def _stage(spark: SparkSession, sf_dir: str) -> tuple[StageStore, DataFrame]:
    store = StageStore(spark)
    return store, store.write("features", _rows(spark, sf_dir))


def _fit(spark: SparkSession, sf_dir: str) -> tuple[StageStore, DataFrame, MixtureFit]:
    store, rows = _stage(spark, sf_dir)
    return store, rows, fit_mixture(rows, FEATURES, ["order_id"], k=K)


_FEATURES_SQL = """feat AS (
  SELECT order_id, CASE WHEN a_share > 0 THEN a_share ELSE CAST(0.001 AS DOUBLE) END AS a_feature,
         CASE WHEN r_share > 0 THEN r_share ELSE CAST(0.001 AS DOUBLE) END AS r_feature,
         CASE WHEN n_share > 0 THEN n_share ELSE CAST(0.001 AS DOUBLE) END AS n_feature,
         (a_votes + r_votes + n_votes) / CAST(100 AS DOUBLE) AS quantity FROM sec)"""


@query(
    "feature_vector",
    with_sections(f", {_FEATURES_SQL} SELECT order_id, a_feature AS v0, r_feature AS v1, n_feature AS v2, quantity AS v3 FROM feat"),
)
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assembled vector, read out again."""
    rows = _rows(spark, sf_dir)
    vectors = Pipeline(stages=feature_stages(FEATURES, False, "error")).fit(rows).transform(rows)
    values = vector_to_array("features")
    return vectors.select("order_id", *[values[i].alias(f"v{i}") for i in range(len(FEATURES))])


@query(
    "standard_scale",
    with_sections(
        f""", {_FEATURES_SQL}, dev AS (SELECT STDDEV_SAMP(a_feature) AS a, STDDEV_SAMP(r_feature) AS r,
                                          STDDEV_SAMP(n_feature) AS n, STDDEV_SAMP(quantity) AS q FROM feat)
        SELECT order_id, ROUND(a_feature / a, 9) AS a_feature_scaled, ROUND(r_feature / r, 9) AS r_feature_scaled,
               ROUND(n_feature / n, 9) AS n_feature_scaled, ROUND(quantity / q, 9) AS quantity_scaled FROM feat, dev"""
    ),
)
def q_standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = _stage(spark, sf_dir)
    scaled = standard_scale(rows, FEATURES, ["order_id"])
    return scaled.select("order_id", *[F.round(f"{f}_scaled", 9).alias(f"{f}_scaled") for f in FEATURES])


def _log_density(fit: MixtureFit, values: Column, component: int) -> Column:
    """Log of weight times density of one component, from its parameters."""
    gaussian = fit.model.gaussians[component]
    mean, covariance = gaussian.mean.toArray(), gaussian.cov.toArray()
    inverse, (_, log_det) = np.linalg.inv(covariance), np.linalg.slogdet(covariance)
    away = [F.get(values, i) - F.lit(float(m)) for i, m in enumerate(mean)]
    square = reduce(
        Column.__add__,
        [F.lit(float(inverse[i, j])) * x * y for i, x in enumerate(away) for j, y in enumerate(away)],
    )
    return F.lit(float(np.log(fit.model.weights[component]) - log_det / 2)) - square / 2


@query(
    "mixture_fit",
    with_sections("SELECT order_id, 1 AS label_in_range, 1 AS most_probable, 1 AS label_recomputed FROM sec"),
)
def mixture_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section with what holds for its label, which is also recomputed from weights, means and covariances."""
    _, rows, fit = _fit(spark, sf_dir)
    labelled = fit.assign(rows)
    values = vector_to_array("features")
    densities = F.array(*[_log_density(fit, values, c) for c in range(K)])
    checks = {
        "label_in_range": F.col("prediction").between(0, K - 1),
        "most_probable": F.array_max(vector_to_array("probability")) >= 1 / K - 1e-9,
        "label_recomputed": F.get(densities, F.col("prediction")) >= F.array_max(densities) - 1e-6,
    }
    return labelled.select("order_id", *[check.cast("int").alias(name) for name, check in checks.items()])


@query(
    "mixture_invariants",
    with_sections(
        """SELECT COUNT(*) AS n_rows, COUNT(DISTINCT order_id) AS n_keys, COUNT(*) AS n_probabilities_sum_to_one,
                  COUNT(*) AS n_groups_in_range, COUNT(*) AS n_most_probable FROM sec"""
    ),
)
def mixture_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for every fit: each section once, in its most probable group, probabilities adding up."""
    _, rows, fit = _fit(spark, sf_dir)
    p = vector_to_array("probability")
    checked = fit.assign(rows).select(
        "order_id",
        (F.abs(F.aggregate(p, F.lit(0.0), lambda x, y: x + y) - 1) < 1e-6).cast("bigint").alias("whole"),
        F.col("prediction").between(0, 3).cast("bigint").alias("inside"),
        (F.get(p, F.col("prediction")) == F.array_max(p)).cast("bigint").alias("best"),
    )
    return checked.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("order_id").alias("n_keys"),
        F.sum("whole").alias("n_probabilities_sum_to_one"),
        F.sum("inside").alias("n_groups_in_range"),
        F.sum("best").alias("n_most_probable"),
    )


def _checked_sizes(sizes: DataFrame) -> DataFrame:
    inside = F.sum(F.when(F.col("prediction").between(0, K - 1), 0).otherwise(1))
    return sizes.agg(F.sum("n_rows").alias("n_rows"), inside.alias("n_groups_out_of_range"))


_SIZES_SQL = with_sections("SELECT COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS n_groups_out_of_range FROM sec")


@query("mixture_sizes", _SIZES_SQL)
def q_mixture_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows, fit = _fit(spark, sf_dir)
    return _checked_sizes(mixture_sizes(fit.assign(rows)))


@query("mixture_scaled_fit", _SIZES_SQL)
def mixture_scaled_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant that fits scaled features."""
    _, rows = _stage(spark, sf_dir)
    fit = fit_mixture(rows, FEATURES, ["order_id"], k=K, seed=12345, scaled=True)
    return _checked_sizes(mixture_sizes(fit.assign(rows)))


def _checked_summary(summary: DataFrame) -> DataFrame:
    """The figures that are certain, and whether the others fit them."""
    k, d = F.col("k"), F.col("n_features")
    parameters = (k - 1) + k * d + k * d * (d + 1) / 2
    expected = -2 * F.col("log_likelihood") + parameters * F.log(F.col("n_rows"))
    return summary.select(
        "k",
        "n_features",
        "n_rows",
        (F.abs(F.col("bic") - expected) <= 1e-9 * F.abs(expected)).cast("int").alias("bic_fits"),
        F.col("iterations").between(1, 100).cast("int").alias("iterations_fit"),
    )


def _summary_sql(ks: str) -> str:
    return with_sections(
        f"""SELECT CAST(k AS INTEGER) AS k, CAST({len(FEATURES)} AS INTEGER) AS n_features, COUNT(*) AS n_rows, 1 AS bic_fits,
            1 AS iterations_fit FROM sec, {ks} AS ks(k) GROUP BY k"""
    )


@query("mixture_summary", _summary_sql(f"range({K}, {K + 1})"))
def q_mixture_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, fit = _fit(spark, sf_dir)
    return _checked_summary(mixture_summary(spark, [fit]))


@query("mixture_k_sweep", _summary_sql("range(2, 11)"))
def mixture_k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = _stage(spark, sf_dir)
    return _checked_summary(mixture_summary(spark, k_sweep(rows, FEATURES, ["order_id"])))


@query(
    "mixture_save_load",
    with_sections("SELECT COUNT(*) AS n_rows, COUNT(*) AS n_same FROM sec"),
)
def mixture_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored and reloaded model labels every section as the fitted one does."""
    store, rows, fit = _fit(spark, sf_dir)
    save_mixture(fit, store.path("model"))
    loaded = load_mixture(store.path("model"))
    before = fit.assign(rows).withColumnRenamed("prediction", "before").drop("features", "probability")
    both = loaded.transform(before)
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum((F.col("before") == F.col("prediction")).cast("bigint")).alias("n_same"),
    )


@query("mixture_sweep")
def q_mixture_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixtures of 2 to 10 components from the same passes, with the figure by which one is chosen."""
    _, rows = _stage(spark, sf_dir)
    return sweep_summary(spark, fit_together(rows, FEATURES, ["order_id"], range(2, 11), max_iter=20))


@query(
    "mixture_sweep_closed_form",
    with_sections(
        f""", {_FEATURES_SQL},
        kept AS (SELECT a_feature AS x, quantity AS y FROM feat WHERE a_feature IS NOT NULL AND quantity IS NOT NULL),
        v AS (SELECT COUNT(*) AS n, VAR_POP(x) * VAR_POP(y) - pow(COVAR_POP(x, y), 2) AS det FROM kept)
        SELECT CAST(1 AS INTEGER) AS k, n AS n_rows, CAST(1 AS INTEGER) AS grows,
               ROUND(-(2 * ln(2 * pi()) + ln(det) + 2) / 2, 5) AS per_row FROM v"""
    ),
)
def q_mixture_sweep_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of mixtures of 1 to 3 components fitted together, the first must be the one Gaussian; no fit's likelihood falls."""
    _, rows = _stage(spark, sf_dir)
    models = fit_together(rows, ["a_feature", "quantity"], ["order_id"], [1, 2, 3], max_iter=10)
    grows = all(b >= a - 1e-6 * abs(a) for m in models.values() for a, b in zip(m.history, m.history[1:]))
    one = sweep_summary(spark, models).where("k = 1")
    return one.select("k", "n_rows", F.lit(int(grows)).alias("grows"), F.expr("ROUND(log_likelihood / n_rows, 5)").alias("per_row"))
