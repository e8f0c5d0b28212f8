"""Regressor presets in one parameter vocabulary.

``n_trees, max_depth, min_split, min_leaf, row_fraction, column_fraction,
learning_rate, num_leaves, l2``. Forests and plain boosting are Spark's; their trees know no split
minimum, so ``min_split`` raises the leaf minimum to half of it. Bagging and the three boosting slots are the library's own
(``histogram_trees``): they hold ``num_leaves``, ``l2`` and ``min_split`` exactly and draw rows and columns once for each tree.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.ml.base import Estimator
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labweave.ml.histogram_trees import HistogramTrees
from labweave.operators.columns import quoted

SEED = 42
MAX_DEPTH = 30


def _depth(params: Mapping) -> int:
    """The depth asked for; none means as deep as Spark's trees go, and more than that is an error."""
    depth = params.get("max_depth") or MAX_DEPTH
    if depth > MAX_DEPTH:
        raise ValueError(f"trees have a depth of at most {MAX_DEPTH}, not {depth}")
    return int(depth)


def _leaf(params: Mapping) -> int:
    return int(max(params.get("min_leaf", 1), params.get("min_split", 2) // 2, 1))


def _columns(fraction: float | None) -> str:
    return "all" if fraction is None or fraction >= 1.0 else str(fraction)


def random_forest(label: str = "label", features: str = "features", **params) -> RandomForestRegressor:
    return RandomForestRegressor(
        labelCol=label, featuresCol=features, seed=SEED,
        numTrees=int(params.get("n_trees", 100)), maxDepth=_depth({"max_depth": 10, **params}), minInstancesPerNode=_leaf(params),
        subsamplingRate=float(params.get("row_fraction", 1.0)),
        featureSubsetStrategy=_columns(params.get("column_fraction")),
    )


def _own(label: str, features: str, params: Mapping) -> HistogramTrees:
    whole = {name: int(params[name]) for name in ("n_trees", "max_depth", "num_leaves", "min_leaf", "min_split") if params.get(name) is not None}
    return HistogramTrees(labelCol=label, featuresCol=features, **{**params, **whole})


def bagged_trees(label: str = "label", features: str = "features", **params) -> HistogramTrees:
    """Bootstrap-aggregated trees: Poisson weights of the rows (of mean ``row_fraction``) and a subset of the columns for each tree."""
    return _own(label, features, {"bagging": True, "n_trees": 100, "max_depth": 10, "seed": SEED, **params})


def gradient_boosting(label: str = "label", features: str = "features", **params) -> GBTRegressor:
    return GBTRegressor(
        labelCol=label, featuresCol=features, seed=SEED,
        maxIter=int(params.get("n_trees", 100)), maxDepth=_depth({"max_depth": 3, **params}), minInstancesPerNode=_leaf(params),
        stepSize=float(params.get("learning_rate", 0.1)), subsamplingRate=float(params.get("row_fraction", 1.0)),
        featureSubsetStrategy=_columns(params.get("column_fraction")),
    )


def boosting_preset(**defaults) -> Callable[..., HistogramTrees]:
    return lambda label="label", features="features", **params: _own(label, features, {"seed": SEED, **defaults, **params})


# defaults of the three boosting slots
depthwise_boosting = boosting_preset(growth="level", max_depth=6, learning_rate=0.3, l2=1.0)
leafwise_boosting = boosting_preset(growth="leaf", num_leaves=31, learning_rate=0.1, max_depth=None, min_leaf=20)
symmetric_boosting = boosting_preset(growth="symmetric", max_depth=6, learning_rate=0.03, l2=3.0)

REGRESSORS: dict[str, Callable[..., Estimator]] = {
    "RF": random_forest,
    "BR": bagged_trees,
    "GBDT": gradient_boosting,
    "XGB": depthwise_boosting,
    "LGBM": leafwise_boosting,
    "CB": symmetric_boosting,
}


def ridge(train: DataFrame, alpha: float = 1.0, label: str = "label", features: str = "features") -> LinearRegression:
    """Least squares with ``alpha * |w|^2``; reads the label's deviation and count first.

    Spark scales the penalty by n and by the label's sample deviation, hence the factor.
    """
    row = train.agg(F.stddev_samp(quoted(label)).alias("dev"), F.count(quoted(label)).alias("n")).first()
    return LinearRegression(
        labelCol=label, featuresCol=features, solver="l-bfgs", elasticNetParam=0.0, standardization=False,
        regParam=alpha * (row.dev or 0.0) / row.n, tol=1e-12, maxIter=500,
    )


def lasso(alpha: float = 0.01, label: str = "label", features: str = "features") -> LinearRegression:
    """Least squares with ``alpha * |w|`` on the mean squared error over two."""
    return LinearRegression(
        labelCol=label, featuresCol=features, elasticNetParam=1.0, standardization=False, regParam=alpha, tol=1e-10, maxIter=1000
    )
