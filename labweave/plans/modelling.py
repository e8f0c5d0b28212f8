"""Model x target runs: select features, tune, fit, score, explain, store."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labweave.ml.prep import preprocessing
from labweave.ml.regressors import REGRESSORS
from labweave.ml.validation import best_candidate, draw_ranges, eliminate_features, search
from labweave.operators.columns import quoted
from labweave.operators.metrics import regression_metrics
from labweave.operators.rows import with_fold, with_split
from labweave.sources.stores import result_rows, save_model, save_selected_features


def training_rows(table: DataFrame, features: Sequence[str], target: str, key: str, folds: int = 5) -> DataFrame:
    """Key, features, ``label``, ``is_test`` and ``fold``; rows without the target are left out."""
    kept = table.filter(F.col(quoted(target)).isNotNull()).select(
        key, *[quoted(c) for c in features], F.col(quoted(target)).cast("double").alias("label")
    )
    return with_fold(with_split(kept, key), key, folds)


def run_targets(
    table: DataFrame, features: Sequence[str], targets: Sequence[str], key: str,
    models: Mapping[str, Callable[..., Estimator]] = REGRESSORS, params: Mapping[str, Mapping] | None = None,
    model_root: str | None = None,
) -> DataFrame:
    """Fit and score every model on every target: ``(target, model, metric, value, status, reason)``.

    Preprocessing is fitted on training rows once per target. A failing model leaves a
    ``failed`` row with the reason, and the rest goes on.
    """
    rows: list[tuple] = []
    for target in targets:
        data = ready = None
        try:
            data = training_rows(table, features, target, key).persist()
            train, test = data.filter(~F.col("is_test")), data.filter("is_test")
            prep = preprocessing(features).fit(train)
            ready = prep.transform(train).persist()
            for name, regressor in models.items():
                try:
                    fitted = regressor(label="label", **(params or {}).get(name, {})).fit(ready)
                    whole = PipelineModel(stages=[prep, fitted])
                    got = regression_metrics(whole.transform(test), "label", "prediction").first()
                    rows += [(target, name, m, got[m], "ok") for m in ("mse", "rmse", "r2")]
                    if model_root:
                        save_model(whole, model_root, target, name)
                except Exception as problem:  # one model must not end the run
                    rows.append((target, name, None, None, f"failed: {problem}"))
        except Exception as problem:  # nor may one target's preprocessing
            rows += [(target, name, None, None, f"failed: {problem}") for name in models]
        finally:
            for held in (ready, data):
                if held is not None:
                    held.unpersist()
    results = result_rows(table.sparkSession, rows)
    failed = F.col("status").startswith("failed")
    return results.withColumns({"reason": F.when(failed, F.regexp_replace("status", "^failed: ", "")), "status": F.when(failed, "failed").otherwise(F.col("status"))})


def select_features(
    table: DataFrame, features: Sequence[str], target: str, key: str, model: str, path: str | None = None,
    params: Mapping | None = None, folds: int = 5, min_features: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """Ranking and curve of one model on one target; the selected list goes to the store."""
    data = training_rows(table, features, target, key, folds)
    train = data.filter(~F.col("is_test"))
    prep = preprocessing(features).fit(train)
    build = lambda _: REGRESSORS[model](label="label", **(params or {}))
    ranking, curve = eliminate_features(
        prep.transform(train).drop("features"), features, build, folds=folds, min_features=min_features
    )
    if path:
        chosen = ranking.filter("selected").select(F.lit(target).alias("target"), F.lit(model).alias("model"), "feature", "rank")
        save_selected_features(chosen, path)
    return ranking, curve


def tune_and_fit(
    table: DataFrame, features: Sequence[str], target: str, key: str, model: str, ranges: Mapping[str, tuple], trials: int,
    folds: int = 5, score_on: str = "cv",
) -> tuple[PipelineModel, DataFrame]:
    """Search, refit the best candidate on all training rows, return it with the trial table."""
    train = training_rows(table, features, target, key, folds).filter(~F.col("is_test")).persist()
    try:
        prep = preprocessing(features).fit(train)
        ready = prep.transform(train)
        candidates = draw_ranges(ranges, trials)
        results = search(ready, REGRESSORS[model], candidates, folds, score_on=score_on)
        best = REGRESSORS[model](label="label", **best_candidate(results, candidates))
        return PipelineModel(stages=[prep, Pipeline(stages=[best]).fit(ready)]), results
    finally:
        train.unpersist()
