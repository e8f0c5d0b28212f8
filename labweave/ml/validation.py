"""Cross validation, parameter search, stacking and feature elimination."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator, Model
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labweave.functions.hashing import MODULUS
from labweave.functions.lowdiscrepancy import MAX_DIMENSIONS, sobol_value
from labweave.ml.forest_trials import forest_scores, grow_alike
from labweave.ml.prep import assembler
from labweave.operators.metrics import regression_metrics
from labweave.operators.rows import best_by_rank, key_hash
from labweave.session import local_table

Build = Callable[[DataFrame], Estimator]
Score = Callable[[DataFrame], DataFrame]


def run_parallel(spark: SparkSession, tasks: Sequence[Callable], parallelism: int) -> list:
    """Run driver-side fits side by side; each only submits Spark jobs."""
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(lambda task: inheritable_thread_target(spark)(task)(), tasks))


def fold_predictions(
    df: DataFrame, build: Build, folds: int = 5, fold: str = "fold", parallelism: int = 4, keep: Sequence[str] = ("label",)
) -> DataFrame:
    """Out-of-fold predictions of a model: fit on the other folds, predict this one."""

    def one(k: int) -> DataFrame:
        train = df.filter(F.col(fold) != k)
        fitted = build(train).fit(train)
        return fitted.transform(df.filter(F.col(fold) == k)).select(fold, *keep, "prediction")

    tasks = [lambda k=k: one(k) for k in range(folds)]
    return reduce(DataFrame.unionByName, run_parallel(df.sparkSession, tasks, parallelism))


def metric_score(label: str = "label", fold: str = "fold") -> Score:
    return lambda predictions: regression_metrics(predictions, label, "prediction", [fold])


def cross_validate(
    df: DataFrame, build: Build, folds: int = 5, fold: str = "fold", label: str = "label", parallelism: int = 4,
    score: Score | None = None,
) -> DataFrame:
    """Scores per fold. ``score`` may replace the metrics; it sees the predictions with their fold."""
    predictions = fold_predictions(df, build, folds, fold, parallelism, keep=(label,))
    return (score or metric_score(label, fold))(predictions)


def draw_choices(choices: Mapping[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """n different random combinations of listed values (all of them if there are fewer)."""
    sizes = [len(v) for v in choices.values()]
    total = int(np.prod(sizes))
    picks = random.Random(seed).sample(range(total), min(n, total))
    out = []
    for pick in picks:
        params = {}
        for (name, values), size in zip(choices.items(), sizes):
            pick, at = divmod(pick, size)
            params[name] = values[at]
        out.append(params)
    return out


def draw_ranges(ranges: Mapping[str, tuple], n: int, skip: int = 1) -> list[dict]:
    """n low-discrepancy points of a box: int, float and log-float ranges."""
    if len(ranges) > MAX_DIMENSIONS:
        raise ValueError(f"at most {MAX_DIMENSIONS} parameters")
    out = []
    for i in range(skip, skip + n):
        params = {}
        for d, (name, (low, high, *log)) in enumerate(ranges.items()):
            u = sobol_value(i, d)
            if log:
                params[name] = float(10 ** (np.log10(low) + u * (np.log10(high) - np.log10(low))))
            elif isinstance(low, float):
                params[name] = float(low + u * (high - low))
            else:
                params[name] = int(low + np.floor(u * (high - low + 1)))
        out.append(params)
    return out


def search(
    df: DataFrame, regressor: Callable[..., Estimator], candidates: Sequence[Mapping], folds: int = 5, fold: str = "fold",
    label: str = "label", parallelism: int = 4, score_on: str = "cv", fixed: Mapping | None = None,
) -> DataFrame:
    """``(trial, params, mean_score, std_score, status)`` per candidate; failed trials keep a row.

    ``score_on="train"`` scores the fit on its own training rows instead of folds. The
    feature table is cached for the whole search; a candidate brings back two numbers. Forests
    that may split on any feature grow side by side, all trials and folds in the same scans.
    """
    spark = df.sparkSession
    cached = df.persist()

    def trial(k: int) -> tuple:
        params = {**(fixed or {}), **candidates[k]}
        shown = {name: str(value) for name, value in params.items()}
        build = lambda train: regressor(label=label, **params)
        try:
            if score_on == "train":
                scores = regression_metrics(build(cached).fit(cached).transform(cached), label, "prediction")
            else:
                scores = cross_validate(cached, build, folds, fold, label, parallelism=1)
            row = scores.agg(F.avg("r2").alias("m"), F.stddev_pop("r2").alias("s")).first()
            return k, shown, row.m, row.s, "ok"
        except Exception as problem:  # a bad candidate must not end the search
            return k, shown, None, None, f"failed: {problem}"

    def side_by_side() -> list[tuple] | None:
        try:
            models = [regressor(label=label, **{**(fixed or {}), **c}) for c in candidates]
            scores = forest_scores(cached, models, folds, fold, label) if grow_alike(models) else None
        except Exception:  # each trial for itself then tells what is wrong
            return None
        shown = [{name: str(value) for name, value in {**(fixed or {}), **c}.items()} for c in candidates]
        return scores and [(k, shown[k], m, s, "ok") for k, (m, s) in enumerate(scores)]

    try:
        rows = side_by_side() if score_on != "train" else None
        rows = rows or run_parallel(spark, [lambda k=k: trial(k) for k in range(len(candidates))], parallelism)
    finally:
        cached.unpersist()
    return local_table(spark, rows, "trial int, params map<string,string>, mean_score double, std_score double, status string")


def best_candidate(results: DataFrame, candidates: Sequence[Mapping]) -> Mapping:
    row = results.filter("mean_score is not null").orderBy(F.col("mean_score").desc(), "trial").first()
    if row is None:
        raise ValueError("no trial succeeded")
    return candidates[row.trial]


def fit_stacking(
    df: DataFrame, bases: Mapping[str, Build], folds: int = 5, fold: str = "fold", label: str = "label",
    features: str = "features", parallelism: int = 4,
) -> PipelineModel:
    """Base learners plus a linear model on their out-of-fold predictions.

    Inside a fold the bases are applied one after another to the same rows, so the
    level-1 table is a union of folds and needs no join. ``df`` is cached while the fits read it.
    """
    cached = df.persist()

    def chain(train: DataFrame) -> PipelineModel:
        stages = [build(train).setPredictionCol(f"p_{name}").fit(train) for name, build in bases.items()]
        return PipelineModel(stages=stages)

    def one(k: int) -> DataFrame:
        fitted = chain(cached.filter(F.col(fold) != k))
        return fitted.transform(cached.filter(F.col(fold) == k)).select(label, *[f"p_{name}" for name in bases])

    tasks = [lambda k=k: one(k) for k in range(folds)] + [lambda: chain(cached)]
    try:
        *parts, full = run_parallel(df.sparkSession, tasks, parallelism)
        level1 = assembler([f"p_{name}" for name in bases], "level1")
        final = LinearRegression(labelCol=label, featuresCol="level1")
        top = Pipeline(stages=[level1, final]).fit(reduce(DataFrame.unionByName, parts))
    finally:
        cached.unpersist()
    return PipelineModel(stages=[*full.stages, *top.stages])


def importances(model: Model) -> np.ndarray:
    """Feature importances of a tree model, or absolute coefficients of a linear one."""
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    return np.abs(model.coefficients.toArray())


def eliminate_features(
    df: DataFrame, features: Sequence[str], build: Build, label: str = "label", fold: str = "fold", folds: int = 5,
    min_features: int = 5, step: int = 1, parallelism: int = 4, importance: Callable[[Model], np.ndarray] = importances,
) -> tuple[DataFrame, DataFrame]:
    """Recursive feature elimination with cross validation.

    Returns ``ranking(feature, rank, selected)`` and ``curve(n_features, r2, rmse)``. Each
    fold runs its own elimination path and scores every size on its held-out rows; the
    size with the best mean R2 wins (fewer features on a tie). The curve takes the scores that
    the paths left of the same fold and features, and fits only what no path did. ``df`` holds
    numeric, null-free feature columns; it is cached while the paths run.
    """
    spark = df.sparkSession
    cached = df.select(*features, label, fold).persist()
    least = min(min_features, len(features))

    def fit(train: DataFrame, kept: Sequence[str]) -> PipelineModel:
        return Pipeline(stages=[assembler(kept), build(train)]).fit(train)

    known: dict[tuple[int, tuple[str, ...]], tuple[float | None, float | None]] = {}  # R2 and RMSE by fold and features

    def score(fitted: PipelineModel, k: int, kept: Sequence[str]) -> None:
        row = regression_metrics(fitted.transform(cached.filter(F.col(fold) == k)), label, "prediction").first()
        known[k, tuple(kept)] = row.r2, row.rmse

    def path(train: DataFrame, stop: int, k: int | None) -> list[list[str]]:
        kept, dropped = list(features), []
        while True:
            fitted = fit(train, kept)
            if k is not None:
                score(fitted, k, kept)
            if len(kept) <= stop:
                return [kept, *dropped[::-1]]
            weights = importance(fitted.stages[-1])
            count = min(step, len(kept) - stop)
            worst = sorted(range(len(kept)), key=lambda i: (weights[i], i))[:count]
            dropped.append([kept[i] for i in worst])
            kept = [c for i, c in enumerate(kept) if i not in worst]

    def others(k: int) -> DataFrame:
        return cached.filter(F.col(fold) != k)

    try:
        run_parallel(spark, [lambda k=k: path(others(k), least, k) for k in range(folds)], parallelism)
        by_size: dict[int, list[float]] = {}
        for (_, kept), (r2, _) in sorted(known.items()):
            if r2 is not None:
                by_size.setdefault(len(kept), []).append(r2)
        best = min(by_size, key=lambda size: (-float(np.mean(by_size[size])), size)) if by_size else least
        order = path(cached, best, None)
        rows = [(name, rank, rank == 1, features.index(name)) for rank, names in enumerate(order, start=1) for name in names]
        ranking = local_table(spark, rows, "feature string, rank int, selected boolean, position int")

        def at_size(n: int) -> tuple[str, ...]:
            chosen = [r.feature for r in best_by_rank(ranking, [], "rank", "position", n).collect()] if n != best else order[0]
            return tuple(sorted(chosen, key=features.index))

        sizes = range(least, len(features) + 1)
        chosen = dict(zip(sizes, run_parallel(spark, [lambda n=n: at_size(n) for n in sizes], parallelism)))
        missing = [(k, kept) for kept in chosen.values() for k in range(folds) if (k, kept) not in known]
        run_parallel(spark, [lambda k=k, kept=kept: score(fit(others(k), kept), k, kept) for k, kept in missing], parallelism)

        def mean(kept: tuple[str, ...], at: int) -> float | None:
            found = [known[k, kept][at] for k in range(folds) if known[k, kept][at] is not None]
            return float(np.mean(found)) if found else None

        curve = [(n, None, None) for n in range(1, least)] + [(n, mean(chosen[n], 0), mean(chosen[n], 1)) for n in sizes]
    finally:
        cached.unpersist()
    return ranking.drop("position"), local_table(spark, curve, "n_features int, r2 double, rmse double")


def halving_rungs(n: int, least_share: float, eta: int = 3) -> list[tuple[int, float]]:
    """Trials and share of the rows of each rung: from ``n`` trials on ``least_share`` of the rows, ``eta`` times fewer on ``eta`` times more."""
    rungs, share = [], least_share
    while True:
        rungs.append((n, share if share < 1 - 1e-9 else 1.0))
        if n <= 1 or rungs[-1][1] == 1:
            return rungs
        n, share = max(1, n // eta), share * eta


def hyperband_brackets(n: int, eta: int = 3, least_share: float | None = None) -> list[list[tuple[int, float]]]:
    """Brackets that trade trials for rows: the first starts ``n`` trials on the smallest share, the last one a few on all rows."""
    share = least_share or 1 / n
    levels = 0
    while share * eta ** (levels + 1) <= 1 + 1e-9:
        levels += 1
    out = []
    for s in range(levels, -1, -1):
        start = max(1, -(-n // eta ** (levels - s)))
        out.append(halving_rungs(start, eta ** -float(s), eta))
    return out


def successive_halving(
    df: DataFrame, key: str, regressor: Callable[..., Estimator], candidates: Sequence[Mapping], brackets: Sequence[Sequence[tuple[int, float]]],
    folds: int = 5, fold: str = "fold", label: str = "label", parallelism: int = 4, seed: int = 42, fixed: Mapping | None = None,
) -> DataFrame:
    """``(bracket, rung, trial, candidate, share, n_rows, mean_score, promoted, status)``.

    Every bracket takes its candidates in turn from the list. A rung scores its trials by cross validation on a share of the rows, those
    whose key hash lies below it, so a larger share holds the smaller one; the best go on to the next rung. Failed trials go out.
    Ties go to the earlier candidate.
    """
    spark = df.sparkSession
    hashed = df.withColumn("_share", key_hash(df, key, seed + 7) / F.lit(float(MODULUS))).persist()
    rows: list[tuple] = []
    taken = 0

    def score(part: DataFrame, candidate: int) -> tuple[float | None, str]:
        try:
            scores = cross_validate(part, lambda _: regressor(label=label, **{**(fixed or {}), **candidates[candidate]}), folds, fold, label, parallelism=1)
            return scores.agg(F.avg("r2").alias("m")).first().m, "ok"
        except Exception as problem:  # a bad candidate must not end the search
            return None, f"failed: {problem}"

    try:
        for b, rungs in enumerate(brackets):
            if taken + rungs[0][0] > len(candidates):
                raise ValueError(f"{sum(r[0][0] for r in brackets)} candidates are needed, not {len(candidates)}")
            alive = list(range(taken, taken + rungs[0][0]))
            taken += rungs[0][0]
            for i, (_, share) in enumerate(rungs):
                part = hashed.where(F.col("_share") < share)
                n_rows = part.count()
                found = run_parallel(spark, [lambda c=c: score(part, c) for c in alive], parallelism)
                fine = sorted((c for c, (m, _) in zip(alive, found) if m is not None), key=lambda c: (-found[alive.index(c)][0], c))
                promoted = set(fine[: rungs[i + 1][0]]) if i + 1 < len(rungs) else set()
                rows += [(b, i, t, c, float(share), n_rows, m, c in promoted, status) for t, (c, (m, status)) in enumerate(zip(alive, found))]
                alive = [c for c in alive if c in promoted]
    finally:
        hashed.unpersist()
    kinds = "bracket int, rung int, trial int, candidate int, share double, n_rows bigint, mean_score double, promoted boolean, status string"
    return local_table(spark, rows, kinds)


def best_of_halving(results: DataFrame, candidates: Sequence[Mapping]) -> Mapping:
    """The best candidate among those scored on the largest share."""
    row = results.where("mean_score is not null").orderBy(F.col("share").desc(), F.col("mean_score").desc(), "candidate").first()
    if row is None:
        raise ValueError("no trial succeeded")
    return candidates[row.candidate]
