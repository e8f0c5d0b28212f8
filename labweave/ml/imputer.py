"""Chained-equation imputing with Bayesian ridge regressions.

Every regression only needs cross-product sums of the filled table. Rows that miss the
same columns (one "pattern") are filled by the same linear map of their observed values,
so the sums per pattern - one scan - are enough to run all rounds on the driver in small
matrix algebra. Two scans replace rounds * columns of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labweave.operators.columns import quoted

MAX_PATTERNS = 4096
Step = tuple[int, float, list[float]]  # column, intercept, one coefficient per column (own is 0)


def bayesian_ridge(sxx: np.ndarray, sxy: np.ndarray, syy: float, n: float, rounds: int = 300, tol: float = 1e-3) -> np.ndarray:
    """Coefficients of Bayesian ridge regression from centred cross products.

    Evidence maximisation (MacKay 1992) with flat Gamma(1e-6, 1e-6) priors on the noise
    precision and the weight precision.
    """
    prior = 1e-6
    eig, vec = np.linalg.eigh(sxx)
    eig, target = np.clip(eig, 0.0, None), vec.T @ sxy
    noise, weight, last = 1.0 / (syy / n + np.finfo(float).eps), 1.0, None
    for _ in range(rounds):
        rotated = target / (eig + weight / noise)
        sse = max(syy - 2 * rotated @ target + rotated @ (eig * rotated), 0.0)
        effective = float(np.sum(noise * eig / (weight + noise * eig)))
        weight = (effective + 2 * prior) / (float(rotated @ rotated) + 2 * prior)
        noise = (n - effective + 2 * prior) / (sse + 2 * prior)
        coef = vec @ rotated
        if last is not None and np.abs(last - coef).sum() < tol:
            break
        last = coef
    return vec @ (target / (eig + weight / noise))


def _values(batch: pd.DataFrame, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = batch.to_numpy(dtype=float, na_value=np.nan) - means
    missing = np.isnan(x)
    return np.where(missing, 0.0, x), missing


def _fill(x: np.ndarray, missing: np.ndarray, steps: Sequence[Step]) -> None:
    """Apply the regressions in order to centred rows, in place."""
    for j, intercept, coef in steps:
        at = missing[:, j]
        if at.any():
            x[at, j] = intercept + x[at] @ np.asarray(coef)


def _gram_rows(pattern: str, gram: np.ndarray) -> pd.DataFrame:
    i, j = np.triu_indices(gram.shape[0])
    return pd.DataFrame({"pattern": pattern, "i": i.astype("int32"), "j": j.astype("int32"), "v": gram[i, j]})


def _pattern_grams(means: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict[str, np.ndarray] = {}
        for batch in batches:
            x, missing = _values(batch, means)
            packed, where = np.unique(missing, axis=0, return_inverse=True)
            for k, bits in enumerate(packed):
                rows = x[where.ravel() == k]
                rows = np.hstack([np.ones((len(rows), 1)), rows])
                name = "".join("1" if b else "0" for b in bits)
                grams[name] = grams.get(name, 0.0) + rows.T @ rows
            if len(grams) > MAX_PATTERNS:
                for name, gram in grams.items():
                    yield _gram_rows(name, gram)
                grams = {}
        for name, gram in grams.items():
            yield _gram_rows(name, gram)

    return run


def _gram_of_filled(means: np.ndarray, steps: Sequence[Step], j: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = None
        for batch in batches:
            x, missing = _values(batch, means)
            _fill(x, missing, steps)
            rows = x[~missing[:, j]]
            rows = np.hstack([np.ones((len(rows), 1)), rows])
            gram = rows.T @ rows if gram is None else gram + rows.T @ rows
        if gram is not None:
            yield _gram_rows("", gram)

    return run


def _round_changes(means: np.ndarray, rounds: Sequence[Sequence[Step]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worst = np.zeros(len(rounds))
        for batch in batches:
            x, missing = _values(batch, means)
            for t, steps in enumerate(rounds):
                before = x.copy()
                _fill(x, missing, steps)
                if len(x):
                    worst[t] = max(worst[t], np.abs(x - before).sum(axis=1).max())
        yield pd.DataFrame({"round": np.arange(len(rounds), dtype="int32"), "change": worst})

    return run


def _regress(gram: np.ndarray, j: int) -> tuple[float, list[float]]:
    """Bayesian ridge of column j on all others from the sums of [1, x_1 .. x_p]."""
    p = gram.shape[0] - 1
    others = [k for k in range(p) if k != j]
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    cross = gram[1:, 1:] - n * np.outer(mean, mean)
    w = bayesian_ridge(cross[np.ix_(others, others)], cross[others, j], float(max(cross[j, j], 0.0)), n)
    coef = np.zeros(p)
    coef[others] = w
    return float(mean[j] - mean @ coef), coef.tolist()


class ChainedImputerModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fills nulls by the fitted regressions; observed cells stay as they are."""

    state = Param(Params._dummy(), "state", "means and regression steps as JSON", TypeConverters.toString)

    def setState(self, means: Sequence[float], steps: Sequence[Step]) -> "ChainedImputerModel":
        return self._set(state=json.dumps({"means": list(means), "steps": list(steps)}))

    def steps(self) -> list[Step]:
        return json.loads(self.getOrDefault(self.state))["steps"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = self.getInputCols()
        state = json.loads(self.getOrDefault(self.state))
        means, steps = np.asarray(state["means"]), state["steps"]
        values = {c: F.nanvl(F.col(quoted(c)).cast("double"), F.lit(None).cast("double")) for c in names}
        if not steps:
            return dataset.withColumns({c: F.coalesce(values[c], F.lit(float(m))) for c, m in zip(names, means)})

        @F.pandas_udf("array<double>")
        def filled(*columns: pd.Series) -> pd.Series:
            x, missing = _values(pd.concat(columns, axis=1), means)
            _fill(x, missing, steps)
            return pd.Series(list(x + means))

        out = dataset.withColumns(values).withColumn("_filled", filled(*[F.col(quoted(c)) for c in names]))
        return out.withColumns({c: F.coalesce(F.col(quoted(c)), F.col("_filled")[i]) for i, c in enumerate(names)}).drop("_filled")


class ChainedImputer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Mean start; columns by ascending number of nulls, each regressed on all others.

    Stops after ``maxIter`` rounds or when the largest change of a row falls below
    ``tol`` times the largest observed value. A single column reduces to the mean fill.
    """

    maxIter = Param(Params._dummy(), "maxIter", "most rounds", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "relative change to stop at", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, maxIter=10, tol=1e-3):
        super().__init__()
        self._setDefault(maxIter=10, tol=1e-3)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> ChainedImputerModel:
        names = self.getInputCols()
        null = F.lit(None).cast("double")
        x = dataset.select(*[F.nanvl(F.col(quoted(c)).cast("double"), null).alias(f"x{i}") for i, c in enumerate(names)])
        stats = x.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count(f"x{i}").alias(f"n{i}") for i in range(len(names))],
            *[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(names))],
            *[F.max(F.abs(f"x{i}")).alias(f"a{i}") for i in range(len(names))],
        ).first()
        empty = [c for i, c in enumerate(names) if stats[f"n{i}"] == 0]
        if empty:
            raise ValueError(f"columns without any value: {empty}")
        means = np.array([stats[f"m{i}"] for i in range(len(names))])
        lacking = {i: stats["rows"] - stats[f"n{i}"] for i in range(len(names)) if stats[f"n{i}"] < stats["rows"]}
        order = sorted(lacking, key=lambda i: lacking[i])
        model = self._copyValues(ChainedImputerModel())
        if not order or len(names) == 1:
            return model.setState(means.tolist(), [])
        rounds = self._solve(x, means, order)
        floor = self.getOrDefault(self.tol) * max(stats[f"a{i}"] for i in range(len(names)))
        changes = (
            x.mapInPandas(_round_changes(means, rounds), "round int, change double")
            .groupBy("round").agg(F.max("change").alias("change")).collect()
        )
        done = [r["round"] for r in changes if r.change < floor]
        kept = rounds[: min(done) + 1] if done else rounds
        return model.setState(means.tolist(), [s for steps in kept for s in steps])

    def _solve(self, x: DataFrame, means: np.ndarray, order: Sequence[int]) -> list[list[Step]]:
        rounds = self.getOrDefault(self.maxIter)
        size = len(means) + 1
        cells = size * (size + 1) // 2
        sums = (
            x.mapInPandas(_pattern_grams(means), "pattern string, i int, j int, v double")
            .groupBy("pattern", "i", "j").agg(F.sum("v").alias("v"))
        )
        got = sums.limit(MAX_PATTERNS * cells + 1).toPandas()
        if len(got) > MAX_PATTERNS * cells:
            return self._solve_by_scans(x, means, order, rounds)
        names = sorted(got["pattern"].unique())
        index = {name: k for k, name in enumerate(names)}
        grams = np.zeros((len(names), size, size))
        k = got["pattern"].map(index).to_numpy()
        i, j, v = got["i"].to_numpy(), got["j"].to_numpy(), got["v"].to_numpy()
        grams[k, i, j] = v
        grams[k, j, i] = v
        missing = np.array([[c == "1" for c in name] for name in names])
        maps = np.zeros_like(grams)
        maps[:, 0, 0] = 1.0
        for c in range(size - 1):
            maps[~missing[:, c], c + 1, c + 1] = 1.0
        history = []
        for _ in range(rounds):
            steps = []
            for c in order:
                seen = ~missing[:, c]
                gram = np.einsum("kab,kbc,kdc->ad", maps[seen], grams[seen], maps[seen], optimize=True)
                intercept, coef = _regress(gram, c)
                maps[~seen, c + 1] = intercept * maps[~seen, 0] + np.einsum("b,kbc->kc", np.asarray(coef), maps[~seen, 1:])
                steps.append((c, intercept, coef))
            history.append(steps)
        return history

    def _solve_by_scans(self, x: DataFrame, means: np.ndarray, order: Sequence[int], rounds: int) -> list[list[Step]]:
        """One scan per regression, always from the source table; for tables with very many patterns."""
        history, done = [], []
        for _ in range(rounds):
            steps = []
            for c in order:
                rows = (
                    x.mapInPandas(_gram_of_filled(means, done + steps, c), "pattern string, i int, j int, v double")
                    .groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
                )
                gram = np.zeros((len(means) + 1, len(means) + 1))
                for r in rows:
                    gram[r.i, r.j] = gram[r.j, r.i] = r.v
                steps.append((c, *_regress(gram, c)))
            history.append(steps)
            done += steps
        return history
