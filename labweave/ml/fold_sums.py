"""Ridge, lasso and least squares for all penalties and folds from one scan of the rows.

A scan gives, for each fold, the number of rows, the means, and the products about the means of all features and the label. Folds add
up, so the rows left after taking out one fold, their solution for every penalty, and its errors on the fold taken out all follow on
the driver from matrices as large as the features, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labweave.operators.columns import quoted
from labweave.session import local_table

SCORES = "alpha double, fold int, n bigint, mse double, r2 double"
SWEEPS, STILL = 10_000, 1e-12


@dataclass
class Moments:
    """Rows, means, and products about the means; the label is the last column."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(axis=0)
        away = x - mean
        return cls(float(len(x)), mean, away.T @ away)

    def __add__(self, other: Moments) -> Moments:
        """Merged without sums of raw squares, so that large offsets cost no digits."""
        n = self.n + other.n
        apart = other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n))


def _merged(parts: Sequence[Moments]) -> Moments | None:
    whole = None
    for part in parts:
        whole = part if whole is None else whole + part
    return whole


def fold_moments(df: DataFrame, features: Sequence[str], label: str = "label", fold: str = "fold") -> dict[int, Moments]:
    """The moments of every fold in one scan. Rows without a label, a fold or any feature are left out.

    A task sends one row for each fold it met; these are merged fold by fold on the executors.
    """
    width = len(features) + 1
    kind = "fold int, n double, mean array<double>, products array<double>"

    def listed(found: dict[int, Moments]) -> pa.Table:
        columns = [list(found), [m.n for m in found.values()], [m.mean.tolist() for m in found.values()], [m.products.ravel().tolist() for m in found.values()]]
        types = (pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["fold", "n", "mean", "products"])

    def read(rows: pa.Table) -> list[Moments]:
        columns = (rows[c].to_pylist() for c in ("n", "mean", "products"))
        return [Moments(n, np.array(mean), np.array(products).reshape(width, width)) for n, mean, products in zip(*columns, strict=True)]

    def run(batches):
        found: dict[int, Moments] = {}
        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(width)])
            folds = batch.column(0).to_numpy(zero_copy_only=False)
            whole = ~np.isnan(x).any(axis=1)
            for k in np.unique(folds[whole]).tolist():
                part = Moments.of(x[whole & (folds == k)])
                found[int(k)] = found[int(k)] + part if int(k) in found else part
        yield from listed(found).to_batches()

    def merge(group: pa.Table) -> pa.Table:
        return listed({group["fold"][0].as_py(): _merged(read(group))})

    columns = [F.col(quoted(c)).cast("double").alias(f"x{i}") for i, c in enumerate([*features, label])]
    rows = df.where(F.col(quoted(fold)).isNotNull()).select(F.col(quoted(fold)).cast("int").alias("fold"), *columns)
    got = rows.mapInArrow(run, kind).groupBy("fold").applyInArrow(merge, kind).toArrow().combine_chunks()
    return dict(sorted(zip(got["fold"].to_pylist(), read(got), strict=True)))


def ridge_weights(train: Moments, alpha: float) -> np.ndarray:
    """Of least squares with ``alpha * |w|^2``; features without spread get no weight."""
    xx, xy = train.products[:-1, :-1], train.products[:-1, -1]
    return np.linalg.lstsq(xx + alpha * np.eye(len(xy)), xy, rcond=None)[0]


def lasso_weights(train: Moments, alpha: float) -> np.ndarray:
    """Of half the mean squared error with ``alpha * |w|``, by coordinate descent on the products."""
    xx, xy = train.products[:-1, :-1] / train.n, train.products[:-1, -1] / train.n
    w = np.zeros(len(xy))
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    for _ in range(SWEEPS):
        moved = 0.0
        for j in np.flatnonzero(np.diag(xx) > 0):
            rest = xy[j] - xx[j] @ w + xx[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - alpha, 0.0) / xx[j, j]
            moved, w[j] = max(moved, abs(new - w[j]) * scale[j]), new
        if moved <= STILL * max(np.sqrt(train.products[-1, -1] / train.n), 1e-300):
            break
    return w


SOLVERS = {"ridge": ridge_weights, "lasso": lasso_weights}


def squared_errors(held: Moments, train: Moments, w: np.ndarray) -> float:
    """The sum of squared errors on the held-out rows of the line through the training means with these weights."""
    direction = np.append(-w, 1.0)
    offset = float(direction @ (held.mean - train.mean))
    return float(direction @ held.products @ direction) + held.n * offset * offset


def penalty_path(
    df: DataFrame, features: Sequence[str], alphas: Sequence[float], kind: str = "ridge", label: str = "label", fold: str = "fold"
) -> tuple[DataFrame, dict[float, tuple[np.ndarray, float]]]:
    """Scores ``(alpha, fold, n, mse, r2)`` on every fold of the fit on the other folds, and weights and intercept of each fit on all rows.

    ``alpha`` 0 of ridge is plain least squares. A fold without spread of the label has no R2; with one fold only there are no scores.
    """
    solve = SOLVERS[kind]
    folds = fold_moments(df, features, label, fold)
    if not folds:
        raise ValueError("no complete rows")
    rows, fits = [], {}
    whole = _merged(list(folds.values()))
    for alpha in alphas:
        w = solve(whole, alpha)
        fits[alpha] = w, float(whole.mean[-1] - whole.mean[:-1] @ w)
        for k, held in folds.items():
            train = _merged([m for i, m in folds.items() if i != k])
            if train is None:
                continue
            error, spread = squared_errors(held, train, solve(train, alpha)), float(held.products[-1, -1])
            rows.append((float(alpha), k, int(held.n), error / held.n, 1 - error / spread if spread > 0 else None))
    return local_table(df.sparkSession, rows, SCORES), fits


def best_penalty(scores: DataFrame) -> float:
    """The penalty of largest mean R2; the larger one on a tie."""
    row = scores.groupBy("alpha").agg(F.avg("r2").alias("r2")).where("r2 is not null").orderBy(F.col("r2").desc(), F.col("alpha").desc()).first()
    if row is None:
        raise ValueError("no penalty has a score")
    return row["alpha"]
