"""Explanations from the nodes of tree models, and kernel Shapley values of any row function.

Node arrays are as large as the model; rows are explained where they lie, Arrow batch by batch, without a shuffle.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labweave.ml.explain import BASE, MAX_GRID, node_table, to_contributions
from labweave.ml.foreign import FunctionModel
from labweave.ml.trees import Tree, TreeEnsembleModel, ensemble_predict
from labweave.operators.columns import quoted
from labweave.operators.rows import sample_rows
from labweave.session import local_table


def tree_ensemble(model: Transformer) -> tuple[float, list[Tree]]:
    """A constant and the trees of a model whose prediction is their sum; Spark's tree models are read from their saved form."""
    if isinstance(model, TreeEnsembleModel):
        return model.base, model.trees
    nodes, averaged = node_table(model)
    rows = nodes.select(
        "treeID", "id", "prediction", "leftChild", "rightChild", "weight", "gain", F.col("rawCount").cast("double").alias("n"),
        F.col("impurityStats").alias("stats"), F.col("split.featureIndex").alias("f"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("t"), F.col("split.numCategories").alias("c"),
    ).toPandas()
    if (rows["c"] > -1).any():
        raise ValueError("categorical splits are not supported")
    total = rows.groupby("treeID")["weight"].first().sum() if averaged else 1.0
    trees = []
    for _, tree in rows.groupby("treeID"):
        tree = tree.sort_values("id")
        cover = np.array([s[0] if s is not None and len(s) else n for s, n in zip(tree["stats"], tree["n"], strict=True)], float)
        trees.append(Tree(
            tree["f"].to_numpy(np.int64), tree["t"].fillna(0.0).to_numpy(float), tree["leftChild"].to_numpy(np.int64), tree["rightChild"].to_numpy(np.int64),
            tree["prediction"].to_numpy(float) * tree["weight"].iloc[0] / total, cover, tree["gain"].to_numpy(float),
        ))
    return 0.0, trees


def child_shares(tree: Tree) -> np.ndarray:
    """Of every node: the share of its parent's training weight that it holds. Children of a node without weight count alike."""
    share = np.ones(len(tree.left))
    inner = np.flatnonzero(tree.left >= 0)
    own = tree.cover[inner]
    for child in (tree.left[inner], tree.right[inner]):
        share[child] = np.where(own > 0, tree.cover[child] / np.where(own > 0, own, 1), 0.5)
    return share


def expected_value(base: float, trees: Sequence[Tree]) -> float:
    """The ensemble's mean over its training weight, from the node shares."""
    total = base
    for tree in trees:
        share, reach = child_shares(tree), np.ones(len(tree.left))
        for at in _from_root(tree):
            if tree.left[at] >= 0:
                for child in (tree.left[at], tree.right[at]):
                    reach[child] = reach[at] * share[child]
            else:
                total += reach[at] * tree.value[at]
    return float(total)


def _from_root(tree: Tree) -> list[int]:
    order = [0]
    for at in order:
        if tree.left[at] >= 0:
            order += [int(tree.left[at]), int(tree.right[at])]
    return order


# --- exact Shapley values of trees

#: Features on a path up to which all patterns of them are listed.
FEW = 8


def _extended(one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Coefficients of the product of ``zero[k] + one[k] t`` for every pattern: the weight of the path's subsets by size."""
    sums = np.zeros((len(one), one.shape[1] + 1))
    sums[:, 0] = 1
    for k in range(one.shape[1]):
        sums[:, 1 : k + 2] = sums[:, 1 : k + 2] * zero[k] + sums[:, : k + 1] * one[:, k, None]
        sums[:, 0] *= zero[k]
    return sums


def _unwound(sums: np.ndarray, one: np.ndarray, zero: np.ndarray, j: int) -> np.ndarray:
    """The same product without factor ``j``."""
    d = one.shape[1]
    if zero[j] == 0:  # nothing to divide by where the pattern leaves the path at j
        others = [k for k in range(d) if k != j]
        return _extended(one[:, others], zero[others])
    out = np.zeros((len(one), d))
    carry = np.zeros(len(one))
    for i in range(d, 0, -1):
        carry = sums[:, i] - zero[j] * carry
        out[:, i - 1] = carry
    off = one[:, j] == 0
    out[off] = sums[off, :d] / zero[j]
    return out


def tree_shapley_values(x: np.ndarray, trees: Sequence[Tree], base: float) -> np.ndarray:
    """Exact Shapley values of every feature, and the expected value in the last column.

    A feature outside a coalition follows both branches by their shares of training weight. For each leaf, the rows' patterns of which
    features on its path lead to it are few; each pattern's subset weights are built by extension and unwound for each feature.
    """
    out = np.zeros((len(x), x.shape[1] + 1))
    out[:, -1] = expected_value(base, trees)
    for tree in trees:
        share = child_shares(tree)
        inner = np.flatnonzero(tree.left >= 0)
        goes_left = np.zeros((len(tree.left), len(x)), bool)
        goes_left[inner] = x[:, tree.feature[inner]].T <= tree.threshold[inner, None]
        paths: list[tuple[int, dict[int, float], dict[int, np.ndarray]]] = [(0, {}, {})]
        while paths:
            at, zero, one = paths.pop()
            if tree.left[at] < 0:
                if zero:
                    _add_leaf(out, float(tree.value[at]), zero, one)
                continue
            f = int(tree.feature[at])
            for child, way in ((int(tree.left[at]), goes_left[at]), (int(tree.right[at]), ~goes_left[at])):
                paths.append((child, {**zero, f: zero.get(f, 1.0) * share[child]}, {**one, f: one[f] & way if f in one else way}))
    return out


def _add_leaf(out: np.ndarray, value: float, zero: Mapping[int, float], one: Mapping[int, np.ndarray]) -> None:
    names, d = list(zero), len(zero)
    held = np.stack([one[f] for f in names], axis=1)
    if d <= FEW:  # all patterns there can be, in place of a sort of the rows
        ones, pattern = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float), held @ (1 << np.arange(d, dtype=np.int64))
    elif d <= 62:
        _, first, pattern = np.unique(held @ (1 << np.arange(d, dtype=np.int64)), return_index=True, return_inverse=True)
    else:
        _, first, pattern = np.unique(held, axis=0, return_index=True, return_inverse=True)
    if d > FEW:
        ones = held[first].astype(float)
    zeros = np.array([zero[f] for f in names])
    sums = _extended(ones, zeros)
    weight = np.array([math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)])
    for j, f in enumerate(names):
        part = (ones[:, j] - zeros[j]) * (_unwound(sums, ones, zeros, j) @ weight) * value
        out[:, f] += part[pattern]


def shapley_column(df: DataFrame, features: Sequence[str], model: Transformer) -> Callable:
    """A function of the feature columns: the array of their exact Shapley values, with the expected value last."""
    base, trees = tree_ensemble(model)
    shared = df.sparkSession.sparkContext.broadcast((base, trees))

    @F.arrow_udf("array<double>")
    def values(*columns: pa.Array) -> pa.Array:
        base, trees = shared.value
        x = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in columns])
        found = tree_shapley_values(x, trees, base)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))

    return values


def exact_tree_shapley(df: DataFrame, key: str, features: Sequence[str], model: Transformer) -> DataFrame:
    """``(key, feature, value, contribution)`` of every row with exact path-dependent Shapley values, including a ``(base)`` row.

    The contributions of a key sum to its prediction. Runs on all rows without a shuffle.
    """
    return _explained(df, key, features, shapley_column(df, features, model))


def _explained(df: DataFrame, key: str, features: Sequence[str], values: Callable) -> DataFrame:
    wide = df.select(quoted(key), *[quoted(c) for c in features], values(*[F.col(quoted(c)).cast("double") for c in features]).alias("_c"))
    names = [*features, BASE]
    return to_contributions(wide, key, names, {c: F.col("_c")[i] for i, c in enumerate(names)})


# --- partial dependence from the nodes


def dependence_of(trees: Sequence[Tree], base: float, points: np.ndarray, given: Sequence[int]) -> np.ndarray:
    """Mean prediction with the ``given`` features set to each point: splits on other features are followed both ways, by training weight."""
    out = np.full(len(points), base)
    column = {f: i for i, f in enumerate(given)}
    for tree in trees:
        share, reach = child_shares(tree), {0: np.ones(len(points))}
        for at in _from_root(tree):
            weight = reach.pop(at)
            if tree.left[at] < 0:
                out += weight * tree.value[at]
                continue
            left, right = int(tree.left[at]), int(tree.right[at])
            f = int(tree.feature[at])
            if f in column:
                goes = points[:, column[f]] <= tree.threshold[at]
                reach[left], reach[right] = weight * goes, weight * ~goes
            else:
                reach[left], reach[right] = weight * share[left], weight * share[right]
    return out


def tree_partial_dependence(spark: SparkSession, model: Transformer, features: Sequence[str], grid: Mapping[str, Sequence[float]]) -> DataFrame:
    """Partial dependence of one or two features by walking the trees: no scan of the rows. Columns ``<feature>_grid`` and ``average``."""
    points = np.array(list(itertools.product(*grid.values())), float).reshape(-1, len(grid))
    if len(points) > MAX_GRID:
        raise ValueError(f"at most {MAX_GRID} grid points")
    base, trees = tree_ensemble(model)
    average = dependence_of(trees, base, points, [list(features).index(c) for c in grid])
    schema = ", ".join([*[f"`{c}_grid` double" for c in grid], "average double"])
    return local_table(spark, [(*map(float, p), float(a)) for p, a in zip(points, average, strict=True)], schema)


# --- kernel Shapley values


def kernel_coalitions(p: int, n: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions of ``p`` features and their weights by the Shapley kernel.

    All of them if there are at most ``n``. Else sizes are listed whole from the outside in while they fit, as those weigh most, and the
    rest of the weight goes to coalitions drawn by size, each with its complement.
    """
    if p < 2:
        return np.zeros((0, p), bool), np.zeros(0)
    weight = {s: (p - 1) / (s * (p - s)) for s in range(1, p)}  # of all coalitions of a size together
    rows: list[tuple[frozenset, float]] = []
    rest = dict(weight)
    for s in range(1, p // 2 + 1):
        pair = {s, p - s}
        if len(rows) + sum(math.comb(p, t) for t in pair) > n:
            break
        for t in sorted(pair):
            rows += [(frozenset(c), weight[t] / math.comb(p, t)) for c in itertools.combinations(range(p), t)]
            del rest[t]
    if rest:
        rng, drawn = random.Random(seed), {}
        sizes = sorted(rest)
        for _ in range(max(1, (n - len(rows)) // 2)):
            s = rng.choices(sizes, [rest[t] for t in sizes])[0]
            chosen = frozenset(rng.sample(range(p), s))
            for c in (chosen, frozenset(range(p)) - chosen):
                drawn[c] = drawn.get(c, 0) + 1
        share = sum(rest.values()) / sum(drawn.values())
        rows += [(c, share * times) for c, times in drawn.items()]
    held = np.zeros((len(rows), p), bool)
    for i, (c, _) in enumerate(rows):
        held[i, list(c)] = True
    return held, np.array([w for _, w in rows])


def kernel_solution(held: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted regression with the sum fixed, as linear maps: contributions are ``values @ a + total * b``.

    ``values`` are the coalitions' gains over the base and ``total`` the whole row's gain; the design is the same for all rows.
    """
    p = held.shape[1]
    if not len(held):
        return np.zeros((0, p)), np.ones(p) / max(p, 1)
    z = held.astype(float)
    inverse = np.linalg.pinv(z.T @ (z * weight[:, None]))
    one = inverse.sum(axis=1)
    a = (z * weight[:, None]) @ inverse
    return a - np.outer(a.sum(axis=1), one) / one.sum(), one / one.sum()


def row_function(model: Transformer) -> Callable[[np.ndarray], np.ndarray]:
    """``matrix -> predictions`` of a tree model, a linear model or a wrapped function."""
    if isinstance(model, FunctionModel):
        return model.predict
    if isinstance(model, LinearRegressionModel):
        weights, intercept = model.coefficients.toArray(), float(model.intercept)
        return lambda x: x @ weights + intercept
    base, trees = tree_ensemble(model)
    return lambda x: ensemble_predict(x, trees, base)


def kernel_shapley(
    df: DataFrame, key: str, features: Sequence[str], model: Transformer | Callable[[np.ndarray], np.ndarray], coalitions: int = 2048, background: int = 50, seed: int = 42
) -> DataFrame:
    """``(key, feature, value, contribution)`` with Shapley values by a weighted regression over coalitions, including a ``(base)`` row.

    A coalition's value is the mean prediction over ``background`` rows (those with the smallest hashes of their key) with the
    coalition's features taken from the explained row. With all coalitions the result is exact. Every row is solved where it lies.
    """
    rows = sample_rows(df.select(key, *features), key, background, seed).select(*[F.col(quoted(c)).cast("double") for c in features]).collect()
    if not rows:
        raise ValueError("no background rows")
    held, weight = kernel_coalitions(len(features), coalitions, seed)
    a, b = kernel_solution(held, weight)
    function = model if not isinstance(model, Transformer) else row_function(model)
    ground = np.array(rows, float)

    @F.pandas_udf("array<double>")
    def values(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        return pd.Series(list(kernel_values(x, function, ground, held, a, b)))

    return _explained(df, key, features, values)


def kernel_values(x: np.ndarray, function: Callable, ground: np.ndarray, held: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Contributions of every row and the base in the last column."""
    base = float(np.mean(function(ground)))
    total = np.asarray(function(x), float) - base if len(x) else np.zeros(0)
    gains = np.empty((len(x), len(held)))
    for i, own in enumerate(held):
        mixed = np.where(own, x[:, None, :], ground[None, :, :]).reshape(-1, x.shape[1])
        gains[:, i] = np.asarray(function(mixed), float).reshape(len(x), len(ground)).mean(axis=1) - base if len(x) else 0
    return np.column_stack([gains @ a + total[:, None] * b, np.full(len(x), base)])
