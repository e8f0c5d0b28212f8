"""Model explanation: partial dependence and Shapley-type contributions."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labweave.functions.stats import stat, with_stats
from labweave.operators.columns import quoted
from labweave.operators.quantiles import column_quantiles
from labweave.operators.rows import sample_rows, top_k
from labweave.session import local_table, shared_dir

BASE = "(base)"
MAX_GRID = 10_000


def linear_grid(df: DataFrame, features: Sequence[str], points: int) -> dict[str, list[float]]:
    """Equally spaced values from minimum to maximum; collects two numbers per feature."""
    row = df.agg(
        *[F.min(quoted(c)).cast("double").alias(f"lo{i}") for i, c in enumerate(features)],
        *[F.max(quoted(c)).cast("double").alias(f"hi{i}") for i, c in enumerate(features)],
    ).first()
    return {c: np.linspace(row[f"lo{i}"], row[f"hi{i}"], points).tolist() for i, c in enumerate(features)}


def few_values(df: DataFrame, columns: Sequence[str], most: int) -> dict[str, list[float]]:
    """The sorted distinct values of the columns that have at most ``most``, exactly; a task sends at most one value more a column."""

    def run(batches):
        seen = [np.zeros(0) for _ in columns]
        for batch in batches:
            for i in range(len(columns)):
                if len(seen[i]) <= most:
                    x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                    seen[i] = np.unique(np.concatenate([seen[i], x]))[: most + 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(seen), dtype=np.int32), [len(s) for s in seen])), pa.array(np.concatenate(seen))], ["i", "v"])

    found = df.select(*[F.col(quoted(c)).cast("double") for c in columns]).mapInArrow(run, "i int, v double").distinct()
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("i").orderBy("v"))).where(F.col("n") <= most + 1)
    values: dict[str, list[float]] = {c: [] for c in columns}
    for r in ranked.collect():
        values[columns[r["i"]]].append(r["v"])
    return {c: sorted(v) for c, v in values.items() if 0 < len(v) <= most}


def quantile_grid(df: DataFrame, features: Sequence[str], points: int, low: float = 0.05, high: float = 0.95) -> dict[str, list[float]]:
    """Equally spaced values between two quantiles; the distinct values when there are fewer."""
    ends: dict[str, dict[float, float]] = {}
    for r in column_quantiles(df, features, [low, high]).collect():
        ends.setdefault(r["column"], {})[r.p] = r.quantile
    few = few_values(df, features, points - 1)
    grid = {c: few.get(c) or np.linspace(ends[c][low], ends[c][high], points).tolist() for c in features}
    return grid


def partial_dependence(df: DataFrame, model: Transformer, grid: Mapping[str, Sequence[float]], prediction: str = "prediction") -> DataFrame:
    """Average prediction with two columns set to every grid point, over all rows.

    Rows widen in place by the literal grid and fall back to one partial sum per grid
    point in the task; the shuffle only carries grid points. ``model`` must start from
    the plain feature columns (a pipeline with its assembler).
    """
    (f1, g1), (f2, g2) = grid.items()
    if len(g1) * len(g2) > MAX_GRID:
        raise ValueError(f"at most {MAX_GRID} grid points")
    points = F.array(*[F.struct(F.lit(float(a)).alias("_g1"), F.lit(float(b)).alias("_g2")) for a in g1 for b in g2])
    others = [quoted(c) for c in df.columns if c not in (f1, f2)]
    wide = df.select(*others, F.inline(points)).withColumns({f1: F.col("_g1"), f2: F.col("_g2")})
    return (
        model.transform(wide)
        .groupBy("_g1", "_g2")
        .agg(F.avg(prediction).alias("average"))
        .withColumnsRenamed({"_g1": f"{f1}_grid", "_g2": f"{f2}_grid"})
    )


def to_contributions(wide: DataFrame, key: str, features: Sequence[str], contributions: Mapping[str, Column]) -> DataFrame:
    """Long table ``(key, feature, value, contribution)``."""
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            (F.col(quoted(c)).cast("double") if c in wide.columns else F.lit(None).cast("double")).alias("value"),
            contributions[c].alias("contribution"),
        )
        for c in features
    ]
    return wide.select(quoted(key), F.inline(F.array(*cells)))


def linear_shapley(df: DataFrame, key: str, features: Sequence[str], model: LinearRegressionModel) -> DataFrame:
    """``coef * (x - mean)`` per row and feature: exact for a linear model."""
    known = with_stats(df, df, **{f"m{i}": F.avg(quoted(c)) for i, c in enumerate(features)})
    parts = {c: F.lit(float(model.coefficients[i])) * (F.col(quoted(c)) - stat(f"m{i}")) for i, c in enumerate(features)}
    return to_contributions(known, key, features, parts)


def node_table(model: Transformer) -> tuple[DataFrame, bool]:
    """Nodes of a tree model as a table, read back from its saved form; True for an average of trees."""
    spark = SparkSession.active()
    path = shared_dir(spark)
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weights = dict(enumerate(model.treeWeights))
    table = local_table(spark, list(weights.items()), "treeID int, weight double")
    return nodes.join(F.broadcast(table), "treeID"), "RandomForest" in type(model).__name__


def _tree_arrays(model: Transformer) -> list[dict]:
    """Node arrays per tree; their size depends on the model, not on the data scored."""
    nodes, averaged = node_table(model)
    rows = nodes.select(
        "treeID", "id", "prediction", "leftChild", "rightChild", "weight",
        F.col("split.featureIndex").alias("f"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("t"),
        F.col("split.numCategories").alias("c"),
    ).toPandas()
    if (rows["c"] > -1).any():
        raise ValueError("categorical splits are not supported")
    total = rows.groupby("treeID")["weight"].first().sum() if averaged else 1.0
    trees = []
    for _, tree in rows.groupby("treeID"):
        tree = tree.sort_values("id")
        trees.append(
            {
                "value": tree["prediction"].to_numpy() * tree["weight"].iloc[0] / total,
                "left": tree["leftChild"].to_numpy(), "right": tree["rightChild"].to_numpy(),
                "feature": tree["f"].to_numpy(), "threshold": tree["t"].fillna(0.0).to_numpy(),
            }
        )
    return trees


def _walk(x: np.ndarray, trees: Sequence[Mapping]) -> np.ndarray:
    """Path contributions (last column: base) of a block of rows."""
    out = np.zeros((x.shape[0], x.shape[1] + 1))
    rows = np.arange(x.shape[0])
    for tree in trees:
        at = np.zeros(x.shape[0], dtype=int)
        out[:, -1] += tree["value"][0]
        active = rows[tree["left"][at] >= 0]
        while len(active):
            here = at[active]
            feature = tree["feature"][here]
            go_left = x[active, feature] <= tree["threshold"][here]
            child = np.where(go_left, tree["left"][here], tree["right"][here])
            out[active, feature] += tree["value"][child] - tree["value"][here]  # a row occurs once per level
            at[active] = child
            active = active[tree["left"][child] >= 0]
    return out


def tree_contributions(df: DataFrame, key: str, features: Sequence[str], model: Transformer) -> DataFrame:
    """Path attribution of a tree model: each split credits its feature with the change in
    node mean. ``(key, feature, value, contribution)`` including a ``(base)`` row; the sum per
    key is the prediction. Runs on all rows, Arrow batch by batch, without a shuffle.
    """
    trees = df.sparkSession.sparkContext.broadcast(_tree_arrays(model))

    @F.pandas_udf("array<double>")
    def walk(*columns: pd.Series) -> pd.Series:
        return pd.Series(list(_walk(np.column_stack([c.to_numpy(dtype=float) for c in columns]), trees.value)))

    wide = df.select(quoted(key), *[quoted(c) for c in features], walk(*[F.col(quoted(c)).cast("double") for c in features]).alias("_c"))
    names = [*features, BASE]
    return to_contributions(wide, key, names, {c: F.col("_c")[i] for i, c in enumerate(names)})


def sampled_shapley(
    df: DataFrame, key: str, features: Sequence[str], model: Transformer, permutations: int = 10, background: int = 50,
    seed: int = 42, prediction: str = "prediction",
) -> DataFrame:
    """Model-agnostic Shapley values by sampled feature orders.

    For every row and order the features switch one by one from a background row to the
    row itself. A prediction counts for the feature just switched and against the next
    one, so the differences need no ordering: one grouped sum per (row, feature), mostly
    combined in the task that made the rows. Sums per key equal the prediction.
    """
    p = len(features)
    rows = sample_rows(df.select(key, *features), key, background, seed).select(*features).collect()
    if not rows:
        raise ValueError("no background rows")
    backgrounds = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])
    rng = random.Random(seed)
    orders = [rng.sample(range(p), p) for _ in range(permutations)]
    plan = F.array(
        *[
            F.struct(
                F.lit(m).alias("_m"),
                F.array(*[F.lit(orders[m].index(j) < k) for j in range(p)]).alias("_own"),
                F.lit(orders[m][k - 1] if k else p).alias("_gains"),
                F.lit(orders[m][k] if k < p else -1).alias("_loses"),
            )
            for m in range(permutations)
            for k in range(p + 1)
        ]
    )
    pick = F.pmod(F.xxhash64(F.col(quoted(key)), F.col("_m"), F.lit(seed)), F.lit(len(rows))).cast("int")
    wide = df.select(quoted(key), *[F.col(quoted(c)).cast("double").alias(f"_x{j}") for j, c in enumerate(features)], F.inline(plan))
    wide = wide.withColumn("_b", F.element_at(backgrounds, pick + 1))
    inputs = wide.select(
        quoted(key), "_gains", "_loses",
        *[F.when(F.col("_own")[j], F.col(f"_x{j}")).otherwise(F.col("_b")[j]).alias(c) for j, c in enumerate(features)],
    )
    scored = model.transform(inputs).select(
        quoted(key),
        F.inline(
            F.array(
                F.struct(F.col("_gains").alias("_j"), F.col(prediction).alias("_part")),
                F.struct(F.col("_loses").alias("_j"), (-F.col(prediction)).alias("_part")),
            )
        ),
    )
    names = F.array(*[F.lit(c) for c in [*features, BASE]])
    return (
        scored.filter(F.col("_j") >= 0)
        .groupBy(quoted(key), "_j")
        .agg((F.sum("_part") / permutations).alias("contribution"))
        .select(quoted(key), F.element_at(names, F.col("_j") + 1).alias("feature"), "contribution")
    )


def contribution_summary(contributions: DataFrame) -> DataFrame:
    """Mean, mean absolute, smallest and largest contribution per feature."""
    return contributions.filter(F.col("feature") != BASE).groupBy("feature").agg(
        F.avg("contribution").alias("mean_contribution"),
        F.avg(F.abs("contribution")).alias("mean_abs"),
        F.min("contribution").alias("lowest"),
        F.max("contribution").alias("highest"),
    )


def ranked_importance(contributions: DataFrame, k: int = 10) -> DataFrame:
    """The k features with the largest mean absolute contribution."""
    means = contributions.filter(F.col("feature") != BASE).groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    return top_k(means, "mean_abs", "feature", k)


def contribution_matrix(contributions: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Per-instance matrix: one column per feature."""
    return contributions.groupBy(key).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("contribution"))).alias(f"shap_{c}") for c in features]
    )
