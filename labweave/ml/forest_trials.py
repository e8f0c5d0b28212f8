"""Forests of several settings on several folds, grown side by side.

A forest whose splits may take any feature is a bag of trees. All trees of all trials and folds share one table of bins; a scan sums
what every tree needs on its next level, and a tree leaves out the rows of its own fold. So the scans are as many as the deepest tree
has levels, however many fits there are, and the rows are kept once, as a byte a feature.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labweave.ml.histogram_trees import FOLD_BITS, MAX_CELLS, BinnedRows, FoldSpec, Growing, _records, _said, feature_edges, grow_together
from labweave.operators.columns import quoted
from labweave.operators.metrics import regression_metrics

NAMES = ("labelCol", "featuresCol", "maxBins")


def grow_alike(models: Sequence) -> bool:
    """Whether these are Spark's forests on the same columns, with every feature open to every split and settings that are in order."""
    return bool(models) and all(type(m) is RandomForestRegressor for m in models) and all(
        m.getFeatureSubsetStrategy() == "all" and not m.isDefined("weightCol") and m.getMinInfoGain() == 0 and m.getMinWeightFractionPerNode() == 0
        and m.getNumTrees() >= 1 and 0 <= m.getMaxDepth() <= 30 and m.getMinInstancesPerNode() >= 1 and 0 < m.getSubsamplingRate() <= 1
        and 2 <= m.getMaxBins() <= 256 and m.getBootstrap() and all(m.getOrDefault(n) == models[0].getOrDefault(n) for n in NAMES)
        for m in models
    )


def forest_scores(rows: DataFrame, models: Sequence[RandomForestRegressor], folds: int, fold: str, label: str) -> list[tuple[float | None, float | None]] | None:
    """Mean and deviation over the folds of R2 for each model; None where ``rows`` hold what these trees don't know (nulls, numbers that
    are not finite, other folds) or where the histograms would not fit the driver."""
    x, y, at = vector_to_array(models[0].getFeaturesCol()).alias("x"), F.col(quoted(label)).cast("double").alias("y"), F.col(quoted(fold)).alias("f")
    wide = rows.select(x, y, at)
    infinite = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    odd = F.col("x").isNull() | infinite(F.col("y")) | F.col("f").isNull() | ~F.col("f").isin(list(range(folds))) | F.exists("x", infinite)
    told = wide.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(odd, F.lit(True))).alias("odd"), F.min("f").alias("low"), F.max("f").alias("high"),
        F.min(F.size("x")).alias("p"), F.max(F.size("x")).alias("most"),
    ).first()
    p, width = told["p"], models[0].getMaxBins()
    if not told["n"] or told["odd"] or told["low"] == told["high"] or not p or p != told["most"] or folds > 1 << FOLD_BITS:
        return None
    if folds * sum(m.getNumTrees() * 2.0 ** m.getMaxDepth() for m in models) * p * width > MAX_CELLS:
        return None
    # the lowest bits of an id tell the fold, the others are what draws hang on
    drawn = F.xxhash64(F.monotonically_increasing_id())
    known = wide.select("x", "y", F.shiftleft(F.shiftright(drawn, FOLD_BITS), FOLD_BITS).bitwiseOR(F.col("f").cast("bigint")).alias("id"))
    data = BinnedRows(known, feature_edges(wide, p, width))
    fits = [(t, k) for t in range(len(models)) for k in range(folds)]
    specs, settings, place = [], [], {}
    for t, k in fits:
        m = models[t]
        kind = "poisson" if m.getNumTrees() > 1 else "share"  # as Spark's: one tree alone is not bagged
        seeds = np.random.default_rng(m.getSeed()).integers(1 << 62, size=m.getNumTrees()).tolist()
        place[t, k] = slice(len(specs), len(specs) + len(seeds))
        specs += [FoldSpec(seed, np.arange(p), kind, m.getSubsamplingRate(), k) for seed in seeds]
        settings += [{"growth": "level", "max_depth": m.getMaxDepth(), "num_leaves": None, "l2": 0.0, "min_leaf": m.getMinInstancesPerNode(), "min_split": 0}] * len(seeds)
    grown = grow_together(data, specs, settings, 0.0)
    said = {fit: [_means(tree, 1 / len(grown[own])) for tree in grown[own]] for fit, own in place.items()}
    scores = regression_metrics(_held_out(data, said, len(models)), "y", "prediction", ["trial", "fold"])
    found = {r["trial"]: (r["m"], r["s"]) for r in scores.groupBy("trial").agg(F.avg("r2").alias("m"), F.stddev_pop("r2").alias("s")).collect()}
    return [found.get(t, (None, None)) for t in range(len(models))]


def _means(tree: Growing, scale: float) -> tuple:
    """Routing of a tree, and the mean of every node times ``scale``."""
    return *tree.routing(), np.array([-n.g / n.h * scale if n.h > 0 else 0.0 for n in tree.nodes])


def _held_out(data: BinnedRows, said: dict, trials: int) -> DataFrame:
    """``trial, fold, y, prediction`` of every row, by the trees that left its fold out."""
    p, low = data.p, (1 << FOLD_BITS) - 1

    def run(batches):
        for bins, y, ids in _records(batches, p):
            folds = ids & low
            for k in np.unique(folds).tolist():
                own = np.flatnonzero(folds == k)
                part = np.ascontiguousarray(bins[:, own])
                for t in range(trials):
                    shown = [np.full(len(own), v, np.int32) for v in (t, k)]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*shown, y[own], _said(part, said[t, k]))], ["trial", "fold", "y", "prediction"])

    return data.rows.select(*data.columns).mapInArrow(run, "trial int, fold int, y double, prediction double")
