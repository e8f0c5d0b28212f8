"""Regression trees as node arrays: prediction, and a Spark ML model around an ensemble of them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Tree:
    """Nodes by number, the root first; ``left`` and ``right`` are -1 in a leaf. A value that is NaN or above the threshold goes right."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray  # weight of the training rows
    gain: np.ndarray

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        at = np.zeros(len(x), np.int64)
        active = np.arange(len(x)) if self.left[0] >= 0 else np.zeros(0, np.int64)
        while len(active):
            here = at[active]
            at[active] = np.where(x[active, self.feature[here]] <= self.threshold[here], self.left[here], self.right[here])
            active = active[self.left[at[active]] >= 0]
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves_of(x)]

    @property
    def n_leaves(self) -> int:
        return int((self.left < 0).sum())

    def to_lists(self) -> dict:
        return {name: getattr(self, name).tolist() for name in self.__dataclass_fields__}

    @classmethod
    def from_lists(cls, lists: dict) -> Tree:
        whole = ("feature", "left", "right")
        return cls(**{name: np.array(lists[name], np.int64 if name in whole else float) for name in cls.__dataclass_fields__})


def ensemble_predict(x: np.ndarray, trees: Sequence[Tree], base: float) -> np.ndarray:
    out = np.full(len(x), base)
    for tree in trees:
        out += tree.predict(x)
    return out


class TreeEnsembleModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A constant plus a sum of trees; an average of trees is a sum of trees with scaled values."""

    nodes = Param(Params._dummy(), "nodes", "base, number of features and trees as JSON", TypeConverters.toString)

    @classmethod
    def of(cls, base: float, n_features: int, trees: Sequence[Tree]) -> TreeEnsembleModel:
        return cls()._set(nodes=json.dumps({"base": base, "n_features": n_features, "trees": [t.to_lists() for t in trees]}))

    @property
    def _content(self) -> dict:
        return json.loads(self.getOrDefault(self.nodes))

    @property
    def base(self) -> float:
        return self._content["base"]

    @property
    def trees(self) -> list[Tree]:
        return [Tree.from_lists(t) for t in self._content["trees"]]

    @property
    def featureImportances(self) -> DenseVector:
        """Share of the total gain of all splits."""
        total = np.zeros(self._content["n_features"])
        for tree in self.trees:
            inner = tree.left >= 0
            np.add.at(total, tree.feature[inner], tree.gain[inner])
        return DenseVector(total / (total.sum() or 1.0))

    def setPredictionCol(self, name: str) -> TreeEnsembleModel:
        return self._set(predictionCol=name)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        base, trees, p = self.base, self.trees, self._content["n_features"]  # as large as the model, not as the data

        @F.arrow_udf("double")
        def score(features: pa.Array) -> pa.Array:
            return pa.array(ensemble_predict(features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), p), trees, base))

        return dataset.withColumn(self.getPredictionCol(), score(vector_to_array(self.getFeaturesCol())))
