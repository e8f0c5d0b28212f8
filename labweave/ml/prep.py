"""Feature preparation: scaling, assembling, category columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labweave.ml.imputer import ChainedImputer
from labweave.operators.columns import quoted

MAX_LEVELS = 1000


class PopulationScalerModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "column means", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "population deviations", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        means, devs = self.getOrDefault(self.means), self.getOrDefault(self.deviations)
        return dataset.withColumns(
            {
                c: (F.col(quoted(c)).cast("double") - F.lit(m)) / F.lit(d if d > 0 else 1.0)
                for c, m, d in zip(self.getInputCols(), means, devs)
            }
        )


class PopulationScaler(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Zero mean and unit population deviation; a constant column becomes 0. One aggregate."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> PopulationScalerModel:
        names = self.getInputCols()
        row = dataset.agg(
            *[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(names)],
            *[F.stddev_pop(quoted(c)).alias(f"d{i}") for i, c in enumerate(names)],
        ).first()
        model = self._copyValues(PopulationScalerModel())
        return model._set(
            means=[row[f"m{i}"] or 0.0 for i in range(len(names))],
            deviations=[row[f"d{i}"] or 0.0 for i in range(len(names))],
        )


def assembler(features: Sequence[str], output: str = "features") -> VectorAssembler:
    """Feature vector in the given order; a null is an error, not a dropped row."""
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="error")


def preprocessing(features: Sequence[str]) -> Pipeline:
    """Impute, scale, assemble; fit it on training rows only."""
    return Pipeline(
        stages=[ChainedImputer(inputCols=list(features)), PopulationScaler(inputCols=list(features)), assembler(features)]
    )


def category_levels(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct levels, at most MAX_LEVELS of them."""
    rows = df.select(F.col(quoted(column)).cast("string").alias("v")).filter("v is not null").distinct().limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"{column} has more than {MAX_LEVELS} levels")
    return sorted(r.v for r in rows)


def with_dummies(df: DataFrame, column: str, levels: Sequence[str] | None = None) -> DataFrame:
    """0/1 columns for all levels but the first; the source column is replaced."""
    levels = category_levels(df, column) if levels is None else sorted(levels)
    value = F.col(quoted(column)).cast("string")
    flags = [F.coalesce((value == level).cast("int"), F.lit(0)).alias(f"{column}_{level}") for level in levels[1:]]
    return df.select(*[quoted(c) for c in df.columns if c != column], *flags)
