"""Models from other libraries behind the same ``transform`` call."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labweave.operators.columns import quoted


class FunctionModel(Transformer):
    """Wraps ``predict(matrix) -> vector``; it runs Arrow batch by batch on the executors."""

    def __init__(self, features: Sequence[str], predict: Callable[[np.ndarray], np.ndarray], output: str = "prediction"):
        super().__init__()
        self.features, self.predict, self.output = list(features), predict, output

    def _transform(self, dataset: DataFrame) -> DataFrame:
        predict = self.predict

        @F.pandas_udf("double")
        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series(np.asarray(predict(np.column_stack([c.to_numpy(dtype=float) for c in columns])), dtype=float))

        return dataset.withColumn(self.output, run(*[F.col(quoted(c)).cast("double") for c in self.features]))
