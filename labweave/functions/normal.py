"""Inverse normal distribution as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labweave.fixed_values import NORMAL_CENTRE, NORMAL_MIDDLE, NORMAL_TAIL


def _ratio(coefficients, x: Column) -> Column:
    top, bottom = (reduce(lambda acc, c: acc * x + F.lit(c), poly[1:], F.lit(poly[0])) for poly in coefficients)
    return top / bottom


def with_normal_quantile(df: DataFrame, p: Column, name: str) -> DataFrame:
    """Add the standard normal quantile of 0 < p < 1 (about 16 digits).

    Works in three projections: one nested expression would repeat ``p`` dozens of times
    and outgrow generated code.
    """
    q, tail = F.col("_q"), F.col("_tail")
    staged = df.withColumn("_p", p).withColumn("_q", F.col("_p") - 0.5)
    staged = staged.withColumns({
        "_centre": F.lit(0.180625) - q * q,
        "_tail": F.sqrt(-F.log(F.least(F.col("_p"), 1.0 - F.col("_p")))),
    })
    size = F.when(tail <= 5.0, _ratio(NORMAL_MIDDLE, tail - 1.6)).otherwise(_ratio(NORMAL_TAIL, tail - 5.0))
    value = F.when(F.abs(q) <= 0.425, q * _ratio(NORMAL_CENTRE, F.col("_centre"))).otherwise(F.signum(q) * size)
    return staged.withColumn(name, value).drop("_p", "_q", "_centre", "_tail")
