"""Small statistics attached to a table without a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = "_stats"


def with_stats(df: DataFrame, source: DataFrame, **aggregates: Column) -> DataFrame:
    """Add the struct column ``_stats`` with one-row aggregates of ``source``.

    The aggregates form one scalar subquery: Spark runs it once ahead of the main query
    and hands the struct over as a constant. Read it with ``stat(name)``, drop it after.
    """
    row = source.select(F.struct(*[a.alias(k) for k, a in aggregates.items()])).scalar()
    return df.withColumn(STATS, row)


def stat(name: str) -> Column:
    return F.col(f"{STATS}.{name}")
