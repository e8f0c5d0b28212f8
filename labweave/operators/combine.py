"""Union of sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_conformed(*sheets: DataFrame) -> DataFrame:
    """Stack tables that share one schema, matched by name."""
    return reduce(lambda a, b: a.unionByName(b), sheets)


def union_outer(*sheets: DataFrame) -> DataFrame:
    """Stack tables with differing columns; absent ones become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sheets)
