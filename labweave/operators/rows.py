"""Row-level operators: filters, sampling, split, folds, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labweave.functions.hashing import MODULUS, key_hash
from labweave.operators.columns import quoted


def match_flag(df: DataFrame, column: str, value, flag: str) -> DataFrame:
    """Rows with ``column == value`` whose flag is true."""
    return df.filter((F.col(column) == F.lit(value)) & F.col(flag))


def drop_null_key(df: DataFrame, key: str | None = None) -> DataFrame:
    """Drop rows whose key (the first column by default) is null."""
    return df.filter(F.col(quoted(key or df.columns[0])).isNotNull())


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement: the smallest key hashes, so repeatable."""
    return df.orderBy(key_hash(df, key, seed), F.col(key)).limit(n)


def with_split(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 42, name: str = "is_test") -> DataFrame:
    """Flag test rows by key hash; the outcome does not depend on partitioning."""
    limit = int(round(test_fraction * MODULUS))
    return df.withColumn(name, key_hash(df, key, seed) < F.lit(limit))


def with_fold(df: DataFrame, key: str, folds: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Fold number 0..folds-1 by key hash."""
    return df.withColumn(name, (key_hash(df, key, seed + 1) % folds).cast("int"))


def top_k(df: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    """The k largest rows; runs as per-task top-k, not as a global sort."""
    return df.orderBy(F.col(by).desc(), F.col(tie)).limit(k)


def best_by_rank(ranking: DataFrame, group: Sequence[str], rank: str, tie: str, n: int) -> DataFrame:
    """The n best-ranked rows per group, ties by name.

    Two window steps: tasks first keep n rows per (group, slice), so a group that
    holds most of the table never meets in one task with more than n rows per slice.
    """
    slice_ = F.pmod(F.xxhash64(F.col(tie)), F.lit(64))
    order = [F.col(rank), F.col(tie)]
    local = Window.partitionBy(*group, "_slice").orderBy(*order)
    final = Window.partitionBy(*group).orderBy(*order)
    return (
        ranking.withColumn("_slice", slice_)
        .withColumn("_n", F.row_number().over(local))
        .filter(F.col("_n") <= n)
        .withColumn("_n", F.row_number().over(final))
        .filter(F.col("_n") <= n)
        .drop("_n", "_slice")
    )
