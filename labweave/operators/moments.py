"""Cross-product sums over many columns in one scan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labweave.functions.stats import stat, with_stats
from labweave.operators.columns import quoted

#: Share of a column's squares that its spread must exceed; rounding leaves less of a constant one.
SPREAD = 1e-12
PAIR_SCHEMA = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"


def _pair_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for batch in batches:
        x = batch.to_numpy(dtype=float, na_value=np.nan)
        seen = ~np.isnan(x)
        x, m = np.where(seen, x, 0.0), seen.astype(float)
        sums = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        total = sums if total is None else total + sums
    if total is not None:
        i, j = np.triu_indices(total.shape[1])
        columns = {"i": i.astype("int32"), "j": j.astype("int32")}
        columns.update({k: total[q][i, j] for q, k in enumerate(("n", "sx", "sy", "sxx", "syy", "sxy"))})
        yield pd.DataFrame(columns)


def present(column: str) -> Column:
    """The column as a double, with null for NaN."""
    x = F.col(quoted(column)).cast("double")
    return F.when(~F.isnan(x), x)


def centred(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles minus their means, so that sums of squares keep their digits."""
    known = with_stats(df, df, **{f"m{i}": F.avg(present(c)) for i, c in enumerate(columns)})
    return known.select(*[(present(c) - stat(f"m{i}")).alias(f"c{i}") for i, c in enumerate(columns)])


def pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sums for every column pair i <= j over the rows where both are present.

    Each task reduces its rows to one small matrix by Arrow batches (thousands of
    aggregate expressions would leave generated code); the shuffle moves one row per
    pair and task.
    """
    partial = centred(df, columns).mapInPandas(_pair_sums, PAIR_SCHEMA)
    sums = [F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    return partial.groupBy("i", "j").agg(*sums)


def pair_correlation() -> Column:
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    cov = F.col("sxy") - sx * sy / n
    vx, vy = F.col("sxx") - sx * sx / n, F.col("syy") - sy * sy / n
    # what rounding leaves of a constant column is no spread
    return F.when((n > 1) & (vx > F.col("sxx") * SPREAD) & (vy > F.col("syy") * SPREAD), cov / F.sqrt(vx * vy))
