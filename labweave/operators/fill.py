"""Null filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labweave.functions.cleaning import nan_to_null
from labweave.functions.stats import STATS, stat, with_stats
from labweave.operators.columns import quoted

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def fill_constants(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Numeric nulls become 0, text nulls become ''; columns in ``keep`` stay untouched."""
    filled = []
    for name, kind in df.dtypes:
        value = F.col(quoted(name))
        if name in keep:
            filled.append(value)
        elif kind in NUMERIC or kind.startswith("decimal"):
            filled.append(F.coalesce(value, F.lit(0).cast(kind)).alias(name))
        elif kind == "string":
            filled.append(F.coalesce(value, F.lit("")).alias(name))
        else:
            filled.append(value)
    return df.select(*filled)


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls (and NaN) become the column mean: one aggregate pass, no join."""
    clean = df.withColumns({c: nan_to_null(F.col(quoted(c)).cast("double")) for c in columns})
    clean = with_stats(clean, clean, **{f"m{i}": F.avg(quoted(c)) for i, c in enumerate(columns)})
    return clean.withColumns({c: F.coalesce(F.col(quoted(c)), stat(f"m{i}")) for i, c in enumerate(columns)}).drop(STATS)
