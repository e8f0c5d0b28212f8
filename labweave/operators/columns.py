"""Column-level operators: rename, conform, subset, complement, insert."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename by map; columns outside the map keep their name, absent keys are ignored."""
    return df.withColumnsRenamed(dict(names))


def conform(df: DataFrame, schema: Sequence[tuple[str, str]]) -> DataFrame:
    """Exactly the given columns, in order and type; absent ones are null."""
    have = set(df.columns)
    types = dict(df.dtypes)

    def pick(name: str, kind: str) -> Column:
        if name not in have:
            return F.lit(None).cast(kind).alias(name)
        value = F.col(quoted(name))
        return (value if types[name] == kind else value.try_cast(kind)).alias(name)

    return df.select(*[pick(n, k) for n, k in schema])


def select_strict(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select(*[quoted(n) for n in names])


def select_available(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns that exist, in the order of ``names``."""
    return df.select(*[quoted(n) for n in names if n in df.columns])


def complement(df: DataFrame, inputs: Sequence[str]) -> list[str]:
    """Names of all other columns, after checking that the inputs exist."""
    select_strict(df, inputs)
    return [c for c in df.columns if c not in set(inputs)]


def insert_after(df: DataFrame, anchor: str, name: str, value: Column, missing_value=0) -> DataFrame:
    """Place ``name`` directly after ``anchor``; without the anchor, append ``missing_value``."""
    if anchor not in df.columns:
        return df.select("*", F.lit(missing_value).alias(name))
    at = df.columns.index(anchor) + 1
    columns = [F.col(quoted(c)) for c in df.columns]
    return df.select(*columns[:at], value.alias(name), *columns[at:])
