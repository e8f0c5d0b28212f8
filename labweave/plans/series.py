"""Result sheets to tagged series: one scan per sheet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labweave.fixed_values import (
    EXERGY_ORDINALS, EXERGY_WINDOWS, FLOW_ORDINALS, FLOW_WINDOWS, REACTION_BLOCKS, REACTION_COUNT, REACTION_STRIDE,
    SPECIES, WEIGHT_ORDINALS, YIELD_ORDINALS, YIELD_WINDOWS,
)
from labweave.functions.cleaning import to_number
from labweave.operators.columns import quoted
from labweave.operators.reshape import block_series, drop_empty_series, window_series

YIELD_NAMES = ("CO2 conversion", "CO conversion", "CH4 yield", "C yield")
EXERGY_NAMES = ("series 1", "series 2", "series 3", "series 4")


def sheet_series(sheet: DataFrame, windows: Sequence[tuple[int, int, int]], names: Sequence[str], ordinals: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """All windows of a sheet as ``(window_id, _row, x, series, value)``; series without a value are dropped.

    ``keys`` names the columns that tell the sheets of a many-sheet table apart.
    """
    series = window_series(sheet, windows, dict(zip(names, ordinals)), keys=keys)
    return drop_empty_series(series, [*keys, "window_id", "series"])


def flow_series(sheet: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return sheet_series(sheet, FLOW_WINDOWS, SPECIES, FLOW_ORDINALS, keys)


def weight_series(sheet: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return sheet_series(sheet, FLOW_WINDOWS, SPECIES, WEIGHT_ORDINALS, keys)


def yield_series(sheet: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return sheet_series(sheet, YIELD_WINDOWS, YIELD_NAMES, YIELD_ORDINALS, keys)


def exergy_series(sheet: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return sheet_series(sheet, EXERGY_WINDOWS, EXERGY_NAMES, EXERGY_ORDINALS, keys)


def reaction_series(sheet: DataFrame, first: int = 7, last: int = 26, row: str = "_row", keys: Sequence[str] = ()) -> DataFrame:
    """Temperature and the four reaction quantities of each reaction, as rows."""
    names = [c for c in sheet.columns if c != row and c not in keys]
    data = sheet.filter(F.col(row).between(first + 1, last + 1)).select(
        *[quoted(k) for k in keys], row, *[to_number(F.col(quoted(c))).alias(c) for c in names]
    )
    keyed = data.withColumn("temperature", F.col(quoted(names[0])))
    return block_series(keyed, [*keys, row, "temperature"], REACTION_BLOCKS, REACTION_STRIDE, REACTION_COUNT)
