"""Wide-to-long reshaping and sheet windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labweave.functions.cleaning import to_number
from labweave.operators.columns import quoted
from labweave.operators.lookup import bounded_copy
from labweave.session import local_table

MAX_WINDOWS = 1000


def to_series(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "series", value: str = "value") -> DataFrame:
    """One row per (key, column)."""
    return df.unpivot([F.col(quoted(k)) for k in keys], [F.col(quoted(c)) for c in columns], name, value)


def block_series(df: DataFrame, keys: Sequence[str], blocks: Mapping[str, int], stride: int, count: int) -> DataFrame:
    """Repeated column blocks to rows: block i takes ordinal ``start + stride * i`` per quantity."""
    names = [c for c in df.columns if c not in keys]
    structs = [
        F.struct(
            F.lit(i + 1).alias("block"),
            *[F.col(quoted(names[start + stride * i])).alias(q) for q, start in blocks.items()],
        )
        for i in range(count)
    ]
    return df.select(*[quoted(k) for k in keys], F.inline(F.array(*structs)))


def drop_empty_series(series: DataFrame, group: Sequence[str], value: str = "value") -> DataFrame:
    """Drop the series without any value.

    The (usually few) empty series are found by one aggregate and removed by an anti join:
    a broadcast when the list is small, so that the rows themselves are not shuffled. A
    window count would pull a whole series into one task.
    """
    empty = (
        series.groupBy(*group).agg(F.count(value).alias("_n")).filter(F.col("_n") == 0)
        .select(*[F.col(quoted(g)).alias(f"_e{i}") for i, g in enumerate(group)])
    )
    small = bounded_copy(empty)
    condition = F.lit(True)
    for i, g in enumerate(group):
        condition = condition & F.col(quoted(g)).eqNullSafe(F.col(f"_e{i}"))
    return series.join(empty if small is None else F.broadcast(small), condition, "left_anti")


def _by_ranges(parsed: DataFrame, windows: Sequence[tuple[int, int, int]], row: str) -> DataFrame:
    """Rows with the window they lie in, ``_w``: both meet in stretches of about a window's length, then the ends are compared."""
    stretch = max(1, sum(last - first + 1 for _, first, last in windows) // len(windows))
    listed = local_table(parsed.sparkSession, [(i, x, first + 1, last + 1) for i, (x, first, last) in enumerate(windows, start=1)], "id int, at int, low bigint, high bigint")
    met = F.sequence(F.floor(F.col("low") / stretch), F.floor(F.col("high") / stretch))
    ranges = listed.select("low", "high", F.struct("id", "at").alias("_w"), F.explode(met).alias("_stretch"))
    own = parsed.withColumn("_own", F.floor(F.col(row) / stretch))
    inside = (F.col("_own") == F.col("_stretch")) & F.col(row).between(F.col("low"), F.col("high"))
    return own.join(ranges, inside).drop("_own", "_stretch", "low", "high")


def window_series(
    sheet: DataFrame,
    windows: Sequence[tuple[int, int, int]],
    columns: Mapping[str, int],
    row: str = "_row",
    numeric: bool = True,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Many (x ordinal, first, last) windows of a sheet in a single scan.

    With ``keys`` (a sheet id) the table holds many sheets and the windows apply to each.

    A window's header is on ``first``; its data are rows ``first + 1 .. last + 1``. Each
    row carries the literal window list through a filter, so there is no join at all; a list of more than
    ``MAX_WINDOWS`` is a table of its own that meets the rows by ranges of row numbers.
    Rows with a null x are dropped.
    """
    ordinals = [c for c in sheet.columns if c != row and c not in keys]
    kept = [quoted(k) for k in keys]
    read = (lambda c: to_number(F.col(quoted(c)))) if numeric else (lambda c: F.col(quoted(c)).cast("double"))
    used = sorted({x for x, _, _ in windows} | set(columns.values()))
    low = min(first for _, first, _ in windows) + 1
    high = max(last for _, _, last in windows) + 1
    # every needed cell is parsed once, then only referred to
    parsed = sheet.filter(F.col(row).between(low, high)).select(*kept, row, *[read(ordinals[o]).alias(f"_p{o}") for o in used])
    if len(windows) > MAX_WINDOWS:
        placed = _by_ranges(parsed, windows, row)
    else:
        cases = F.array(
            *[
                F.when(F.col(row).between(first + 1, last + 1), F.struct(F.lit(i).alias("id"), F.lit(x).alias("at")))
                for i, (x, first, last) in enumerate(windows, start=1)
            ]
        )
        placed = parsed.select("*", F.explode(F.array_compact(cases)).alias("_w"))
    x_value = F.coalesce(*[F.when(F.col("_w.at") == x, F.col(f"_p{x}")) for x in sorted({x for x, _, _ in windows})])
    values = F.array(*[F.struct(F.lit(s).alias("series"), F.col(f"_p{o}").alias("value")) for s, o in columns.items()])
    return (
        placed.select("*", x_value.alias("x"))
        .filter(F.col("x").isNotNull())
        .select(*kept, F.col("_w.id").alias("window_id"), row, "x", F.inline(values))
    )
