"""Column profiles: correlation, nulls, distinct values, bins, frequencies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labweave.functions.binning import bin_interval, with_right_closed_bins
from labweave.functions.stats import STATS, stat, with_stats
from labweave.operators.columns import quoted
from labweave.operators.lookup import bounded_copy, hot_keys, salted_left_join
from labweave.operators.moments import pair_correlation, pair_moments
from labweave.operators.quantiles import group_quantiles
from labweave.session import materialised


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(name_i, name_j, corr, n)`` for i < j, each pair over its own complete rows.

    NaN counts as missing, and a column without spread has no correlation (null). One scan and one rule, however many columns there are.
    """
    names = F.array(*[F.lit(c) for c in columns])
    return pair_moments(df, columns).filter(F.col("i") < F.col("j")).select(
        F.element_at(names, F.col("i") + 1).alias("name_i"),
        F.element_at(names, F.col("j") + 1).alias("name_j"),
        pair_correlation().alias("corr"),
        F.col("n").cast("bigint").alias("n"),
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or df.columns)
    row = df.agg(*[F.count_if(F.col(quoted(c)).isNull()).alias(f"n{i}") for i, c in enumerate(columns)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(columns)]
    return row.select(F.inline(F.array(*cells)))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, the null included."""
    return df.select(quoted(column)).distinct()


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column.

    The exact form goes through (column, value) pairs: a two-step aggregate that spreads
    by value, where several ``count(distinct)`` in one aggregate would end in one task.
    """
    if approximate:
        row = df.agg(*[F.approx_count_distinct(quoted(c)).alias(f"n{i}") for i, c in enumerate(columns)])
        cells = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_distinct")) for i, c in enumerate(columns)]
        return row.select(F.inline(F.array(*cells)))
    kinds = dict(df.dtypes)
    # adding zero makes the two zeros of floating point one value
    value = {c: F.col(quoted(c)) + F.lit(0.0) if kinds[c] in ("double", "float") else F.col(quoted(c)) for c in columns}
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), value[c].cast("string").alias("v")) for c in columns])
    counted = df.select(F.inline(pairs)).distinct().groupBy("column").agg(F.count("v").alias("n_distinct"))
    return counted


def bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, lo, hi)`` per numeric column, from one aggregate pass."""
    row = df.agg(
        *[F.min(quoted(c)).cast("double").alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(quoted(c)).cast("double").alias(f"hi{i}") for i, c in enumerate(columns)],
    )
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"))
        for i, c in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*cells)))


def with_frequency(df: DataFrame, column: str, name: str = "frequency") -> DataFrame:
    """Attach how often a row's own value occurs; null for null.

    Counts are aggregated first and joined back: by broadcast when there are few distinct
    values, else by a shuffle in which the hot values, which the counts tell, are salted, so a value held by a third of the rows is
    never one task's work as it would be in a window.
    """
    key = F.col(quoted(column))
    counts = df.filter(key.isNotNull()).groupBy(key.alias("_value")).agg(F.count(F.lit(1)).alias(name))
    small = bounded_copy(counts)
    if small is not None:
        joined = df.join(F.broadcast(small), key == F.col("_value"), "left")
    else:
        known = materialised(counts)  # they tell the hot values as well
        joined = salted_left_join(df, known, key, "_value", hot_keys(known, "_value", name))
    return joined.select(*[quoted(c) for c in df.columns], name)


def with_bin(df: DataFrame, column: str, bins: int = 5, name: str = "bin", interval: bool = False) -> DataFrame:
    """Equal-width right-closed bin number (or interval struct) over the column's range."""
    value = F.col(quoted(column)).cast("double")
    known = with_stats(df, df, lo=F.min(value), hi=F.max(value))
    binned = with_right_closed_bins(known, {name: (value, stat("lo"), stat("hi"))}, bins)
    if interval:
        binned = binned.withColumn(name, bin_interval(F.col(quoted(name)), stat("lo"), stat("hi"), bins))
    return binned.drop(STATS)


def _ranges(columns: Sequence[str]) -> dict:
    return {
        **{f"lo{i}": F.min(quoted(c)).cast("double") for i, c in enumerate(columns)},
        **{f"hi{i}": F.max(quoted(c)).cast("double") for i, c in enumerate(columns)},
    }


def _all_bins(df: DataFrame, columns: Sequence[str], bins: int, source: DataFrame | None = None) -> DataFrame:
    """Columns ``b0, b1, ..``: the bin numbers of several columns over their ranges in ``source``."""
    known = with_stats(df, df if source is None else source, **_ranges(columns))
    specs = {
        f"b{i}": (F.col(quoted(c)).cast("double"), stat(f"lo{i}"), stat(f"hi{i}")) for i, c in enumerate(columns)
    }
    return with_right_closed_bins(known, specs, bins).drop(STATS)


def bin_distribution(df: DataFrame, column: str, target: str, probabilities: Sequence[float], bins: int = 5) -> DataFrame:
    """Exact target quantiles and counts per equal-width bin of another column."""
    known = df.select(quoted(column), quoted(target)).filter(F.col(quoted(column)).isNotNull())
    # never null now; saying so keeps null checks on the bin from being pushed down as its whole expression
    binned = with_bin(known, column, bins).withColumn("bin", F.coalesce("bin", F.lit(0)))
    return group_quantiles(binned, "bin", target, probabilities)


def bin_histogram(df: DataFrame, column: str, target: str, bins: int = 5, cells: int = 10) -> DataFrame:
    """Counts of the target in equal-width cells, per bin of another column."""
    both = with_bin(with_bin(df, column, bins), target, cells, "cell")
    return both.groupBy("bin", "cell").agg(F.count(F.lit(1)).alias("n"))


def pair_histograms(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Bin counts of every column pair i < j, and of every column alone (i = j).

    Rows fan out to one narrow struct per pair and are combined in the task, so the
    shuffle holds at most ``pairs * bins**2`` rows per task.
    """
    binned = _all_bins(df.select(*[quoted(c) for c in columns]), columns, bins)
    cells = [
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"b{i}").alias("bin_i"), F.col(f"b{j}").alias("bin_j"))
        for i in range(len(columns))
        for j in range(i, len(columns))
    ]
    counts = (
        binned.select(F.inline(F.array(*cells)))
        .filter(F.col("bin_i").isNotNull() & F.col("bin_j").isNotNull())
        .groupBy("i", "j", "bin_i", "bin_j")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    names = F.array(*[F.lit(c) for c in columns])
    return counts.select(
        F.element_at(names, F.col("i") + 1).alias("name_i"), F.element_at(names, F.col("j") + 1).alias("name_j"),
        "bin_i", "bin_j", "n",
    )


def bubble_table(df: DataFrame, x: str, y: str, group: str, extra: Sequence[str] = ()) -> DataFrame:
    """Points with the frequency of their group value, ready for a bubble chart."""
    return with_frequency(df.select(*[quoted(c) for c in (x, y, group, *extra)]), group)


def response_surface(df: DataFrame, x: str, y: str, z: str, cells: int = 100) -> DataFrame:
    """Mean of z (with count) on an equal-width cells x cells grid."""
    # bins are null only where their input is: a filter on a bin would be pushed down as its whole expression
    rows = df.select(*[F.col(quoted(c)) for c in (x, y, z)]).dropna()
    return (
        _all_bins(rows, [x, y], cells, df)
        .groupBy(F.col("b0").alias("bin_x"), F.col("b1").alias("bin_y"))
        .agg(F.avg(quoted(z)).alias("z"), F.count(F.lit(1)).alias("n"))
    )


def response_surfaces(df: DataFrame, inputs: Sequence[str], outputs: Sequence[str], cells: int = 100) -> DataFrame:
    """The surface of every (input pair, output) in one scan and one aggregate."""
    binned = _all_bins(df, inputs, cells).select(
        *[f"b{i}" for i in range(len(inputs))],
        *[F.col(quoted(c)).cast("double").alias(f"z{k}") for k, c in enumerate(outputs)],
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(inputs[i]).alias("name_x"),
                F.lit(inputs[j]).alias("name_y"),
                F.col(f"b{i}").alias("bin_x"),
                F.col(f"b{j}").alias("bin_y"),
            )
            for i, j in combinations(range(len(inputs)), 2)
        ]
    )
    wide = (
        binned.select(*[f"z{k}" for k in range(len(outputs))], F.inline(pairs))
        .filter(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull())
        .groupBy("name_x", "name_y", "bin_x", "bin_y")
        .agg(
            *[F.avg(f"z{k}").alias(f"m{k}") for k in range(len(outputs))],
            *[F.count(f"z{k}").alias(f"n{k}") for k in range(len(outputs))],
        )
    )
    cells_out = F.array(
        *[
            F.struct(F.lit(o).alias("output"), F.col(f"m{k}").alias("z"), F.col(f"n{k}").alias("n"))
            for k, o in enumerate(outputs)
        ]
    )
    return wide.select("name_x", "name_y", "bin_x", "bin_y", F.inline(cells_out)).filter(F.col("n") > 0)
