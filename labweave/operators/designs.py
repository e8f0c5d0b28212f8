"""Designs of experiments, built in place by Spark from ranges of integers."""

from __future__ import annotations

from collections.abc import Mapping
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labweave.functions.cleaning import quantise
from labweave.functions.lowdiscrepancy import BITS, MAX_DIMENSIONS, sobol_point
from labweave.operators.columns import quoted

Factors = Mapping[str, tuple[float, float, float]]


def level_count(low: float, high: float, step: float) -> int:
    """Levels from low to high, the end included when it is reached within half a step."""
    return max(0, ceil((high + step / 2 - low) / step))


def full_factorial(spark: SparkSession, factors: Factors) -> DataFrame:
    """Every level combination, the last factor varying fastest.

    A run number is split into level numbers by integer division, so the design needs
    no cross join and spreads evenly over tasks at any size.
    """
    sizes = {name: level_count(*spec) for name, spec in factors.items()}
    total = 1
    for size in sizes.values():
        total *= size
    run, divisor, levels = F.col("id"), total, []
    for name, (low, _, step) in factors.items():
        divisor //= max(1, sizes[name])
        number = F.floor(run / F.lit(divisor)) % sizes[name] if divisor > 1 else run % sizes[name]
        levels.append((F.lit(float(low)) + number * F.lit(float(step))).alias(name))
    return spark.range(total).select(F.col("id").alias("run"), *levels)


def default_skip(n: int) -> int:
    """Leading sequence points left out: the next power of two, at least 16."""
    return max(16, 2 ** ceil(log2(max(n, 1))))


def role_names(d: int) -> list[str]:
    """Row roles of one block, in order: A, AB_1..AB_d, BA_1..BA_d, B."""
    return ["A", *[f"AB_{j}" for j in range(1, d + 1)], *[f"BA_{j}" for j in range(1, d + 1)], "B"]


def saltelli_blocks(
    blocks: DataFrame,
    bounds: Mapping[str, tuple[float, float]],
    points: int,
    skip: int | None = None,
    block_id: str = "block_id",
    second_order: bool = True,
) -> DataFrame:
    """Rows of the Saltelli design for the given block ids ``0 .. points - 1``.

    Each block is expanded in place to 2 D + 2 rows (D + 2 without second order):
    ``block_id, role_no, role, <factors>``; other columns of ``blocks`` are kept.
    """
    d = len(bounds)
    if 2 * d > MAX_DIMENSIONS:
        raise ValueError(f"at most {MAX_DIMENSIONS // 2} factors")
    skip = default_skip(points) if skip is None else skip
    bits = max(1, (points + skip).bit_length())
    if bits > BITS:
        raise ValueError(f"the sequence has 2^{BITS} points; {points} blocks after a skip of {skip} would repeat them")
    index = F.col(quoted(block_id)).cast("bigint") + F.lit(skip)
    low_high = list(bounds.values())

    def scaled(dimension: int) -> Column:
        low, high = low_high[dimension % d]
        return F.lit(float(low)) + sobol_point(index, dimension, bits) * F.lit(float(high - low))

    base = blocks.select(
        "*",
        *[scaled(j).alias(f"_a{j}") for j in range(d)],
        *[scaled(j + d).alias(f"_b{j}") for j in range(d)],
    )

    def row(number: int, role: str) -> Column:
        if role in ("A", "B"):
            picks = [role.lower()] * d
        else:
            main, other = role[0].lower(), role[1].lower()
            swapped = int(role[3:]) - 1
            picks = [other if j == swapped else main for j in range(d)]
        values = [F.col(f"_{picks[j]}{j}").alias(name) for j, name in enumerate(bounds)]
        return F.struct(F.lit(number).alias("role_no"), F.lit(role).alias("role"), *values)

    roles = [r for r in role_names(d) if second_order or not r.startswith("BA")]
    return base.select(*[quoted(c) for c in blocks.columns], F.inline(F.array(*[row(i, r) for i, r in enumerate(roles)])))


def saltelli_design(spark: SparkSession, bounds: Mapping[str, tuple[float, float]], n: int, **options) -> DataFrame:
    """The design for n fresh blocks, from ``spark.range``."""
    return saltelli_blocks(spark.range(n).select(F.col("id").alias("block_id")), bounds, n, **options)


def quantise_design(design: DataFrame, factors: Factors) -> DataFrame:
    """Round every factor to its step and clip it to its range; a missing factor is an error."""
    missing = [name for name in factors if name not in design.columns]
    if missing:
        raise KeyError(f"factors not in the design: {missing}")
    return design.withColumns({n: quantise(F.col(quoted(n)), step, low, high) for n, (low, high, step) in factors.items()})
