"""Equal-width binning with right-closed bins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_right_closed_bins(df: DataFrame, specs: Mapping[str, tuple[Column, Column, Column]], bins: int = 5) -> DataFrame:
    """Add bin numbers 1..bins: name -> (value, low, high).

    A value on an inner edge belongs to the bin below it; a constant column sits in the
    middle bin. The division only guesses; comparing with the two edges of the guess makes
    it exact. Width and guess are projected first: repeated inside one expression they
    would outgrow the method size that the JVM compiles.
    """
    width = {n: f"_w{i}" for i, n in enumerate(specs)}
    guess = {n: f"_g{i}" for i, n in enumerate(specs)}
    out = df.withColumns({width[n]: (high - low) / F.lit(float(bins)) for n, (_, low, high) in specs.items()})
    out = out.withColumns(
        {
            guess[n]: F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(F.try_divide(v - low, F.col(width[n]))).cast("int")))
            for n, (v, low, _) in specs.items()
        }
    )

    def number(n: str) -> Column:
        v, low, high = specs[n]
        w, g = F.col(width[n]), F.col(guess[n])
        down = ((g > 1) & (v <= low + (g - 1) * w)).cast("int")
        up = ((g < bins) & (v > low + g * w)).cast("int")
        return F.when(high == low, F.when(v.isNotNull(), F.lit((bins + 1) // 2))).otherwise(g - down + up)

    picked = out.withColumns({n: F.when(specs[n][0].isNotNull(), number(n)) for n in specs})
    return picked.drop(*width.values(), *guess.values())


def bin_interval(number: Column, low: Column, high: Column, bins: int = 5) -> Column:
    """``struct<bin, lo, hi>``; the lowest edge is widened by 0.1 % of the range."""
    width = (high - low) / F.lit(float(bins))
    pad = F.when(low == 0, F.lit(0.001)).otherwise(F.abs(low) * 0.001)
    flat_width = 2 * pad / F.lit(float(bins))
    start = low + (number - 1) * width - F.when(number == 1, (high - low) * 0.001).otherwise(F.lit(0.0))
    ends = F.when(
        high == low,
        F.struct(number.alias("bin"), (low - pad + (number - 1) * flat_width).alias("lo"), (low - pad + number * flat_width).alias("hi")),
    ).otherwise(F.struct(number.alias("bin"), start.alias("lo"), (low + number * width).alias("hi")))
    return F.when(number.isNotNull(), ends)
