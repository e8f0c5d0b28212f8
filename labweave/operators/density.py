"""Kernel density of a column on a grid, by linear binning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labweave.functions.stats import STATS, stat, with_stats
from labweave.operators.moments import present

#: Bandwidths beyond which a value adds nothing: the Gaussian kernel is below 1e-10 of its peak there.
REACH = 6.8


def kernel_density(df: DataFrame, column: str, points: int = 200, resolution: int = 50, cut: float = 3.0, factor: float = 1.0) -> DataFrame:
    """``(point, x, density)``: a Gaussian density at equally spaced points, ``cut`` bandwidths beyond the smallest and largest value.

    The bandwidth is the sample deviation times ``n ** -0.2`` times ``factor``. Rows go to two neighbouring cells of a lattice of
    ``resolution`` cells a bandwidth, weighted by nearness, and are counted there; each cell that holds anything adds to the grid points
    within ``REACH`` bandwidths. Rows are combined in the task, so the shuffles carry cells and points. Against the direct sum the
    error is at most ``1 / (8 * resolution**2)`` of the kernel's peak, ``1 / (bandwidth * sqrt(2 pi))``. Nulls and NaN are left out; a
    column of fewer than two values or without spread has no density (no rows).
    """
    values = df.select(present(column).alias("v")).where("v is not null")
    known = with_stats(values, values, n=F.count("v"), lo=F.min("v"), hi=F.max("v"), dev=F.stddev_samp("v"))
    width = stat("dev") * F.pow(stat("n").cast("double"), F.lit(-0.2)) * float(factor)
    # the statistics travel with the cells: the same numbers in every row
    scaled = known.where((stat("n") > 1) & (stat("hi") > stat("lo"))).select(
        ((F.col("v") - stat("lo")) / width * resolution).alias("u"), width.alias("h"), stat("n").alias("n"), stat("lo").alias("lo"), stat("hi").alias("hi")
    )
    low = F.floor("u")
    near = F.array(
        F.struct(low.alias("cell"), (1 - (F.col("u") - low)).alias("w")),
        F.struct((low + 1).alias("cell"), (F.col("u") - low).alias("w")),
    )
    cells = scaled.select("h", "n", "lo", "hi", F.inline(near)).groupBy("cell").agg(
        F.sum("w").alias("w"), *[F.first(c).alias(c) for c in ("h", "n", "lo", "hi")]
    )
    start, step = F.col("lo") - cut * F.col("h"), (F.col("hi") - F.col("lo") + 2 * cut * F.col("h")) / (points - 1)
    placed = cells.select("w", "h", "n", start.alias("start"), step.alias("step"), (F.col("lo") + F.col("cell") * F.col("h") / resolution).alias("c"))
    first = F.greatest(F.lit(0), F.ceil((F.col("c") - REACH * F.col("h") - F.col("start")) / F.col("step")).cast("int"))
    last = F.least(F.lit(points - 1), F.floor((F.col("c") + REACH * F.col("h") - F.col("start")) / F.col("step")).cast("int"))
    reached = placed.withColumns({"first": first, "last": last}).where("first <= last")
    hit = reached.select("*", F.explode(F.sequence("first", "last")).alias("point"))
    at = F.col("start") + F.col("point") * F.col("step")
    away = (at - F.col("c")) / F.col("h")
    density = F.col("w") * F.exp(-0.5 * away * away) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    found = hit.groupBy("point").agg(F.sum(density).alias("density"))
    # points that no value reaches have no density
    grid = known.select(STATS).limit(1).where((stat("n") > 1) & (stat("hi") > stat("lo"))).select(
        (stat("lo") - cut * width).alias("a"), ((stat("hi") - stat("lo") + 2 * cut * width) / (points - 1)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    )
    return grid.join(found, "point", "left").select("point", (F.col("a") + F.col("point") * F.col("b")).alias("x"), F.coalesce("density", F.lit(0.0)).alias("density"))
