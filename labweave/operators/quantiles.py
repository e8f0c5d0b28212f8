"""Exact quantiles and exact global ranks without a global sort in one task.

Quantiles of few groups cut the value axis at approximate quantiles (the "ladder"). Between two steps
lies an open interval; each step is a point of its own, so a value held by very many rows is never part of an interval.

Ranks, and quantiles of many groups, sort by ranges: each task holds one range of the order, about a million rows, and a rank is the
number of rows in lower ranges plus the place inside the range. Ranges are cut along the tie column too, so a hot value spreads.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labweave.functions.cleaning import nan_to_null
from labweave.operators.columns import quoted
from labweave.session import local_table, materialised

MAX_GROUPS = 10_000
LEAF_ROWS = 1_000_000
TREE_STEPS = 64
SKETCH_TASKS = 64
#: Rows for which a task of its own pays, while there are fewer ranges than cores.
LEAST_RANGE = 20_000
#: The bits of a row number that count inside a partition.
INSIDE_BITS = 33


def _ladders(rows: DataFrame, key: str, value: str, steps: int) -> dict[object, list[float]]:
    """The approximate quantiles of ``value`` for each ``key``, in order and with repeats.

    Each scan task sends its sketch to one of ``SKETCH_TASKS`` tasks, and these merge the sketches in parallel; only their ladders, of
    fixed length, meet in one place, weighted by the rows behind them.
    """
    fractions = [i / steps for i in range(1, steps)]
    sketch = F.percentile_approx(value, fractions, max(10_000, steps * 20))
    parts = rows.groupBy(key, (F.spark_partition_id() % SKETCH_TASKS).alias("_part")).agg(F.count(value).alias("_rows"), sketch.alias("_rungs"))
    rungs = parts.where("_rows > 0").select(key, F.explode("_rungs").alias("_rung"), "_rows")
    merged = rungs.groupBy(key).agg(F.percentile("_rung", fractions, F.col("_rows")).alias("_ladder"))
    return {r[0]: r[1] for r in merged.collect()}


def _search(value: Column, steps: Sequence[float], offset: int) -> Column:
    """Balanced comparison tree: 2 * (steps below) + 1 if the value is a step itself."""
    if not steps:
        return F.lit(2 * offset)
    mid = len(steps) // 2
    here = F.lit(steps[mid])
    return (
        F.when(value < here, _search(value, steps[:mid], offset))
        .when(value == here, F.lit(2 * (offset + mid) + 1))
        .otherwise(_search(value, steps[mid + 1 :], offset + mid + 1))
    )


def _piece_in_array(value: Column, ladder: Column) -> Column:
    below = F.size(F.filter(ladder, lambda s: s < value))
    return (2 * below + F.when(F.array_contains(ladder, value), 1).otherwise(0)).cast("int")


def _piece(value: Column, ladder: Sequence[float]) -> Column:
    """Piece number of a value; long ladders go through a coarse tree, then a short list."""
    if len(ladder) <= TREE_STEPS:
        return _search(value, ladder, 0).cast("int")
    width = ceil(len(ladder) / TREE_STEPS)
    starts = [ladder[i] for i in range(width, len(ladder), width)]
    # block b holds rungs [b * width, (b + 1) * width); its first rung is starts[b - 1]
    block = F.floor((_search(value, starts, 0) + 1) / 2).cast("int")
    blocks = F.array(*[F.array(*[F.lit(x) for x in ladder[i : i + width]]) for i in range(0, len(ladder), width)])
    return (block * (2 * width) + _piece_in_array(value, F.element_at(blocks, block + 1))).cast("int")


@dataclass
class _Cell:
    """An open value interval of one group that still hides wanted ranks."""

    group: object
    low: float | None
    high: float | None
    below: int
    rows: int
    ranks: set[int] = field(default_factory=set)


def _rows_in_cells(rows: DataFrame, cells: Sequence[_Cell], kind: str) -> DataFrame:
    table = local_table(rows.sparkSession, [(i, c.group, c.low, c.high) for i, c in enumerate(cells)], f"cell int, cg {kind}, low double, high double"
    )
    inside = (F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") < F.col("high")))
    return rows.join(F.broadcast(table), (F.col("g") == F.col("cg")) & inside).select("cell", "v")


def _read_leaves(rows: DataFrame, cells: Sequence[_Cell], kind: str) -> dict[tuple[object, int], float]:
    """Values at the wanted ranks of cells short enough to order directly."""
    wanted = local_table(rows.sparkSession, [(i, r - c.below) for i, c in enumerate(cells) for r in sorted(c.ranks)], "wcell int, inner long"
    )
    counts = _rows_in_cells(rows, cells, kind).groupBy("cell", "v").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("cell").orderBy("v")
    spans = counts.withColumn("hi", F.sum("c").over(order)).withColumn("lo", F.col("hi") - F.col("c"))
    hit = (F.col("cell") == F.col("wcell")) & (F.col("inner") >= F.col("lo")) & (F.col("inner") < F.col("hi"))
    picked = spans.join(F.broadcast(wanted), hit).select("cell", "inner", "v").collect()
    return {(cells[r.cell].group, cells[r.cell].below + r.inner): r.v for r in picked}


def _split_cells(rows: DataFrame, cells: Sequence[_Cell], kind: str, steps: int, values: dict) -> list[_Cell]:
    """Cut long cells along a ladder; ranks that fall on a rung are done."""
    members = _rows_in_cells(rows, cells, kind)
    ladders = {cell: sorted(set(rungs)) for cell, rungs in _ladders(members, "cell", "v", steps).items()}
    table = local_table(rows.sparkSession, list(ladders.items()), "lcell int, ladder array<double>")
    pieces = (
        members.join(F.broadcast(table), F.col("cell") == F.col("lcell"))
        .groupBy("cell", _piece_in_array(F.col("v"), F.col("ladder")).alias("piece"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    finer = []
    for i, cell in enumerate(cells):
        below = cell.below
        for r in sorted((r for r in pieces if r.cell == i), key=lambda r: r.piece):
            ranks = {k for k in cell.ranks if below <= k < below + r.n}
            rung = r.piece // 2
            if ranks and r.piece % 2:
                values.update({(cell.group, k): ladders[i][rung] for k in ranks})
            elif ranks:
                low = ladders[i][rung - 1] if rung > 0 else cell.low
                high = ladders[i][rung] if rung < len(ladders[i]) else cell.high
                finer.append(_Cell(cell.group, low, high, below, r.n, ranks))
            below += r.n
    return finer


def group_quantiles(
    df: DataFrame,
    group: str,
    value: str,
    probabilities: Sequence[float],
    steps: int = TREE_STEPS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``(group, p, quantile, n)`` with linear interpolation, exact.

    Scan-only refinement: each round cuts the cells that hold a wanted rank at ``steps``
    approximate quantiles and counts the pieces, until a cell has at most ``leaf_rows``
    rows. No sort of the table and no value list of a group in one task. Counts and
    ladders of the (few) wanted cells are collected. More than ``MAX_GROUPS`` groups are read off a sort by (group, value) instead.
    """
    rows = df.select(F.col(quoted(group)).alias("g"), nan_to_null(F.col(quoted(value)).cast("double")).alias("v")).filter(
        F.col("g").isNotNull() & F.col("v").isNotNull()
    )
    kind = rows.schema["g"].dataType.simpleString()
    totals = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).limit(MAX_GROUPS + 1).collect()
    if len(totals) > MAX_GROUPS:
        return _quantiles_of_many(rows, probabilities).withColumnRenamed("g", group)
    cells = [
        _Cell(r.g, None, None, 0, r.n, {f(p * (r.n - 1)) for p in probabilities for f in (floor, ceil)}) for r in totals
    ]
    values: dict[tuple[object, int], float] = {}
    while cells:
        leaves = [c for c in cells if c.rows <= leaf_rows]
        if leaves:
            values.update(_read_leaves(rows, leaves, kind))
        cells = [c for c in cells if c.rows > leaf_rows]
        if cells:
            cells = _split_cells(rows, cells, kind, steps, values)
    out = []
    for r in totals:
        for p in probabilities:
            at = p * (r.n - 1)
            low, high = values[r.g, floor(at)], values[r.g, ceil(at)]
            out.append((r.g, float(p), low + (high - low) * (at - floor(at)), r.n))
    return local_table(df.sparkSession, out, f"{quoted(group)} {kind}, p double, quantile double, n long")


def column_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], steps: int = TREE_STEPS) -> DataFrame:
    """``(column, p, quantile, n)`` for several numeric columns at once."""
    long = df.select(*[F.col(quoted(c)).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    return group_quantiles(long, "column", "value", probabilities, steps)


def _ranked(rows: DataFrame, order: Sequence[str], name: str, ranges: int | None = None) -> DataFrame:
    """``rows`` with their 1-based place in the order; written once, as two sorts of equal rows need not agree."""
    spark = rows.sparkSession
    if ranges is None:
        n = rows.count()
        ranges = max(1, n // LEAF_ROWS, min(spark.sparkContext.defaultParallelism, n // LEAST_RANGE))
    by = [quoted(c) for c in order]
    held = materialised(rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", INSIDE_BITS)
    counts = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # a row for each range, about a million times fewer than rows
    below = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_below"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << INSIDE_BITS) - 1))
    joined = held.withColumn("_own", part).join(F.broadcast(below), F.col("_own") == F.col("_part"))
    return joined.select(*[quoted(c) for c in rows.columns], (F.col("_below") + inside + 1).cast("bigint").alias(name))


def _quantiles_of_many(rows: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """``(g, p, quantile, n)`` for any number of groups: ranks over (group, value), then the rows at the wanted ranks."""
    ranked = materialised(_ranked(rows, ["g", "v"], "rank"))
    groups = ranked.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    wanted = groups.select("g", "n", "first", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p"))
    wanted = wanted.withColumn("at", F.col("p") * (F.col("n") - 1))
    ends = F.array(F.struct(F.floor("at").alias("place"), (1 - (F.col("at") - F.floor("at"))).alias("share")), F.struct(F.ceil("at").alias("place"), (F.col("at") - F.floor("at")).alias("share")))
    asked = wanted.select("g", "n", "p", "first", F.inline(ends)).select("g", "n", "p", (F.col("first") + F.col("place")).alias("rank"), "share")
    # a rank is one row, so no key is hot
    found = asked.join(ranked.select("rank", "v"), "rank")
    return found.groupBy("g", "p").agg(F.sum(F.col("v") * F.col("share")).alias("quantile"), F.first("n").alias("n"))


def with_global_rank(df: DataFrame, value: str, tie: str, name: str = "rank", steps: int | None = None) -> DataFrame:
    """1-based rank by (value, tie) over all rows; rows with a null value are dropped.

    ``steps`` is the number of ranges, by default about one per million rows. ``tie`` should be unique: rows that agree in both columns
    have no order among them.
    """
    return _ranked(df.filter(F.col(quoted(value)).isNotNull()), [value, tie], name, steps)
