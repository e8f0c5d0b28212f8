"""Response surfaces without gaps: empty cells take the value of the nearest filled ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labweave.functions.stats import stat, with_stats
from labweave.operators.columns import quoted
from labweave.operators.profile import _all_bins

NEAREST = 4


def nearest_filled(bins: np.ndarray, centres: np.ndarray, cells: int, k: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of every empty cell of a ``cells`` x ``cells`` grid: its place, the ``k`` nearest filled cells and their distances.

    ``bins`` are the filled cells from 1, ``centres`` the means of their points in cell widths. Rings of cells around the empty one are
    searched outwards; what lies beyond ring r is at least r + 0.5 away, so the search ends when the k-th best is nearer.
    Ties go to the lower cell.
    """
    where = np.full((cells + 1, cells + 1), -1)
    where[bins[:, 0], bins[:, 1]] = np.arange(len(bins))
    empty = np.argwhere(where[1:, 1:] < 0) + 1
    found: list[list[int]] = [[] for _ in empty]
    best = [np.zeros(0, int)] * len(empty)
    far = [np.zeros(0)] * len(empty)
    waiting, ring = np.arange(len(empty)), 1
    while len(waiting) and ring < cells:
        side = np.arange(-ring, ring + 1)
        inner = np.arange(-ring + 1, ring)
        offsets = np.concatenate([
            np.stack([np.full(len(side), -ring), side], 1), np.stack([np.full(len(side), ring), side], 1),
            np.stack([inner, np.full(len(inner), -ring)], 1), np.stack([inner, np.full(len(inner), ring)], 1),
        ])
        at = empty[waiting][:, None, :] + offsets
        inside = ((at >= 1) & (at <= cells)).all(axis=2)
        cell = np.where(inside, where[np.where(inside, at[:, :, 0], 0), np.where(inside, at[:, :, 1], 0)], -1)
        still = []
        for e, row in zip(waiting.tolist(), cell, strict=True):
            found[e] += row[row >= 0].tolist()
            if len(found[e]) >= min(k, len(bins)):
                some = np.sort(np.array(found[e]))
                away = np.sqrt(((centres[some] - (empty[e] - 0.5)) ** 2).sum(axis=1))
                order = np.argsort(away, kind="stable")[:k]
                if away[order[-1]] <= ring + 0.5 or ring + 1 == cells or len(some) == len(bins):
                    best[e], far[e] = some[order], away[order]
                    continue
            still.append(e)
        waiting, ring = np.array(still, int), ring + 1
    return empty, best, far


def filled_surface(df: DataFrame, x: str, y: str, z: str, cells: int = 100, nearest: int = NEAREST) -> DataFrame:
    """``(bin_x, bin_y, z, n)`` of every cell of the grid: the mean of its points, or with ``n`` 0 an interpolated value.

    An empty cell takes the mean of the ``nearest`` filled cells, weighted by the inverse square of the distance, in cell widths, from
    its centre to the mean place of their points. Points are aggregated by cell first; the search then works on at most ``cells`` squared
    rows, in one task. Rows that miss a value are left out; no rows give no surface.
    """
    rows = df.select(*[F.col(quoted(c)).cast("double").alias(a) for c, a in ((x, "x"), (y, "y"), (z, "z"))]).dropna()
    known = with_stats(rows, rows, lx=F.min("x"), hx=F.max("x"), ly=F.min("y"), hy=F.max("y"))
    place = {f"c{a}": F.coalesce(F.try_divide((F.col(a) - stat(f"l{a}")) * cells, stat(f"h{a}") - stat(f"l{a}")), F.lit((cells + 1) // 2 - 0.5)) for a in ("x", "y")}
    placed = known.select("x", "y", "z", *[c.alias(n) for n, c in place.items()])
    held = _all_bins(placed, ["x", "y"], cells, rows).groupBy(F.col("b0").alias("bin_x"), F.col("b1").alias("bin_y")).agg(
        F.avg("z").alias("z"), F.count(F.lit(1)).alias("n"), F.avg("cx").alias("cx"), F.avg("cy").alias("cy")
    )

    def fill(table: pa.Table) -> pa.Table:
        bins = np.stack([table["bin_x"].to_numpy(), table["bin_y"].to_numpy()], axis=1)
        order = np.lexsort((bins[:, 1], bins[:, 0]))
        bins, centres = bins[order], np.stack([table["cx"].to_numpy(), table["cy"].to_numpy()], axis=1)[order]
        values, counts = table["z"].to_numpy()[order], table["n"].to_numpy()[order]
        empty, best, far = nearest_filled(bins, centres, cells, nearest)
        weights = [1 / np.maximum(d, 1e-12) ** 2 for d in far]
        made = [float(w @ values[b] / w.sum()) for w, b in zip(weights, best, strict=True)]
        all_bins = np.concatenate([bins, empty]).astype(np.int32)
        columns = [all_bins[:, 0], all_bins[:, 1], np.concatenate([values, made]), np.concatenate([counts, np.zeros(len(empty), np.int64)])]
        return pa.table([pa.array(c) for c in columns], names=["bin_x", "bin_y", "z", "n"])

    return held.groupBy().applyInArrow(fill, "bin_x int, bin_y int, z double, n bigint")
