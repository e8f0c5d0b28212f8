"""Exact top-k search by inner product, pruned with multi-resolution segment statistics.

A vector is cut into segments, each described by its mean and its deviation. For two vectors a and b the centred parts obey
Cauchy-Schwarz, so the sum over segments of ``width * (mean_a * mean_b + deviation_a * deviation_b)`` is never below their inner
product; as a squared distance is ``|a|^2 + |b|^2 - 2ab``, this is the lower bound of their distance. Resolutions run from coarse to
fine; vectors that stay above the k-th best score so far are the survivors, and only they get their exact product.

Queries and candidates meet in a grid of blocks of bounded size, and each cell keeps its k best for each query.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part, nor do null ids; of a repeated id the
smallest vector counts; shorter vectors are filled up with zeros; ties go to the smaller id; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
#: Segments at each resolution.
RESOLUTIONS = (4, 16, 32)


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of equal segments, scaled so that the product of two rows bounds the inner product of their vectors."""
    n, width = vectors.shape
    size = max(1, -(-width // segments))
    cut = np.zeros((n, size * (-(-width // size))))
    cut[:, :width] = vectors
    cut = cut.reshape(n, -1, size)
    mean = cut.mean(axis=2)
    deviation = np.sqrt(np.maximum((cut * cut).mean(axis=2) - mean * mean, 0))
    return math.sqrt(size) * np.concatenate([mean, deviation], axis=1)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    out = np.zeros((len(column), width), np.int64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(column):
        heads = np.cumsum(lengths) - lengths
        row = np.repeat(np.arange(len(column)), lengths)
        out[row, np.arange(len(row)) - heads[row]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def block_top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, resolutions=RESOLUTIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of one block for every query: query id, id, score. Ties go to the smaller id; a query's own id is left out."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    width = max(queries.shape[1], 1)
    largest = max(int(np.abs(queries).max(initial=0)), int(np.abs(vectors).max(initial=0)))
    kind = np.float64 if largest * largest * width < 1 << 53 else np.int64  # products are exact in both
    q, v = queries.astype(kind), vectors.astype(kind)
    levels = [(segment_statistics(queries, s), segment_statistics(vectors, s).T) for s in resolutions if s < width or s == resolutions[0]]
    coarse = levels[0][0] @ levels[0][1]
    norms = np.abs(levels[0][0]).max(initial=0) * np.abs(levels[0][1]).max(initial=0) * len(levels[0][1])
    slack = 1e-9 * (norms + 1)
    out = [], [], []
    for i in range(len(q)):
        own = int(np.searchsorted(ids, query_ids[i]))
        own = own if own < len(ids) and ids[own] == query_ids[i] else -1
        bound = coarse[i]
        if own >= 0:
            bound[own] = -np.inf
        room = len(ids) - (own >= 0)
        keep = min(k, room)
        if keep <= 0:
            continue
        # the products of the most promising ones give a first limit
        first = np.argpartition(-bound, keep - 1)[: keep] if keep < len(ids) else np.flatnonzero(np.arange(len(ids)) != own)
        limit = (v[first] @ q[i]).min()
        left = np.flatnonzero(bound + slack >= limit)
        for mine, theirs in levels[1:]:
            if len(left) <= 4 * keep:
                break
            finer = mine[i] @ theirs[:, left]
            first = left[np.argpartition(-finer, keep - 1)[:keep]]
            limit = max(limit, (v[first] @ q[i]).min())
            left = left[finer + slack >= limit]
        scores = v[left] @ q[i]
        best = np.lexsort((left, -scores))[:keep]
        out[0].append(np.full(len(best), query_ids[i]))
        out[1].append(ids[left[best]])
        out[2].append(scores[best].astype(np.int64))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """``id`` and ``v``: the floor of ``scale`` times each component, for the rows that take part."""
    component = F.col(vector)
    usable = component.isNotNull() & ~F.exists(component, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        rows.where(F.col(key).isNotNull() & F.coalesce(usable, F.lit(False))).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(component).alias("v"))
        .select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    )


def exact_top(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each query its k best others: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    Both sides have ``id`` and ``v``. Rows are hashed into blocks of about ``block_rows``; the grid of query blocks and candidate blocks
    repeats a candidate for each query block and a query for each candidate block.
    """
    sizes = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    asked = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    width = max(sizes["width"], asked["width"], 1)
    rows_of, columns_of = max(1, -(-asked["n"] // block_rows)), max(1, -(-sizes["n"] // block_rows))

    def block(n: int):
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    left = queries.select("id", "v", block(rows_of).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(columns_of - 1))).alias("j"))
    right = vectors.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(rows_of - 1))).alias("i"), block(columns_of).alias("j"))

    def cell(asking: pa.Table, held: pa.Table) -> pa.Table:
        found = block_top(
            asking["id"].to_numpy(), _matrix(asking["v"], width), held["id"].to_numpy(), _matrix(held["v"], width), k
        )
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    best = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(cell, "query_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
