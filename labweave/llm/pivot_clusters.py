"""Centroid clustering of integer vectors with a table of pivot distances (LAESA).

Every vector's distances to a few fixed pivots are computed once and stored beside it. In each round the triangle inequality bounds the
distance to every centroid from below by the largest difference of the two distances to a pivot; only centroids whose bound does not
exceed the best distance so far get their exact integer distance. A round is one scan that sends one row of sums for each cluster and
Arrow batch; the driver holds nothing but ``k`` centroids and the pivots.

Defined cases: vectors that are null, have another length than ``width``, or hold null, NaN or infinite components take no part;
repeated ids and null ids are rows of their own (null ids start a centroid only if there are too few others); ties in the starting order
go to the smaller vector, ties in distance to the smaller centroid; with fewer vectors than ``k`` there are as many centroids as vectors;
an empty table gives no rows; extra columns are not read. Components beyond +-2^27 after scaling would not give distances in 64 bits and
are an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labweave.session import shared_dir

#: Vectors among which the pivots are chosen, and how many become pivots.
PIVOT_POOL, PIVOTS = 64, 8
LARGEST = 1 << 27


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one row, or to as many rows."""
    away = a - b
    return np.einsum("ij,ij->i", away, away)


def spread_pivots(pool: np.ndarray, n: int) -> np.ndarray:
    """Rows far from each other: each next one has the largest sum of distances to those before, as LAESA picks them."""
    chosen, sums = [0], np.zeros(len(pool))
    while len(chosen) < min(n, len(pool)):
        sums += np.sqrt(squared(pool, pool[chosen[-1]]))
        sums[chosen] = -1
        chosen.append(int(sums.argmax()))
    return pool[chosen]


def nearest_centroids(vectors: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of every row, its exact squared distance, and how many exact distances that took.

    ``to_pivots`` are the stored squared distances. Roots are rounded, so bounds give way by more than rounding can add.
    """
    own, theirs = np.sqrt(to_pivots), np.sqrt(np.stack([squared(centroids, p) for p in pivots], axis=1))
    bound = np.zeros((len(vectors), len(centroids)))
    for p in range(len(pivots)):
        mine, other = own[:, p, None], theirs[None, :, p]
        np.maximum(bound, np.abs(mine - other) - 1e-12 * (mine + other), out=bound)
    bound *= bound * (1 - 1e-12)
    cluster = bound.argmin(axis=1)
    best, first, exact = squared(vectors, centroids[cluster]), cluster.copy(), len(vectors)
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= best) & (first != c))
        found = squared(vectors[rows], centroids[c])
        exact += len(rows)
        closer = (found < best[rows]) | ((found == best[rows]) & (c < cluster[rows]))
        cluster[rows[closer]], best[rows[closer]] = c, found[closer]
    return cluster, best, exact


def integer_rows(rows: DataFrame, key: str, vector: str, width: int, scale: int) -> DataFrame:
    """``id`` and ``v``, the floor of ``scale`` times each component, of the rows that take part."""
    held = F.col(vector)
    sound = (F.size(held) == width) & ~F.exists(held, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fits = F.forall(held, lambda x: F.abs(x.cast("double") * scale) <= LARGEST)
    whole = F.transform(held, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    checked = F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component exceeds {LARGEST} after scaling")).cast("array<int>"))
    return rows.where(F.coalesce(sound, F.lit(False))).select(F.col(key).alias("id"), checked.alias("v"))


def starting_order(key: Column) -> Column:
    """The digest by which vectors are taken as first centroids."""
    return F.sha2(F.concat(F.lit("1:"), key.cast("string")).cast("binary"), 256)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _listed(matrix: np.ndarray) -> pa.Array:
    """Each row of a matrix as a list."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(matrix.ravel()))


def _written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read from there: no task repeats the work and no executor's loss loses it."""
    path = f"{shared_dir(rows.sparkSession)}-{name}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _new_centroids(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The floor of every cluster's exact mean; an empty cluster keeps its centroid."""
    k, width = centroids.shape

    def run(batches):
        for batch in batches:
            vectors, table = _matrix(batch.column(0), width), _matrix(batch.column(1), len(pivots))
            if not len(vectors):
                continue
            cluster = nearest_centroids(vectors, table, centroids, pivots)[0]
            order = np.argsort(cluster, kind="stable")
            met, heads = np.unique(cluster[order], return_index=True)
            sums = np.add.reduceat(vectors[order], heads, axis=0)
            times = np.diff(np.append(heads, len(order)))
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(times), _listed(sums)], ["c", "n", "sums"])

    parts = table.select("v", "to_pivots").mapInArrow(run, "c bigint, n bigint, sums array<bigint>")
    total = parts.select("c", "n", F.posexplode("sums").alias("i", "s")).groupBy("c", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    out = centroids.copy()
    for r in total:
        out[r["c"], r["i"]] = r["s"] // r["n"]
    return out


def pivot_clusters(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, pivots: int = PIVOTS
) -> tuple[DataFrame, np.ndarray]:
    """``key``, ``cluster`` and ``distance`` (squared) of every vector that takes part, and the final centroids.

    The first centroids are the ``k`` rows with the smallest digests of their ids; each round assigns all rows and moves the centroids.
    """
    kind = rows.schema[key].dataType.simpleString()
    kept = integer_rows(rows, key, vector, width, scale)
    first = kept.orderBy(starting_order(F.col("id")).asc_nulls_last(), "id", "v").limit(max(k, PIVOT_POOL)).select("v").collect()
    pool = np.array([r["v"] for r in first], np.int64).reshape(-1, width)
    centroids, fixed = pool[:k], spread_pivots(pool, pivots) if len(pool) else pool

    def measured(batches):
        for batch in batches:
            vectors = _matrix(batch.column(1), width)
            table = np.stack([squared(vectors, p) for p in fixed], axis=1) if len(fixed) else np.zeros((len(vectors), 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _listed(table)], ["id", "v", "to_pivots"])

    table = _written(kept.mapInArrow(measured, f"id {kind}, v array<int>, to_pivots array<bigint>"), "pivots")
    for _ in range(rounds if len(pool) else 0):
        centroids = _new_centroids(table, centroids, fixed)

    def assigned(batches):
        for batch in batches:
            cluster, distance, _ = nearest_centroids(_matrix(batch.column(1), width), _matrix(batch.column(2), len(fixed)), centroids, fixed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    placed = table.mapInArrow(assigned, f"id {kind}, cluster int, distance bigint") if len(pool) else table.selectExpr("id", "0 as cluster", "0L as distance")
    return _written(placed, "clusters").withColumnRenamed("id", key), centroids


def with_inertia(placed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds each cluster's sum of distances, the sum of all, and the digest of the cluster's centroid; ``k`` rows reach the driver."""
    sums = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = {c: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for c, v in enumerate(centroids.tolist())}

    def of_cluster(values: dict, kind: str) -> Column:
        pairs = [F.lit(x) for c in sorted(values) for x in (c, values[c])]
        return F.create_map(*pairs)[F.col("cluster")].cast(kind) if pairs else F.lit(None).cast(kind)

    return placed.select(
        "*", of_cluster(sums, "bigint").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("bigint").alias("inertia"),
        of_cluster(digests, "string").alias("centroid_sha256"),
    )
