"""Lookup joins with defaults, reverse name maps, concat, pairs and products."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labweave.functions.cleaning import strip
from labweave.operators.columns import insert_after, quoted
from labweave.session import local_table

BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 1 << 25
LITERAL_ROWS = 10_000
SALTS = 16
#: A key is hot from so many rows on; at most so many keys are.
HOT_ROWS, MAX_HOT = 100, 1000


def bounded_copy(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame | None:
    """The table as a local relation when it has at most ``limit`` rows and ``most_bytes`` bytes, else None.

    One job answers both "is it small?" and "what is in it?"; later uses neither count nor
    recompute it. Reading stops one row beyond the limit, and no more than the bytes reach the driver.
    """
    names = [*df.columns, "_over"]

    def capped(batches):
        used = 0
        for batch in batches:
            used += batch.nbytes
            over = used > most_bytes
            part = batch.slice(0, 1) if over else batch
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([over] * len(part), pa.bool_())], names)
            if over:
                return

    kinds = T.StructType([*df.schema.fields, T.StructField("_over", T.BooleanType())])
    rows = df.limit(limit + 1).coalesce(1).mapInArrow(capped, kinds).toArrow()
    if rows.num_rows > limit or pc.any(rows["_over"]).as_py():
        return None
    return df.sparkSession.createDataFrame(rows.drop_columns(["_over"]), df.schema)


def hot_keys(counts: DataFrame, key: str, n: str) -> list:
    """The keys with at least ``HOT_ROWS`` rows, the ``MAX_HOT`` most frequent of them: a key beyond these has less than one row in
    ``MAX_HOT``."""
    top = counts.where(F.col(n) >= HOT_ROWS).orderBy(F.col(n).desc(), key).limit(MAX_HOT)
    return [r[0] for r in top.select(key).collect()]


def salted_left_join(facts: DataFrame, side: DataFrame, fact_key: Column, side_key: str, hot: list | None = None) -> DataFrame:
    """Left join by shuffle that spreads hot keys: their facts are salted, and only their rows of the unique-keyed side are copied.

    Without ``hot``, the facts' keys are counted first. The salt hangs on the row and on the task that reads it, so equal rows of
    different tasks spread too, and a repeated task draws the same salts. Facts without a key match nothing and spread as well.
    """
    if hot is None:
        hot = hot_keys(facts.where(fact_key.isNotNull()).groupBy(fact_key.alias("_k")).agg(F.count(F.lit(1)).alias("_n")), "_k", "_n")
    is_hot = (lambda key: key.isin(hot)) if hot else (lambda key: F.lit(False))
    replicated = side.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.when(is_hot(F.col(side_key)), SALTS - 1).otherwise(0))))
    salt = F.pmod(F.xxhash64(*[quoted(c) for c in facts.columns], F.spark_partition_id()), F.lit(SALTS)).cast("int")
    salted = facts.withColumn("_salt_l", F.when(fact_key.isNull() | is_hot(fact_key), salt).otherwise(0))
    return salted.join(replicated, (fact_key == F.col(side_key)) & (F.col("_salt_l") == F.col("_salt_r")), "left")


def dimension(spark: SparkSession, rows: Mapping[str, tuple], key: str, attributes: Sequence[str]) -> DataFrame:
    """Constant dictionary as a dimension table (a local relation, so its size is known)."""
    if len(rows) > LITERAL_ROWS:
        raise ValueError("too many rows for a literal dimension; read it as a table")
    first = next(iter(rows.values()))
    kinds = ["int" if isinstance(v, int) else "double" for v in first]
    schema = f"{key} string, " + ", ".join(f"{a} {k}" for a, k in zip(attributes, kinds))
    return local_table(spark, [(k, *v) for k, v in rows.items()], schema)


def lookup(
    df: DataFrame,
    dim: DataFrame,
    key: str,
    dim_key: str,
    attributes: Mapping[str, str],
    default=None,
    bounded: bool | None = None,
) -> DataFrame:
    """Left lookup on the stripped key; misses and null keys get ``default``.

    ``attributes`` maps dimension columns to output columns. The dimension is broadcast
    only when it is known (``bounded=True``) or read to be small. A larger one is joined
    by a salted shuffle.
    """
    side = dim.select(
        strip(F.col(quoted(dim_key))).alias("_dim_key"),
        *[F.col(quoted(a)).alias(f"_dim_{i}") for i, a in enumerate(attributes)],
    )
    fact_key = strip(F.col(quoted(key)))
    if bounded is None:
        # one row for each stripped key, so that no fact is doubled: the one with the smallest raw key
        names = [f"_dim_{i}" for i in range(len(attributes))]
        raw = side.withColumn("_raw", F.col("_dim_key")) if not names else dim.select(
            strip(F.col(quoted(dim_key))).alias("_dim_key"), F.col(quoted(dim_key)).cast("string").alias("_raw"),
            *[F.col(quoted(a)).alias(n) for a, n in zip(attributes, names)],
        )
        side = raw.groupBy("_dim_key").agg(F.min_by(F.struct("_raw", *names), "_raw").alias("_row")).select("_dim_key", *[f"_row.{n}" for n in names])
        small = bounded_copy(side)
        bounded, side = small is not None, small if small is not None else side
    if bounded:
        joined = df.join(F.broadcast(side), fact_key == F.col("_dim_key"), "left")
    else:
        joined = salted_left_join(df, side, fact_key, "_dim_key")
    outputs = {}
    for i, name in enumerate(attributes.values()):
        value = F.col(f"_dim_{i}")
        outputs[name] = value if default is None else F.coalesce(value, F.lit(default).cast(side.schema[f"_dim_{i}"].dataType))
    helpers = [c for c in joined.columns if c in side.columns or c in ("_salt_l", "_salt_r")]
    return joined.withColumns(outputs).drop(*helpers)


def lookup_roles(
    df: DataFrame, dim: DataFrame, roles: Mapping[str, Mapping[str, str]], dim_key: str, default=0.0, bounded: bool | None = None
) -> DataFrame:
    """The same dimension looked up for several key columns: broadcast if it is known (``bounded=True``) or read to be small."""
    order = list(df.columns)
    for key, attributes in roles.items():
        df = lookup(df, dim, key, dim_key, attributes, default, bounded)
        order += [a for a in attributes.values() if a not in order]
    return df.select(*[quoted(c) for c in order])


def lookup_after(df: DataFrame, dim: DataFrame, key: str, dim_key: str, attribute: str, name: str, default=0.0,
                 bounded: bool | None = None) -> DataFrame:
    """Lookup whose result column sits directly after its key column."""
    if key not in df.columns:
        return insert_after(df, key, name, F.lit(default), default)
    order = list(df.columns)
    at = order.index(key) + 1
    found = lookup(df, dim, key, dim_key, {attribute: name}, default, bounded)
    return found.select(*[quoted(c) for c in order[:at]], quoted(name), *[quoted(c) for c in order[at:] if c != name])


def unmap_names(names: DataFrame, name_map: Mapping[str, str], column: str = "feature") -> tuple[DataFrame, DataFrame]:
    """Codes back to full names: ``(matched, unmatched)``; the map is a literal."""
    spark = names.sparkSession
    pairs = F.broadcast(local_table(spark, [(c, n) for n, c in name_map.items()], "_code string, full_name string"))
    condition = F.col(column) == F.col("_code")
    return names.join(pairs, condition, "inner").drop("_code"), names.join(pairs, condition, "left_anti")


def concat_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Put two tables side by side, aligned on a row key; rows that only one of them has stay, with nulls for the other."""
    return left.join(right, key, "full")


def name_pairs(spark: SparkSession, names: Sequence[str], outputs: Sequence[str] = ()) -> DataFrame:
    """All pairs i < j of a short name list, one row per output."""
    rows = [
        (i, j, names[i], names[j], out)
        for i, j in combinations(range(len(names)), 2)
        for out in (outputs or [None])
    ]
    return local_table(spark, rows, "i int, j int, name_i string, name_j string, output string")


def attach_grid(df: DataFrame, points: Column) -> DataFrame:
    """Pair every row with every struct of an array column; a narrow step, no join."""
    return df.select("*", F.inline(points))
