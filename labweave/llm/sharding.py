"""Proportional stratified interleaving into shards.

Rows of each source are put into a seeded random order, placed at the fractional rank ``(rank - 1/2) / rows of the source``, and all
rows are sorted by that fraction: any run of the order holds the sources in their overall proportions. Cutting it into equal counts
gives the shards, so every shard matches the mixture and row counts differ by one at most.

Ranks inside a source and in the whole order are counted over buckets of about ``bucket_rows`` rows: rows are ranked inside their bucket
and the rows of earlier buckets are added. The seeded order is uniform, so a source that holds a third of all rows spreads over a third
of the buckets, and no window runs over a whole source or the whole table.

Defined cases: a null text has no bytes (size 1, checksum 0); null sources are one source; repeated rows keep a place each; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 20_000
#: Denominator of the random order's buckets; 52 bits of a digest are exact in a double.
_SPAN = float(1 << 52)


def _seeded(key: Column, seed: int) -> Column:
    """13 hex digits of a digest of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")).substr(1, 13)


def _before(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per bucket, the rows of the same keys in earlier buckets: a window over bucket counts only."""
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_rows"))
    order = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return counts.select(*keys, "_bucket", (F.sum("_rows").over(order.orderBy("_bucket")) - F.col("_rows")).alias("_before"))


def stratified_shards(rows: DataFrame, key: str, source: str, n_shards: int, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``shard`` and the gapless ``slot`` in it. Keep ``rows`` narrow: it is read for the counts and again for the ranks."""
    keyed = rows.withColumn("_order", _seeded(F.col(key), seed)).withColumn("_source", F.coalesce(F.col(source).cast("string"), F.lit("\0")))
    sizes = keyed.groupBy("_source").agg(F.count("*").alias("_of"))
    total = sizes.agg(F.coalesce(F.sum("_of"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-total // bucket_rows))
    spread = F.conv(F.col("_order"), 16, 10).cast("double") / F.lit(_SPAN)
    placed = keyed.withColumn("_bucket", F.floor(spread * buckets).cast("long"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_order", key)
    fraction = (F.row_number().over(inside) + F.col("_before") - F.lit(0.5)) / F.col("_of")
    mixed = (
        placed.join(_before(placed, ["_source"]), ["_source", "_bucket"]).join(sizes, "_source")
        .withColumn("_at", fraction).drop("_before", "_bucket", "_of")
        .withColumn("_bucket", F.least(F.floor(F.col("_at") * buckets).cast("long"), F.lit(buckets - 1)))
    )
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_at", "_source", "_order", key)) + F.col("_before") - 1
    return (  # shard s begins at the place s * total / n_shards, rounded up
        mixed.join(_before(mixed, []), "_bucket").withColumn("_place", place.cast("long")).withColumn("shard", F.expr(f"(_place * {n_shards}L) div {max(total, 1)}L").cast("int"))
        .withColumn("slot", F.col("_place") - F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L"))
        .drop("_bucket", "_before", "_at", "_order", "_source", "_place")
    )
