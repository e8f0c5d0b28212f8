"""Labelled rows for the classifiers: who may be learnt from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from: the checksum of the id as text divides by 5. A null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """``key`` and 0/1 ``y`` of the rows that may be learnt from; of contradicting labels the larger counts."""
    return (
        labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key)))
        .groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("y"))
    )


def sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[int, float]]:
    """At most ``per_label`` labelled documents of each class, and how many rows of its class each one stands for.

    The rows are those with the smallest digests of their ids, so the choice is stable. Ids are chosen from the narrow label table; at
    most twice ``per_label`` of them meet the documents in a broadcast, which that number bounds.
    """
    known = training_labels(labels, label, key)
    order = F.xxhash64("key", F.lit(29))
    of = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = known.where("y = 0").orderBy(order, "key").limit(per_label).unionByName(known.where("y = 1").orderBy(order, "key").limit(per_label))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "key").dropDuplicates(["key"])
    return rows, {y: n / min(n, per_label) for y, n in of.items()}
