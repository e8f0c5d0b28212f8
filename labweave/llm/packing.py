"""Best-fit packing of documents into bins of one capacity, without conflicts.

Two pieces conflict when they come from one source or belong to one cluster of duplicates; a bin never holds both. Each bin carries a
bitmap of its sources and one of its clusters. Bins are kept in order of what room they have left: the search begins at the smallest
room that suffices and goes on to the next until a bin without a conflict is found, which is the tightest compatible one; if there is
none, a new bin is opened. Pieces are placed from the largest to the smallest.

A document longer than a bin is cut into full pieces, which fill bins of their own, and a rest, which is packed like any other. Bins are
packed in blocks of about ``block_rows`` pieces, dealt by a hash of the document's id, so a task's work has a bound and a source or a
cluster that holds a third of all rows spreads over all blocks.

Defined cases: a null or empty text still takes its separator's byte; a null source or cluster conflicts with nothing; ties in size go to
the smaller id, then the earlier piece; repeated rows are separate pieces of one cluster; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY, BLOCK_ROWS = 8192, 4096


def text_size(text: Column) -> Column:
    """UTF-8 bytes and one for the separator."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_cluster(text: Column) -> Column:
    """The same for texts that differ in white space and letter case only."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))))


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """For pieces in order: the bin of each and where in it the piece begins."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    cluster_bit = {c: 1 << i for i, c in enumerate(dict.fromkeys(c for c in clusters if c is not None))}
    rooms: list[tuple[int, int]] = []  # what is left and the bin, in order
    seen: list[list[int]] = []  # bitmaps of a bin's sources and clusters
    bins, begins = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        at = bisect_left(rooms, (size, -1))
        while at < len(rooms) and (seen[rooms[at][1]][0] & s or seen[rooms[at][1]][1] & c):
            at += 1
        if at < len(rooms):
            room, number = rooms.pop(at)
        else:
            room, number = capacity, len(seen)
            seen.append([0, 0])
        seen[number][0] |= s
        seen[number][1] |= c
        bins.append(number)
        begins.append(capacity - room)
        if room > size:
            insort(rooms, (room - size, number))
    return bins, begins


def pack(rows: DataFrame, key: str, size: str, source: str, cluster: str, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every piece of every row: ``key``, ``piece``, ``start`` and ``length`` in the document, ``bin``, ``at`` in the bin, and ``used``,
    what the bin holds."""
    pieces = F.ceil(F.col("size") / capacity)
    items = rows.select(F.col(key).cast("long").alias("key"), F.col(size).cast("long").alias("size"), F.col(source).cast("string").alias("source"), F.col(cluster).cast("long").alias("cluster"))
    total = items.agg(F.coalesce(F.sum(pieces), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_rows))
    cut = items.select(
        F.pmod(F.xxhash64("key", "size"), F.lit(blocks)).alias("block"), "key", F.explode(F.sequence(F.lit(0).cast("long"), (pieces - 1).cast("long"))).alias("piece"), "size", "source", "cluster",
    ).withColumn("start", F.col("piece") * capacity).withColumn("length", F.least(F.col("size") - F.col("start"), F.lit(capacity))).drop("size")

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("key", "ascending"), ("piece", "ascending"), ("source", "ascending")])
        lengths = table["length"].to_pylist()
        bins, begins = best_fit(lengths, table["source"].to_pylist(), table["cluster"].to_pylist(), capacity)
        used = [0] * (max(bins, default=-1) + 1)
        for number, length in zip(bins, lengths):
            used[number] += length
        base = table["block"][0].as_py() << 32
        return pa.table({
            "key": table["key"], "piece": table["piece"], "start": table["start"], "length": table["length"],
            "bin": pa.array([base + b for b in bins], pa.int64()), "at": pa.array(begins, pa.int64()), "used": pa.array([used[b] for b in bins], pa.int64()),
        })

    schema = "key bigint, piece bigint, start bigint, length bigint, bin bigint, at bigint, used bigint"
    return cut.groupBy("block").applyInArrow(one, schema).withColumnRenamed("key", key)


def pack_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    rows = docs.select(F.col(key), text_size(F.col(text)).alias("_size"), F.col(source).alias("_source"), text_cluster(F.col(text)).alias("_cluster"))
    return pack(rows, key, "_size", "_source", "_cluster", capacity, block_rows)
