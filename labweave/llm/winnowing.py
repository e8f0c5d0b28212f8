"""Document fingerprints by winnowing.

Every run of ``k`` code points gets a rolling hash; in each window of ``w`` neighbouring hashes the smallest is chosen, the rightmost
of equals, and its position is kept. Two texts that share ``w + k - 1`` code points in a row share a chosen hash, and a text shorter than
``k`` is its own single run.

Defined cases: a null text counts as empty; an empty text has no fingerprint; two empty fingerprints are alike (1), an empty and
another are not (0). Equal texts give equal fingerprints. Texts are read whole, long ones in overlapping pieces with the same choices.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labweave.llm.arrays import mix

K, W = 20, 31
#: Positions inside a piece and the bits that hold them below a hash.
PIECE, BITS = 1 << 19, 20
_LOW = np.uint64((1 << BITS) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text that one bucket of consecutive documents should hold.
BUCKET_BYTES = 16 << 20

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64; kept, at most PIECE plus a margin long."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` code points, each from the last by one difference of running sums."""
    up, down = _powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: len(codes) - k + 1])


def winnow(codes: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes (44 bits) and their positions, in text order."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = min(k, n)
    grams = n - k + 1
    hashes, places = [], []
    for start in range(0, max(grams - w + 1, 1), PIECE):
        stop = min(start + PIECE + w - 1, grams)
        key = gram_hashes(codes[start : stop + k - 1], k)
        key = (key & ~_LOW) | (_LOW - np.arange(len(key), dtype=np.uint64))  # of equal hashes the rightmost is the smallest
        width = min(w, len(key))
        least, span = key, 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            windows = len(key) - width + 1
            least = np.minimum(least[:windows], least[width - span : width - span + windows])
        least = least[np.concatenate([[True], least[1:] != least[:-1]])]
        hashes.append((least >> np.uint64(BITS)).astype(np.int64))
        places.append((_LOW - (least & _LOW)).astype(np.int64) + start)
    h, p = np.concatenate(hashes), np.concatenate(places)
    fresh = np.concatenate([[True], p[1:] != p[:-1]])
    return h[fresh], p[fresh]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sets of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def digest(hashes: np.ndarray, places: np.ndarray) -> str:
    return hashlib.sha256(hashes.tobytes() + places.tobytes()).hexdigest()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Every document with its chosen ``hashes`` and their ``positions``."""

    def run(batches):
        for batch in batches:
            rows = [winnow(code_points(x.as_py() or ""), k, w) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in (0, 1))], ["key", "hashes", "positions"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, hashes array<bigint>, positions array<bigint>").withColumnRenamed("key", key)


def _bucketed(docs: DataFrame, key: str, text: str, bucket_bytes: int) -> tuple[DataFrame, int]:
    """Rows by ranges of the key, and into each range a copy of the row that follows its smallest one.

    Two narrow passes over keys and lengths find the ranges: one row for each range reaches the driver, so their number is total bytes
    over ``bucket_bytes``. The copies are one row for each range.
    """
    ids = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    total = ids.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("bytes")).first()["bytes"] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    known = ids.select("id").where("id is not null")
    tops = sorted(r["top"] for r in known.repartitionByRange(buckets, "id").groupBy(F.spark_partition_id().alias("part")).agg(F.max("id").alias("top")).collect())
    cuts = np.array(tops[:-1], np.int64)
    last = tops[-1] if tops else None

    @F.pandas_udf("bigint")
    def place_of(values: pd.Series) -> pd.Series:
        """Twice the number of the key's range, and one more for the largest key of a range that another follows."""
        known, keys = values.notna().to_numpy(), values.fillna(0).astype("int64").to_numpy()
        at = np.searchsorted(cuts, keys)
        largest = (at < len(cuts)) & (np.append(cuts, 0)[at] == keys)
        return pd.Series(np.where(known, 2 * at + largest, 0), index=values.index)

    placed = ids.withColumn("place", place_of("id")).withColumn("bucket", F.shiftright("place", 1).cast("int"))

    def copy(bucket: Column) -> Column:
        return F.struct(bucket.cast("int").alias("bucket"), F.lit(True).alias("copied"))

    own = F.struct(F.col("bucket"), F.lit(False).alias("copied"))
    first = F.col("id").eqNullSafe(F.lit(last).cast("bigint"))
    above = F.col("place") % 2 == 1
    places = F.filter(F.array(own, F.when(above, copy(F.col("bucket") + 1)), F.when(first, copy(F.lit(0)))), lambda x: x.isNotNull())
    return placed.select("id", "text", F.explode(places).alias("at")).select("id", "text", "at.*"), buckets


def edited_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, w: int = W, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Each document against its edited text and against the next document by descending key (after the last: the first).

    In the edited text the last third of the code points, rounded down, is replaced by as many first ones of the next document, or all
    it has. Rows without a key come last; rows of one key follow each other by text. Texts are shuffled once; a task walks its ranges
    row by row and holds two documents at a time.
    """
    rows, buckets = _bucketed(docs, key, text, bucket_bytes)
    rows = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "copied", F.col("id").desc_nulls_last(), F.xxhash64("text"), "text")

    def run(batches):
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        waiting = None  # bucket, id, text, code points, fingerprint, distinct hashes

        def compare(row, following):
            _, ident, body, codes, own, distinct = row
            cut = len(codes) // 3
            edited = body[: len(body) - cut] + following[2][:cut]
            other = winnow(code_points(edited), k, w)
            return (
                ident, len(codes), hashlib.sha256(edited.encode()).hexdigest(), digest(*own), digest(*other),
                likeness(distinct, np.unique(other[0])), likeness(distinct, following[5]),
            )

        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                ident, value, bucket, copied = (batch.column(c)[i].as_py() for c in range(4))
                value = value or ""
                if copied and (waiting is None or waiting[0] != bucket):
                    continue  # a further row of the key that was copied
                codes = code_points(value)
                own = winnow(codes, k, w)
                row = (bucket, ident, value, codes, own, np.unique(own[0]))
                if waiting is not None and waiting[0] == bucket:
                    out.append(compare(waiting, row))
                waiting = None if copied else row
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("id", "text", "bucket", "copied").mapInArrow(run, schema).withColumnRenamed("id", key)
