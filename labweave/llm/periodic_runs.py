"""Periodic runs of words: stretches that repeat one phrase several times over, and texts with the repeats taken out.

Words get names, equal for equal words of one text. The dictionary of basic factors then names every stretch of 1, 2, 4, ... words by the
pair of names of its halves; a stretch that occurs once in its text is followed no further. At each length, the next occurrence of a
stretch within twice its length is a gap, and equal gaps in a row are an arithmetic progression that proposes its gap as a period. In a
run of period q and at least 4 q words, the factors of the least power of two not below q recur exactly q apart, so every run is proposed
there. Proposals of one period that overlap are joined, compared word by word, extended to both sides as far as the period holds, and
kept once.

Defined cases: null and empty texts, and texts of blanks, have no words and no runs; words are compared byte for byte, case included;
repeated and null ids are rows of their own; an empty table gives no rows; extra columns are not read. A text is worked on as a whole: a
task needs memory in proportion to the longest one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labweave.llm.arrays import WHITE_SPACE, text_blocks, word_bounds, word_hashes
from labweave.session import bound_batches

LEAST_WORDS, LEAST_REPEATS = 6, 4
#: Bytes of texts that a task looks at together.
SLICE_BYTES = 1 << 18


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Small numbers, equal for equal words of one row. Words with one hash are compared byte for byte with the first of them."""
    if not len(starts):
        return np.zeros(0, np.int64)
    lengths, hashes = ends - starts, word_hashes(data, starts, ends, fold=False)
    _, first, hashed = np.unique(hashes, return_index=True, return_inverse=True)
    like, fine, at = first[hashed], True, 0
    while at < len(starts) and fine:
        last = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right")))
        own, size = slice(at, last), lengths[at:last]
        fine = bool((size == lengths[like[own]]).all())
        if fine:
            inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            fine = bool((data[np.repeat(starts[own], size) + inside] == data[np.repeat(starts[like[own]], size) + inside]).all())
        at = last
    if not fine:  # two words share a hash: name them by their bytes
        names: dict[bytes, int] = {}
        hashed = np.array([names.setdefault(data[a:b].tobytes(), len(names)) for a, b in zip(starts, ends, strict=True)])
    return np.unique(row * (int(hashed.max()) + 1) + hashed, return_inverse=True)[1]


def proposals(names: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Period, first word and end of every progression, for each factor length; ``names`` differ between texts."""
    n, size = len(names), 1
    at, name = np.arange(n), names
    while len(at):
        order = np.argsort(name, kind="stable")
        place, sorted_name = at[order], name[order]
        same = sorted_name[1:] == sorted_name[:-1]
        gap = np.where(same, place[1:] - place[:-1], 0)
        steady = np.flatnonzero((gap[1:] == gap[:-1]) & (gap[1:] > 0) & (gap[1:] <= 2 * size))
        if len(steady):  # three occurrences in a row; longer progressions overlap and are joined later
            yield gap[steady], place[steady], place[steady + 2] + size
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        known = np.full(n, -1, np.int64)
        known[place[twice]] = sorted_name[twice]
        at = np.sort(place[twice & (place + 2 * size <= n)])
        second = known[at + size]
        at, second = at[second >= 0], second[second >= 0]
        if len(at):
            name = np.unique(known[at] * (int(second.max()) + 1) + second, return_inverse=True)[1]
        size *= 2


def overlaps_joined(period: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proposals of one period that overlap or touch, as one, by period and first word."""
    order = np.lexsort((first, period))
    period, first, end = period[order], first[order], end[order]
    apart = np.searchsorted(np.unique(period), period) * (2 * int(end.max()) + 2)  # keeps the furthest end of one period out of the next
    reach = np.maximum.accumulate(end + apart) - apart
    heads = np.flatnonzero(np.append(True, (period[1:] != period[:-1]) | (first[1:] > reach[:-1])))
    return period[heads], first[heads], np.maximum.reduceat(end, heads)


def runs_of(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs, by start, then period."""
    none = np.zeros(0, np.int64)
    found = [overlaps_joined(*x) for x in proposals(names)]
    if not found:
        return none, none, none
    period, first, end = overlaps_joined(*(np.concatenate(x) for x in zip(*found, strict=True)))
    # where words a period apart agree, within each proposal and one word to either side
    low, high = np.maximum(first - 1, 0), np.minimum(end + 1, len(names))
    size = np.maximum(high - period - low, 0)
    which = np.repeat(np.arange(len(low)), size)
    place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which]
    agree = names[place] == names[place + period[which]]
    begins = agree & np.append(True, ~agree[:-1] | (which[1:] != which[:-1]))[: len(agree)]
    ends = agree & np.append(~agree[1:] | (which[1:] != which[:-1]), True)[: len(agree)]
    start, stop, period = place[begins], place[ends] + 1, period[which[begins]]
    # a stretch that reaches past its proposal goes on until the words differ
    moving = np.arange(len(start))
    while len(moving):
        moving = moving[(start[moving] > 0)]
        moving = moving[names[start[moving] - 1] == names[start[moving] - 1 + period[moving]]]
        start[moving] -= 1
    moving = np.arange(len(stop))
    while len(moving):
        moving = moving[stop[moving] + period[moving] < len(names)]
        moving = moving[names[stop[moving]] == names[stop[moving] + period[moving]]]
        stop[moving] += 1
    length = stop - start + period
    long = length >= np.maximum(LEAST_WORDS, LEAST_REPEATS * period)
    kept = np.unique(np.stack([start[long], period[long], length[long]], axis=1), axis=0)
    least = np.array([_is_least(names, s, q) for s, q, _ in kept.tolist()], bool)
    kept = kept[least] if len(kept) else kept
    return kept[:, 0], kept[:, 2], kept[:, 1]


def _is_least(names: np.ndarray, start: int, period: int) -> bool:
    """Whether no proper divisor of the period is one too; over four periods a smaller period would have to be a divisor."""
    rest, p = period, 2
    while rest > 1:
        if rest % p == 0:
            smaller = period // p
            if np.array_equal(names[start : start + period], names[start + smaller : start + smaller + period]):
                return False
            while rest % p == 0:
                rest //= p
        p = p + 1 if p * p <= rest else max(rest, p + 1)
    return True


def repeated_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` words some run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: np.ndarray) -> list[bytes]:
    """Each row's words with one blank between them; ``heads`` tells where the rows' words begin."""
    sizes = ends - starts + 1
    parts, at = [], 0
    bytes_before = np.append(0, np.cumsum(sizes))
    while at < len(starts):
        last = max(at + 1, int(np.searchsorted(bytes_before, bytes_before[at] + SLICE_BYTES, "right")) - 1)
        size = sizes[at:last]
        lead = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(lead, size)
        source = np.minimum(np.repeat(starts[at:last], size) + inside, len(data) - 1)
        piece = data[source]
        piece[lead + size - 1] = 0x20
        parts.append(piece)
        at = last
    text = np.concatenate(parts).tobytes() if parts else b""
    return [text[bytes_before[a] : max(bytes_before[a], bytes_before[b] - 1)] for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True)]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``runs`` (start, length and period in words, by start, then period) and ``collapsed``: the text's words, without those
    that a run holds after its first period, joined by blanks."""

    def run(batches):
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            for first, data, offsets in text_blocks(batch.column(1), SLICE_BYTES):
                rows = len(offsets) - 1
                starts, ends = word_bounds(data, offsets, WHITE_SPACE)
                heads = np.searchsorted(starts, offsets)
                row = np.repeat(np.arange(rows), np.diff(heads))
                start, length, period = runs_of(word_names(data, starts, ends, row))
                kept = ~repeated_words(len(starts), start, length, period)
                collapsed = joined_words(data, starts[kept], ends[kept], np.append(0, np.cumsum(kept))[heads])
                own = row[start] if len(start) else start
                values = pa.StructArray.from_arrays([pa.array(start - heads[own]), pa.array(length), pa.array(period)], fields=list(kind))
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(rows + 1)).astype(np.int32)), values)
                texts = pa.array(collapsed, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), runs, texts], ["key", "runs", "collapsed"])

    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    out = f"key {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select(key, text).mapInArrow(run, out).withColumnRenamed("key", key)


def longest_run(runs: Column) -> Column:
    """The run of greatest length; ties go to the smaller start, then to the smaller period. Null without runs."""
    better = lambda a, b: F.when(
        a.isNull() | (b["length"] > a["length"]) | ((b["length"] == a["length"]) & ((b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["period"] < a["period"])))), b
    ).otherwise(a)
    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)


def looped_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``text`` with the end of every tenth text, by the checksum of its id, turned into a loop of its own words.

    With ``g`` the checksum without its last digit, each word from ``a = g % n`` on becomes the word ``a + (i - a) % p`` of the text, where
    ``p = 1 + (n - a) // (3 + g % 8)``; such a text's words are then joined by single blanks. Other texts, and those without an id, stay.
    """
    checksum = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.when(checksum % 10 == 0, F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    cut = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), words.alias("w"), F.floor(checksum / 10).cast("bigint").alias("g"))
    n = F.size("w").cast("bigint")
    begun = cut.withColumn("a", F.when(n > 0, F.col("g") % n))
    begun = begun.withColumn("p", F.floor(1 + (n - F.col("a")) / (3 + F.col("g") % 8)).cast("bigint"))
    word = F.expr("transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)]))")
    return begun.select(F.col("key").alias(key), F.when(F.col("a").isNotNull(), F.concat_ws(" ", word)).otherwise(F.col("text")).alias(text))
