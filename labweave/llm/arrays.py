"""Numpy views of Arrow text columns and vectorised word hashes.

Everything here works on the UTF-8 bytes of many rows at once. Texts are read whole; ``BLOCK_BYTES`` only bounds how many bytes of
rows are looked at together, so a task's memory follows the longest single text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` reproducible 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x1F123BB5)) * _ODD)


def byte_class(members: bytes) -> np.ndarray:
    """A lookup table that is true for the given bytes."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


WHITE_SPACE = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d")
NOT_ALNUM = byte_class(bytes(b for b in range(128) if not chr(b).isalnum()))

_BYTE_VALUES = stream(7, 256)
_FOLDED_VALUES = _BYTE_VALUES.copy()
_FOLDED_VALUES[65:91] = _BYTE_VALUES[97:123]


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows: ``(first row, bytes, offsets)``. A null counts as empty; a longer row stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, ends, payload = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(payload, np.uint8) if payload is not None and payload.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; words end at separators and at row ends."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= edge[1:-1] | ~inside[:-1]
    ends[:-1] &= edge[1:-1] | ~inside[1:]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def powers(n: int) -> np.ndarray:
    """``_STEP`` to the powers 0 to n - 1, modulo 2^64."""
    out = np.full(max(n, 1), _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, limit: int = BLOCK_BYTES) -> np.ndarray:
    """A 64-bit hash of every word; ``fold`` lowers A-Z. Works through the words in slices of about ``limit`` bytes."""
    values = _FOLDED_VALUES if fold else _BYTE_VALUES
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + limit, "right")))
        s, lengths = starts[first:last], ends[first:last] - starts[first:last]
        heads = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
        terms = values[data[place + np.repeat(s, lengths)]] * powers(int(lengths.max()))[place]
        out[first:last] = np.add.reduceat(terms, heads) + lengths.astype(np.uint64)
        first = last
    return mix(out)


def hashed_words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each row's words begin (one entry more than rows)."""
    starts, ends = word_bounds(data, offsets, separator)
    return word_hashes(data, starts, ends, fold), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, heads: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and the row of each; a row with fewer words gives its whole sequence as one."""
    counts = np.diff(heads)
    rows, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(words) >= width:
        rolled = words[: len(words) - width + 1].copy()
        for j in range(1, width):
            rolled = rolled * _STEP + words[j : len(words) - width + 1 + j]
        row = np.repeat(np.arange(len(counts)), counts)
        whole = row[: len(rolled)] == row[width - 1 :]
        rows, hashes = row[: len(rolled)][whole], mix(rolled[whole])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        own = np.empty(len(short), np.uint64)
        for i, r in enumerate(short):
            rolled = int(counts[r])
            for w in words[heads[r] : heads[r + 1]].tolist():
                rolled = (rolled * int(_STEP) + w) & 0xFFFFFFFFFFFFFFFF
            own[i] = rolled
        rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, mix(mix(own) + _ODD)])
    return rows, hashes


def distinct_by_row(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, back to back, and where each of the ``n`` rows begins."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    if len(rows):
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        rows, hashes = rows[fresh], hashes[fresh]
    return hashes, np.searchsorted(rows, np.arange(n + 1))


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, widths: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each width: the words that are longer, as indices, and the hashes of their first bytes of that width (A-Z lowered)."""
    deep = max(widths)
    grid = np.minimum(starts[:, None] + np.arange(deep), max(len(data) - 1, 0))
    sums = np.cumsum(_FOLDED_VALUES[data[grid]] * powers(deep), axis=1) if len(starts) else np.zeros((0, deep), np.uint64)
    for width in widths:
        long = np.flatnonzero(ends - starts > width)
        yield long, mix(mix(sums[long, width - 1]) + np.uint64(width * int(_ODD) & 0xFFFFFFFFFFFFFFFF))
