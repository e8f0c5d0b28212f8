"""Sobol sequence: direction numbers on the driver, points as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from labweave.fixed_values import DIRECTION_NUMBERS

BITS = 31
MAX_DIMENSIONS = len(DIRECTION_NUMBERS) + 1


def direction_vector(dimension: int) -> list[int]:
    """Integers v_1..v_BITS of one dimension, scaled by 2**BITS."""
    if not 0 <= dimension < MAX_DIMENSIONS:
        raise ValueError(f"the direction table covers {MAX_DIMENSIONS} dimensions")
    if dimension == 0:
        return [1 << (BITS - 1 - b) for b in range(BITS)]
    degree, coefficient, start = DIRECTION_NUMBERS[dimension - 1]
    m = list(start)
    for k in range(degree, BITS):
        taps = [(coefficient >> (degree - 1 - t)) & 1 for t in range(1, degree)]
        value = m[k - degree] ^ (m[k - degree] << degree)
        for t, tap in enumerate(taps, start=1):
            value ^= (m[k - t] << t) * tap
        m.append(value)
    return [m[b] << (BITS - 1 - b) for b in range(BITS)]


def sobol_integer(gray: Column, dimension: int, bits: int) -> Column:
    """Coordinate scaled by 2**BITS, for Gray-coded indexes below 2**bits."""
    vector = direction_vector(dimension)[:bits]
    terms = [F.shiftright(gray, b).bitwiseAND(F.lit(1).cast("bigint")) * F.lit(v) for b, v in enumerate(vector)]
    return reduce(lambda a, b: a.bitwiseXOR(b), terms)


def gray_code(index: Column) -> Column:
    index = index.cast("bigint")
    return index.bitwiseXOR(F.shiftright(index, 1))


def sobol_point(index: Column, dimension: int, bits: int = BITS) -> Column:
    """Coordinate in [0, 1) of point ``index``."""
    return sobol_integer(gray_code(index), dimension, bits) / float(1 << BITS)


def sobol_value(index: int, dimension: int) -> float:
    """The same coordinate as a Python number, for small driver-side draws."""
    gray = index ^ (index >> 1)
    picked = (v for b, v in enumerate(direction_vector(dimension)) if gray >> b & 1)
    return reduce(lambda a, b: a ^ b, picked, 0) / float(1 << BITS)
