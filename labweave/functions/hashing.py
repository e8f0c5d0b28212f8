"""Hashes that only use arithmetic or md5, so other SQL engines can repeat them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODULUS = 2147483647  # 2**31 - 1, prime
INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def integer_hash(key: Column, *salts: Column | int) -> Column:
    """Uniform integer in [0, 2**31 - 1) from an integer key; stays within 64 bits."""
    key = key.cast("bigint")
    low = F.pmod(key, F.lit(MODULUS))
    high = F.pmod(F.shiftright(key, 31), F.lit(MODULUS))
    value = (low + high * 31337) % MODULUS
    for salt in salts or (0,):
        salt = salt.cast("bigint") if isinstance(salt, Column) else F.lit(int(salt) % MODULUS)
        value = (value * 48271 + salt + 11) % MODULUS
        value = value.bitwiseXOR(F.shiftright(value, 16))
        value = (value * 69621 + 7919) % MODULUS
        value = value.bitwiseXOR(F.shiftright(value, 15))
        value = (value * 40692 + 104729) % MODULUS
    return value


def text_hash(key: Column, seed: int) -> Column:
    """Uniform integer in [0, 2**31 - 1) from any key, through md5."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % MODULUS


def key_hash(df: DataFrame, key: str, seed: int) -> Column:
    """The cheap hash for integer keys, md5 for the rest."""
    if dict(df.dtypes)[key] in INTEGRAL:
        return integer_hash(F.col(key), seed)
    return text_hash(F.col(key), seed)


def unit(hashed: Column) -> Column:
    """Hash value as a double in (0, 1)."""
    return (hashed + 0.5) / float(MODULUS)


def uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) of every id, by a 64-bit scrambling."""
    with np.errstate(over="ignore"):
        x = ids.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def poisson_weights(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson draws by inversion; counts beyond 40 have no chance worth a bit of ``u`` while the mean is at most 1."""
    mass = np.array([math.exp(-mean) * mean**k / math.factorial(k) for k in range(41)])
    return np.searchsorted(np.cumsum(mass), u, side="right").astype(float)
