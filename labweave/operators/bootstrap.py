"""Bootstrap of blocks with exactly as many draws as blocks in every resample.

A resample's weights are Poisson numbers of a mean a little below one, from a hash of block and resample, plus the draws still missing to
the number of blocks, each of a block picked uniformly. Poisson weights of a given total are a multinomial draw, so their sum with the
missing draws is one of the whole size. Any task can tell the weights of the blocks it holds: no values are shuffled for them, and
only the missing draws, in number like the square root of the blocks, are looked up.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labweave.functions.hashing import poisson_weights, uniform
from labweave.operators.designs import role_names
from labweave.operators.sensitivity import TermSums, _index_rows, block_key, run_sums, term_means
from labweave.session import materialised

#: Blocks that a bucket holds on average, and the most halvings into buckets (their counts go to the driver and to all tasks).
BUCKET_BLOCKS, MAX_LEVELS = 2048, 20
#: By how many deviations the Poisson total stays below the number of blocks; a resample beyond that is drawn again with twice as many.
MARGIN = 5.0


@dataclass
class Draws:
    """What the weights of any block in all resamples follow from."""

    resamples: int
    mean: float
    salt: int
    keys: np.ndarray  # of the blocks with a further draw, in order, and its resample
    which: np.ndarray

    def poisson(self, keys: np.ndarray, resample: int) -> np.ndarray:
        return poisson_weights(uniform(keys, self.salt + resample), self.mean)

    def weights(self, keys: np.ndarray) -> np.ndarray:
        """How often each resample draws each block."""
        out = np.stack([self.poisson(keys, r) for r in range(self.resamples)]) if self.resamples else np.zeros((0, len(keys)))
        first, last = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        own = np.repeat(np.arange(len(keys)), last - first)
        at = np.arange(len(own)) + np.repeat(first - (np.cumsum(last - first) - (last - first)), last - first)
        np.add.at(out, (self.which[at], own), 1.0)
        return out


def draw_blocks(blocks: DataFrame, resamples: int, seed: int) -> Draws:
    """The draws over ``blocks``, which has one row and a ``_key`` for each block; read three times."""
    n = blocks.count()
    levels = 0
    while levels < MAX_LEVELS and (n >> levels) > BUCKET_BLOCKS:
        levels += 1
    bucketed = blocks.select("_key", (F.shiftrightunsigned("_key", 64 - levels) if levels else F.lit(0)).cast("int").alias("_bucket"))
    counts = np.zeros(1 << levels, np.int64)
    for r in bucketed.groupBy("_bucket").count().collect():
        counts[r["_bucket"]] = r["count"]
    ends = np.cumsum(counts)
    none = np.zeros(0, np.int64)
    margin, salt = MARGIN, (seed + 1) << 24
    while True:
        drawn = Draws(resamples, max(0.0, 1 - margin / np.sqrt(n)) if n else 0.0, salt, none, none)
        missing = n - _totals(blocks, drawn)
        if (missing >= 0).all():
            break
        margin, salt = 2 * margin, salt + (1 << 20)
    rng = np.random.default_rng([seed, salt])
    places = np.concatenate([rng.integers(0, n, m) for m in missing]) if missing.any() else none
    which = np.repeat(np.arange(resamples), missing)
    wanted = np.unique(places)

    def pick(group: pa.Table) -> pa.Table:
        bucket = group["_bucket"][0].as_py()
        first = int(ends[bucket] - counts[bucket])
        at = wanted[slice(*np.searchsorted(wanted, [first, int(ends[bucket])]))]
        return pa.table([pa.array(np.sort(group["_key"].to_numpy())[at - first]), pa.array(at)], names=["_key", "at"])

    if len(wanted):
        found = bucketed.groupBy("_bucket").applyInArrow(pick, "_key bigint, at bigint").toArrow().sort_by("at")
        keys = found["_key"].to_numpy()[np.searchsorted(found["at"].to_numpy(), places)]
        order = np.argsort(keys, kind="stable")
        drawn.keys, drawn.which = keys[order], which[order]
    return drawn


def _totals(blocks: DataFrame, drawn: Draws) -> np.ndarray:
    """The Poisson weights of every resample, added up."""

    def run(batches):
        total = np.zeros(drawn.resamples)
        for batch in batches:
            total += [drawn.poisson(batch.column(0).to_numpy(), r).sum() for r in range(drawn.resamples)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(drawn.resamples, dtype=np.int32)), pa.array(total.astype(np.int64))], ["r", "n"])

    out = np.zeros(drawn.resamples, np.int64)
    if drawn.mean > 0:
        for r in blocks.select("_key").mapInArrow(run, "r int, n bigint").groupBy("r").agg(F.sum("n").alias("n")).collect():
            out[r["r"]] = r["n"]
    return out


def distinct_blocks(table: DataFrame) -> DataFrame:
    """Every block with its key; written once, as its draws read it several times."""
    return materialised(table.select("block_id").distinct().select("block_id", block_key("block_id").alias("_key")))


def bootstrap_draws(table: DataFrame, resamples: int = 100, seed: int = 42) -> DataFrame:
    """``(block_id, resample, w)`` for every block and resample that draws it; the weights of a resample total the number of blocks."""
    kind = table.schema["block_id"].dataType.simpleString()
    blocks = distinct_blocks(table)
    drawn = draw_blocks(blocks, resamples, seed)

    def run(batches):
        for batch in batches:
            weights = drawn.weights(batch.column(1).to_numpy()).astype(np.int64)
            which, at = np.nonzero(weights)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array((which + 1).astype(np.int32)), pa.array(weights[which, at])], ["block_id", "resample", "w"])

    return blocks.mapInArrow(run, f"block_id {kind}, resample int, w bigint")


def exact_bootstrap_widths(table: DataFrame, names: Sequence[str], resamples: int = 100, seed: int = 42, z: float = 1.959963984540054) -> DataFrame:
    """``(output, order, factor_i, factor_j, conf)``: half-widths from resamples of exactly as many blocks as there are.

    ``table`` is a block table. Each task gives its weighted sums of products for every output and resample by matrix products, and only
    these sums go on.
    """
    d = len(names)
    outputs = [r["output"] for r in table.select("output").distinct().collect()]  # names of columns of the run table
    place, roles = {o: i for i, o in enumerate(outputs)}, role_names(d)
    drawn = draw_blocks(distinct_blocks(table), resamples, seed)

    def run(batches):
        sums = TermSums(d, outputs, resamples)
        for batch in batches:
            if not len(batch):
                continue
            keys, block = np.unique(batch.column(1).to_numpy(), return_inverse=True)
            weights = drawn.weights(keys)
            which = np.array([place[o] for o in batch.column(0).to_pylist()])
            values = np.column_stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(roles))]).astype(float)
            for k in np.unique(which).tolist():
                own = which == k
                sums.add({r: values[own, i : i + 1] for i, r in enumerate(roles)}, weights[:, block[own]], slice(k, k + 1))
        if sums.met:
            yield from sums.rows().to_batches()

    rows = table.select("output", block_key("block_id").alias("_key"), *roles)
    return _widths(term_means(rows.mapInArrow(run, TermSums(d, outputs, 0).schema), d), names, z)


def _widths(means: DataFrame, names: Sequence[str], z: float) -> DataFrame:
    spread = _index_rows(means.where("resample > 0"), ["output", "resample"], names)
    return spread.groupBy("output", "order", "factor_i", "factor_j").agg((F.lit(z) * F.stddev_samp("value")).alias("conf"))


def analyse_with_widths(
    runs: DataFrame, names: Sequence[str], outputs: Sequence[str], resamples: int = 100, seed: int = 42, z: float = 1.959963984540054
) -> DataFrame:
    """``(output, order, factor_i, factor_j, value, conf)`` of every output, with exact resamples.

    One scan standardises, one finds the blocks, and one sums the terms for the indices and all resamples. A constant output gets nulls.
    """
    drawn = draw_blocks(distinct_blocks(runs), resamples, seed)
    rows = _index_rows(run_sums(runs, len(names), outputs, drawn), ["output", "resample"], names)
    plain = F.col("resample") == 0
    return rows.groupBy("output", "order", "factor_i", "factor_j").agg(
        F.max(F.when(plain, F.col("value"))).alias("value"), (F.lit(z) * F.stddev_samp(F.when(~plain, F.col("value")))).alias("conf")
    )
