"""Cutting lineage through files that every executor can read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from labweave.session import shared_dir


def stored(rows: DataFrame) -> DataFrame:
    """The rows, written to ``spark.checkpoint.dir`` and read from there, so that losing an executor loses none of them."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(rows.sparkSession))
    return rows.checkpoint()
