"""Sensitivity study: make the design, read simulated runs, rank the inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from labweave.fixed_values import FACTORIAL_DESIGN, PROCESS_INPUTS, QUASI_DESIGN
from labweave.operators.bootstrap import analyse_with_widths
from labweave.operators.columns import complement
from labweave.operators.designs import full_factorial, quantise_design, saltelli_design
from labweave.operators.profile import response_surfaces
from labweave.operators.sensitivity import analyse_outputs
from labweave.sources.tables import write_delimited


def quasi_design(spark: SparkSession, blocks: int = 500) -> DataFrame:
    """Quantised Saltelli design of the four process factors."""
    bounds = {name: (low, high) for name, (low, high, _) in QUASI_DESIGN.items()}
    return quantise_design(saltelli_design(spark, bounds, blocks), QUASI_DESIGN)


def factorial_design(spark: SparkSession) -> DataFrame:
    return full_factorial(spark, FACTORIAL_DESIGN)


def save_design(design: DataFrame, path: str) -> None:
    write_delimited(design, path)


def study(runs: DataFrame, inputs: Sequence[str] = PROCESS_INPUTS, resamples: int = 100, cells: int = 100) -> tuple[DataFrame, DataFrame]:
    """Indices with widths, and response surfaces, of every output column of the runs.

    ``runs`` carries ``block_id`` and ``role`` next to the inputs and outputs. Every resample draws as many blocks as there are.
    """
    outputs = [c for c in complement(runs, [*inputs, "block_id", "role"]) if c != "role_no"]
    indices = analyse_with_widths(runs, list(inputs), outputs, resamples) if resamples else analyse_outputs(runs, list(inputs), outputs)
    return indices, response_surfaces(runs, inputs, outputs, cells)
