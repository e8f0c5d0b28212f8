"""Data assembly: two laboratories' sheets to one enriched table, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labweave.fixed_values import (
    CODED_SHEET_NAMES, FEATURE_CODES, LAB_SHEET_NAMES, MATERIALS, METHODS, ROLES, TARGETS, UNIFIED_SCHEMA,
)
from labweave.functions.cleaning import strip, tag_source, to_number
from labweave.operators.chemistry import first_energy
from labweave.operators.columns import conform, quoted, rename
from labweave.operators.combine import union_conformed
from labweave.operators.fill import fill_constants
from labweave.operators.lookup import bounded_copy, dimension, lookup, lookup_after, lookup_roles


def harmonise(sheet: DataFrame, names: Mapping[str, str], source: int, number: Callable[[Column], Column] = to_number) -> DataFrame:
    """Rename, tag the reference with its source, clean numbers, conform to the unified schema."""
    sheet = rename(sheet, names)
    if "Reference" in sheet.columns:
        sheet = sheet.withColumn("Reference", tag_source(F.col("Reference"), source))
    types = dict(sheet.dtypes)
    text_numbers = {
        name: number(F.col(quoted(name))) for name, kind in UNIFIED_SCHEMA if kind != "string" and types.get(name) == "string"
    }
    return conform(sheet.withColumns(text_numbers) if text_numbers else sheet, UNIFIED_SCHEMA)


def enrich(table: DataFrame) -> DataFrame:
    """Material and method attributes: five broadcast lookups, no shuffle."""
    spark = table.sparkSession
    materials = dimension(spark, MATERIALS, "material", ["formation_energy", "density"])
    methods = dimension(spark, METHODS, "method", ["scalability", "cost"])
    roles = {
        f"{r} type": {"density": f"{r} type density", "formation_energy": f"{r} type formation energy"} for r in ROLES
    }
    table = lookup_roles(table, materials, roles, "material", bounded=True)
    return lookup(
        table, methods, "Preparation method", "method",
        {"scalability": "Preparation Scalability", "cost": "Preparation cost"}, bounded=True,
    )


def attach_adsorption(table: DataFrame, documents: DataFrame) -> DataFrame:
    """First CO adsorption energy per material, next to each role's type column."""
    energies = first_energy(documents)
    small = bounded_copy(energies)
    if small is None:
        # the documents name more materials than fit; only those that the table names can be met
        types = [strip(F.col(quoted(f"{role} type"))) for role in ROLES if f"{role} type" in table.columns]
        named = table.select(F.explode(F.array(*types)).alias("_named")).where("_named is not null").distinct()
        few = bounded_copy(named)
        energies = energies.join(named if few is None else F.broadcast(few), F.col("material") == F.col("_named"), "left_semi")
        small = bounded_copy(energies)
    for role, name in zip(ROLES, ("Active component", "Promoter", "Support a type", "Support b type")):
        table = lookup_after(
            table, energies if small is None else small, f"{role} type", "material", "energy", f"{name} adsorption energy",
            bounded=small is not None,
        )
    return table


def assemble(coded: DataFrame, lab: DataFrame, documents: DataFrame | None = None, fill_targets: bool = False) -> DataFrame:
    """Both sheets, harmonised, stacked, enriched and null-filled.

    Targets stay null where a sheet has none, unless ``fill_targets`` asks for zeros.
    """
    stacked = union_conformed(harmonise(coded, CODED_SHEET_NAMES, 1), harmonise(lab, LAB_SHEET_NAMES, 2))
    order = [quoted(name) for name, _ in UNIFIED_SCHEMA]
    filled = fill_constants(enrich(stacked).select(*order), keep=() if fill_targets else TARGETS)
    return attach_adsorption(filled, documents) if documents is not None else filled


def feature_code(name: str) -> str | None:
    """Short code of a unified column, whatever spelling of the unit it carries."""
    plain = name.replace(" type ", " ").replace("wt%", "wt percent").replace("vol%", "vol percent")
    return FEATURE_CODES.get(plain.replace("H2/CO2", "h2/co2"))


def model_table(table: DataFrame) -> DataFrame:
    """Coded feature columns, preparation method and the three targets under plain names."""
    picks = [F.col(quoted(c)).cast("double").alias(feature_code(c)) for c in table.columns if feature_code(c)]
    targets = [F.col(quoted(t)).alias(n) for t, n in zip(TARGETS, ("co2_conv", "ch4_sel", "ch4_yield"))]
    return table.select(*picks, F.col(quoted("Preparation method")).alias("prep_method"), *targets)
