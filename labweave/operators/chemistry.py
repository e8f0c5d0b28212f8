"""Per-structure densities and adsorption energies from plain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labweave.functions.cleaning import strip

AVOGADRO = 6.022e23
CUBIC_ANGSTROM = 1e-24


def structure_densities(sites: DataFrame, structures: DataFrame, key: str = "structure_id") -> DataFrame:
    """Five density estimates per structure.

    Sites are aggregated before the join (map-side combine keeps a structure with very
    many sites cheap), so the join sees one row per structure on both sides.
    """
    totals = sites.groupBy(key).agg(F.count(F.lit(1)).alias("n_sites"), F.sum("weight").alias("weight"))
    n, weight, volume = F.col("n_sites"), F.col("weight"), F.col("volume")
    return totals.join(structures, key).select(
        key,
        (n * F.lit(0.1)).alias("density_empirical"),
        F.when(volume > 0, weight / volume).alias("density_volume"),
        F.when(volume != 0, n / volume * weight).alias("density_packing"),
        (n * F.lit(0.05)).alias("density_count"),
        F.when(volume > 0, (weight / F.lit(AVOGADRO)) / (volume * F.lit(CUBIC_ANGSTROM))).alias("density_mass"),
    )


def adsorption_energy(energies: DataFrame, keys: Sequence[str] = ("material", "surface", "site")) -> DataFrame:
    """E(slab with adsorbate) - (E(slab) + E(gas)); null when a part is missing."""
    part = {k: F.sum(F.when(F.col("kind") == k, F.col("energy"))) for k in ("slab_ads", "slab", "gas")}
    return energies.groupBy(*keys).agg((part["slab_ads"] - (part["slab"] + part["gas"])).alias("adsorption_energy"))


def first_energy(results: DataFrame, formula: str = "CO") -> DataFrame:
    """First qualifying adsorption energy per material, in document order.

    ``results`` has one row per document with the array column ``results``; documents
    are ordered by ``doc``. Without that column there may be one document only, as several have no order.
    """
    if "doc" not in results.columns and results.select(F.lit(1)).limit(2).count() > 1:
        raise ValueError("several documents need a column doc that orders them")
    doc = F.col("doc") if "doc" in results.columns else F.lit(0)
    entry = F.col("entry.adsorption_measurement")
    rows = results.select(doc.alias("doc"), F.posexplode("results").alias("pos", "entry")).select(
        "doc",
        "pos",
        F.coalesce(entry["adsorbate_species"]["formula"], F.lit("")).alias("formula"),
        F.coalesce(entry["is_most_stable_site"], F.lit(False)).alias("stable"),
        F.coalesce(entry["adsorption_energy"], F.lit(0.0)).alias("energy"),
        strip(F.coalesce(entry["bulk_surface_property_set"]["bulk_surface_material"]["name"], F.lit(""))).alias("material"),
    )
    return (
        rows.filter((F.col("formula") == formula) & F.col("stable") & (F.col("material") != ""))
        .groupBy("material")
        .agg(F.min_by("energy", F.struct("doc", "pos")).alias("energy"))
    )
