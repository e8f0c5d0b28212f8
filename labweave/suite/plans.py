"""Queries over whole plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from labweave.fixed_values import (
    EXERGY_ORDINALS, EXERGY_WINDOWS, FEATURE_CODES, FLOW_ORDINALS, FLOW_WINDOWS, MATERIALS, METHODS, REACTION_BLOCKS, REACTION_COUNT, REACTION_STRIDE,
    SPECIES, TARGETS, UNIFIED_SCHEMA, WEIGHT_ORDINALS, YIELD_ORDINALS, YIELD_WINDOWS,
)
from labweave.plans import assembly, series
from labweave.suite.common import query, sql_number, sql_values, table
from labweave.suite.joins import FIRST_SQL
from labweave.suite.sources import measurement_documents


def coded_sheet(spark, sf):
    """Line items under the irregular headers of the coded sheet, as text."""
    text = lambda c: F.col(c).cast("string")
    key = F.col("l_suppkey") % 4
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") != 2, text("l_orderkey")).alias("Reference"),
        F.when(key == 0, " Ni ").when(key == 1, "Co").when(key == 2, "Mystery").alias("Active component type"),
        F.when(F.col("l_partkey") % 2 == 0, "Al2O3").otherwise("error-1").alias("Support\na type"),
        F.when(F.col("l_linenumber") == 1, "IWI").otherwise("none").alias("Preparation method"),
        F.concat(F.when(F.col("l_orderkey") % 5 == 0, "?").otherwise(""), text("l_quantity")).alias("Temperature (℃)"),
        text("l_tax").alias("H2/CO2\nratio (mol/mol)"),
        text("l_extendedprice").alias("CO2\nconversion ratio(%)"),
        text("l_discount").alias("CH4\nyield(%)"),
    )


def lab_sheet(spark, sf):
    """Orders under the headers of the second laboratory."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("Number of data"),
        F.col("o_custkey").alias("Reference"),
        F.col("o_orderstatus").alias("Experiment No"),
        F.when(F.col("o_custkey") % 2 == 0, "Ru ").otherwise("CeO2").alias("Base"),
        F.col("o_orderpriority").alias("Catalyst preparation method"),
        F.col("o_totalprice").alias("Pressure (bar)"),
        (F.col("o_totalprice") / 2).alias("CO2 Conversion %"),
    )


def assembly_sql() -> str:
    have = {
        "Reference": ("coalesce('1-[' || CAST(CASE WHEN l_linenumber <> 2 THEN l_orderkey END AS VARCHAR) || ']', '')", "coalesce('2-[' || CAST(o_custkey AS VARCHAR) || ']', '')"),
        "Number of data": ("''", "CAST(o_orderkey AS VARCHAR)"),
        "Experiment No": ("''", "o_orderstatus"),
        "Active component type": ("coalesce(CASE l_suppkey % 4 WHEN 0 THEN ' Ni ' WHEN 1 THEN 'Co' WHEN 2 THEN 'Mystery' END, '')", "CASE WHEN o_custkey % 2 = 0 THEN 'Ru ' ELSE 'CeO2' END"),
        "Support a type": ("CASE WHEN l_partkey % 2 = 0 THEN 'Al2O3' ELSE 'error-1' END", "''"),
        "Preparation method": ("CASE WHEN l_linenumber = 1 THEN 'IWI' ELSE 'none' END", "o_orderpriority"),
        "Temperature (C)": (f"coalesce({sql_number('(CASE WHEN l_orderkey % 5 = 0 THEN chr(63) ELSE chr(32) END || CAST(l_quantity AS VARCHAR))')}, 0.0)", "0.0"),
        "Pressure (bar)": ("0.0", "o_totalprice"),
        "H2/CO2 ratio (mol/mol)": (sql_number("CAST(l_tax AS VARCHAR)"), "0.0"),
        "CO2 conversion ratio(%)": ("l_extendedprice", "o_totalprice / 2"),
        "CH4 selectivity (%)": ("NULL", "NULL"),
        "CH4 yield(%)": (sql_number("CAST(l_discount AS VARCHAR)"), "NULL"),
    }
    computed = ("density", "formation energy", "Scalability", "cost")
    base = [n for n, _ in UNIFIED_SCHEMA if not n.endswith(computed)]
    kinds = dict(UNIFIED_SCHEMA)
    empty = lambda n: "''" if kinds[n] == "string" else ("NULL" if n in TARGETS else "0.0")
    side = lambda i: ", ".join(
        f"CAST({have.get(n, (empty(n), empty(n)))[i]} AS {'VARCHAR' if kinds[n] == 'string' else 'DOUBLE'}) AS \"{n}\"" for n in base
    )
    picked, joins = [], []
    for k, role in enumerate(("Active component", "Promoter", "Support a", "Support b")):
        joins.append(f"LEFT JOIN m m{k} ON trim(t.\"{role} type\") = m{k}.material LEFT JOIN ({FIRST_SQL}) f{k} ON trim(t.\"{role} type\") = f{k}.material")
        label = f"{role} type" if role.startswith("Support") else role
        picked += [
            f"coalesce(m{k}.density, 0.0) AS \"{role} type density\"", f"coalesce(m{k}.energy, 0.0) AS \"{role} type formation energy\"",
            f"coalesce(f{k}.energy, 0.0) AS \"{label} adsorption energy\"",
        ]
    return f"""
    WITH m AS (SELECT material, CAST(e AS DOUBLE) AS energy, CAST(d AS DOUBLE) AS density FROM (VALUES {sql_values(MATERIALS)}) v(material, e, d)),
         t AS (SELECT {side(0)} FROM lineitem UNION ALL SELECT {side(1)} FROM orders)
    SELECT t.*, {', '.join(picked)}, coalesce(v.scalability, 0) AS "Preparation Scalability", coalesce(v.cost, 0) AS "Preparation cost"
    FROM t {' '.join(joins)} LEFT JOIN (VALUES {sql_values(METHODS)}) v(method, scalability, cost) ON trim(t."Preparation method") = v.method"""


@query("plan_assembly", assembly_sql())
def plan_assembly(spark, sf):
    """Two sheets and nested measurements to one table of 45 columns."""
    return assembly.assemble(coded_sheet(spark, sf), lab_sheet(spark, sf), measurement_documents(spark, sf))


def model_table_sql() -> str:
    def header(name: str) -> str:
        name = name.replace("wt percent", "wt%").replace("vol percent", "vol%").replace("h2/co2", "H2/CO2")
        role = next((k for k in ("formation energy", "density") if name.endswith(k)), None)
        return f"{name.removesuffix(role)}type {role}" if role else name

    codes = ", ".join(f'CAST("{header(name)}" AS DOUBLE) AS "{code}"' for name, code in FEATURE_CODES.items())
    targets = ", ".join(f'"{t}" AS {short}' for t, short in zip(TARGETS, ("co2_conv", "ch4_sel", "ch4_yield")))
    return f'SELECT {codes}, "Preparation method" AS prep_method, {targets} FROM ({assembly_sql()})'


@query("plan_model_table", model_table_sql())
def plan_model_table(spark, sf):
    """The assembled table under the short names that models use, with the three targets."""
    return assembly.model_table(plan_assembly(spark, sf))


SHEET_ROWS = 240


def event_sheets(spark, sf, width):
    """Events cut into sheets of 240 rows; the last column of the first sheet is empty."""
    i = F.col("event_id")
    cell = lambda k: F.when((i + k) % 9 == 0, "n/a").otherwise(F.round(F.col("value") + k, 2).cast("string"))
    dead = F.lit(None).cast("string")
    columns = [F.when((F.lit(k) == width - 1) & (i < SHEET_ROWS), dead).otherwise(cell(k)).alias(f"c{k}") for k in range(width)]
    return table(spark, sf, "events").select(
        F.floor(i / SHEET_ROWS).alias("sheet"), (i % SHEET_ROWS + 2).cast("bigint").alias("_row"), *columns
    )


def series_sql(windows, names, ordinals, width) -> str:
    cell = lambda k: f"CASE WHEN (event_id + {k}) % 9 = 0 THEN NULL ELSE round(value + {k}, 2) END"
    dead = lambda k: f"CASE WHEN {k} = {width - 1} AND event_id < {SHEET_ROWS} THEN NULL ELSE {cell(k)} END"
    base = f"SELECT event_id // {SHEET_ROWS} AS sheet, event_id % {SHEET_ROWS} + 2 AS _row, event_id, value FROM events"
    parts = " UNION ALL ".join(
        f"SELECT sheet, {w} AS window_id, _row, {dead(x)} AS x, '{s}' AS series, {dead(o)} AS value FROM b WHERE _row BETWEEN {first + 1} AND {last + 1}"
        for w, (x, first, last) in enumerate(windows, start=1)
        for s, o in zip(names, ordinals)
    )
    return f"""WITH b AS ({base}), s AS (SELECT * FROM ({parts}) WHERE x IS NOT NULL)
    SELECT s.* FROM s SEMI JOIN (SELECT sheet, window_id, series FROM s GROUP BY ALL HAVING count(value) > 0) k
    ON s.sheet = k.sheet AND s.window_id = k.window_id AND s.series = k.series"""


@query("plan_flow_series", series_sql(FLOW_WINDOWS, SPECIES, FLOW_ORDINALS, 13))
def plan_flow_series(spark, sf):
    """Thirteen windows of seven species flows from every sheet, in one scan."""
    return series.flow_series(event_sheets(spark, sf, 13), ["sheet"])


@query("plan_weight_series", series_sql(FLOW_WINDOWS, SPECIES, WEIGHT_ORDINALS, 20))
def plan_weight_series(spark, sf):
    """The same windows, read for the species' weights."""
    return series.weight_series(event_sheets(spark, sf, 20), ["sheet"])


@query("plan_yield_series", series_sql(YIELD_WINDOWS, series.YIELD_NAMES, YIELD_ORDINALS, 19))
def plan_yield_series(spark, sf):
    """Nine windows of conversions and yields."""
    return series.yield_series(event_sheets(spark, sf, 19), ["sheet"])


@query("plan_exergy_series", series_sql(EXERGY_WINDOWS, series.EXERGY_NAMES, EXERGY_ORDINALS, 16))
def plan_exergy_series(spark, sf):
    """Six windows of four exergy series."""
    return series.exergy_series(event_sheets(spark, sf, 16), ["sheet"])


def reaction_sql() -> str:
    base = "SELECT event_id // 21 AS sheet, event_id % 21 + 8 AS _row, value FROM events WHERE event_id % 21 < 20"  # the last of 21 rows lies below the region
    return f"WITH b AS ({base}) " + " UNION ALL ".join(
        f"SELECT sheet, _row, round(value, 2) AS temperature, {i + 1} AS block, "
        + ", ".join(f"round(value + {start + REACTION_STRIDE * i}, 2) AS \"{q}\"" for q, start in REACTION_BLOCKS.items())
        + " FROM b"
        for i in range(REACTION_COUNT)
    )


@query("plan_reaction_series", reaction_sql())
def plan_reaction_series(spark, sf):
    """Six reaction blocks at stride eight from every sheet."""
    i = F.col("event_id")
    columns = [F.round(F.col("value") + k, 2).cast("string").alias(f"c{k}") for k in range(47)]
    sheets = table(spark, sf, "events").select(F.floor(i / 21).alias("sheet"), (i % 21 + 8).cast("bigint").alias("_row"), *columns)
    return series.reaction_series(sheets, keys=["sheet"])
