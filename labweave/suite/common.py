"""Registry of the checked queries and SQL text shared by their oracles."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labweave.functions.hashing import MODULUS
from labweave.functions.lowdiscrepancy import BITS, direction_vector

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator id; ``sql`` is the same result in plain SQL."""

    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists already")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(value: Column | str, digits: int = 6) -> Column:
    """Rounded, without negative zero: floating sums differ in order between engines."""
    return F.round(value, digits) + F.lit(0.0)


def sql_values(rows: Mapping[str, tuple]) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return ", ".join("(" + ", ".join(quote(x) for x in (k, *v)) + ")" for k, v in rows.items())


def sql_hash(key: str, *salts: str | int) -> str:
    value = f"((({key}) % {MODULUS} + ((({key}) >> 31) % {MODULUS}) * 31337) % {MODULUS})"
    for salt in salts:
        value = f"(({value} * 48271 + ({salt}) + 11) % {MODULUS})"
        value = f"xor({value}, {value} >> 16)"
        value = f"(({value} * 69621 + 7919) % {MODULUS})"
        value = f"xor({value}, {value} >> 15)"
        value = f"(({value} * 40692 + 104729) % {MODULUS})"
    return value


def sql_sobol(gray: str, dimension: int, bits: int = 24) -> str:
    """Sobol coordinate in [0, 1) of a Gray-coded index below 2**bits."""
    terms = [f"((({gray}) >> {b}) & 1) * {v}" for b, v in enumerate(direction_vector(dimension)[:bits])]
    return f"({reduce(lambda a, b: f'xor({a}, {b})', terms)}) / {float(1 << BITS)}"


NUMBER_SQL = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"


def sql_number(text: str) -> str:
    bare = f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN regexp_matches({bare}, '{NUMBER_SQL}') THEN TRY_CAST({bare} AS DOUBLE) END"


# quantities as somebody might have typed them; the same rule in both engines
DIRTY_SQL = """
SELECT l_orderkey, l_linenumber, l_extendedprice,
       CASE l_orderkey % 8
            WHEN 0 THEN '?' || CAST(l_quantity AS VARCHAR)
            WHEN 1 THEN replace(CAST(l_quantity AS VARCHAR), '.', ',')
            WHEN 2 THEN 'NA'
            WHEN 3 THEN '  ' || CAST(l_quantity AS VARCHAR) || ' '
            WHEN 4 THEN CAST(l_quantity AS VARCHAR) || 'e1'
            WHEN 5 THEN '?'
            WHEN 6 THEN CAST(l_quantity AS VARCHAR) || 'd'
            ELSE CAST(l_quantity AS VARCHAR) END AS qty_text
FROM lineitem"""


def dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("l_quantity").cast("string")
    case = F.col("l_orderkey") % 8
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        F.when(case == 0, F.concat(F.lit("?"), text))
        .when(case == 1, F.translate(text, ".", ","))
        .when(case == 2, F.lit("NA"))
        .when(case == 3, F.concat(F.lit("  "), text, F.lit(" ")))
        .when(case == 4, F.concat(text, F.lit("e1")))
        .when(case == 5, F.lit("?"))
        .when(case == 6, F.concat(text, F.lit("d")))
        .otherwise(text)
        .alias("qty_text"),
    )


# features with gaps, for profiling and filling
GAPS_SQL = """
SELECT l_orderkey, l_quantity, l_extendedprice,
       CASE WHEN l_orderkey % 7 <> 0 THEN l_discount END AS l_discount,
       CASE WHEN (l_orderkey + l_linenumber) % 11 <> 0 THEN l_tax END AS l_tax,
       l_returnflag, l_linestatus, l_linenumber
FROM lineitem"""


def gappy_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_quantity",
        "l_extendedprice",
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_discount")).alias("l_discount"),
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 11 != 0, F.col("l_tax")).alias("l_tax"),
        "l_returnflag",
        "l_linestatus",
        "l_linenumber",
    )
