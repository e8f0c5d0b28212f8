"""Queries over projections, filters, cleaning, filling, sampling and re-aimed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from labweave.fixed_values import MISSING_TOKENS, MISSING_TOKENS_EXTENDED, READER_NULL_TOKENS
from labweave.functions import cleaning as c
from labweave.operators import chemistry, columns, fill, reshape, rows
from labweave.suite.common import DIRTY_SQL, GAPS_SQL, dirty_lineitem, gappy_lineitem, query, r, sql_hash, sql_number, table
from labweave.suite.sources import MEASUREMENT_SQL, measurement_documents

MISSING_SQL = ", ".join(f"'{t}'" for t in MISSING_TOKENS)


@query("p1_rename", "SELECT c_custkey AS id, c_name AS name, c_nationkey, c_acctbal AS balance, c_mktsegment FROM customer")
def p1(spark, sf):
    return columns.rename(table(spark, sf, "customer"), {"c_custkey": "id", "c_name": "name", "c_acctbal": "balance", "absent": "x"})


@query(
    "p2_conform",
    "SELECT CAST(NULL AS VARCHAR) AS segment, s_suppkey, s_name, CAST(s_nationkey AS DOUBLE) AS s_nationkey, "
    "s_acctbal, CAST(NULL AS DOUBLE) AS yield FROM supplier",
)
def p2(spark, sf):
    schema = [("segment", "string"), ("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "double"), ("s_acctbal", "double"), ("yield", "double")]
    return columns.conform(table(spark, sf, "supplier"), schema)


@query("p3_column_subset", "SELECT p_brand, p_partkey, p_size FROM part")
def p3(spark, sf):
    part = columns.select_strict(table(spark, sf, "part"), ["p_brand", "p_partkey", "p_size", "p_type"])
    return columns.select_available(part, ["p_brand", "p_partkey", "not_there", "p_size"])


@query("p4_complement", "SELECT l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def p4(spark, sf):
    inputs = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate"]
    li = table(spark, sf, "lineitem")
    return li.select(*columns.complement(li, inputs))


@query("p5_insert_after", "SELECT o_orderkey, o_totalprice, o_totalprice * 2 AS twice, o_orderpriority, 0 AS extra FROM orders")
def p5(spark, sf):
    base = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    out = columns.insert_after(base, "o_totalprice", "twice", F.col("o_totalprice") * 2)
    return columns.insert_after(out, "absent", "extra", F.lit(1))


@query("p6_match_flag", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def p6(spark, sf):
    flagged = table(spark, sf, "orders").withColumn("large", F.col("o_totalprice") > 100000)
    return rows.match_flag(flagged, "o_orderstatus", "F", "large").select("o_orderkey", "o_custkey")


@query("p7_drop_null_key", f"SELECT l_discount, l_orderkey, l_tax FROM ({GAPS_SQL}) WHERE l_discount IS NOT NULL")
def p7(spark, sf):
    return rows.drop_null_key(gappy_lineitem(spark, sf).select("l_discount", "l_orderkey", "l_tax"))


SERIES_SQL = """
SELECT user_id % 3 AS window_id, event_type AS series,
       CASE WHEN event_type = 'error' AND user_id % 3 = 1 THEN NULL ELSE value END AS value FROM events"""


@query(
    "p8_drop_empty_series",
    f"SELECT * FROM ({SERIES_SQL}) WHERE (window_id, series) IN (SELECT (window_id, series) FROM ({SERIES_SQL}) GROUP BY window_id, series HAVING count(value) > 0)",
)
def p8(spark, sf):
    window = F.col("user_id") % 3
    empty = (F.col("event_type") == "error") & (window == 1)
    series = table(spark, sf, "events").select(
        window.alias("window_id"), F.col("event_type").alias("series"), F.when(~empty, F.col("value")).alias("value")
    )
    return reshape.drop_empty_series(series, ["window_id", "series"])


@query("c1_sentinel_to_null", f"SELECT l_orderkey, CASE WHEN trim(qty_text) IN ({MISSING_SQL}) THEN NULL ELSE qty_text END AS qty FROM ({DIRTY_SQL})")
def c1(spark, sf):
    return dirty_lineitem(spark, sf).select("l_orderkey", c.null_if_missing(F.col("qty_text")).alias("qty"))


TOKENS = (*READER_NULL_TOKENS, "?", " NA", "\u00a0NaN\u2003", "nan ", "0", "n.a.")
TOKENS_SQL = "list_value(" + ", ".join(f"'{t}'" for t in TOKENS) + f")[CAST(l_orderkey % {len(TOKENS)} AS BIGINT) + 1]"


@query(
    "c1_reader_tokens",
    f"""SELECT l_orderkey, CASE WHEN cell NOT IN ({', '.join(f"'{t}'" for t in READER_NULL_TOKENS)}) THEN cell END AS read,
          CASE WHEN l_orderkey % {len(TOKENS)} >= {TOKENS.index('0')} THEN cell END AS cleaned FROM (SELECT l_orderkey, {TOKENS_SQL} AS cell FROM lineitem)""",
)
def c1_reader(spark, sf):
    """What a reader takes for missing, cell by cell, and then the wider list with any white space around its tokens."""
    cell = F.element_at(F.array(*[F.lit(t) for t in TOKENS]), (F.col("l_orderkey") % len(TOKENS) + 1).cast("int"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", c.null_if_reader_missing(cell).alias("read"))
    return rows.withColumn("cleaned", c.null_if_missing(F.col("read"), MISSING_TOKENS_EXTENDED))


@query("c2_numeric_coercion", f"SELECT l_orderkey, {sql_number('qty_text')} AS qty FROM ({DIRTY_SQL})")
def c2(spark, sf):
    return dirty_lineitem(spark, sf).select("l_orderkey", c.to_number(F.col("qty_text")).alias("qty"))


LENIENT_TEXT = "replace(replace(qty_text, '?', ''), ',', '.')"


@query("c3_lenient_clean", f"SELECT l_orderkey, {sql_number(LENIENT_TEXT)} AS qty FROM ({DIRTY_SQL})")
def c3(spark, sf):
    return dirty_lineitem(spark, sf).select("l_orderkey", c.to_number_lenient(F.col("qty_text")).alias("qty"))


DIGITS_SQL = f"SELECT l_orderkey, TRY_CAST(regexp_replace(qty_text, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS qty FROM ({DIRTY_SQL})"


@query("c4_digits_clean", f"SELECT l_orderkey, round(coalesce(qty, avg(qty) OVER ()), 6) + 0.0 AS qty FROM ({DIGITS_SQL})")
def c4(spark, sf):
    digits = dirty_lineitem(spark, sf).select("l_orderkey", c.to_number_digits(F.col("qty_text")).alias("qty"))
    return fill.fill_mean(digits, ["qty"]).select("l_orderkey", r("qty").alias("qty"))


@query("c5_text_category", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_class, p_brand FROM part")
def c5(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("size_class"), "p_brand")


@query(
    "c6_source_tag",
    f"SELECT l_orderkey, coalesce('1-[' || CAST(CASE WHEN l_discount IS NULL THEN NULL ELSE l_linenumber END AS VARCHAR) || ']', '') AS tag FROM ({GAPS_SQL})",
)
def c6(spark, sf):
    gaps = gappy_lineitem(spark, sf)
    number = F.when(F.col("l_discount").isNotNull(), F.col("l_linenumber"))
    return gaps.select("l_orderkey", c.tag_source(number, 1).alias("tag"))


@query("c7_strip_key", f"SELECT l_orderkey, regexp_replace(chr(9) || qty_text || chr(10), '^\\s+|\\s+$', '', 'g') AS key FROM ({DIRTY_SQL})")
def c7(spark, sf):
    padded = F.concat(F.lit("\t"), F.col("qty_text"), F.lit("\n"))
    return dirty_lineitem(spark, sf).select("l_orderkey", c.strip(padded).alias("key"))


@query(
    "c8_safe_name",
    "SELECT page_id, regexp_replace(url, '[\\\\/*?:\"<>|]', '_', 'g') AS file_name, translate(url, ' /()', '__') AS label FROM pages",
)
def c8(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", c.safe_file_name(F.col("url")).alias("file_name"), c.safe_label(F.col("url")).alias("label")
    )


@query("c9_quantise_clip", "SELECT event_id, least(greatest(round_even(value / 0.5, 0) * 0.5, 1.0), 40.0) AS value FROM events")
def c9(spark, sf):
    return table(spark, sf, "events").select("event_id", c.quantise(F.col("value"), 0.5, 1.0, 40.0).alias("value"))


@query(
    "c10_nested_defaults",
    f"SELECT doc, coalesce(formula, '') AS formula, coalesce(stable, false) AS stable, coalesce(energy, 0.0) AS energy FROM ({MEASUREMENT_SQL})",
)
def c10(spark, sf):
    docs = measurement_documents(spark, sf).select("doc", F.explode("results.adsorption_measurement").alias("m"))
    return docs.select(
        "doc",
        c.field_or("m", "adsorbate_species.formula", "").alias("formula"),
        c.field_or("m", "is_most_stable_site", False).alias("stable"),
        c.field_or("m", "adsorption_energy", 0.0).alias("energy"),
    )


@query(
    "f1_constant_fill",
    f"""SELECT l_orderkey, coalesce(l_discount, 0) AS l_discount, coalesce(l_tax, 0) AS l_tax,
               coalesce(CASE WHEN l_tax IS NULL THEN NULL ELSE l_returnflag END, '') AS flag FROM ({GAPS_SQL})""",
)
def f1(spark, sf):
    flag = F.when(F.col("l_tax").isNotNull(), F.col("l_returnflag")).alias("flag")
    return fill.fill_constants(gappy_lineitem(spark, sf).select("l_orderkey", "l_discount", "l_tax", flag))


@query(
    "f2_mean_fill",
    f"""SELECT l_orderkey, round(coalesce(l_discount, avg(l_discount) OVER ()), 6) + 0.0 AS l_discount,
               round(coalesce(l_tax, avg(l_tax) OVER ()), 6) + 0.0 AS l_tax FROM ({GAPS_SQL})""",
)
def f2(spark, sf):
    filled = fill.fill_mean(gappy_lineitem(spark, sf), ["l_discount", "l_tax"])
    return filled.select("l_orderkey", r("l_discount").alias("l_discount"), r("l_tax").alias("l_tax"))


@query(
    "u1_series_and_blocks",
    """SELECT l_orderkey, 1 AS block, l_quantity AS a, l_extendedprice AS b FROM lineitem
       UNION ALL SELECT l_orderkey, 2, l_discount, l_tax FROM lineitem
       UNION ALL SELECT l_orderkey, 0, value, NULL FROM (UNPIVOT (SELECT l_orderkey, l_quantity, l_tax FROM lineitem)
                 ON l_quantity, l_tax INTO NAME series VALUE value)""",
)
def u1(spark, sf):
    li = table(spark, sf, "lineitem")
    wide = li.select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    blocks = reshape.block_series(wide, ["l_orderkey"], {"a": 0, "b": 1}, stride=2, count=2)
    series = reshape.to_series(li, ["l_orderkey"], ["l_quantity", "l_tax"])
    return blocks.unionByName(
        series.select("l_orderkey", F.lit(0).alias("block"), F.col("value").alias("a"), F.lit(None).cast("double").alias("b"))
    )


@query(
    "u2_multi_window",
    """SELECT CAST(event_id // len + 1 AS INTEGER) AS window_id, event_id AS _row,
              CASE WHEN (event_id // len) % 2 = 0 THEN CAST(user_id AS DOUBLE) ELSE value END AS x,
              s.series AS series, CASE WHEN s.series = 'v' THEN value ELSE CAST(user_id AS DOUBLE) END AS value
       FROM events, (SELECT (max(event_id) + 13) // 13 AS len FROM events), (VALUES ('v'), ('u')) s(series)
       WHERE CASE WHEN (event_id // len) % 2 = 0 THEN user_id ELSE value END IS NOT NULL""",
)
def u2(spark, sf):
    sheet = table(spark, sf, "events").select(
        F.col("event_id").alias("_row"), F.col("user_id").cast("string").alias("c0"), F.col("value").cast("string").alias("c1")
    )
    length = (sheet.agg(F.max("_row")).first()[0] + 13) // 13
    windows = [(i % 2, i * length - 1, (i + 1) * length - 2) for i in range(13)]
    return reshape.window_series(sheet, windows, {"v": 1, "u": 0})


@query("d1_preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5")
def d1(spark, sf):
    return rows.preview(table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("d2_sample", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {sql_hash('o_orderkey', 42)}, o_orderkey LIMIT 100")
def d2(spark, sf):
    return rows.sample_rows(table(spark, sf, "orders"), "o_orderkey", 100).select("o_orderkey", "o_totalprice")


@query("d3_split", f"SELECT o_orderkey, {sql_hash('o_orderkey', 42)} < 429496729 AS is_test FROM orders")
def d3(spark, sf):
    return rows.with_split(table(spark, sf, "orders"), "o_orderkey").select("o_orderkey", "is_test")


@query("d4_folds", f"SELECT o_orderkey, CAST({sql_hash('o_orderkey', 43)} % 5 AS INTEGER) AS fold FROM orders")
def d4(spark, sf):
    return rows.with_fold(table(spark, sf, "orders"), "o_orderkey").select("o_orderkey", "fold")


@query(
    "r1_structure_densities",
    """SELECT o_orderkey AS structure_id, round(n * CAST(0.1 AS DOUBLE), 6) AS density_empirical,
              round(CASE WHEN v > 0 THEN w / v END, 9) AS density_volume, round(CASE WHEN v <> 0 THEN n / v * w END, 9) AS density_packing,
              round(n * CAST(0.05 AS DOUBLE), 6) AS density_count, round(CASE WHEN v > 0 THEN (w / 6.022e23) / (v * 1e-24) END, 9) AS density_mass
       FROM (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS w FROM lineitem GROUP BY 1)
       JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE o_totalprice END AS v FROM orders) ON l_orderkey = o_orderkey""",
)
def r1(spark, sf):
    sites = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("structure_id"), F.col("l_quantity").alias("weight"))
    volume = F.when(F.col("o_orderkey") % 10 == 0, 0.0).otherwise(F.col("o_totalprice"))
    structures = table(spark, sf, "orders").select(F.col("o_orderkey").alias("structure_id"), volume.alias("volume"))
    out = chemistry.structure_densities(sites, structures)
    digits = {"density_empirical": 6, "density_count": 6}
    return out.select("structure_id", *[F.round(n, digits.get(n, 9)).alias(n) for n in out.columns[1:]])


@query(
    "r2_adsorption_energy",
    """SELECT l_returnflag AS material, l_linestatus AS surface, l_suppkey AS site,
              round(sum(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity END)
                    - (sum(CASE WHEN l_linenumber % 3 = 1 THEN l_quantity END) + sum(CASE WHEN l_linenumber % 3 = 2 THEN l_quantity END)), 6) + 0.0
              AS adsorption_energy FROM lineitem GROUP BY 1, 2, 3""",
)
def r2(spark, sf):
    kind = F.element_at(F.array(F.lit("slab_ads"), F.lit("slab"), F.lit("gas")), F.col("l_linenumber") % 3 + 1)
    energies = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("material"), F.col("l_linestatus").alias("surface"), F.col("l_suppkey").alias("site"),
        kind.alias("kind"), F.col("l_quantity").alias("energy"),
    )
    out = chemistry.adsorption_energy(energies)
    return out.withColumn("adsorption_energy", r("adsorption_energy"))
