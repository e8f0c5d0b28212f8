"""Queries over scans, sinks and stores."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Window
from pyspark.sql import functions as F

from labweave.ml.prep import assembler
from labweave.operators.columns import conform
from labweave.operators.metrics import regression_metrics
from labweave.operators.reshape import to_series
from labweave.operators.rows import best_by_rank
from labweave.session import shared_dir
from labweave.sources import stores, tables
from labweave.suite.common import query, r, table

ADSORPTION_SCHEMA = """doc bigint, results array<struct<adsorption_measurement: struct<
    adsorbate_species: struct<formula: string>, is_most_stable_site: boolean, adsorption_energy: double,
    bulk_surface_property_set: struct<bulk_surface_material: struct<name: string>>>>>"""

# one document per event, with absent fields by rule
MEASUREMENT_SQL = """
SELECT event_id AS doc,
       CASE WHEN event_id % 3 = 0 THEN 'CO' WHEN event_id % 17 = 1 THEN NULL ELSE 'H2' END AS formula,
       CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_id % 2 = 1 END AS stable,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS energy,
       CASE WHEN event_id % 13 = 0 THEN '' ELSE event_type || '-' || CAST(user_id AS VARCHAR) END AS material
FROM events"""


def measurement_documents(spark, sf):
    """Events as nested measurement documents."""
    i = F.col("event_id")
    formula = F.when(i % 3 == 0, "CO").when(i % 17 == 1, F.lit(None)).otherwise("H2")
    stable = F.when(i % 19 == 0, F.lit(None)).otherwise(i % 2 == 1)
    energy = F.when(i % 11 == 0, F.lit(None)).otherwise(F.col("value"))
    name = F.when(i % 13 == 0, "").otherwise(F.concat_ws("-", "event_type", F.col("user_id").cast("string")))
    measurement = F.struct(
        F.struct(formula.alias("formula")).alias("adsorbate_species"),
        stable.alias("is_most_stable_site"),
        energy.alias("adsorption_energy"),
        F.struct(F.struct(name.alias("name")).alias("bulk_surface_material")).alias("bulk_surface_property_set"),
    )
    return table(spark, sf, "events").select(
        i.alias("doc"), F.array(F.struct(measurement.alias("adsorption_measurement"))).alias("results")
    )


@query(
    "s1_csv_encodings",
    "SELECT CAST(c_custkey AS VARCHAR) AS key, 'Käufer ' || c_name AS label FROM customer "
    "UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'Hersteller für ' || s_name FROM supplier",
)
def s1(spark, sf):
    root = shared_dir(spark)
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit("Käufer "), "c_name").alias("label"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.concat(F.lit("Hersteller für "), "s_name").alias("label"))
    tables.write_delimited(c, f"{root}/utf8", encoding="UTF-8")
    tables.write_delimited(s, f"{root}/latin1", encoding="ISO-8859-1")
    return tables.read_delimited(spark, [f"{root}/utf8", f"{root}/latin1"], "key string, label string")


@query(
    "s2_sheet_region",
    "SELECT event_id AS _row, user_id, value FROM events WHERE event_id BETWEEN 1 AND 1099511627776",
)
def s2(spark, sf):
    sheet = table(spark, sf, "events").withColumnRenamed("event_id", "_row")
    return tables.sheet_region(sheet, [3, 1], first=0, last=1 << 40)


@query("s3_first_available", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def s3(spark, sf):
    found = tables.read_first(spark, [f"{sf}/no_such_table.parquet", f"{sf}/orders.parquet"])
    return found.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("s4_nested_json", f"SELECT doc, formula, stable, energy, material FROM ({MEASUREMENT_SQL})")
def s4(spark, sf):
    root = shared_dir(spark)
    measurement_documents(spark, sf).write.json(f"{root}/docs")
    docs = tables.read_nested_json(spark, f"{root}/docs", ADSORPTION_SCHEMA, multi_line=False)
    m = F.col("e.adsorption_measurement")
    return docs.select("doc", F.explode("results").alias("e")).select(
        "doc",
        m["adsorbate_species"]["formula"].alias("formula"),
        m["is_most_stable_site"].alias("stable"),
        m["adsorption_energy"].alias("energy"),
        m["bulk_surface_property_set"]["bulk_surface_material"]["name"].alias("material"),
    )


@query("s5_csv_round_trip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def s5(spark, sf):
    root = shared_dir(spark)
    columns = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderpriority", "string")]
    tables.write_delimited(table(spark, sf, "orders").select(*[c for c, _ in columns]), f"{root}/orders")
    return conform(tables.read_delimited(spark, f"{root}/orders"), columns)


OLS_SQL = """
SELECT l_orderkey, l_quantity, round(f.b0 + f.b1 * l_quantity, 4) + 0.0 AS prediction
FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS b1, regr_intercept(l_extendedprice, l_quantity) AS b0 FROM lineitem) f"""


@query("s6_model_round_trip", OLS_SQL)
def s6(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", F.col("l_extendedprice").alias("label"))
    root = shared_dir(spark)
    stores.save_model(Pipeline(stages=[assembler(["l_quantity"]), LinearRegression()]).fit(rows), root, "price", "OLS")
    fitted = stores.load_model(root, "price", "OLS")
    return fitted.transform(rows).select("l_orderkey", "l_quantity", r("prediction", 4).alias("prediction"))


@query(
    "s7_feature_store",
    """SELECT target, model, feature, CAST(rank AS INTEGER) AS rank FROM (
         SELECT *, row_number() OVER (PARTITION BY target, model ORDER BY size DESC, feature) AS rank FROM (
           SELECT l_returnflag AS target, l_linestatus AS model, feature, round(avg(value), 6) AS size
           FROM (UNPIVOT (SELECT l_returnflag, l_linestatus, l_quantity, l_discount, l_tax FROM lineitem)
                 ON l_quantity, l_discount, l_tax INTO NAME feature VALUE value) GROUP BY 1, 2, 3)) WHERE rank <= 2""",
)
def s7(spark, sf):
    names = ["l_quantity", "l_discount", "l_tax"]
    long = to_series(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], names, "feature")
    means = long.groupBy(F.col("l_returnflag").alias("target"), F.col("l_linestatus").alias("model"), "feature").agg(
        (-r(F.avg("value"))).alias("size")
    )
    # a handful of features per (target, model)
    ranked = means.withColumn("rank", F.row_number().over(Window.partitionBy("target", "model").orderBy("size", "feature")))
    path = f"{shared_dir(spark)}/selected"
    stores.save_selected_features(best_by_rank(ranked, ["target", "model"], "rank", "feature", 2), path)
    return stores.load_selected_features(spark, path)


@query(
    "s8_result_store",
    """SELECT target, 'flat' AS model, round(avg((y - p) * (y - p)), 2) + 0.0 AS mse, NULL::DOUBLE AS r2,
              max(CASE WHEN target = 'R' THEN 1 ELSE 0 END) AS failed
       FROM (SELECT l_returnflag AS target, l_extendedprice AS y, 50000.0 AS p FROM lineitem) GROUP BY 1""",
)
def s8(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("target"), F.col("l_extendedprice").alias("y"), F.lit(50000.0).alias("p")
    )
    scores = regression_metrics(rows, "y", "p", ["target"])
    results = to_series(scores.select("target", r("mse", 2).alias("mse"), F.lit(float("nan")).alias("r2")), ["target"], ["mse", "r2"], "metric")
    results = results.select(
        "target", F.lit("flat").alias("model"), "metric", F.nanvl("value", F.lit(None).cast("double")).alias("value"),
        F.when(F.col("target") == "R", "failed").otherwise("ok").alias("status"),
    )
    path = f"{shared_dir(spark)}/results"
    results.write.parquet(path)
    return stores.summarise_results(spark.read.schema(stores.RESULT_SCHEMA).parquet(path), ["mse", "r2"])
