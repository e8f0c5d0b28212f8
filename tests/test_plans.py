"""What the physical plans look like, skewed keys, sources and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labweave.operators import lookup, profile, quantiles
from labweave.operators.moments import pair_correlation, pair_moments
from labweave.session import local_table, shared_dir
from labweave.sources import tables
from labweave.streaming.scoring import score_stream
from labweave.suite.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j1_material_lookup", "j2_method_lookup", "j3_derived_lookup"])
def test_small_lookups_broadcast(name, spark, data):
    text = plan(QUERIES[name](spark, data))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_large_lookup_shuffles(spark, data):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["j8_large_dimension_lookup"](spark, data))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text or "ShuffledHashJoin" in text


@pytest.mark.parametrize("name", [n for n in QUERIES if n[0] in "cp" and n[1].isdigit()] + ["j1_material_lookup", "w2_equal_width_bins", "plan_assembly"])
def test_no_python_in_the_plan(name, spark, data):
    text = plan(QUERIES[name](spark, data))
    assert "Python" not in text and "InPandas" not in text


def test_row_window_reaches_the_scan(spark, data):
    text = plan(QUERIES["s2_sheet_region"](spark, data))
    assert "GreaterThanOrEqual" in text.split("PushedFilters")[1] and "props" not in text.split("ReadSchema")[1]


def test_no_cross_joins(spark, data):
    for name in ("e1_full_factorial", "e2_saltelli_quantised", "j7_grid_product", "u2_multi_window", "x1_partial_dependence"):
        text = plan(QUERIES[name](spark, data))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def skewed(spark, n=6000):
    """A third of the rows share one value."""
    value = F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 7919 % 1009) / 100.0)
    return spark.range(n).select(F.col("id").alias("k"), value.alias("v"), (F.col("id") % 2).cast("string").alias("g"))


@pytest.mark.parametrize("steps", [4, 64, 300])
def test_global_rank_of_a_hot_value(spark, steps):
    got = quantiles.with_global_rank(skewed(spark), "v", "k", steps=steps).toPandas().sort_values(["v", "k"])
    assert np.array_equal(got["rank"].to_numpy(), np.arange(1, 6001))


def test_hot_value_is_cut_into_pieces(spark):
    ladder = skewed(spark).agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 10000)).first()[0]
    assert ladder.count(5.0) > 15


@pytest.mark.parametrize("leaf", [10, 500, 10**6])
def test_quantiles_refine_to_the_exact_value(spark, leaf):
    probabilities = [0.0, 0.05, 0.37, 0.5, 0.95, 1.0]
    df = skewed(spark)
    got = {(r.g, r.p): r.quantile for r in quantiles.group_quantiles(df, "g", "v", probabilities, steps=8, leaf_rows=leaf).collect()}
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        for p in probabilities:
            assert got[g, p] == pytest.approx(np.quantile(part["v"], p))


def test_frequency_by_shuffle_equals_broadcast(spark, monkeypatch):
    df = skewed(spark).withColumn("v", F.when(F.col("k") % 11 != 0, F.col("v")))
    quick = sorted((r.k, r.frequency) for r in profile.with_frequency(df, "v").collect())
    monkeypatch.setattr(profile, "bounded_copy", lambda _: None)
    assert quick == sorted((r.k, r.frequency) for r in profile.with_frequency(df, "v").collect())


def test_salted_lookup_equals_broadcast(spark):
    dim = local_table(spark, [("5.0", 1), ("0.01", 2)], "name string, n int")
    df = skewed(spark).withColumn("key", F.concat(F.lit(" "), F.col("v").cast("string")))
    one, two = (lookup.lookup(df, dim, "key", "name", {"n": "n"}, 0, bounded=b) for b in (True, False))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_bounded_copy(spark):
    assert lookup.bounded_copy(spark.range(5), 4) is None
    assert lookup.bounded_copy(spark.range(5), 5).count() == 5


def test_matrix_moments_equal_corr(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).cast("double").alias("a"), F.when(F.col("id") % 5 != 0, F.col("id") * 53 % 97).cast("double").alias("b"))
    got = pair_moments(df, ["a", "b"]).filter("i = 0 and j = 1").select(pair_correlation().alias("r")).first().r
    assert got == pytest.approx(df.agg(F.corr("a", "b")).first()[0])


def test_encodings_and_first_source(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("name,v\nKäse,1\n".encode("utf-8"))
    (tmp_path / "l.csv").write_bytes("name,v\nBüro,2\n".encode("latin-1"))
    got = tables.read_delimited(spark, str(tmp_path), "name string, v string").collect()
    assert sorted(map(tuple, got)) == [("Büro", "2"), ("Käse", "1")]
    with pytest.raises(FileNotFoundError):
        tables.read_first(spark, [str(tmp_path / "none.csv")])
    assert tables.read_existing(spark, [str(tmp_path / "none.csv"), str(tmp_path / "u.csv")], "csv", header="true").count() == 1


def test_shared_dir_follows_the_setting(spark):
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_stream_scoring(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import LinearRegression

    from labweave.ml.prep import preprocessing

    df = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("label"))
    df.write.parquet(str(tmp_path / "in"))
    model = Pipeline(stages=[*preprocessing(["x"]).getStages(), LinearRegression()]).fit(df)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    scored = spark.read.parquet(str(tmp_path / "out"))
    assert scored.count() == 50 and scored.filter(F.abs(F.col("prediction") - F.col("label")) > 1e-6).count() == 0


def test_many_documents_cost_the_assembly_no_shuffle_of_rows(spark, monkeypatch):
    """Once, documents on more materials than fit in a copy had every row of the table shuffled for each of the four roles."""
    from labweave.operators import lookup
    from labweave.plans import assembly

    monkeypatch.setattr(assembly, "bounded_copy", lambda df: lookup.bounded_copy(df, 20))
    item = "struct(struct('CO' AS formula) AS adsorbate_species, true AS is_most_stable_site, CAST(id AS DOUBLE) AS adsorption_energy, " \
        "struct(struct(CASE id WHEN 5 THEN 'Ni' WHEN 6 THEN 'Al2O3' ELSE concat('m', id) END AS name) AS bulk_surface_material) AS bulk_surface_property_set)"
    documents = spark.range(1, 100).selectExpr("id AS doc", f"array(struct({item} AS adsorption_measurement)) AS results")
    rows = [(" Ni ", "Al2O3"), (None, "Al2O3"), ("Co", None), ("m50", "Ni")]
    table = spark.createDataFrame(rows, "`Active component type` string, `Support a type` string")
    out = assembly.attach_adsorption(table, documents)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan and "Aggregate" not in plan
    got = [(r["Active component adsorption energy"], r["Support a type adsorption energy"]) for r in out.collect()]
    assert got == [(5.0, 6.0), (0.0, 6.0), (0.0, 0.0), (50.0, 5.0)]
