"""Inputs that once gave wrong results without an error."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from labweave.functions.cleaning import strip
from labweave.operators import designs
from labweave.operators.lookup import lookup
from labweave.operators.metrics import qq_line
from labweave.operators.profile import correlation_matrix, distinct_counts
from labweave.operators.sensitivity import analyse_outputs
from labweave.operators.designs import role_names
from labweave.sources.stores import model_path
from labweave.sources.tables import read_delimited


def runs(spark, spoil):
    rows = [(b, r, float(b * 7 % 5 + i * 0.3)) for b in range(40) for i, r in enumerate(role_names(2))]
    return spark.createDataFrame(spoil(rows), "block_id bigint, role string, y double")


@pytest.mark.parametrize("spoil", [
    lambda rows: rows[1:], lambda rows: [*rows, rows[0]], lambda rows: [*rows[1:], (0, "other", 1.0)],
], ids=["missing", "doubled", "unknown"])
def test_spoilt_blocks_are_an_error_in_the_indices(spark, spoil):
    assert analyse_outputs(runs(spark, lambda rows: rows), ["a", "b"], ["y"], resamples=2).count()
    with pytest.raises(Exception, match="incomplete or doubled roles"):
        analyse_outputs(runs(spark, spoil), ["a", "b"], ["y"], resamples=2).collect()


@pytest.mark.parametrize("width", [8, 9])
def test_constant_and_nan_columns_at_any_width(spark, width):
    rows = [tuple([0.1, math.nan if i == 3 else float(i * i)] + [float((i * (k + 3)) % 11) for k in range(width - 2)]) for i in range(50)]
    frame = spark.createDataFrame(rows, ", ".join(f"c{k} double" for k in range(width)))
    got = {(r.name_i, r.name_j): r for r in correlation_matrix(frame, frame.columns).collect()}
    assert got["c0", "c2"].corr is None and got["c0", "c1"].corr is None
    assert got["c1", "c2"].n == 49 and -1 <= got["c1", "c2"].corr <= 1
    plain = frame.where(~F.isnan("c1")).agg(F.corr("c1", "c2")).first()[0]
    assert got["c1", "c2"].corr == pytest.approx(plain)


def test_constant_residuals(spark):
    got = qq_line(spark.createDataFrame([(2.0, -1.0), (2.0, 0.0), (2.0, 1.0)], "ordered double, theoretical double")).first()
    assert (got.slope, got.intercept, got.r) == (0.0, 2.0, None)


def test_keys_that_meet_after_stripping(spark):
    facts = spark.createDataFrame([("Ni",), ("Cu ",)], "k string")
    side = spark.createDataFrame([("Ni", 1.0), (" Ni", 2.0), (" Cu", 3.0)], "m string, e double")
    assert sorted(r.v for r in lookup(facts, side, "k", "m", {"e": "v"}).collect()) == [2.0, 3.0]


def test_one_zero(spark):
    got = {r["column"]: r.n_distinct for r in distinct_counts(spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "x double"), ["x"]).collect()}
    assert got == {"x": 2}


def test_white_space_beyond_ascii(spark):
    assert spark.createDataFrame([("  x 　",)], "t string").select(strip(F.col("t"))).first()[0] == "x"


def test_names_that_meet_after_cleaning():
    assert model_path("r", "CO2 Conversion", "m") != model_path("r", "CO2_Conversion", "m")


def test_sequence_does_not_repeat(spark):
    with pytest.raises(ValueError, match="repeat"):
        designs.saltelli_blocks(spark.range(1).withColumnRenamed("id", "block_id"), {"a": (0, 1), "b": (0, 1)}, points=1 << 31)


def test_paths_with_blanks_and_headers_that_differ(spark, tmp_path):
    folder = tmp_path / "a sheet"
    folder.mkdir()
    (folder / "one file.csv").write_text("k,v\na,1\n")
    assert [tuple(r) for r in read_delimited(spark, str(folder)).collect()] == [("a", "1")]
    (folder / "two.csv").write_text("v,k\n2,b\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_delimited(spark, str(folder)).collect()


def test_sketches_merge_by_weight(spark):
    """Ladders of unequal tasks, a hot value among them, stay in order and hold the hot value as often as its share."""
    from labweave.operators.quantiles import _ladders

    rows = spark.range(0, 40_000, 1, 7).selectExpr("'a' AS g", "CASE WHEN id % 3 = 0 THEN 5.0D ELSE CAST(id AS DOUBLE) END AS v")
    rows = rows.unionByName(spark.createDataFrame([("b", 1.0), ("c", None)], "g string, v double"))
    got = _ladders(rows, "g", "v", 64)
    assert set(got) == {"a", "b"} and set(got["b"]) == {1.0}
    assert got["a"] == sorted(got["a"]) and 19 <= got["a"].count(5.0) <= 23


def test_side_by_side_keeps_both_sides(spark):
    from labweave.operators.lookup import concat_columns

    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, y string")
    assert sorted(map(tuple, concat_columns(left, right, "k").collect())) == [(1, "a", None), (2, "b", "c"), (3, None, "d")]


def test_equal_rows_of_different_tasks_spread(spark):
    from pyspark.sql import functions as F

    from labweave.operators.lookup import salted_left_join

    facts = spark.range(0, 1000, 1, 8).select(F.lit("hot").alias("k"))
    side = spark.createDataFrame([("hot", 1)], "dk string, n int")
    joined = salted_left_join(facts, side, F.col("k"), "dk")
    assert joined.count() == 1000 and joined.where("n = 1").count() == 1000
    assert joined.select("_salt_l").distinct().count() > 1


def test_depth_beyond_the_limit_is_an_error():
    from labweave.ml.regressors import random_forest

    with pytest.raises(ValueError):
        random_forest(max_depth=50)
