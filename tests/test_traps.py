"""One small case per known pitfall of the data or of the engines."""

import math

import pytest
from pyspark.sql import functions as F

from labweave.functions import cleaning as c
from labweave.operators import chemistry, columns, designs, fill, lookup, metrics, profile, reshape, rows, sensitivity
from labweave.ml import prep
from labweave.plans import assembly, sensitivity as study
from labweave.session import local_table
from labweave.suite.sources import ADSORPTION_SCHEMA


def texts(spark, values, column):
    df = local_table(spark, [(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_targets_stay_null_unless_asked(spark):
    df = local_table(spark, [(None, None, None)], "a double, t string, target double")
    assert fill.fill_constants(df, keep=["target"]).first() == (0.0, "", None)
    assert fill.fill_constants(df).first() == (0.0, "", 0.0)


def test_unknown_method_gives_null_numbers(spark):
    sheet = local_table(spark, [("IWI",), ("nobody",), (None,)], "`Preparation method` string")
    got = assembly.enrich(assembly.harmonise(sheet, {}, 1)).select("Preparation cost").collect()
    assert [r[0] for r in got] == [1, None, None]


def test_best_scores_ignore_nan(spark):
    nan = float("nan")
    df = local_table(spark, [("m", 4, nan, nan), ("m", 5, 0.5, 2.0), ("m", 6, 0.7, 3.0)], "model string, n_features int, r2 double, rmse double")
    assert metrics.best_scores(df, ["model"]).first() == ("m", 0.7, 2.0, 6)


def test_number_modes_differ(spark):
    raw = ["?8.83", "1,5", "1e5", " 7 ", "1d", "nan", "NaN", "", None, "0x1p3", "-.5", "5."]
    assert texts(spark, raw, c.to_number) == [None, None, 1e5, 7.0, None, None, None, None, None, None, -0.5, 5.0]
    assert texts(spark, raw[:3], c.to_number_lenient) == [8.83, 1.5, 1e5]
    assert texts(spark, raw[:3], c.to_number_digits) == [8.83, 15.0, 15.0]


def test_missing_tokens(spark):
    assert texts(spark, ["?", " NA ", "nan", "x"], c.null_if_missing) == [None, None, None, "x"]


def test_strip_takes_all_white_space(spark):
    assert texts(spark, ["\t Ni\r\n", "a b", None], c.strip) == ["Ni", "a b", None]


def test_tag_source(spark):
    assert texts(spark, ["7", None], lambda t: c.tag_source(t, 2)) == ["2-[7]", ""]


def test_quantise_rounds_half_to_even(spark):
    df = local_table(spark, [(0.5,), (1.5,), (2.5,), (-9.0,), (99.0,)], "x double")
    assert [r[0] for r in df.select(c.quantise(F.col("x"), 1.0, 0.0, 10.0)).collect()] == [0.0, 2.0, 2.0, 0.0, 10.0]


def test_bins_are_right_closed(spark):
    df = local_table(spark, [(float(v),) for v in (0, 2, 2.0001, 4, 8, 10)] + [(None,)], "x double")
    assert [r.bin for r in profile.with_bin(df, "x").orderBy("x").collect()] == [None, 1, 1, 2, 2, 4, 5]
    widened = profile.with_bin(df, "x", interval=True).filter("x = 0").first().bin
    assert widened.lo == pytest.approx(-0.01) and widened.hi == 2.0


def test_constant_column_sits_in_the_middle_bin(spark):
    df = local_table(spark, [(3.0,), (3.0,)], "x double")
    assert {r.bin for r in profile.with_bin(df, "x").collect()} == {3}
    assert profile.with_bin(df, "x", interval=True).first().bin.lo < 3.0


def test_scaler_uses_the_population_deviation(spark):
    df = local_table(spark, [(1.0, 5.0), (3.0, 5.0)], "x double, flat double")
    out = prep.PopulationScaler(inputCols=["x", "flat"]).fit(df).transform(df)
    assert sorted(tuple(r) for r in out.collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_design_sizes(spark):
    assert study.quasi_design(spark).count() == 5000
    assert study.factorial_design(spark).count() == 36480


def test_design_refuses_a_missing_factor(spark):
    design = designs.saltelli_design(spark, {"T": (0, 1)}, 4)
    with pytest.raises(KeyError):
        designs.quantise_design(design, {"T": (0, 1, 0.5), "P": (0, 1, 0.5)})


def test_first_points_of_the_sequence(spark):
    rows_ = designs.saltelli_design(spark, {"x": (0.0, 1.0)}, 8, skip=0).filter("role in ('A', 'B')").orderBy("block_id", "role").collect()
    first, second = [r.x for r in rows_[0::2]], [r.x for r in rows_[1::2]]
    assert first == [0.0, 0.5, 0.75, 0.25, 0.375, 0.875, 0.625, 0.125]
    assert second == [0.0, 0.5, 0.25, 0.75, 0.375, 0.875, 0.125, 0.625]


def test_incomplete_block_is_an_error(spark):
    runs = designs.saltelli_design(spark, {"x": (0.0, 1.0), "z": (0.0, 1.0)}, 4).withColumn("y", F.col("x"))
    broken = runs.filter("not (block_id = 2 and role = 'B')")
    with pytest.raises(Exception, match="block 2"):
        sensitivity.block_table(broken, 2, ["y"]).collect()


def test_windows_tile_the_sheet_and_drop_text(spark):
    cells = [(i, str(i) if i != 4 else "text", "n/a" if i < 6 else str(10 * i)) for i in range(1, 10)]
    sheet = local_table(spark, cells, "_row long, x string, y string")
    out = reshape.window_series(sheet, [(0, 1, 4), (0, 5, 8)], {"y": 1})
    got = sorted((r.window_id, r._row, r.x, r.value) for r in out.collect())
    assert got == [(1, 2, 2.0, None), (1, 3, 3.0, None), (1, 5, 5.0, None), (2, 6, 6.0, 60.0), (2, 7, 7.0, 70.0), (2, 8, 8.0, 80.0), (2, 9, 9.0, 90.0)]
    assert {r.window_id for r in reshape.drop_empty_series(out, ["window_id", "series"]).collect()} == {2}


def test_overlapping_windows_keep_both(spark):
    sheet = local_table(spark, [(i, str(i)) for i in range(1, 6)], "_row long, x string")
    assert reshape.window_series(sheet, [(0, 1, 4), (0, 2, 4)], {"x": 0}).count() == 4 + 3


def test_strict_columns(spark):
    df = local_table(spark, [(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        columns.select_strict(df, ["a", "z"])
    assert columns.select_available(df, ["z", "b"]).columns == ["b"]
    assert columns.insert_after(df, "a", "c", F.lit(9)).columns == ["a", "c", "b"]
    assert columns.complement(df, ["b"]) == ["a"]


def test_names_with_special_characters(spark):
    df = local_table(spark, [(1.0,)], "`H2/CO2 ratio (mol/mol)` double")
    assert fill.fill_mean(df, ["H2/CO2 ratio (mol/mol)"]).first()[0] == 1.0
    assert assembly.feature_code("H2/CO2 ratio (mol/mol)") == "H2_CO2"
    assert assembly.feature_code("Active component type density") == "ACD"
    assert assembly.feature_code("Reduced hydrogen content (vol%)") == "RHC"


def test_first_adsorption_energy_wins(spark):
    def entry(name, formula="CO", stable=True, energy=1.0):
        return {"adsorption_measurement": {"adsorbate_species": {"formula": formula}, "is_most_stable_site": stable,
                "adsorption_energy": energy, "bulk_surface_property_set": {"bulk_surface_material": {"name": name}}}}

    docs = [(0, [entry("Ni", "H2", energy=9.0), entry("Ni", energy=-1.5), entry("Ni", energy=-2.5), entry("Co", stable=False),
                 entry("", energy=3.0), entry("Ru", energy=None), {"adsorption_measurement": None}])]
    got = {r.material: r.energy for r in chemistry.first_energy(spark.createDataFrame(docs, ADSORPTION_SCHEMA)).collect()}
    assert got == {"Ni": -1.5, "Ru": 0.0}


def test_densities_of_an_empty_volume(spark):
    sites = local_table(spark, [("s", 2.0), ("s", 4.0)], "structure_id string, weight double")
    structures = local_table(spark, [("s", 0.0)], "structure_id string, volume double")
    got = chemistry.structure_densities(sites, structures).first()
    assert got.density_empirical == pytest.approx(0.2) and got.density_count == pytest.approx(0.1)
    assert got.density_volume is None and got.density_packing is None and got.density_mass is None


def test_split_and_folds(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    split = lambda d: {r.k for r in rows.with_split(d, "k").filter("is_test").collect()}
    assert split(df) == split(df.repartition(13)) and 3600 < len(split(df)) < 4400
    sizes = rows.with_fold(df, "k").groupBy("fold").count().collect()
    assert sorted(r.fold for r in sizes) == [0, 1, 2, 3, 4] and all(3600 < r["count"] < 4400 for r in sizes)
    assert rows.with_fold(df.withColumn("k", F.col("k").cast("string")), "k").groupBy("fold").count().count() == 5


def test_normal_quantile(spark):
    from statistics import NormalDist

    from labweave.functions.normal import with_normal_quantile

    p = [1e-12, 1e-5, 0.02, 0.3, 0.5, 0.9, 0.999, 1 - 1e-9]
    df = with_normal_quantile(local_table(spark, [(x,) for x in p], "p double"), F.col("p"), "z")
    for r in df.collect():
        assert math.isclose(r.z, NormalDist().inv_cdf(r.p), rel_tol=1e-12, abs_tol=1e-15)


def test_reverse_names_report_the_unmatched(spark):
    names = local_table(spark, [("T",), ("XX",)], "feature string")
    from labweave.fixed_values import FEATURE_CODES

    matched, unmatched = lookup.unmap_names(names, FEATURE_CODES)
    assert [r.full_name for r in matched.collect()] == ["Temperature (C)"] and [r.feature for r in unmatched.collect()] == ["XX"]
