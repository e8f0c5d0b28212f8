"""Densities, filled surfaces, exact bootstrap, penalty paths and halving against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from labweave.ml import fold_sums, prep, regressors, validation
from labweave.operators import bootstrap, density, designs, sensitivity, surfaces

# --- density


def direct_density(x, points, cut=3.0):
    x = np.array([v for v in x if v is not None and not math.isnan(v)])
    h = x.std(ddof=1) * len(x) ** -0.2
    at = np.linspace(x.min() - cut * h, x.max() + cut * h, points)
    return at, np.exp(-0.5 * ((at[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi)), h


@pytest.mark.parametrize("resolution", [5, 50])
def test_density_is_within_its_bound(spark, resolution):
    rng = np.random.default_rng(0)
    x = [*rng.normal(size=700).tolist(), *(10 + rng.exponential(size=300)).tolist(), None, float("nan"), 80.0]  # a gap that no value reaches
    got = density.kernel_density(spark.createDataFrame([(v,) for v in x], "v double").repartition(3), "v", 120, resolution).orderBy("point").collect()
    at, want, h = direct_density(x, 120)
    assert np.allclose([r["x"] for r in got], at)
    assert np.abs(np.array([r["density"] for r in got]) - want).max() <= 1 / (8 * resolution**2) / (h * math.sqrt(2 * math.pi)) + 1e-10
    assert min(r["density"] for r in got) == 0.0


def test_no_density_without_spread(spark):
    for rows in ([], [(1.0,)], [(2.0,), (2.0,), (None,)]):
        assert density.kernel_density(spark.createDataFrame(rows, "v double"), "v").count() == 0


# --- surfaces


def test_empty_cells_take_the_nearest_filled_ones(spark):
    rng = np.random.default_rng(3)
    x = rng.random(150)
    points = [(float(a), float(a * a + 0.05 * rng.random()), float(np.sin(5 * a))) for a in x] + [(None, 1.0, 1.0), (0.5, None, 1.0), (0.5, 0.5, None)]
    df = spark.createDataFrame(points, "x double, y double, z double")
    got = {(r["bin_x"], r["bin_y"]): r for r in surfaces.filled_surface(df, "x", "y", "z", cells=15, nearest=3).collect()}
    assert len(got) == 225
    whole = np.array([p for p in points if None not in p])
    low, high = whole[:, :2].min(axis=0), whole[:, :2].max(axis=0)
    place = (whole[:, :2] - low) * 15 / (high - low)
    bins = np.clip(np.ceil(place), 1, 15).astype(int)
    filled = {}
    for b, p, z in zip(map(tuple, bins.tolist()), place, whole[:, 2]):
        filled.setdefault(b, []).append((*p, z))
    centres = {b: np.mean(v, axis=0) for b, v in filled.items()}
    for b, r in got.items():
        if b in centres:
            assert r["n"] == len(filled[b]) and r["z"] == pytest.approx(centres[b][2])
        else:
            near = sorted((math.dist(c[:2], np.array(b) - 0.5), c[2]) for c in centres.values())[:3]
            assert r["n"] == 0 and r["z"] == pytest.approx(sum(z / d**2 for d, z in near) / sum(1 / d**2 for d, _ in near))


def test_surface_of_few_points(spark):
    kinds = "x double, y double, z double"
    assert surfaces.filled_surface(spark.createDataFrame([], kinds), "x", "y", "z", cells=4).count() == 0
    one = surfaces.filled_surface(spark.createDataFrame([(1.0, 2.0, 5.0), (1.0, 2.0, 7.0)], kinds), "x", "y", "z", cells=4).collect()
    assert len(one) == 16 and all(r["z"] == pytest.approx(6.0) for r in one)


# --- bootstrap


def test_draws_total_the_blocks_and_spread_like_a_multinomial(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "BUCKET_BLOCKS", 16)
    blocks = spark.range(500).select(F.col("id").alias("block_id"))
    drawn = bootstrap.bootstrap_draws(blocks.repartition(7), 200, seed=3).toPandas()
    assert (drawn.groupby("resample")["w"].sum() == 500).all()
    weights = np.zeros((200, 500))
    weights[drawn["resample"] - 1, drawn["block_id"]] = drawn["w"]
    assert abs(weights.mean() - 1) < 1e-12 and abs(weights.var() - (1 - 1 / 500)) < 0.02
    assert abs(np.corrcoef(weights.T)[~np.eye(500, dtype=bool)].mean() + 1 / 499) < 1e-3
    again = bootstrap.bootstrap_draws(blocks.repartition(2), 200, seed=3).toPandas()
    assert drawn.sort_values(["resample", "block_id"]).reset_index(drop=True).equals(again.sort_values(["resample", "block_id"]).reset_index(drop=True))
    assert bootstrap.bootstrap_draws(blocks.limit(0), 5).count() == 0
    assert {(r["block_id"], r["w"]) for r in bootstrap.bootstrap_draws(spark.createDataFrame([("only",)], "block_id string"), 5).collect()} == {("only", 1)}


def test_exact_widths_equal_resampled_indices(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "BUCKET_BLOCKS", 32)
    names, n = ["x1", "x2", "x3"], 200
    blocks = spark.range(n).select(F.col("id").alias("block_id"))
    runs = designs.saltelli_blocks(blocks, {c: (-3.0, 3.0) for c in names}, n).withColumns({"y": F.sin("x1") + 7 * F.sin("x2") * F.sin("x2"), "flat": F.lit(1.0)})
    table = sensitivity.standardise_blocks(sensitivity.block_table(runs, 3, ["y", "flat"]), 3)
    got = {(r["output"], r["order"], r["factor_i"], r["factor_j"]): r["conf"] for r in bootstrap.exact_bootstrap_widths(table, names, 40).collect()}
    drawn = bootstrap.bootstrap_draws(table.select("block_id").distinct(), 40)
    times = F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))
    resampled = table.join(drawn, "block_id").select(F.concat_ws("|", "output", F.col("resample").cast("string")).alias("output"), *designs.role_names(3), times.alias("t"))
    parts = sensitivity.sobol_indices(resampled, names).withColumn("output", F.split("output", r"\|")[0])
    want = parts.groupBy("output", "order", "factor_i", "factor_j").agg((F.lit(1.959963984540054) * F.stddev_samp("value")).alias("conf")).collect()
    for r in want:
        key = (r["output"], r["order"], r["factor_i"], r["factor_j"])
        assert got[key] is None and r["conf"] is None if key[0] == "flat" else got[key] == pytest.approx(r["conf"])


# --- penalty paths


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) * [1, 10, 0.1] + [1e6, 0, 5]  # an offset that raw sums of squares would lose
    y = x[:, 0] * 2 - 2e6 + 0.3 * x[:, 1] + rng.normal(size=400)
    rows = [(*map(float, v), float(t), int(i % 4)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0, 0), (1.0, 1.0, 1.0, None, 0), (1.0, float("nan"), 1.0, 1.0, 1), (1.0, 1.0, 1.0, 1.0, None)], "a double, b double, c double, label double, fold int").repartition(3), x, y


def test_ridge_path_equals_fits_on_rows(scored):
    df, x, y = scored
    scores, fits = fold_sums.penalty_path(df, ["a", "b", "c"], [0.0, 50.0])
    got = {(r["alpha"], r["fold"]): r for r in scores.collect()}
    fold = np.arange(400) % 4
    for alpha in (0.0, 50.0):
        for k in range(4):
            t = fold != k
            a, b = x[t] - x[t].mean(axis=0), y[t] - y[t].mean()
            w = np.linalg.solve(a.T @ a + alpha * np.eye(3), a.T @ b)
            p = y[t].mean() + (x[~t] - x[t].mean(axis=0)) @ w
            assert got[alpha, k]["n"] == 100 and got[alpha, k]["mse"] == pytest.approx(((y[~t] - p) ** 2).mean(), rel=1e-6)
            assert got[alpha, k]["r2"] == pytest.approx(1 - ((y[~t] - p) ** 2).mean() / y[~t].var(), rel=1e-6)
    assert fold_sums.best_penalty(scores) == 0.0


def test_lasso_path_meets_its_conditions_and_sparks_fit(scored):
    df, x, y = scored
    _, fits = fold_sums.penalty_path(df, ["a", "b", "c"], [0.2], "lasso")
    w, intercept = fits[0.2]
    a, b = x - x.mean(axis=0), y - y.mean()
    slope = a.T @ (b - a @ w) / 400
    for j in range(3):
        assert slope[j] == pytest.approx(0.2 * np.sign(w[j]), abs=1e-6) if w[j] else abs(slope[j]) <= 0.2 + 1e-9
    rows = prep.assembler(["a", "b", "c"]).transform(df.dropna().where("NOT isnan(b)"))
    spark_fit = regressors.lasso(0.2).fit(rows)
    assert np.allclose(w, spark_fit.coefficients.toArray(), atol=1e-3)


def test_paths_of_odd_rows(spark):
    kinds = "a double, label double, fold int"
    with pytest.raises(ValueError, match="no complete rows"):
        fold_sums.penalty_path(spark.createDataFrame([(None, 1.0, 0)], kinds), ["a"], [1.0])
    scores, fits = fold_sums.penalty_path(spark.createDataFrame([(1.0, 2.0, 0), (1.0, 4.0, 0)], kinds), ["a"], [1.0])
    assert scores.count() == 0 and fits[1.0][0][0] == 0 and fits[1.0][1] == 3.0
    with pytest.raises(ValueError, match="no penalty"):
        fold_sums.best_penalty(scores)


# --- halving


def test_rungs_and_brackets():
    assert validation.halving_rungs(9, 1 / 9, 3) == [(9, pytest.approx(1 / 9)), (3, pytest.approx(1 / 3)), (1, 1.0)]
    assert validation.halving_rungs(2, 0.5, 2) == [(2, 0.5), (1, 1.0)]
    assert [[n for n, _ in b] for b in validation.hyperband_brackets(9, 3)] == [[9, 3, 1], [3, 1], [1]]


def test_failed_trials_go_out(spark):
    rows = spark.range(300).select("id", F.col("id").cast("double").alias("x"), (2.0 * F.col("id") + F.col("id") % 3).alias("label"), (F.col("id") % 2).cast("int").alias("fold"))

    def line(label, feature):
        if feature == "none":
            raise ValueError("cannot be built")
        return Pipeline(stages=[prep.assembler([feature], "one"), LinearRegression(labelCol=label, featuresCol="one")])

    candidates = [{"feature": "none"}, {"feature": "fold"}, {"feature": "x"}]
    out = validation.successive_halving(rows, "id", line, candidates, [[(3, 0.5), (1, 1.0)]], folds=2).collect()
    assert [(r["rung"], r["candidate"], r["promoted"], r["status"][:6]) for r in out] == [(0, 0, False, "failed"), (0, 1, False, "ok"), (0, 2, True, "ok"), (1, 2, False, "ok")]
    assert out[0]["n_rows"] < out[-1]["n_rows"] == 300
    with pytest.raises(ValueError, match="candidates are needed"):
        validation.successive_halving(rows, "id", line, candidates[:2], [[(3, 0.5), (1, 1.0)]])


# --- bounds and caps


def test_copies_are_bounded_by_bytes(spark):
    from labweave.operators import lookup

    wide = spark.range(40).select(F.repeat(F.lit("x"), 1000).alias("text"))
    assert lookup.bounded_copy(wide, most_bytes=10_000) is None
    assert lookup.bounded_copy(wide, most_bytes=1 << 20).count() == 40
    assert lookup.bounded_copy(wide.limit(0)).count() == 0


def test_more_windows_than_a_literal_list_holds(spark, monkeypatch):
    from labweave.operators import reshape

    rows = [(i, str(i), str(i * i)) for i in range(1, 200)]
    sheet = spark.createDataFrame(rows, "_row bigint, x string, y string")
    windows = [(i % 2, 3 * i, 3 * i + 5) for i in range(1, 60)]
    few = reshape.window_series(sheet, windows, {"y": 1}).collect()
    monkeypatch.setattr(reshape, "MAX_WINDOWS", 3)
    many = reshape.window_series(sheet, windows, {"y": 1}).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, many)) and len(few) > 300


def test_quantiles_of_many_groups(spark, monkeypatch):
    from labweave.operators import quantiles

    rows = spark.range(5000).select((F.col("id") % 37).alias("g"), ((F.col("id") * 7919) % 1000 / 10).alias("v")).unionByName(spark.range(3000).select(F.lit(5).cast("long").alias("g"), F.lit(2.5).alias("v")))
    probabilities = [0.0, 0.1, 0.5, 0.99, 1.0]
    few = sorted(map(tuple, quantiles.group_quantiles(rows, "g", "v", probabilities).collect()))
    monkeypatch.setattr(quantiles, "MAX_GROUPS", 3)
    many = sorted(map(tuple, quantiles.group_quantiles(rows, "g", "v", probabilities).collect()))
    assert len(few) == len(many) == 37 * 5
    assert all(a[:2] == b[:2] and a[3] == b[3] and a[2] == pytest.approx(b[2]) for a, b in zip(few, many))


def test_ranks_over_many_ranges(spark):
    from labweave.operators import quantiles

    rows = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") % 101 * 1.0).alias("v")).unionByName(spark.createDataFrame([(-1, None)], "k bigint, v double"))
    got = quantiles.with_global_rank(rows, "v", "k", steps=13).toPandas().sort_values(["v", "k"])
    assert got["rank"].tolist() == list(range(1, 20_001))
    assert quantiles.with_global_rank(rows.limit(0), "v", "k").count() == 0


def test_few_values_are_exact(spark):
    from labweave.ml.explain import few_values

    rows = spark.range(1000).repartition(7).select((F.col("id") % 4).alias("a"), (F.col("id") % 5).alias("b"), F.when(F.col("id") < 0, 1.0).alias("c"))
    assert few_values(rows, ["a", "b", "c"], 4) == {"a": [0.0, 1.0, 2.0, 3.0]}


def test_several_documents_need_an_order(spark):
    from labweave.operators.chemistry import first_energy

    kind = "results array<struct<adsorption_measurement: struct<adsorbate_species: struct<formula: string>, is_most_stable_site: boolean, adsorption_energy: double, bulk_surface_property_set: struct<bulk_surface_material: struct<name: string>>>>>"
    with pytest.raises(ValueError, match="column doc"):
        first_energy(spark.createDataFrame([([],), ([],)], kind))
    assert first_energy(spark.createDataFrame([([],)], kind)).count() == 0


def test_reasons_of_failures_are_kept(spark):
    from labweave.plans.modelling import run_targets

    def broken(**_):
        raise ValueError("no such model")

    rows = spark.range(60).select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    out = run_targets(rows, ["x"], ["y"], "id", {"broken": broken}).collect()
    assert [(r["status"], r["reason"]) for r in out] == [("failed", "no such model")]


def test_only_hot_keys_are_copied(spark, monkeypatch):
    from labweave.operators import lookup

    monkeypatch.setattr(lookup, "HOT_ROWS", 100)
    facts = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).cast("long").alias("key"))
    side = spark.range(0, 3000, 2).unionByName(spark.createDataFrame([(7,)], "id bigint")).select(F.col("id").alias("_s"), (F.col("id") * 10).alias("value"))
    got = lookup.salted_left_join(facts, side, F.col("key"), "_s").select("id", "key", "value").collect()
    known = {r["_s"]: r["value"] for r in side.collect()}
    assert len(got) == 3000 and all(r["value"] == known.get(r["key"]) for r in got)
    counts = facts.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    assert lookup.hot_keys(counts.where("key is not null"), "key", "n") == [7]


def scattered_runs(spark, n, outputs):
    names = ["x1", "x2", "x3"]
    blocks = spark.range(n).select(F.col("id").alias("block_id"))
    runs = designs.saltelli_blocks(blocks, {c: (-3.0, 3.0) for c in names}, n)
    return names, runs.withColumns({f"y{k}": F.sin("x1") + k * F.sin("x2") * F.col("x3") for k in range(outputs)}).withColumn("flat", F.lit(1.0))


def test_indices_and_widths_straight_from_runs_equal_those_of_the_block_table(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "BUCKET_BLOCKS", 32)
    names, runs = scattered_runs(spark, 300, 2)
    outputs = ["y0", "y1", "flat"]
    table = sensitivity.standardise_blocks(sensitivity.block_table(runs, 3, outputs), 3)
    keyed = lambda rows, c: {(r["output"], r["order"], r["factor_i"], r["factor_j"]): r[c] for r in rows}
    value = keyed(sensitivity.sobol_indices(table, names).collect(), "value")
    conf = keyed(bootstrap.exact_bootstrap_widths(table, names, 20).collect(), "conf")
    # written block by block, and with the runs of a block in many tasks
    for layout in (runs, runs.repartition(5, "role")):
        got = bootstrap.analyse_with_widths(layout, names, outputs, 20).collect()
        for want, column in ((value, "value"), (conf, "conf")):
            found = keyed(got, column)
            assert found.keys() == want.keys()
            assert all(found[k] is None if v is None else found[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_study_passes_on_no_values_of_blocks_that_lie_together(spark):
    """Once, all values of all outputs were shuffled and written by block, more than the disk holds at 25 outputs."""
    names, runs = scattered_runs(spark, 400, 3)
    runs = runs.coalesce(2)
    tagged = []
    plain = type(runs).mapInArrow

    def watched(self, f, schema):
        out = plain(self, f, schema)
        if "_sums" in str(schema):
            tagged.append(out)
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(runs), "mapInArrow", watched)
        sensitivity.analyse_outputs(runs, names, ["y0", "y1", "y2"]).collect()
    assert tagged[0].where("_y is not null").count() == 0 and tagged[0].where("_sums is null").count() == 400


@pytest.mark.parametrize("spoil", [lambda r: r.where("NOT (block_id = 7 AND role = 'A')"), lambda r: r.unionByName(r.where("block_id = 7")), lambda r: r.withColumn("role", F.when((F.col("block_id") == 7) & (F.col("role") == "A"), "other").otherwise(F.col("role")))])
def test_spoilt_blocks_are_an_error_in_the_study(spark, spoil):
    names, runs = scattered_runs(spark, 40, 1)
    with pytest.raises(Exception, match="incomplete or doubled roles in block 7"):
        sensitivity.analyse_outputs(spoil(runs), names, ["y0"]).collect()


def test_searches_and_stacks_read_their_input_once(spark):
    """Once, every fit of a stack and every step before a search made the feature table anew."""
    from labweave.plans.modelling import tune_and_fit

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    def source():
        rows = spark.range(200).selectExpr("id", "CAST(id % 17 AS DOUBLE) AS a", "CAST(id % 5 AS DOUBLE) AS b", "CAST(id % 17 + 0.1 * (id % 5) AS DOUBLE) AS label")
        return rows.mapInArrow(counted, rows.schema)

    data = prep.assembler(["a", "b"]).transform(source().withColumn("fold", (F.col("id") % 3).cast("int")))
    validation.fit_stacking(data, {"one": lambda _: LinearRegression(), "two": lambda _: LinearRegression(regParam=0.1)}, folds=3)
    assert read.value == 200
    tune_and_fit(source(), ["a", "b"], "label", "id", "BR", {"n_trees": (1, 2), "max_depth": (1, 2)}, 1, folds=2)
    assert read.value == 400
