import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

import labweave.ml.imputer as imputer_module
from labweave.ml import explain, prep, regressors, validation
from labweave.ml.imputer import ChainedImputer, bayesian_ridge
from labweave.operators import designs, sensitivity
from labweave.operators.rows import with_fold
from labweave.session import local_table


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 4))
    x[:, 3] = 0.5 * x[:, 0] - x[:, 1] + 0.05 * rng.normal(size=400)
    y = 3 * x[:, 0] + x[:, 1] ** 2 + 0.1 * rng.normal(size=400)
    df = local_table(spark, [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, label double")
    return df.persist(), x, y


FEATURES = ["a", "b", "c", "d"]


def chained_by_rows(x, rounds, tol=1e-3):
    """Plain row-wise chained regressions, independent of the pattern algebra."""
    missing = np.isnan(x)
    filled = np.where(missing, np.nanmean(x, axis=0), x)
    order = [j for j in np.argsort(missing.sum(axis=0), kind="stable") if missing[:, j].any()]
    limit = tol * np.nanmax(np.abs(x))
    for _ in range(rounds):
        before = filled.copy()
        for j in order:
            seen, others = ~missing[:, j], [k for k in range(x.shape[1]) if k != j]
            a, t = filled[np.ix_(seen, others)], filled[seen, j]
            ac, tc = a - a.mean(axis=0), t - t.mean()
            w = bayesian_ridge(ac.T @ ac, ac.T @ tc, float(tc @ tc), len(t))
            filled[~seen, j] = t.mean() + (filled[np.ix_(~seen, others)] - a.mean(axis=0)) @ w
        if np.abs(filled - before).sum(axis=1).max() < limit:
            break
    return filled


def with_gaps(x):
    rng = np.random.default_rng(3)
    y = x.copy()
    for j, share in ((0, 0.1), (1, 0.2), (3, 0.3)):
        y[rng.random(len(y)) < share, j] = np.nan
    return y


def gap_frame(spark, x):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return local_table(spark, rows, "id long, a double, b double, c double, d double")


def test_imputer_equals_row_wise_regressions(spark, numbers):
    x = with_gaps(numbers[1])
    df = gap_frame(spark, x)
    out = ChainedImputer(inputCols=FEATURES).fit(df).transform(df).orderBy("id").toPandas()[FEATURES].to_numpy()
    assert np.allclose(out, chained_by_rows(x, 10), atol=1e-8)
    assert np.array_equal(out[~np.isnan(x)], x[~np.isnan(x)])


def test_imputer_with_many_patterns_takes_scans(spark, numbers, monkeypatch):
    df = gap_frame(spark, with_gaps(numbers[1]))
    quick = ChainedImputer(inputCols=FEATURES, maxIter=2).fit(df)
    monkeypatch.setattr(imputer_module, "MAX_PATTERNS", 1)
    slow = ChainedImputer(inputCols=FEATURES, maxIter=2).fit(df)
    assert len(quick.steps()) == len(slow.steps())
    for a, b in zip(quick.steps(), slow.steps()):
        assert a[0] == b[0] and np.allclose([a[1], *a[2]], [b[1], *b[2]], atol=1e-9)


def test_single_column_is_the_mean(spark):
    df = local_table(spark, [(1.0,), (3.0,), (None,)], "a double")
    assert sorted(r.a for r in ChainedImputer(inputCols=["a"]).fit(df).transform(df).collect()) == [1.0, 2.0, 3.0]


def test_preprocessing_survives_saving(spark, numbers, tmp_path):
    df = gap_frame(spark, with_gaps(numbers[1]))
    fitted = prep.preprocessing(FEATURES).fit(df)
    fitted.write().overwrite().save(str(tmp_path / "prep"))
    from pyspark.ml import PipelineModel

    again = PipelineModel.load(str(tmp_path / "prep"))
    key = lambda m: [tuple(r.features) for r in m.transform(df).orderBy("id").collect()]
    assert key(fitted) == key(again)


def test_ridge_solves_the_normal_equations(spark, numbers):
    df, x, y = numbers
    rows = prep.assembler(FEATURES).transform(df)
    got = regressors.ridge(rows, 10.0).fit(rows).coefficients.toArray()
    xc, yc = x - x.mean(axis=0), y - y.mean()
    assert np.allclose(got, np.linalg.solve(xc.T @ xc + 10 * np.eye(4), xc.T @ yc), rtol=1e-5)


@pytest.mark.parametrize("build", [regressors.random_forest, regressors.gradient_boosting])
def test_tree_contributions_add_up(spark, numbers, build):
    rows = prep.assembler(FEATURES).transform(numbers[0])
    model = build(n_trees=5, max_depth=4).fit(rows)
    parts = explain.tree_contributions(rows, "id", FEATURES, model).groupBy("id").agg(F.sum("contribution").alias("s"))
    gap = parts.join(model.transform(rows).select("id", "prediction"), "id").agg(F.max(F.abs(F.col("s") - F.col("prediction")))).first()[0]
    assert gap < 1e-9


def test_sampled_shapley_of_a_linear_model(spark, numbers):
    df = numbers[0]
    model = Pipeline(stages=[prep.assembler(FEATURES), LinearRegression()]).fit(df)
    w = model.stages[-1].coefficients
    parts = explain.sampled_shapley(df, "id", FEATURES, model, permutations=40, background=50)
    wide = {(r.id, r.feature): r.contribution for r in parts.collect()}
    rows = {r.id: r for r in model.transform(df).collect()}
    for i in range(0, 400, 97):
        assert sum(wide[i, c] for c in [*FEATURES, explain.BASE]) == pytest.approx(rows[i].prediction)
    # against the mean of its background the contribution is coef * (x - background mean)
    big = np.array([[wide[i, c] for c in FEATURES] for i in range(400)])
    x = np.array([[rows[i][c] for c in FEATURES] for i in range(400)])
    for j in range(4):
        assert np.corrcoef(big[:, j], w[j] * x[:, j])[0, 1] > 0.95 or abs(w[j]) < 0.1


def test_elimination_keeps_the_signal(spark, numbers):
    df = with_fold(numbers[0], "id", 3)
    ranking, curve = validation.eliminate_features(df, FEATURES, lambda _: regressors.random_forest(n_trees=8, max_depth=5), folds=3, min_features=2)
    got = {r.feature: r["rank"] for r in ranking.collect()}
    assert set(got) == set(FEATURES) and got["a"] == 1 and got["b"] == 1
    selected = ranking.filter("selected").count()
    assert sorted(v for v in got.values() if v > 1) == list(range(2, 4 - selected + 2))
    sizes = {r.n_features: r.r2 for r in curve.collect()}
    assert sizes[1] is None and all(sizes[n] is not None for n in (2, 3, 4))


def test_elimination_fits_no_fold_and_features_twice(spark, numbers):
    df, fitted = with_fold(numbers[0], "id", 3), []

    def build(train):
        fitted.append(train)
        return regressors.random_forest(n_trees=4, max_depth=4)

    _, curve = validation.eliminate_features(df, FEATURES, build, folds=3, min_features=3)
    # paths of two sizes on three folds and one on all rows; the curve adds what a path left out, here at most the smaller size
    assert len(fitted) <= 3 * 2 + 2 + 3
    whole = Pipeline(stages=[prep.assembler(FEATURES), regressors.random_forest(n_trees=4, max_depth=4)])
    want = validation.cross_validate(df, lambda _: whole, 3).agg(F.avg("r2"), F.avg("rmse")).first()
    got = {r.n_features: r for r in curve.collect()}[len(FEATURES)]
    assert (got.r2, got.rmse) == pytest.approx(tuple(want))


def test_search_keeps_failed_trials(spark, numbers):
    df = prep.assembler(FEATURES).transform(with_fold(numbers[0], "id", 2))
    got = validation.search(df, regressors.gradient_boosting, [{"n_trees": 3}, {"n_trees": -1}], folds=2).orderBy("trial").collect()
    assert got[0].status == "ok" and got[0].mean_score > 0 and got[1].status.startswith("failed") and got[1].mean_score is None
    assert validation.best_candidate(validation.search(df, regressors.gradient_boosting, [{"n_trees": 2}], folds=2), [{"n_trees": 2}]) == {"n_trees": 2}


def test_forests_of_a_search_grow_side_by_side(spark, numbers, monkeypatch):
    """No fit of its own for any trial and fold, and scores like those of Spark's forests; rows with nulls still take the fits."""
    df = prep.assembler(FEATURES).transform(with_fold(numbers[0], "id", 3)).persist()
    trials = [{"n_trees": 8, "max_depth": 5, "min_leaf": 4}, {"n_trees": 1, "max_depth": 3}, {"n_trees": 6, "max_depth": 1, "row_fraction": 0.5}]
    want = [validation.cross_validate(df, lambda _: regressors.random_forest(**t), 3).agg(F.avg("r2")).first()[0] for t in trials]
    fits, fit = [], RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, *given: fits.append(1) or fit(self, *given))
    got = validation.search(df, regressors.random_forest, trials, folds=3).orderBy("trial").collect()
    assert not fits and [r.status for r in got] == ["ok"] * 3 and all(r.std_score >= 0 for r in got)
    assert [r.mean_score for r in got] == pytest.approx(want, abs=0.06)
    gaps = df.withColumn("label", F.when(F.col("id") % 7 > 0, F.col("label")))
    validation.search(gaps, regressors.random_forest, trials[1:2], folds=3)
    assert fits
    torn = prep.assembler(FEATURES).transform(with_fold(numbers[0].withColumn("a", F.when(F.col("id") != 5, F.col("a"))), "id", 3))
    (one,) = validation.search(torn, regressors.random_forest, trials[1:2], folds=3).collect()
    assert one.status.startswith("failed") and one.mean_score is None


def test_draws():
    many = validation.draw_choices({"a": [1, 2, 3], "b": ["x", None]}, 100)
    assert len(many) == 6 and len({tuple(p.items()) for p in many}) == 6
    points = validation.draw_ranges({"n": (2, 5), "rate": (0.001, 0.1, "log"), "f": (0.5, 1.0)}, 64)
    assert {p["n"] for p in points} == {2, 3, 4, 5}
    rates = np.log10([p["rate"] for p in points])
    assert rates.min() >= -3 and rates.max() <= -1 and abs(rates.mean() + 2) < 0.05


def test_stacking_beats_its_worst_base(spark, numbers):
    df = prep.assembler(FEATURES).transform(with_fold(numbers[0], "id", 3))
    bases = {"rf": lambda _: regressors.random_forest(n_trees=5, max_depth=3), "lin": lambda _: LinearRegression()}
    model = validation.fit_stacking(df, bases, folds=3)
    from labweave.operators.metrics import regression_metrics

    stack = regression_metrics(model.transform(df), "label", "prediction").first().r2
    line = regression_metrics(LinearRegression().fit(df).transform(df), "label", "prediction").first().r2
    assert stack > line


def test_ishigami(spark):
    bounds = {n: (-np.pi, np.pi) for n in ("x1", "x2", "x3")}
    x1, x2, x3 = (F.col(n) for n in bounds)
    runs = designs.saltelli_design(spark, bounds, 4096).withColumn("y", F.sin(x1) + 7 * F.sin(x2) ** 2 + 0.1 * x3**4 * F.sin(x1)).withColumn("flat", F.lit(1.0))
    got = {(r.output, r.order, r.factor_i, r.factor_j): (r.value, r.conf) for r in sensitivity.analyse_outputs(runs, list(bounds), ["y", "flat"], 50).collect()}
    want = {("S1", "x1", None): 0.314, ("S1", "x2", None): 0.442, ("S1", "x3", None): 0.0, ("ST", "x1", None): 0.558,
            ("ST", "x2", None): 0.442, ("ST", "x3", None): 0.244, ("S2", "x1", "x3"): 0.244, ("S2", "x1", "x2"): 0.0}
    for key, value in want.items():
        assert got[("y", *key)][0] == pytest.approx(value, abs=0.01)
        assert 0 < got[("y", *key)][1] < 0.1
    assert all(v[0] is None for k, v in got.items() if k[0] == "flat")
    for n in bounds:
        assert got["y", "ST", n, None][0] >= got["y", "S1", n, None][0] - got["y", "S1", n, None][1]


def test_foreign_model_in_partial_dependence(spark, numbers):
    from labweave.ml.foreign import FunctionModel

    model = FunctionModel(FEATURES, lambda m: m[:, 0] * 2 + m[:, 1] * m[:, 2])
    grid = {"a": [0.0, 1.0], "b": [0.0, 2.0]}
    got = {(r.a_grid, r.b_grid): r.average for r in explain.partial_dependence(numbers[0], model, grid).collect()}
    mean_c = numbers[1][:, 2].mean()
    assert got[1.0, 2.0] == pytest.approx(2 + 2 * mean_c) and got[0.0, 0.0] == pytest.approx(0.0)


def test_quantile_grid_lists_few_values(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("double").alias("few"), F.col("id").cast("double").alias("many"))
    grid = explain.quantile_grid(df, ["few", "many"], 5)
    assert grid["few"] == [0.0, 1.0, 2.0] and grid["many"] == pytest.approx(np.linspace(49.95, 949.05, 5).tolist())
