"""Queries over feature preparation, models and explanations."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from labweave.fixed_values import SEARCH_RANGES
from labweave.functions.hashing import MODULUS
from labweave.ml import explain, prep, regressors, validation
from labweave.ml.imputer import ChainedImputer
from labweave.operators.metrics import score_summary
from labweave.operators.rows import with_fold, with_split
from labweave.plans.modelling import run_targets, select_features, training_rows, tune_and_fit
from labweave.session import shared_dir
from labweave.sources import stores
from labweave.suite.common import query, r, sql_hash, table

FEATURES = ["qty", "discount", "tax", "lines", "late"]

# one row per order: features from its lines, its price as the target
ORDER_SQL = """
SELECT l_orderkey AS k, sum(l_quantity) AS qty, avg(l_discount) AS discount, avg(l_tax) AS tax, CAST(count(*) AS DOUBLE) AS lines,
       CAST(max(l_linenumber) AS DOUBLE) AS late, sum(l_extendedprice) / 1000 AS label FROM lineitem GROUP BY 1"""


def order_features(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.sum("l_quantity").alias("qty"),
        F.avg("l_discount").alias("discount"),
        F.avg("l_tax").alias("tax"),
        F.count(F.lit(1)).cast("double").alias("lines"),
        F.max("l_linenumber").cast("double").alias("late"),
        (F.sum("l_extendedprice") / 1000).alias("label"),
    )


def prepared(spark, sf, folds: int = 3):
    return prep.assembler(FEATURES).transform(with_fold(with_split(order_features(spark, sf), "k"), "k", folds))


@query(
    "g1_chained_imputer",
    "SELECT l_orderkey, l_quantity, l_discount, round(2 * l_quantity + 30 * l_discount, 3) + 0.0 AS mix FROM lineitem",
)
def g1(spark, sf):
    """One column in seven rows is missing and an exact mix of the others, so it must come back."""
    mix = F.when(F.col("l_orderkey") % 7 != 0, 2 * F.col("l_quantity") + 30 * F.col("l_discount"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount", mix.alias("mix"))
    model = ChainedImputer(inputCols=["l_quantity", "l_discount", "mix"]).fit(rows)
    return model.transform(rows).withColumn("mix", r("mix", 3))


@query(
    "g2_population_scaler",
    """SELECT l_orderkey, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) + 0.0 AS l_quantity,
              round((l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER (), 6) + 0.0 AS l_tax, CAST(0.0 AS DOUBLE) AS flat FROM lineitem""",
)
def g2(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_tax", F.lit(3.0).alias("flat"))
    out = prep.PopulationScaler(inputCols=["l_quantity", "l_tax", "flat"]).fit(rows).transform(rows)
    return out.withColumns({c: r(c) for c in ("l_quantity", "l_tax", "flat")})


@query("g3_assembled_vector", "SELECT l_orderkey, l_tax AS f1, l_quantity AS f2, l_discount AS f3, 3 AS size FROM lineitem")
def g3(spark, sf):
    out = prep.assembler(["l_tax", "l_quantity", "l_discount"]).transform(table(spark, sf, "lineitem"))
    v = vector_to_array("features")
    return out.select("l_orderkey", v[0].alias("f1"), v[1].alias("f2"), v[2].alias("f3"), F.size(v).alias("size"))


@query(
    "g4_dummies",
    """SELECT o_orderkey, CAST(o_orderstatus = 'O' AS INTEGER) AS o_orderstatus_O, CAST(o_orderstatus = 'P' AS INTEGER) AS o_orderstatus_P FROM orders""",
)
def g4(spark, sf):
    return prep.with_dummies(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


def held_out_sql(*models: str) -> str:
    """What must hold of models scored on the held-out orders, whatever their trees look like."""
    listed = ", ".join(f"('{m}')" for m in models)
    return f"""
    WITH d AS (SELECT * FROM ({ORDER_SQL}) WHERE {sql_hash('k', 42)} < {int(round(0.2 * MODULUS))})
    SELECT model, count(*) AS n_test, count(*) AS predicted, round(sum(label), 2) + 0.0 AS label_total, true AS beats_mean FROM d, (VALUES {listed}) m(model) GROUP BY 1"""


def held_out_facts(scored):
    """Held-out rows and predictions of each model, and whether its squared error is below that of the mean."""
    finite = F.col("prediction").isNotNull() & ~F.isnan("prediction")
    error = F.avg((F.col("label") - F.col("prediction")) ** 2)
    return scored.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_test"), F.count(F.when(finite, 1)).alias("predicted"), r(F.sum("label"), 2).alias("label_total"),
        (error < F.var_pop("label")).alias("beats_mean"),
    )


def held_out_scores(spark, sf, models):
    """Facts about each model on the test rows, all trained on the same rows."""
    data = prepared(spark, sf)
    train, test = data.filter(~F.col("is_test")).persist(), data.filter("is_test")
    scored = None
    for name, model in models.items():
        one = model.fit(train).transform(test).select(F.lit(name).alias("model"), "label", "prediction")
        scored = one if scored is None else scored.unionByName(one)
    train.unpersist()
    return held_out_facts(scored)


@query("m1_random_forest", held_out_sql("RF"))
def m1(spark, sf):
    return held_out_scores(spark, sf, {"RF": regressors.random_forest(n_trees=10, max_depth=6, min_split=10, min_leaf=2)})


@query("m2_bagged_trees", held_out_sql("BR"))
def m2(spark, sf):
    return held_out_scores(spark, sf, {"BR": regressors.bagged_trees(n_trees=10, max_depth=6, row_fraction=0.8)})


@query("m3_gradient_boosting", held_out_sql("GBDT"))
def m3(spark, sf):
    return held_out_scores(spark, sf, {"GBDT": regressors.gradient_boosting(n_trees=8, max_depth=3, learning_rate=0.2)})


@query("m4_boosting_presets", held_out_sql("XGB", "LGBM", "CB"))
def m4(spark, sf):
    presets = {
        "XGB": regressors.depthwise_boosting(n_trees=5, row_fraction=0.8, column_fraction=0.8),
        "LGBM": regressors.leafwise_boosting(n_trees=5, num_leaves=16),
        "CB": regressors.symmetric_boosting(n_trees=5, max_depth=4),
    }
    return held_out_scores(spark, sf, presets)


RIDGE_SQL = """
WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_discount) AS mz, avg(l_extendedprice) AS my,
                  count(*) * var_pop(l_quantity) + 1000.0 AS xx, count(*) * var_pop(l_discount) + 1000.0 AS zz, count(*) * covar_pop(l_quantity, l_discount) AS xz,
                  count(*) * covar_pop(l_quantity, l_extendedprice) AS xy, count(*) * covar_pop(l_discount, l_extendedprice) AS zy FROM lineitem)
SELECT round((zz * xy - xz * zy) / (xx * zz - xz * xz), 2) + 0.0 AS w_quantity, round((xx * zy - xz * xy) / (xx * zz - xz * xz), 1) + 0.0 AS w_discount,
       round(my - mx * (zz * xy - xz * zy) / (xx * zz - xz * xz) - mz * (xx * zy - xz * xy) / (xx * zz - xz * xz), 1) + 0.0 AS intercept FROM s"""


@query("m5_ridge", RIDGE_SQL)
def m5(spark, sf):
    rows = prep.assembler(["l_quantity", "l_discount"]).transform(table(spark, sf, "lineitem"))
    fitted = regressors.ridge(rows, 1000.0, "l_extendedprice").setLabelCol("l_extendedprice").fit(rows)
    w = [float(c) for c in fitted.coefficients]
    # the fitted numbers come back as a row of the scanned table's own aggregate
    return rows.agg(F.count(F.lit(1)).alias("n")).select(
        r(F.lit(w[0]), 2).alias("w_quantity"), r(F.lit(w[1]), 1).alias("w_discount"), r(F.lit(float(fitted.intercept)), 1).alias("intercept")
    )


LASSO_SQL = """
WITH s AS (SELECT covar_pop(l_quantity, l_extendedprice) AS xy, var_pop(l_quantity) AS xx, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem),
     w AS (SELECT sign(xy) * greatest(abs(xy) - 50.0, 0) / xx AS w, mx, my FROM s)
SELECT l_orderkey, l_quantity, round(my + w * (l_quantity - mx), 2) + 0.0 AS prediction FROM lineitem, w"""


@query("m6_lasso", LASSO_SQL)
def m6(spark, sf):
    rows = prep.assembler(["l_quantity"]).transform(table(spark, sf, "lineitem"))
    fitted = regressors.lasso(50.0, "l_extendedprice").fit(rows)
    return fitted.transform(rows).select("l_orderkey", "l_quantity", r("prediction", 2).alias("prediction"))


@query("m7_stacking", held_out_sql("stack"))
def m7(spark, sf):
    data = prepared(spark, sf, 5)
    train, test = data.filter(~F.col("is_test")).persist(), data.filter("is_test")
    bases = {
        "rf": lambda _: regressors.random_forest(n_trees=5, max_depth=5),
        "gb": lambda _: regressors.gradient_boosting(n_trees=4, max_depth=3),
    }
    stack = validation.fit_stacking(train, bases, folds=5)
    train.unpersist()
    return held_out_facts(stack.transform(test).withColumn("model", F.lit("stack")))


def trial_facts(results, allowed):
    """Of each trial: how it ended, whether it beats the mean, and whether its parameters are among the ``allowed`` (name to rule)."""
    fits = reduce(lambda a, b: a & b, (rule(F.col("params")[name]) for name, rule in allowed.items()))
    return results.select("trial", "status", (F.col("mean_score") > 0).alias("beats_mean"), F.size("params").alias("n_params"), fits.alias("allowed"))


def trial_sql(n: int, params: int) -> str:
    return f"SELECT CAST(i AS INTEGER) AS trial, 'ok' AS status, true AS beats_mean, {params} AS n_params, true AS allowed FROM range({n}) t(i) WHERE (SELECT count(*) FROM lineitem) > 0"


@query("m8_random_search", trial_sql(3, 4))
def m8(spark, sf):
    choices = {"n_trees": [4, 8], "max_depth": [3, 5, None], "min_split": [2, 10], "min_leaf": [1, 4]}
    listed = {name: (lambda c, values=values: c.isin(*map(str, values))) for name, values in choices.items()}
    results = validation.search(prepared(spark, sf, 5), regressors.random_forest, validation.draw_choices(choices, 3), folds=5)
    return trial_facts(results, listed)


@query("m9_range_search", f"SELECT *, 'cv' AS score_on FROM ({trial_sql(2, 4)}) UNION ALL SELECT *, 'train' FROM ({trial_sql(1, 4)})")
def m9(spark, sf):
    ranges = {"n_trees": (2, 5), "learning_rate": (0.01, 0.3, "log"), "max_depth": (2, 4), "row_fraction": (0.5, 1.0)}
    inside = {name: (lambda c, low=low, high=high: c.cast("double").between(low, high)) for name, (low, high, *_) in ranges.items()}
    cv = validation.search(prepared(spark, sf, 5), regressors.gradient_boosting, validation.draw_ranges(ranges, 2), folds=5)
    train = validation.search(prepared(spark, sf), regressors.gradient_boosting, validation.draw_ranges(ranges, 1), score_on="train")
    return trial_facts(cv, inside).withColumn("score_on", F.lit("cv")).unionByName(trial_facts(train, inside).withColumn("score_on", F.lit("train")))


FOLD_SQL = f"SELECT *, CAST({sql_hash('k', 43)} % 5 AS INTEGER) AS fold FROM ({ORDER_SQL})"
FOLD_FIT_SQL = f"""
WITH d AS ({FOLD_SQL}), f AS (SELECT k.fold, regr_slope(label, qty) AS b1, regr_intercept(label, qty) AS b0 FROM d, range(5) k(fold) WHERE d.fold <> k.fold GROUP BY 1),
     p AS (SELECT d.fold, label, b0 + b1 * qty AS prediction FROM d JOIN f ON d.fold = f.fold)"""


def line_fit(_):
    return Pipeline(stages=[prep.assembler(["qty"]), LinearRegression()])


@query(
    "m10_cross_validation",
    FOLD_FIT_SQL
    + """SELECT round(avg(r2), 6) + 0.0 AS mean_score, round(stddev_pop(r2), 6) + 0.0 AS std_score FROM (
         SELECT fold, 1 - avg((label - prediction) ** 2) / var_pop(label) AS r2 FROM p GROUP BY 1)""",
)
def m10(spark, sf):
    data = with_fold(order_features(spark, sf), "k")
    out = score_summary(validation.cross_validate(data, line_fit))
    return out.select(r("mean_score").alias("mean_score"), r("std_score").alias("std_score"))


def ranking_facts(ranking, told):
    """Of each feature: that it has a rank, and whether it is among the selected; null for a feature that the target does not ``tell`` on."""
    return ranking.select(
        "feature", (F.col("rank").isNotNull() & (F.col("selected") == (F.col("rank") == 1))).alias("ranked"),
        F.when(F.col("feature").isin(*told), F.col("selected")).alias("selected"),
    )


def ranking_sql(*told: str) -> str:
    rows = ", ".join(f"('{f}', true, {'true' if f in told else 'NULL::BOOLEAN'})" for f in FEATURES)
    return f"SELECT * FROM (VALUES {rows}) v(feature, ranked, selected) WHERE (SELECT count(*) FROM lineitem) > 0"


@query(
    "m11_feature_elimination",
    f"""SELECT 'ranking' AS part, * FROM ({ranking_sql('qty')}) UNION ALL
        SELECT 'curve', 'n=' || n, true, n >= 3 FROM range(1, {len(FEATURES) + 1}) t(n)""",
)
def m11(spark, sf):
    """The target hangs on one feature alone, so that one must be selected; sizes from three on are scored, and beat the mean."""
    data = with_fold(order_features(spark, sf).withColumn("label", 3 * F.col("qty")), "k", 5)
    ranking, curve = validation.eliminate_features(
        data, FEATURES, lambda _: regressors.random_forest(n_trees=4, max_depth=4), folds=5, min_features=3
    )
    sizes = curve.select(
        F.lit("curve").alias("part"), F.format_string("n=%d", "n_features").alias("feature"), F.lit(True).alias("ranked"),
        F.coalesce(F.col("r2") > 0, F.lit(False)).alias("selected"),
    )
    return ranking_facts(ranking, ["qty"]).withColumn("part", F.lit("ranking")).unionByName(sizes)


@query(
    "m12_models_by_target",
    """SELECT target, model, metric, status, CASE WHEN metric <> 'r2' OR target = 'price' THEN true END AS holds, NULL AS reason FROM (VALUES ('price'), ('price_per_line')) t(target),
              (VALUES ('RF', 'ok'), ('GBDT', 'ok')) m(model, status), (VALUES ('mse'), ('rmse'), ('r2')) s(metric)
       UNION ALL SELECT target, 'broken', NULL, 'failed', NULL, 'this model cannot be built' FROM (VALUES ('price'), ('price_per_line')) t(target)""",
)
def m12(spark, sf):
    """Two models and one that cannot be built, on two targets: errors are positive, and so is R2 for the price.

    The price per line hardly hangs on these features, so nothing is said of its R2.
    """
    rows = order_features(spark, sf).withColumn("price_per_line", F.col("label") / F.col("lines")).withColumnRenamed("label", "price")

    def broken(**_):
        raise ValueError("this model cannot be built")

    models = {"RF": regressors.random_forest, "GBDT": regressors.gradient_boosting, "broken": broken}
    small = {"RF": {"n_trees": 4, "max_depth": 4}, "GBDT": {"n_trees": 3}}
    out = run_targets(rows, FEATURES, ["price", "price_per_line"], "k", models, small)
    return out.select("target", "model", "metric", "status", F.when((F.col("metric") != "r2") | (F.col("target") == "price"), F.col("value") > 0).alias("holds"), "reason")


@query("plan_select_features", f"SELECT feature, ranked, selected, n FROM ({ranking_sql('qty')}), (SELECT count(*) AS n FROM ({ORDER_SQL}) WHERE {sql_hash('k', 42)} >= {int(round(0.2 * MODULUS))})")
def plan_select_features(spark, sf):
    """Elimination with imputing and scaling before it, on the training rows of a target that hangs on one feature; ``n`` counts them."""
    rows = order_features(spark, sf).withColumn("triple", 3 * F.col("qty"))
    ranking, _ = select_features(rows, FEATURES, "triple", "k", "RF", params={"n_trees": 4, "max_depth": 4}, min_features=3)
    n = training_rows(rows, FEATURES, "triple", "k").filter("NOT is_test").count()
    return ranking_facts(ranking, ["qty"]).withColumn("n", F.lit(n))


@query("plan_tune_and_fit", f"SELECT h.*, 2 AS ok_trials, true AS allowed FROM ({held_out_sql('tuned BR')}) h")
def plan_tune_and_fit(spark, sf):
    """Two trials over the ranges of bagged trees, with fewer trees than a study takes; the best one is fitted again and scored."""
    ranges = {**SEARCH_RANGES["BR"], "n_trees": (4, 8)}
    inside = {name: (lambda c, low=low, high=high: c.cast("double").between(low, high)) for name, (low, high, *_) in ranges.items()}
    rows = order_features(spark, sf).withColumnRenamed("label", "price")
    model, trials = tune_and_fit(rows, FEATURES, "price", "k", "BR", ranges, 2)
    ended = trial_facts(trials, inside).agg(F.count_if(F.col("status") == "ok").cast("int").alias("ok_trials"), F.bool_and("allowed").alias("allowed")).first()
    test = training_rows(rows, FEATURES, "price", "k").filter("is_test")
    facts = held_out_facts(model.transform(test).withColumn("model", F.lit("tuned BR")))
    return facts.withColumns({"ok_trials": F.lit(ended.ok_trials), "allowed": F.lit(ended.allowed)})


@query(
    "m13_batch_scoring",
    f"""WITH d AS ({ORDER_SQL}) SELECT k, round(b0 + b1 * qty, 4) + 0.0 AS prediction FROM d,
        (SELECT regr_slope(label, qty) AS b1, regr_intercept(label, qty) AS b0 FROM d) f""",
)
def m13(spark, sf):
    """Imputing and scaling travel with the saved model; for a linear model they cancel out."""
    rows = order_features(spark, sf)
    steps = prep.preprocessing(["qty"]).getStages()
    root = shared_dir(spark)
    stores.save_model(Pipeline(stages=[*steps, LinearRegression()]).fit(rows), root, "price", "scaled OLS")
    return stores.load_model(root, "price", "scaled OLS").transform(rows).select("k", r("prediction", 4).alias("prediction"))


# a model with an interaction, as plain SQL
BLACK_BOX = "SELECT *, 2 * l_quantity + 317.31415926 * l_discount * l_tax AS prediction FROM __THIS__"
BOX_FEATURES = ["l_quantity", "l_discount", "l_tax"]

PDP_SQL = """
WITH e AS (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_discount) AS d0, max(l_discount) AS d1, avg(l_tax) AS t FROM lineitem)
SELECT round(q0 + i * (q1 - q0) / 9, 6) + 0.0 AS l_quantity_grid, round(d0 + j * (d1 - d0) / 9, 6) + 0.0 AS l_discount_grid,
       round(2 * (q0 + i * (q1 - q0) / 9) + 317.31415926 * (d0 + j * (d1 - d0) / 9) * t, 6) + 0.0 AS average FROM e, range(10) a(i), range(10) b(j)"""


@query("x1_partial_dependence", PDP_SQL)
def x1(spark, sf):
    rows = table(spark, sf, "lineitem").select(*BOX_FEATURES)
    out = explain.partial_dependence(rows, SQLTransformer(statement=BLACK_BOX), explain.linear_grid(rows, BOX_FEATURES[:2], 10))
    return out.select(*[r(c).alias(c) for c in out.columns])


PDQ_SQL = """
WITH e AS (SELECT quantile_cont(l_quantity, 0.05) AS q0, quantile_cont(l_quantity, 0.95) AS q1, quantile_cont(l_discount, 0.05) AS d0,
                  quantile_cont(l_discount, 0.95) AS d1, avg(l_tax) AS t FROM lineitem)
SELECT round(q0 + i * (q1 - q0) / 4, 6) + 0.0 AS l_quantity_grid, round(d0 + j * (d1 - d0) / 4, 6) + 0.0 AS l_discount_grid,
       round(2 * (q0 + i * (q1 - q0) / 4) + 317.31415926 * (d0 + j * (d1 - d0) / 4) * t, 6) + 0.0 AS average FROM e, range(5) a(i), range(5) b(j)"""


@query("x2_quantile_partial_dependence", PDQ_SQL)
def x2(spark, sf):
    rows = table(spark, sf, "lineitem").select(*BOX_FEATURES)
    out = explain.partial_dependence(rows, SQLTransformer(statement=BLACK_BOX), explain.quantile_grid(rows, BOX_FEATURES[:2], 5))
    return out.select(*[r(c).alias(c) for c in out.columns])


OLS2_SQL = f"""
d AS ({ORDER_SQL}),
s AS (SELECT avg(qty) AS mx, avg(lines) AS mz, var_pop(qty) AS xx, var_pop(lines) AS zz, covar_pop(qty, lines) AS xz, covar_pop(qty, label) AS xy, covar_pop(lines, label) AS zy FROM d),
c AS (SELECT k, 'qty' AS feature, qty AS value, (zz * xy - xz * zy) / (xx * zz - xz * xz) * (qty - mx) AS contribution FROM d, s
      UNION ALL SELECT k, 'lines', lines, (xx * zy - xz * xy) / (xx * zz - xz * xz) * (lines - mz) FROM d, s)"""


def linear_parts(spark, sf):
    rows = order_features(spark, sf)
    fitted = Pipeline(stages=[prep.assembler(["qty", "lines"]), LinearRegression()]).fit(rows)
    return explain.linear_shapley(rows, "k", ["qty", "lines"], fitted.stages[-1])


@query("x3_linear_shapley", f"WITH {OLS2_SQL} SELECT k, feature, value, round(contribution, 4) + 0.0 AS contribution FROM c")
def x3(spark, sf):
    return linear_parts(spark, sf).withColumn("contribution", r("contribution", 4))


def additivity_gap(parts, scored):
    sums = parts.groupBy("k").agg(F.sum("contribution").alias("total"))
    gap = r(F.abs(F.col("total") - F.col("prediction"))).alias("gap")
    return sums.join(scored.select("k", "prediction"), "k").select("k", gap)


@query("x4_tree_contributions", f"SELECT k, 0.0::DOUBLE AS gap FROM ({ORDER_SQL})")
def x4(spark, sf):
    """Contributions and base must add up to the prediction of every row."""
    data = prepared(spark, sf)
    fitted = regressors.gradient_boosting(n_trees=5, max_depth=3).fit(data)
    return additivity_gap(explain.tree_contributions(data, "k", FEATURES, fitted), fitted.transform(data))


@query("x5_sampled_shapley", f"SELECT k, 0.0::DOUBLE AS gap FROM ({ORDER_SQL})")
def x5(spark, sf):
    rows = order_features(spark, sf)
    box = SQLTransformer(statement="SELECT *, qty * discount + lines * tax + late AS prediction FROM __THIS__")
    parts = explain.sampled_shapley(rows, "k", FEATURES, box, permutations=3, background=20)
    return additivity_gap(parts, box.transform(rows))


@query(
    "x6_contribution_tables",
    f"""WITH {OLS2_SQL} SELECT feature, round(avg(contribution), 4) + 0.0 AS mean_contribution, round(avg(abs(contribution)), 4) + 0.0 AS mean_abs,
        round(min(contribution), 4) + 0.0 AS lowest, round(max(contribution), 4) + 0.0 AS highest FROM c GROUP BY 1""",
)
def x6(spark, sf):
    out = explain.contribution_summary(linear_parts(spark, sf))
    return out.select("feature", *[r(c, 4).alias(c) for c in out.columns[1:]])


@query(
    "x6_contribution_matrix",
    f"""WITH {OLS2_SQL} SELECT k, round(max(CASE WHEN feature = 'qty' THEN contribution END), 4) + 0.0 AS shap_qty,
        round(max(CASE WHEN feature = 'lines' THEN contribution END), 4) + 0.0 AS shap_lines FROM c GROUP BY 1""",
)
def x6_matrix(spark, sf):
    out = explain.contribution_matrix(linear_parts(spark, sf), "k", ["qty", "lines"])
    return out.select("k", r("shap_qty", 4).alias("shap_qty"), r("shap_lines", 4).alias("shap_lines"))


@query(
    "a9_ranked_importance",
    f"WITH {OLS2_SQL} SELECT feature, round(avg(abs(contribution)), 4) + 0.0 AS mean_abs FROM c GROUP BY 1 ORDER BY 2 DESC LIMIT 10",
)
def a9(spark, sf):
    return explain.ranked_importance(linear_parts(spark, sf), 10).withColumn("mean_abs", r("mean_abs", 4))


@query("y2_importance_callback", ranking_sql("qty", "late"))
def y2(spark, sf):
    """Elimination driven by a caller's importance rule: the coefficients of a linear model, on a target made of two features."""
    data = with_fold(order_features(spark, sf).withColumn("label", 2 * F.col("qty") - 3 * F.col("late")), "k", 5)
    weigh = lambda model: abs(model.coefficients.toArray())
    ranking, _ = validation.eliminate_features(data, FEATURES, lambda _: LinearRegression(), folds=5, min_features=2, importance=weigh)
    return ranking_facts(ranking, ["qty", "late"])


@query(
    "y3_predict_callback",
    """SELECT CAST(10 * i AS DOUBLE) AS qty_grid, CAST(j AS DOUBLE) AS lines_grid, round(avg(greatest(10.0 * i, late) + j * tax), 6) + 0.0 AS average
       FROM (SELECT l_orderkey, max(CAST(l_linenumber AS DOUBLE)) AS late, avg(l_tax) AS tax FROM lineitem GROUP BY 1), range(3) a(i), range(3) b(j) GROUP BY 1, 2""",
)
def y3(spark, sf):
    """Any black-box predictor that Spark can run: here one given as SQL."""
    box = SQLTransformer(statement="SELECT *, greatest(qty, late) + lines * tax AS prediction FROM __THIS__")
    rows = order_features(spark, sf).select("k", "qty", "lines", "late", "tax")
    out = explain.partial_dependence(rows, box, {"qty": [0.0, 10.0, 20.0], "lines": [0.0, 1.0, 2.0]})
    return out.select(*[r(c).alias(c) for c in out.columns])


@query("y4_objective_callback", FOLD_FIT_SQL + "SELECT fold, round(avg(abs(label - prediction)), 4) + 0.0 AS mae FROM p GROUP BY 1")
def y4(spark, sf):
    """A caller's score instead of R2: the mean absolute error per fold."""
    data = with_fold(order_features(spark, sf), "k")
    mae = lambda p: p.groupBy("fold").agg(r(F.avg(F.abs(F.col("label") - F.col("prediction"))), 4).alias("mae"))
    return validation.cross_validate(data, line_fit, score=mae)
