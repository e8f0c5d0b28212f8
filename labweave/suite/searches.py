"""Queries over penalty paths from fold sums and over searches by successive halving."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from labweave.functions.hashing import MODULUS
from labweave.ml import fold_sums, prep, validation
from labweave.operators.rows import with_fold
from labweave.plans.modelling import run_targets
from labweave.suite.common import query, r, sql_hash
from labweave.suite.models import FOLD_SQL, ORDER_SQL, order_features

ALPHAS = (0.0, 10.0, 10_000.0)


def folded(spark, sf, folds=5):
    return with_fold(order_features(spark, sf), "k", folds)


def path_rows(spark, sf, features, alphas, kind):
    scores, _ = fold_sums.penalty_path(folded(spark, sf), features, alphas, kind)
    return scores.select("alpha", "fold", "n", r("mse", 4).alias("mse"), r("r2").alias("r2"))


SCORED_SQL = """
SELECT f.alpha, d.fold, count(*) AS n, round(avg((label - my - w * (qty - mx) - u * (lines - mz)) ** 2), 4) + 0.0 AS mse,
  round(1 - avg((label - my - w * (qty - mx) - u * (lines - mz)) ** 2) / var_pop(label), 6) + 0.0 AS r2
FROM d JOIN f ON d.fold = f.fold GROUP BY 1, 2"""

ALPHAS_SQL = ", ".join(f"({a}::DOUBLE)" for a in ALPHAS)
TRAIN_SQL = f"""
d AS ({FOLD_SQL}),
s AS (SELECT k.fold, count(*) AS n, avg(qty) AS mx, avg(lines) AS mz, avg(label) AS my, count(*) * var_pop(qty) AS xx, count(*) * var_pop(lines) AS zz,
  count(*) * covar_pop(qty, lines) AS xz, count(*) * covar_pop(qty, label) AS xy, count(*) * covar_pop(lines, label) AS zy FROM d, range(5) k(fold) WHERE d.fold <> k.fold GROUP BY 1)"""


@query(
    "m5_penalty_path",
    f"""WITH {TRAIN_SQL}, f AS (
          SELECT fold, alpha, mx, mz, my, ((zz + alpha) * xy - xz * zy) / ((xx + alpha) * (zz + alpha) - xz * xz) AS w,
                 ((xx + alpha) * zy - xz * xy) / ((xx + alpha) * (zz + alpha) - xz * xz) AS u FROM s, (VALUES {ALPHAS_SQL}) a(alpha))
        {SCORED_SQL}""",
)
def m5_path(spark, sf):
    """Ridge with two features: scores of three penalties on five folds, from one scan. The first is plain least squares."""
    return path_rows(spark, sf, ["qty", "lines"], ALPHAS, "ridge")


LASSO_ALPHAS = (0.0, 5.0, 400.0)


@query(
    "m6_penalty_path",
    f"""WITH {TRAIN_SQL}, f AS (SELECT fold, alpha, mx, 0.0 AS mz, my, sign(xy) * greatest(abs(xy) / n - alpha, 0) / (xx / n) AS w, 0.0 AS u
          FROM s, (VALUES {', '.join(f'({a}::DOUBLE)' for a in LASSO_ALPHAS)}) a(alpha))
        {SCORED_SQL}""",
)
def m6_path(spark, sf):
    """Lasso with one feature, whose solution is a shrunk slope: scores of three penalties on five folds, from one scan."""
    return path_rows(spark, sf, ["qty"], LASSO_ALPHAS, "lasso")


@query(
    "m10_fold_sums",
    f"""WITH {TRAIN_SQL}, f AS (SELECT fold, 0.0 AS alpha, mx, mz, my, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS w, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS u FROM s),
        p AS ({SCORED_SQL}) SELECT round(avg(r2), 5) + 0.0 AS mean_score, round(stddev_pop(r2), 5) + 0.0 AS std_score FROM p""",
)
def m10_sums(spark, sf):
    """Five-fold cross validation of least squares without fitting anything on rows."""
    scores, _ = fold_sums.penalty_path(folded(spark, sf), ["qty", "lines"], [0.0])
    return scores.agg(r(F.avg("r2"), 5).alias("mean_score"), r(F.stddev_pop("r2"), 5).alias("std_score"))


RUNGS = validation.halving_rungs(4, 0.25, 2)
CANDIDATES = [{"feature": c} for c in ("tax", "lines", "late", "qty")]


def _rung_sql(rung: int) -> str:
    """Scores of all candidates on the rung's share of the rows, and which of those still in it go on."""
    n, share = RUNGS[rung]
    keep = RUNGS[rung + 1][0] if rung + 1 < len(RUNGS) else 0
    inside = f"WHERE c IN (SELECT c FROM r{rung - 1} WHERE promoted)" if rung else ""
    long = " UNION ALL ".join(f"SELECT {i} AS c, fold, {x['feature']} AS x, label FROM part{rung}" for i, x in enumerate(CANDIDATES))
    return f"""
    part{rung} AS (SELECT * FROM d WHERE {sql_hash('k', 49)} / {float(MODULUS)} < {share}),
    long{rung} AS ({long}),
    fit{rung} AS (SELECT l.c, k.fold, regr_slope(label, x) AS b1, regr_intercept(label, x) AS b0 FROM long{rung} l, range(3) k(fold) WHERE l.fold <> k.fold GROUP BY 1, 2),
    score{rung} AS (SELECT c, avg(r2) AS m FROM (SELECT l.c, l.fold, 1 - avg((label - b0 - b1 * x) ** 2) / var_pop(label) AS r2 FROM long{rung} l JOIN fit{rung} f ON l.c = f.c AND l.fold = f.fold GROUP BY 1, 2) GROUP BY 1),
    r{rung} AS (SELECT {rung} AS rung, c, (SELECT count(*) FROM part{rung}) AS n_rows, m, row_number() OVER (ORDER BY m DESC, c) <= {keep} AS promoted FROM score{rung} {inside})"""


@query(
    "m9_successive_halving",
    f"""WITH d AS (SELECT *, CAST({sql_hash('k', 43)} % 3 AS INTEGER) AS fold FROM ({ORDER_SQL})), {', '.join(_rung_sql(i) for i in range(len(RUNGS)))}
        SELECT CAST(rung AS INTEGER) AS rung, CAST(c AS INTEGER) AS candidate, n_rows, round(m, 5) + 0.0 AS mean_score, promoted FROM ("""
    + " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(len(RUNGS)))
    + ")",
)
def m9_halving(spark, sf):
    """Four lines on one feature each, scored on a quarter, half and all of the rows; the better half goes on each time."""

    def line(label, feature):
        return Pipeline(stages=[prep.assembler([feature], "one"), LinearRegression(labelCol=label, featuresCol="one")])

    out = validation.successive_halving(folded(spark, sf, 3), "k", line, CANDIDATES, [RUNGS], folds=3)
    return out.select("rung", "candidate", "n_rows", r("mean_score", 5).alias("mean_score"), "promoted")


# --- stacking, random search and runs by target with models whose fits SQL can repeat

LINES = ["qty", "late"]


@query(
    "m7_stacked_lines",
    f"""WITH d AS ({FOLD_SQL}), f AS (
          SELECT k.fold, regr_slope(label, qty) AS s1, regr_intercept(label, qty) AS i1, regr_slope(label, late) AS s2, regr_intercept(label, late) AS i2
          FROM d, range(5) k(fold) WHERE d.fold <> k.fold GROUP BY 1),
        p AS (SELECT i1 + s1 * qty AS p1, i2 + s2 * late AS p2, label FROM d JOIN f ON d.fold = f.fold),
        s AS (SELECT avg(p1) AS m1, avg(p2) AS m2, avg(label) AS my, var_pop(p1) AS a, var_pop(p2) AS b, covar_pop(p1, p2) AS c, covar_pop(p1, label) AS y1, covar_pop(p2, label) AS y2 FROM p),
        w AS (SELECT (b * y1 - c * y2) / (a * b - c * c) AS w1, (a * y2 - c * y1) / (a * b - c * c) AS w2, m1, m2, my FROM s),
        g AS (SELECT regr_slope(label, qty) AS s1, regr_intercept(label, qty) AS i1, regr_slope(label, late) AS s2, regr_intercept(label, late) AS i2 FROM d)
        SELECT k, round(my + w1 * (i1 + s1 * qty - m1) + w2 * (i2 + s2 * late - m2), 3) + 0.0 AS prediction FROM d, w, g""",
)
def m7_lines(spark, sf):
    """Two lines as base learners and a plane on their out-of-fold predictions: the stacked prediction of every row."""
    data = folded(spark, sf)
    for c in LINES:
        data = prep.assembler([c], f"v_{c}").transform(data)
    bases = {c: (lambda _, c=c: LinearRegression(featuresCol=f"v_{c}")) for c in LINES}
    return validation.fit_stacking(data, bases, folds=5).transform(data).select("k", r("prediction", 3).alias("prediction"))


CHOICES = {"feature": ["qty", "lines", "late", "tax", "discount"], "power": [1, 2, 3]}
DRAWN = validation.draw_choices(CHOICES, 6)


def _search_sql() -> str:
    long = " UNION ALL ".join(f"SELECT {i} AS c, fold, pow({x['feature']}, {x['power']}) AS x, label FROM d" for i, x in enumerate(DRAWN))
    return f"""
    WITH d AS ({FOLD_SQL}), l AS ({long}),
    f AS (SELECT l.c, k.fold, regr_slope(label, x) AS b1, regr_intercept(label, x) AS b0 FROM l, range(5) k(fold) WHERE l.fold <> k.fold GROUP BY 1, 2),
    s AS (SELECT l.c, l.fold, 1 - avg((label - b0 - b1 * x) ** 2) / var_pop(label) AS r2 FROM l JOIN f ON l.c = f.c AND l.fold = f.fold GROUP BY 1, 2)
    SELECT CAST(c AS INTEGER) AS trial, round(avg(r2), 5) + 0.0 AS mean_score, round(stddev_pop(r2), 5) + 0.0 AS std_score, 'ok' AS status FROM s GROUP BY 1"""


@query("m8_search_scores", _search_sql())
def m8_scores(spark, sf):
    """Six of fifteen combinations drawn at random, each a line on a power of one feature: mean and deviation of the fold scores."""

    def curve(label, feature, power):
        made = SQLTransformer(statement=f"SELECT *, pow({feature}, {power}) AS _power FROM __THIS__")
        return Pipeline(stages=[made, prep.assembler(["_power"], "one"), LinearRegression(labelCol=label, featuresCol="one")])

    out = validation.search(folded(spark, sf), curve, DRAWN, folds=5)
    return out.select("trial", r("mean_score", 5).alias("mean_score"), r("std_score", 5).alias("std_score"), "status")


TEST = f"{sql_hash('k', 42)} < {int(round(0.2 * MODULUS))}"
TARGETS = {"price": "label", "price_per_line": "label / lines", "late_again": "late"}


@query(
    "m12_lines_by_target",
    "WITH "
    + ", ".join(
        f"""d_{t} AS (SELECT k, qty, {y} AS y, {TEST} AS test FROM ({ORDER_SQL})), f_{t} AS (SELECT regr_slope(y, qty) AS b1, regr_intercept(y, qty) AS b0 FROM d_{t} WHERE NOT test),
        e_{t} AS (SELECT avg((y - b0 - b1 * qty) ** 2) AS mse, var_pop(y) AS v FROM d_{t}, f_{t} WHERE test)"""
        for t, y in TARGETS.items()
    )
    + " "
    + " UNION ALL ".join(
        f"SELECT '{t}' AS target, unnest(['mse', 'rmse', 'r2']) AS metric, round(unnest([mse, sqrt(mse), 1 - mse / v]), 5) + 0.0 AS value FROM e_{t}" for t in TARGETS
    ),
)
def m12_lines(spark, sf):
    """A line for each of three targets, imputing and scaling before it: errors and R2 on the held-out rows."""
    rows = order_features(spark, sf).select("k", "qty", F.col("label").alias("price"), (F.col("label") / F.col("lines")).alias("price_per_line"), F.col("late").alias("late_again"))
    out = run_targets(rows, ["qty"], list(TARGETS), "k", {"line": lambda label: LinearRegression(labelCol=label)})
    return out.select("target", "metric", r("value", 5).alias("value"))
