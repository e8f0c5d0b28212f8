"""Queries over the library's own trees and the explanations from their nodes."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from labweave.ml import explain, prep, regressors, shapley
from labweave.ml.foreign import FunctionModel
from labweave.ml.histogram_trees import HistogramTrees, drawn_specs
from labweave.session import local_table
from labweave.suite.common import query, r, sql_hash, table

LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def lines(spark, sf):
    """Line items with four features of few values each, their vector, and the price in thousands."""
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", *[F.col(c).cast("double").alias(c) for c in LINE_FEATURES], (F.col("l_extendedprice") / 1000).alias("label")
    )
    return prep.assembler(LINE_FEATURES).transform(rows)


def first_split_sql(gradient: str, l2: float, features=LINE_FEATURES) -> str:
    """The split of largest gain of the rows ``s``, with the sums to both sides: one row ``f, t, gl, hl, gr, hr, gain``."""
    values = " UNION ALL ".join(f"SELECT {i} AS i, '{f}' AS f, CAST({f} AS DOUBLE) AS v, sum({gradient}) AS g, CAST(count(*) AS DOUBLE) AS h FROM s GROUP BY {f}" for i, f in enumerate(features))
    return f"""
    SELECT i, f, t, gl, hl, gr, hr, gain FROM (
      SELECT *, gl * gl / (hl + {l2}) + gr * gr / (hr + {l2}) - (gl + gr) * (gl + gr) / (hl + hr + {l2}) AS gain FROM (
        SELECT i, f, v AS t, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER p - sum(g) OVER w AS gr, sum(h) OVER p - sum(h) OVER w AS hr FROM ({values})
        WINDOW w AS (PARTITION BY i ORDER BY v), p AS (PARTITION BY i)))
    WHERE hr > 0 ORDER BY gain DESC, i, t LIMIT 1"""


LINES_SQL = "SELECT l_orderkey, l_quantity, l_discount, l_tax, l_linenumber, l_extendedprice / 1000 AS label FROM lineitem"
PRESETS = {"level": (1.0, 0.3), "leaf": (0.0, 0.1), "symmetric": (3.0, 0.03)}


def _stump_sql(name: str, l2: float, rate: float) -> str:
    return f"""SELECT '{name}' AS growth, f AS feature, t AS threshold, round(-gl / (hl + {l2}) * {rate}, 9) + 0.0 AS left_value,
        round(-gr / (hr + {l2}) * {rate}, 9) + 0.0 AS right_value, CAST(hl AS BIGINT) AS left_rows FROM ({first_split_sql('m - label', l2)})"""


@query("m4_first_split", f"WITH s AS (SELECT *, avg(label) OVER () AS m FROM ({LINES_SQL})) " + " UNION ALL ".join(f"SELECT * FROM ({_stump_sql(n, *x)})" for n, x in PRESETS.items()))
def m4_first_split(spark, sf):
    """The split and the leaf values of one tree of depth 1 of each kind: leaves are -G / (H + l2), scaled by the learning rate."""
    rows, found = lines(spark, sf), []
    for growth, (l2, rate) in PRESETS.items():
        tree = HistogramTrees(growth=growth, n_trees=1, max_depth=1, l2=l2, learning_rate=rate).fit(rows).trees[0]
        left, right = tree.left[0], tree.right[0]
        found.append((growth, LINE_FEATURES[tree.feature[0]], float(tree.threshold[0]), float(tree.value[left]), float(tree.value[right]), int(tree.cover[left])))
    out = local_table(spark, found, "growth string, feature string, threshold double, left_value double, right_value double, left_rows bigint")
    return out.withColumns({c: r(c, 9) for c in ("left_value", "right_value")})


def _round_sql(before: str, after: str, residual: str) -> str:
    """One round of boosting stumps as SQL: ``after`` is ``before`` with another residual."""
    return f"""{after}_split AS ({first_split_sql(f'-{residual}', 1.0).replace('FROM s ', f'FROM {before} ')}),
    {after} AS (SELECT b.* EXCLUDE ({residual}), {residual} - 0.3 * CASE WHEN CASE f {' '.join(f"WHEN '{c}' THEN {c}" for c in LINE_FEATURES)} END <= t
        THEN -gl / (hl + 1.0) ELSE -gr / (hr + 1.0) END AS {residual} FROM {before} b, {after}_split)"""


@query(
    "m4_three_rounds",
    f"""WITH s0 AS (SELECT *, label - avg(label) OVER () AS res FROM ({LINES_SQL})), {_round_sql('s0', 's1', 'res')}, {_round_sql('s1', 's2', 'res')}, {_round_sql('s2', 's3', 'res')}
        SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, count(*) AS n, round(avg(label - res), 5) + 0.0 AS prediction, round(avg(res * res), 3) + 0.0 AS mse FROM s3 GROUP BY 1""",
)
def m4_three_rounds(spark, sf):
    """Three stumps, each on what the ones before leave over: mean prediction and squared error by quantity, of all rows."""
    rows = lines(spark, sf)
    scored = HistogramTrees(n_trees=3, max_depth=1, l2=1.0, learning_rate=0.3).fit(rows).transform(rows)
    return scored.groupBy("l_quantity").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("prediction"), 5).alias("prediction"), r(F.avg((F.col("label") - F.col("prediction")) ** 2), 3).alias("mse")
    )


@query(
    "m4_leaf_budget",
    """SELECT growth, leaves AS asked, CAST(t AS INTEGER) AS tree, leaves AS n_leaves, n AS covered FROM (VALUES ('leaf', 5), ('leaf', 16), ('level', 7), ('symmetric', 8)) b(growth, leaves),
       range(2) i(t), (SELECT count(*) AS n FROM lineitem)""",
)
def m4_leaf_budget(spark, sf):
    """Leaves of each tree, and the training rows in them: exactly as many as asked for; a symmetric tree of depth 3 has eight."""
    rows, found = lines(spark, sf), []
    for growth, leaves in (("leaf", 5), ("leaf", 16), ("level", 7), ("symmetric", 8)):
        budget = {"max_depth": 3} if growth == "symmetric" else {"num_leaves": leaves, "max_depth": None}
        for i, tree in enumerate(HistogramTrees(growth=growth, n_trees=2, **budget).fit(rows).trees):
            found.append((growth, leaves, i, tree.n_leaves, int(tree.cover[tree.left < 0].sum())))
    return local_table(spark, found, "growth string, asked int, tree int, n_leaves int, covered bigint")


MASKED = {"n_trees": 6, "max_depth": 1, "bagging": True, "column_fraction": 0.5, "seed": 11}


def _mask_sql() -> str:
    """The first split of every tree among its own features, with all rows at weight one."""
    trees = [
        f"SELECT {i} AS tree, f AS feature, t AS threshold, round(-gl / hl, 9) + 0.0 AS left_value, round(-gr / hr, 9) + 0.0 AS right_value "
        f"FROM ({first_split_sql('-label', 0.0, [LINE_FEATURES[j] for j in spec.features])})"
        for i, spec in enumerate(drawn_specs(MASKED, len(LINE_FEATURES)))
    ]
    return f"WITH s AS ({LINES_SQL}) " + " UNION ALL ".join(f"SELECT * FROM ({t})" for t in trees)


@query("m2_feature_subsets", _mask_sql())
def m2_feature_subsets(spark, sf):
    """Trees grown side by side, each on its own half of the features: first split and leaf means, with all row weights at one."""
    trees = HistogramTrees(**{**MASKED, "row_weights": "all"}).fit(lines(spark, sf)).trees
    n = len(trees)  # an average: values are shares of the tree's own
    found = [(i, LINE_FEATURES[t.feature[0]], float(t.threshold[0]), float(t.value[t.left[0]]) * n, float(t.value[t.right[0]]) * n) for i, t in enumerate(trees)]
    out = local_table(spark, found, "tree int, feature string, threshold double, left_value double, right_value double")
    return out.withColumns({c: r(c, 9) for c in ("left_value", "right_value")})


# --- a target made of two steps, so that a tree of depth 2 is known beforehand

STEP = "CASE WHEN l_quantity <= 25 THEN 2.0 WHEN l_discount <= 0.05 THEN 10.0 ELSE 14.0 END"
STEP_SQL = f"""
d AS (SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS d, CAST({STEP} AS DOUBLE) AS y FROM lineitem),
s AS (SELECT avg(y) AS m, avg(CAST(q <= 25 AS INTEGER)) AS low, avg(y) FILTER (WHERE q > 25) AS high FROM d)"""


def stepped(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", *[F.col(c).cast("double").alias(c) for c in LINE_FEATURES], F.expr(STEP).cast("double").alias("label"))
    return prep.assembler(LINE_FEATURES).transform(rows)


def step_tree(rows):
    return HistogramTrees(n_trees=1, max_depth=2, learning_rate=1.0).fit(rows)


@query("m1_step_target", f"SELECT l_orderkey, {STEP}::DOUBLE AS forest, {STEP}::DOUBLE AS boosted, {STEP}::DOUBLE AS bagged FROM lineitem")
def m1_step_target(spark, sf):
    """A target of three steps, which one tree of depth 2 meets exactly: predictions of a forest, of boosting and of bagging on all rows."""
    rows = stepped(spark, sf)
    forest = regressors.random_forest(n_trees=1, max_depth=2).setMaxBins(64).setPredictionCol("forest").fit(rows)
    boosted = GBTRegressor(maxIter=1, maxDepth=2, maxBins=64, predictionCol="boosted").fit(rows)
    bagged = regressors.bagged_trees(n_trees=3, max_depth=2).setPredictionCol("bagged").fit(rows)
    out = bagged.transform(boosted.transform(forest.transform(rows)))
    return out.select("l_orderkey", *[r(c).alias(c) for c in ("forest", "boosted", "bagged")])


SHAPLEY_SQL = f"""
WITH {STEP_SQL}, v AS (
  SELECT *, CASE WHEN q <= 25 THEN 2.0 ELSE high END AS vq, low * 2.0 + (1 - low) * CASE WHEN d <= 0.05 THEN 10.0 ELSE 14.0 END AS vd FROM d, s)
SELECT l_orderkey, unnest(['l_quantity', 'l_discount', '{explain.BASE}']) AS feature, unnest([q, d, NULL]) AS value,
  round(unnest([((vq - m) + (y - vd)) / 2, ((vd - m) + (y - vq)) / 2, m]), 6) + 0.0 AS contribution FROM v"""


@query("x4_exact_tree_shapley", SHAPLEY_SQL)
def x4_exact(spark, sf):
    """Exact path-dependent Shapley values of a tree with an interaction, on all rows; features without a split have none."""
    rows = stepped(spark, sf)
    parts = shapley.exact_tree_shapley(rows, "l_orderkey", LINE_FEATURES, step_tree(rows))
    return parts.where(F.col("feature").isin("l_quantity", "l_discount", explain.BASE)).withColumn("contribution", r("contribution"))


@query("x4_exact_additivity", "SELECT l_orderkey AS k, 0.0::DOUBLE AS gap FROM lineitem")
def x4_additivity(spark, sf):
    """Exact Shapley values of a deep boosted model, and of Spark's own: contributions and base add up to the prediction of every row.

    The gap is the larger one of the two models.
    """
    rows = lines(spark, sf)
    own = regressors.leafwise_boosting(n_trees=4, num_leaves=12).fit(rows).setPredictionCol("own")
    # Spark's learner stops at a label or feature that is no finite number; such rows are not trained on, but explained like all others
    finite = reduce(and_, [F.abs(c) < float("inf") for c in (*LINE_FEATURES, "label")])
    sparks = regressors.gradient_boosting(n_trees=4, max_depth=5).fit(rows.where(finite)).setPredictionCol("sparks")
    gaps = sparks.transform(own.transform(rows))
    names = [F.col(f"`{c}`") for c in LINE_FEATURES]
    found = []
    for model in (own, sparks):
        total = F.aggregate(shapley.shapley_column(gaps, LINE_FEATURES, model)(*names), F.lit(0.0), lambda a, b: a + b)
        found.append(F.abs(total - F.col(model.getPredictionCol())))
    return gaps.select(F.col("l_orderkey").alias("k"), r(F.greatest(*found)).alias("gap"))


KERNEL_SQL = f"""
WITH b AS (SELECT * FROM orders ORDER BY {sql_hash('o_orderkey', 42)}, o_orderkey LIMIT 30),
s AS (SELECT avg(p) AS p, avg(c) AS c, avg(y) AS y, avg(p * c) AS pc FROM (SELECT o_totalprice * 0.00031415926 AS p, CAST(o_custkey % 7 AS DOUBLE) AS c, CAST(year(o_orderdate) AS DOUBLE) - 1990 AS y FROM b)),
d AS (SELECT o_orderkey, o_totalprice * 0.00031415926 AS op, CAST(o_custkey % 7 AS DOUBLE) AS oc, CAST(year(o_orderdate) AS DOUBLE) - 1990 AS oy FROM orders)
SELECT o_orderkey, unnest(['p', 'c', 'y', '{explain.BASE}']) AS feature,
  round(unnest([(op * c - pc + op * oc - p * oc) / 2, (oc * p - pc + op * oc - op * c) / 2, 3 * (oy - y), pc + 3 * y]), 6) + 0.0 AS contribution FROM d, s"""


@query("x5_kernel_shapley", KERNEL_SQL)
def x5_kernel(spark, sf):
    """A function with an interaction, all coalitions: the weighted regression gives the exact Shapley values of every row."""
    rows = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_totalprice") * 0.00031415926).alias("p"), (F.col("o_custkey") % 7).cast("double").alias("c"), (F.year("o_orderdate") - 1990).cast("double").alias("y")
    )
    box = FunctionModel(["p", "c", "y"], lambda x: x[:, 0] * x[:, 1] + 3 * x[:, 2])
    parts = shapley.kernel_shapley(rows, "o_orderkey", ["p", "c", "y"], box, background=30)
    return parts.select("o_orderkey", "feature", r("contribution").alias("contribution"))


@query(
    "x1_tree_dependence",
    f"""WITH {STEP_SQL} SELECT CAST(5 * i AS DOUBLE) AS l_quantity_grid, CAST(0.01 AS DOUBLE) * j AS l_tax_grid, round(CASE WHEN 5 * i <= 25 THEN 2.0 ELSE high END, 6) + 0.0 AS average
        FROM s, range(11) a(i), range(9) b(j)""",
)
def x1_tree(spark, sf):
    """Dependence by walking the tree: the discount, outside the grid, is followed both ways by its share of the training rows."""
    grid = {"l_quantity": [5.0 * i for i in range(11)], "l_tax": [0.01 * j for j in range(9)]}
    return shapley.tree_partial_dependence(spark, step_tree(stepped(spark, sf)), LINE_FEATURES, grid).withColumn("average", r("average"))
