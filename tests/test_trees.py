"""Own tree learners, exact and kernel Shapley values against plain recursions."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import functions as F

from labweave.ml import explain, histogram_trees, prep, regressors, shapley
from labweave.ml.foreign import FunctionModel
from labweave.ml.histogram_trees import HistogramTrees, drawn_specs, poisson_weights, uniform
from labweave.ml.trees import Tree, TreeEnsembleModel
from labweave.session import shared_dir
from labweave.suite import trees as suite

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(0)
    x = np.stack([rng.integers(0, 30, 1500), rng.integers(0, 5, 1500), rng.integers(-40, 40, 1500) / 10], axis=1).astype(float)
    return x, 3 * (x[:, 0] > 12) + x[:, 1] * (x[:, 2] > 0) + rng.normal(size=1500).round(2)


@pytest.fixture(scope="module")
def rows(spark, made):
    x, y = made
    frame = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "k bigint, a double, b double, c double, label double")
    return prep.assembler(NAMES).transform(frame.repartition(3)).persist()


def nested(tree, at=0):
    return tree.value[at] if tree.left[at] < 0 else (int(tree.feature[at]), float(tree.threshold[at]), nested(tree, tree.left[at]), nested(tree, tree.right[at]))


def same(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return a[0] == b[0] and a[1] == pytest.approx(b[1]) and same(a[2], b[2]) and same(a[3], b[3])
    return not isinstance(a, tuple) and not isinstance(b, tuple) and a == pytest.approx(b, abs=1e-9)


def best_split(x, g, at, l2, least):
    best = None
    for j in range(x.shape[1]):
        for t in np.unique(x[at, j])[:-1]:
            left = x[at, j] <= t
            a, b = at[left], at[~left]
            if min(len(a), len(b)) >= least:
                gain = g[a].sum() ** 2 / (len(a) + l2) + g[b].sum() ** 2 / (len(b) + l2) - g[at].sum() ** 2 / (len(at) + l2)
                if best is None or gain > best[0] * (1 + 1e-9):
                    best = gain, j, float(t), a, b
    return best


def by_level(x, g, depth, l2, least):
    def rec(at, d):
        found = best_split(x, g, at, l2, least) if d < depth else None
        if found is None or found[0] < 1e-9:
            return -g[at].sum() / (len(at) + l2)
        return (found[1], found[2], rec(found[3], d + 1), rec(found[4], d + 1))

    return rec(np.arange(len(g)), 0)


def by_leaf(x, g, leaves, l2):
    """The leaf of largest gain first."""
    root = {"at": np.arange(len(g))}
    held = [root]
    while len(held) < leaves:
        for leaf in held:
            leaf.setdefault("best", best_split(x, g, leaf["at"], l2, 1))
        leaf = max((n for n in held if n["best"]), key=lambda n: n["best"][0])
        leaf["left"], leaf["right"] = {"at": leaf["best"][3]}, {"at": leaf["best"][4]}
        held = [n for n in held if n is not leaf] + [leaf["left"], leaf["right"]]

    def shown(n):
        return (n["best"][1], n["best"][2], shown(n["left"]), shown(n["right"])) if "left" in n else -g[n["at"]].sum() / (len(n["at"]) + l2)

    return shown(root)


def test_level_wise_equals_plain_recursion(rows, made):
    x, y = made
    model = HistogramTrees(n_trees=1, learning_rate=1.0, max_depth=4, l2=2.0, min_leaf=5).fit(rows)
    assert same(nested(model.trees[0]), by_level(x, y.mean() - y, 4, 2.0, 5))


def test_leaf_wise_equals_best_first(rows, made):
    x, y = made
    model = HistogramTrees(growth="leaf", n_trees=1, learning_rate=1.0, max_depth=None, num_leaves=11).fit(rows)
    assert model.trees[0].n_leaves == 11
    assert same(nested(model.trees[0]), by_leaf(x, y.mean() - y, 11, 0.0))


def test_symmetric_splits_are_one_for_a_level(rows, made):
    x, y = made
    tree = HistogramTrees(growth="symmetric", n_trees=1, learning_rate=1.0, max_depth=3, l2=3.0).fit(rows).trees[0]
    depth, at = {0: 0}, 0
    for at in range(len(tree.left)):
        if tree.left[at] >= 0:
            depth[int(tree.left[at])] = depth[int(tree.right[at])] = depth[at] + 1
    splits = {}
    for n, d in depth.items():
        if tree.left[n] >= 0:
            splits.setdefault(d, set()).add((int(tree.feature[n]), float(tree.threshold[n])))
    assert [len(splits[d]) for d in range(3)] == [1, 1, 1] and tree.n_leaves == 8
    g, groups = y.mean() - y, [np.arange(len(y))]
    for d in range(3):
        def total(j, t):
            parts = [p for at in groups for p in (at[x[at, j] <= t], at[x[at, j] > t])]
            return sum(g[p].sum() ** 2 / (len(p) + 3) for p in parts)
        (j, t), = splits[d]
        assert total(j, t) == pytest.approx(max(total(i, v) for i in range(3) for v in np.unique(x[:, i])[:-1]))
        groups = [p for at in groups for p in (at[x[at, j] <= t], at[x[at, j] > t])]


def test_boosting_over_a_refresh_and_in_small_scans(rows, made, monkeypatch):
    monkeypatch.setattr(histogram_trees, "REFRESH", 2)
    monkeypatch.setattr(histogram_trees, "MAX_CELLS", 3 * 80)  # one node a scan, and sums by Spark
    x, y = made
    model = HistogramTrees(n_trees=5, max_depth=2, l2=1.0, learning_rate=0.5).fit(rows)
    left = y - y.mean()
    for tree in model.trees:
        assert same(nested(tree), _scaled(by_level(x, -left, 2, 1.0, 1), 0.5))
        left = left - tree.predict(x)
    got = {r["k"]: r["prediction"] for r in model.transform(rows).select("k", "prediction").collect()}
    assert np.allclose([got[i] for i in range(len(y))], y - left)


def _scaled(tree, by):
    return (*tree[:2], _scaled(tree[2], by), _scaled(tree[3], by)) if isinstance(tree, tuple) else tree * by


def test_bagging_splits_on_its_subset_and_weighs_rows(rows, made):
    x, y = made
    settings = {"bagging": True, "n_trees": 4, "max_depth": 2, "column_fraction": 0.67, "key": "k"}
    model = HistogramTrees(**settings).fit(rows)
    ids = {r["k"]: r["id"] for r in rows.select("k", F.xxhash64("k").alias("id")).collect()}
    ids = np.array([ids[i] for i in range(len(y))], np.int64)
    for spec, tree in zip(drawn_specs(settings, 3), model.trees):
        inner = tree.left >= 0
        assert len(spec.features) == 2 and set(tree.feature[inner]) <= set(spec.features)
        w = poisson_weights(uniform(ids, spec.seed), 1.0)
        leaf = tree.leaves_of(x)
        for at in np.flatnonzero(~inner):
            mine = leaf == at
            assert tree.value[at] * 4 == pytest.approx((w * y)[mine].sum() / w[mine].sum())
            assert tree.cover[at] == w[mine].sum()


def test_poisson_draws():
    w = poisson_weights(uniform(np.arange(200_000, dtype=np.int64), 5), 0.7)
    assert w.mean() == pytest.approx(0.7, abs=0.01) and w.var() == pytest.approx(0.7, abs=0.02)
    assert (poisson_weights(np.array([0.0, 1 - 2**-53]), 1.0) <= 41).all()


def test_more_values_than_bins(spark):
    rows = spark.range(5000).select((F.col("id") * 1.0).alias("a"), F.when(F.col("id") < 2500, 1.0).otherwise(9.0).alias("label"))
    tree = HistogramTrees(n_trees=1, max_depth=1, learning_rate=1.0, max_bins=16).fit(prep.assembler(["a"]).transform(rows)).trees[0]
    assert abs(tree.threshold[0] - 2500) < 5000 / 16


def test_odd_training_rows(spark):
    nan = float("nan")
    frame = spark.createDataFrame([(1.0, 2.0, 5.0), (1.0, nan, 7.0), (1.0, 3.0, 5.0), (1.0, 4.0, None)], "a double, b double, label double")
    rows = prep.assembler(["a", "b"]).setHandleInvalid("keep").transform(frame)
    tree = HistogramTrees(n_trees=1, max_depth=1, learning_rate=1.0).fit(rows).trees[0]  # NaN is above all values
    assert (tree.feature[0], tree.threshold[0]) == (1, 3.0) or tree.threshold[0] == 4.0
    flat = HistogramTrees(n_trees=2).fit(rows.where("b = 2.0"))
    assert [t.n_leaves for t in flat.trees] == [1, 1] and flat.transform(rows).select("prediction").first()[0] == 5.0
    with pytest.raises(ValueError, match="no training rows"):
        HistogramTrees().fit(rows.where("false"))
    for wrong in ({"growth": "sideways"}, {"growth": "symmetric", "max_depth": None}, {"max_bins": 1000}):
        with pytest.raises(ValueError):
            HistogramTrees(**wrong).fit(rows)
    with pytest.raises(ValueError, match="unknown"):
        HistogramTrees(n_leaves=3)


def test_saved_model_predicts_alike(spark, rows):
    model = regressors.leafwise_boosting(n_trees=2, num_leaves=4).fit(rows)
    path = shared_dir(spark)
    PipelineModel(stages=[model]).write().save(path)
    again = PipelineModel.load(path)
    assert isinstance(again.stages[0], TreeEnsembleModel)
    assert again.transform(rows).exceptAll(model.transform(rows)).count() == 0
    assert model.featureImportances.toArray().sum() == pytest.approx(1)


# --- Shapley values


def random_tree(rng, p, depth):
    nodes = []

    def grow(d, n):
        at = len(nodes)
        nodes.append(None)
        if d == 0 or rng.random() < 0.2 or n < 2:
            nodes[at] = (-1, 0.0, -1, -1, float(rng.normal()), n, 0.0)
            return at
        f, t, k = int(rng.integers(p)), float(rng.normal()), int(rng.integers(0, n + 1))  # a child may hold no rows
        nodes[at] = (f, t, grow(d - 1, k), grow(d - 1, n - k), 0.0, n, 1.0)
        return at

    grow(depth, 100)
    return Tree(*(np.array(v) for v in zip(*nodes)))


def conditional(tree, x, held, share, at=0):
    """The tree's value with the held features known and all others followed both ways."""
    if tree.left[at] < 0:
        return tree.value[at]
    f, left, right = tree.feature[at], tree.left[at], tree.right[at]
    if f in held:
        return conditional(tree, x, held, share, left if x[f] <= tree.threshold[at] else right)
    return share[left] * conditional(tree, x, held, share, left) + share[right] * conditional(tree, x, held, share, right)


def all_subsets(p, value):
    known = {frozenset(c): value(frozenset(c)) for k in range(p + 1) for c in itertools.combinations(range(p), k)}
    of = lambda j, c: math.factorial(len(c)) * math.factorial(p - len(c) - 1) / math.factorial(p) * (known[c | {j}] - known[c])
    return [sum(of(j, c) for c in known if j not in c) for j in range(p)], known[frozenset()]


def test_tree_shapley_equals_all_subsets():
    rng = np.random.default_rng(4)
    for _ in range(25):
        trees = [random_tree(rng, 4, 5) for _ in range(2)]
        shares, x = [shapley.child_shares(t) for t in trees], rng.normal(size=(5, 4))
        got = shapley.tree_shapley_values(x, trees, 0.5)
        for i, row in enumerate(x):
            want, base = all_subsets(4, lambda c: 0.5 + sum(conditional(t, row, c, s) for t, s in zip(trees, shares)))
            assert np.allclose(got[i], [*want, base])
        points = rng.normal(size=(6, 2))
        wide = np.zeros((6, 4))
        wide[:, [1, 3]] = points
        want = [0.5 + sum(conditional(t, row, {1, 3}, s) for t, s in zip(trees, shares)) for row in wide]
        assert np.allclose(shapley.dependence_of(trees, 0.5, points, [1, 3]), want)


def test_tree_shapley_of_spark_models(spark, rows):
    for regressor in (regressors.random_forest(n_trees=3, max_depth=4), regressors.gradient_boosting(n_trees=3, max_depth=3)):
        model = regressor.fit(rows)
        sums = shapley.exact_tree_shapley(rows, "k", NAMES, model).groupBy("k").agg(F.sum("contribution").alias("s"))
        gap = sums.join(model.transform(rows), "k").agg(F.max(F.abs(F.col("s") - F.col("prediction")))).first()[0]
        assert gap < 1e-9
        base, trees = shapley.tree_ensemble(model)
        at = {c: [1.0, 2.0] for c in NAMES[:1]}
        line = [r["average"] for r in shapley.tree_partial_dependence(spark, model, NAMES, at).orderBy("a_grid").collect()]
        assert np.allclose(line, shapley.dependence_of(trees, base, np.array([[1.0], [2.0]]), [0]))


def test_additivity_is_asked_of_the_own_and_of_sparks_model(spark, tmp_path, monkeypatch):
    made = [(i // 3 or None, 1.0 + i % 50, i % 11 / 100, i % 9 / 100, 1 + i % 7, None if i % 40 == 0 else 1000.0 * (i % 50) * (1 + i % 11 % 2)) for i in range(600)]
    frame = spark.createDataFrame(made, "l_orderkey bigint, l_quantity double, l_discount double, l_tax double, l_linenumber int, l_extendedprice double")
    frame.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = lambda: sorted(((r["k"] or 0, r["gap"]) for r in suite.x4_additivity(spark, str(tmp_path)).collect()))
    assert got() == [(i // 3, 0.0) for i in range(600)]
    read, trees = shapley.tree_ensemble, {}

    def shifted(kind):
        def ensemble(model):
            base, trees[type(model)] = read(model)
            return base + isinstance(model, kind), trees[type(model)]

        return ensemble

    for kind in (TreeEnsembleModel, GBTRegressionModel):
        monkeypatch.setattr(shapley, "tree_ensemble", shifted(kind))
        assert got() == [(i // 3, 1.0) for i in range(600)]  # a fault in either explanation shows in every row
        assert len(trees[kind]) == 4 and min(t.n_leaves for t in trees[kind]) > 8


def test_kernel_shapley_with_all_coalitions_equals_all_subsets():
    rng = np.random.default_rng(1)
    f = lambda x: x[:, 0] * x[:, 1] + 3 * x[:, 2] - x[:, 3] * x[:, 4] * x[:, 0]
    ground, x = rng.normal(size=(6, 5)), rng.normal(size=(4, 5))
    got = shapley.kernel_values(x, f, ground, *(lambda h, w: (h, *shapley.kernel_solution(h, w)))(*shapley.kernel_coalitions(5, 32)))
    for i, row in enumerate(x):
        want, base = all_subsets(5, lambda c: f(np.where(np.isin(np.arange(5), list(c)), row, ground)).mean())
        assert np.allclose(got[i], [*want, base])


def test_sampled_coalitions_keep_the_kernel_and_the_sum():
    held, weight = shapley.kernel_coalitions(14, 400)
    assert len(held) <= 400 and weight.sum() == pytest.approx(sum(13 / (s * (14 - s)) for s in range(1, 14)))
    assert len({tuple(h) for h in held}) == len(held) and {tuple(h) for h in held} == {tuple(~h) for h in held}
    rng = np.random.default_rng(2)
    line, ground, x = rng.normal(size=14), rng.normal(size=(9, 14)), rng.normal(size=(3, 14))
    got = shapley.kernel_values(x, lambda v: v @ line, ground, held, *shapley.kernel_solution(held, weight))
    assert np.allclose(got[:, :-1], line * (x - ground.mean(axis=0)))  # a linear function is met by any design


def test_kernel_shapley_of_models(spark, rows):
    few = rows.where("k < 60")
    tree = regressors.depthwise_boosting(n_trees=2, max_depth=3).fit(rows)
    plan = shapley.kernel_shapley(few, "k", NAMES, tree, background=10)
    assert "hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()
    sums = plan.groupBy("k").agg(F.sum("contribution").alias("s")).join(tree.transform(few), "k")
    assert sums.agg(F.max(F.abs(F.col("s") - F.col("prediction")))).first()[0] < 1e-9
    one = shapley.kernel_shapley(few, "k", ["a"], FunctionModel(["a"], lambda x: 2 * x[:, 0]), background=10)
    assert {r["feature"] for r in one.collect()} == {"a", explain.BASE}
    with pytest.raises(ValueError, match="no background"):
        shapley.kernel_shapley(few.where("false"), "k", NAMES, tree)


def test_binned_rows_lie_many_to_a_record(spark):
    made = spark.range(0, 5000, 1, 2).select(F.array((F.col("id") % 7).cast("double"), (F.col("id") % 3).cast("double")).alias("x"), F.col("id").cast("double").alias("y"), "id")
    for drawn in (True, False):
        data = histogram_trees.BinnedRows(made, histogram_trees.feature_edges(made, 2, 255), drawn)
        assert data.rows.count() == 2  # one for each task, 5000 before
        growing = histogram_trees.Growing(histogram_trees.Spec(1, np.array([0, 1]), "all"), histogram_trees.DEFAULTS, data.sizes)
        got = data.histograms([growing], [[0]], 2.0, [])[0][0]
        data.subtract(2.0, [])
        assert (data.histograms([growing], [[0]], 0.0, [])[0][0] == got).all()
        want = np.zeros((2, 7, 2))
        for i in range(5000):
            for j, b in enumerate((i % 7, i % 3)):
                want[j, b] += 2.0 - i, 1
        assert (got == want).all()


def test_chunks_keep_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(histogram_trees, "CHUNK", 10)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b))], ["v"]) for a, b in ((0, 3), (3, 3), (3, 26), (26, 30), (30, 31))]
    got = list(histogram_trees._chunks(iter(batches)))
    assert [b.num_rows for b in got] == [10, 10, 10, 1]
    assert [v for b in got for v in b.column(0).to_pylist()] == list(range(31))


def test_listed_patterns_give_the_sorted_ones_values(made, monkeypatch):
    rng = np.random.default_rng(4)
    tree = Tree(
        np.array([0, 1, 2, -1, -1, 0, -1, -1, -1]), np.array([12.0, 2, 0, 0, 0, 5, 0, 0, 0]), np.array([1, 3, 5, -1, -1, 6, -1, -1, -1]),
        np.array([2, 4, 8, -1, -1, 7, -1, -1, -1]), rng.normal(size=9), np.array([10.0, 6, 4, 5, 1, 3, 0, 3, 1]), np.ones(9),
    )
    listed = shapley.tree_shapley_values(made[0], [tree], 1.5)
    monkeypatch.setattr(shapley, "FEW", 0)
    assert np.array_equal(listed, shapley.tree_shapley_values(made[0], [tree], 1.5))
