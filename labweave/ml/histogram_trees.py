"""Own tree learners on histograms: boosting grown by level, by leaf or symmetrically, and bagging.

The rows are written once as bins (one byte a feature), many rows to a record. A scan places every row in the trees as grown so far and sums gradients and
weights by node, feature and bin; Spark adds up what the tasks found. Only the lighter child of a split is summed, its sibling is the
parent less that child. Histograms on the driver are bounded by leaves x features x bins.

* By level: all leaves of a depth are split at once.
* By leaf: the leaf of largest gain is split next, until there are ``num_leaves``. One scan sums the children of every leaf that could
  still be split, so a tree takes about as many scans as levels, and the order of splits is the exact one.
* Symmetric: one split for all leaves of a depth, the one of largest total gain.

A leaf's value is ``-G / (H + l2)``, for squared error: the sum of what is left to explain over the weight plus ``l2``. Bagging grows its
trees side by side, each on Poisson weights of the rows and its own subset of the features. Weights are hashes of ``key`` and tree, so
they do not hang on partitions.

Equal gains go to the lower feature, then to the lower threshold. Thresholds are values of the training rows: all distinct ones, or quantiles
where a feature has more than ``max_bins``.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Generator, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labweave.functions.hashing import poisson_weights, uniform
from labweave.ml.trees import Tree, TreeEnsembleModel
from labweave.operators.columns import quoted
from labweave.session import shared_dir

#: Histogram cells (node x feature x bin) that one scan sums in a task at most; more trees take turns.
MAX_CELLS = 1 << 22
#: Rows whose numbers lie in one record.
CHUNK = 1 << 15
#: Lowest bits of an id that tell a row's fold, where trees leave folds out.
FOLD_BITS = 16
#: Trees after which the sum of all trees so far is written to the rows again.
REFRESH = 10
#: Relative difference up to which gains count as equal.
TIE = 1e-9

DEFAULTS = {
    "growth": "level", "n_trees": 100, "max_depth": 6, "num_leaves": None, "l2": 0.0, "learning_rate": 0.1, "row_fraction": 1.0,
    "column_fraction": 1.0, "min_leaf": 1, "min_split": 2, "max_bins": 255, "bagging": False, "row_weights": None, "key": None, "seed": 42,
}


# --- bins


def feature_edges(rows: DataFrame, p: int, max_bins: int) -> list[np.ndarray]:
    """Per feature the values that can be thresholds: all distinct ones but the largest, or quantiles of a feature with more than
    ``max_bins``. Tasks send at most ``max_bins + 1`` values a feature."""

    def run(batches):
        seen = [np.zeros(0) for _ in range(p)]
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            for j in range(p):
                if len(seen[j]) <= max_bins:
                    seen[j] = np.unique(np.concatenate([seen[j], x[~np.isnan(x[:, j]), j]]))[: max_bins + 1]
        for j in range(p):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen[j]), j, np.int32)), pa.array(seen[j])], ["j", "v"])

    listed = rows.select("x").mapInArrow(run, "j int, v double").distinct().groupBy("j").agg(F.count("v").alias("n"), F.sort_array(F.slice(F.collect_set("v"), 1, max_bins + 1)).alias("v"))
    # a feature's set is bounded by tasks x max_bins; only lists that are short enough come back
    known = {r["j"]: r for r in listed.select("j", "n", F.when(F.col("n") <= max_bins, F.col("v")).alias("v")).collect()}
    many = [j for j, r in known.items() if r["n"] > max_bins]
    quantiles = {}
    if many:
        shares = [k / max_bins for k in range(1, max_bins)]
        row = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.col("x")[j]), F.col("x")[j]), shares, 20 * max_bins).alias(f"q{j}") for j in many]).first()
        quantiles = {j: np.unique(row[f"q{j}"]) for j in many}
    return [quantiles[j] if j in quantiles else np.array(known[j]["v"][:-1], float) if j in known else np.zeros(0) for j in range(p)]


# --- growing


@dataclass
class Spec:
    """What is drawn for one tree."""

    seed: int
    features: np.ndarray  # that it may split on
    rows: str  # all, share or poisson
    fraction: float = 1.0

    def weights(self, ids: np.ndarray, known: dict | None = None) -> np.ndarray:
        if self.rows == "all":
            return np.ones(len(ids))
        u = uniform(ids, self.seed)
        return poisson_weights(u, self.fraction) if self.rows == "poisson" else (u < self.fraction).astype(float)


@dataclass
class FoldSpec(Spec):
    """A tree on the rows outside of a fold, which the lowest bits of an id tell; draws hang on the others and are the same for all folds."""

    fold: int = 0

    def weights(self, ids: np.ndarray, known: dict | None = None) -> np.ndarray:
        known, draw = {} if known is None else known, (self.seed, self.rows, self.fraction)
        if draw not in known:
            known[draw] = super().weights(ids >> FOLD_BITS)
        return known[draw] * ((ids & ((1 << FOLD_BITS) - 1)) != self.fold)


@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    left: tuple[float, float]  # sums of gradient and weight
    right: tuple[float, float]


@dataclass
class Node:
    depth: int
    g: float = 0.0
    h: float = 0.0
    n: float = 0.0
    split: Split | None = None  # the best one
    left: int = -1
    right: int = -1
    taken: bool = False  # whether the split is part of the tree; by leaf, children are looked at ahead of that


def rounding(hist: np.ndarray) -> float:
    """A gain that rounding alone could give: a node whose rows all leave the same over has gains of that size."""
    weight = hist[:, :, 1].sum(axis=1).max(initial=0.0)
    return TIE * np.abs(hist[:, :, 0]).sum(axis=1).max(initial=0.0) ** 2 / weight if weight > 0 else 0.0


@dataclass
class Growing:
    """A tree under way. ``nodes`` may hold children of splits that are never taken."""

    spec: Spec
    settings: Mapping
    sizes: list[int]  # bins of each feature
    nodes: list[Node] = field(default_factory=lambda: [Node(0)])
    held: dict[int, np.ndarray] = field(default_factory=dict)  # histograms by node: feature, bin, (gradient, weight)

    def best(self, hist: np.ndarray, depth: int) -> Split | None:
        """The split of largest gain; None if none gains, leaves are too small or the tree too deep."""
        s = self.settings
        if s["max_depth"] is not None and depth >= s["max_depth"]:
            return None
        g, h = hist[:, :, 0], hist[:, :, 1]
        gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
        total_g, total_h = float(g[self.spec.features[0]].sum()), float(h[self.spec.features[0]].sum())
        if total_h < s["min_split"]:
            return None
        gains = self.gains(gl, hl, total_g, total_h)
        gains[(hl < s["min_leaf"]) | (total_h - hl < s["min_leaf"])] = -np.inf
        return self.largest(gains, gl, hl, total_g, total_h, rounding(hist))

    def gains(self, gl: np.ndarray, hl: np.ndarray, g: float, h: float) -> np.ndarray:
        l2 = self.settings["l2"]
        with np.errstate(divide="ignore", invalid="ignore"):
            part = lambda a, b: np.where(b + l2 > 0, a * a / (b + l2), 0.0)
            return part(gl, hl) + part(g - gl, h - hl) - part(np.float64(g), np.float64(h))

    def largest(self, gains: np.ndarray, gl: np.ndarray, hl: np.ndarray, g: float, h: float, least: float) -> Split | None:
        masked = np.full_like(gains, -np.inf)
        for j in self.spec.features:
            masked[j, : self.sizes[j] - 1] = gains[j, : self.sizes[j] - 1]
        top = masked.max(initial=-np.inf)
        if not top > least:
            return None
        j, b = (int(v) for v in np.argwhere(masked >= top * (1 - TIE))[0])
        return Split(float(gains[j, b]), j, b, (float(gl[j, b]), float(hl[j, b])), (float(g - gl[j, b]), float(h - hl[j, b])))

    def open_children(self, at: int) -> None:
        node = self.nodes[at]
        node.left, node.right = len(self.nodes), len(self.nodes) + 1
        for g, h in (node.split.left, node.split.right):
            self.nodes.append(Node(node.depth + 1, g, h))

    def children_summed(self, parents: Sequence[int]) -> Generator:
        """Sums the lighter child of each parent in one scan; the sibling is what is left."""
        lighter = {at: min((self.nodes[at].left, self.nodes[at].right), key=lambda c: (self.nodes[c].h, c)) for at in parents}
        found = yield list(lighter.values())
        for at, child in lighter.items():
            node = self.nodes[at]
            other = node.right if child == node.left else node.left
            self.held[child], self.held[other] = found[child], self.held.pop(at) - found[child]
            for c in (child, other):
                self.nodes[c].split = self.best(self.held[c], self.nodes[c].depth)
                if self.nodes[c].split is None:
                    del self.held[c]

    def may_split(self, depth: int) -> bool:
        return self.settings["max_depth"] is None or depth < self.settings["max_depth"]

    def grow(self) -> Generator:
        """Yields lists of nodes to sum and receives their histograms."""
        found = yield [0]
        root, hist = self.nodes[0], found[0]
        root.g, root.h = (float(v) for v in hist[self.spec.features[0]].sum(axis=0))
        self.held[0] = hist
        yield from {"level": self.by_level, "leaf": self.by_leaf, "symmetric": self.symmetric}[self.settings["growth"]]()
        self.held.clear()

    def by_level(self) -> Generator:
        self.nodes[0].split = self.best(self.held[0], 0)
        level, leaves = [0], 1
        while True:
            ready = sorted((at for at in level if self.nodes[at].split), key=lambda at: (-self.nodes[at].split.gain, at))
            if self.settings["num_leaves"]:
                ready = ready[: self.settings["num_leaves"] - leaves]
            if not ready:
                return
            for at in sorted(ready):
                self.nodes[at].taken = True
                self.open_children(at)
            leaves += len(ready)
            level = [c for at in sorted(ready) for c in (self.nodes[at].left, self.nodes[at].right)]
            if not self.may_split(self.nodes[level[0]].depth):
                return
            yield from self.children_summed(sorted(ready))

    def by_leaf(self) -> Generator:
        most = self.settings["num_leaves"] or 31
        self.nodes[0].split = self.best(self.held[0], 0)
        queue, leaves = [], 1

        def offer(at: int) -> None:
            if self.nodes[at].split:
                heapq.heappush(queue, (-self.nodes[at].split.gain, at))

        offer(0)
        while queue and leaves < most:
            at = queue[0][1]
            node = self.nodes[at]
            if node.left < 0 and leaves + 1 < most and self.may_split(node.depth + 1):
                # of the leaves in the queue only the best can still be split: their children are looked at together
                likely = [a for _, a in heapq.nsmallest(most - leaves, queue) if self.nodes[a].left < 0 and self.may_split(self.nodes[a].depth + 1)]
                for a in likely:
                    self.open_children(a)
                yield from self.children_summed(likely)
                continue
            heapq.heappop(queue)
            if node.left < 0:
                self.open_children(at)
            node.taken, leaves = True, leaves + 1
            offer(node.left)
            offer(node.right)

    def symmetric(self) -> Generator:
        level = [0]
        for depth in range(self.settings["max_depth"]):
            total, least, sums = 0.0, 0.0, []
            for at in level:
                least += rounding(self.held[at])
                gl, hl = np.cumsum(self.held[at][:, :, 0], axis=1)[:, :-1], np.cumsum(self.held[at][:, :, 1], axis=1)[:, :-1]
                total = total + self.gains(gl, hl, self.nodes[at].g, self.nodes[at].h)
                sums.append((gl, hl))
            chosen = self.largest(total, *sums[0], self.nodes[level[0]].g, self.nodes[level[0]].h, least)
            if chosen is None:
                return
            j, b = chosen.feature, chosen.bin
            for at, (gl, hl) in zip(level, sums, strict=True):
                node, left = self.nodes[at], (float(gl[j, b]), float(hl[j, b]))
                own = float(self.gains(gl[j, b], hl[j, b], node.g, node.h))
                node.split, node.taken = Split(own, j, b, left, (node.g - left[0], node.h - left[1])), True
                self.open_children(at)
            parents, level = level, [c for at in level for c in (self.nodes[at].left, self.nodes[at].right)]
            if depth + 1 == self.settings["max_depth"]:
                return
            lighter = [min((self.nodes[a].left, self.nodes[a].right), key=lambda c: (self.nodes[c].h, c)) for a in parents]
            found = yield lighter
            for at, child in zip(parents, lighter, strict=True):
                node = self.nodes[at]
                other = node.right if child == node.left else node.left
                self.held[child], self.held[other] = found[child], self.held.pop(at) - found[child]

    def routing(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Feature, bin and children of every node, children ahead of their turn included."""
        nodes = self.nodes
        inner = [n.split if n.left >= 0 else None for n in nodes]
        return (
            np.array([s.feature if s else 0 for s in inner]), np.array([s.bin if s else 0 for s in inner]),
            np.array([n.left for n in nodes]), np.array([n.right for n in nodes]),
        )

    def finished(self, edges: Sequence[np.ndarray], scale: float) -> Tree:
        """The tree of the splits that were taken, numbered from the root down; values times ``scale``."""
        order, l2 = [0], self.settings["l2"]
        for at in order:
            if self.nodes[at].taken:
                order += [self.nodes[at].left, self.nodes[at].right]
        place = {at: i for i, at in enumerate(order)}
        nodes = [self.nodes[at] for at in order]
        value = [-n.g / (n.h + l2) * scale if n.h + l2 > 0 else 0.0 for n in nodes]
        pick = lambda f, other: np.array([f(n) if n.taken else other for n in nodes])
        return Tree(
            pick(lambda n: n.split.feature, -1), pick(lambda n: edges[n.split.feature][n.split.bin], 0.0).astype(float),
            pick(lambda n: place[n.left], -1), pick(lambda n: place[n.right], -1), np.array(value), np.array([n.h for n in nodes]),
            pick(lambda n: n.split.gain, 0.0).astype(float),
        )


def rows_by_leaf(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, wanted: Sequence[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Nodes without children and the rows that end there; ``bins`` by feature. Only the ways to the ``wanted`` ones are gone, if given."""
    lead = np.ones(len(left), bool)
    if wanted is not None:
        lead[:] = False
        lead[list(wanted)] = True
        for at in range(len(left) - 1, -1, -1):  # children have larger numbers
            if left[at] >= 0:
                lead[at] = lead[left[at]] or lead[right[at]]
    open_nodes = [(0, np.arange(bins.shape[1]))]
    while open_nodes:
        at, rows = open_nodes.pop()
        if not lead[at] or not len(rows):
            continue
        if left[at] < 0:
            yield at, rows
            continue
        goes_left = bins[feature[at]][rows] <= cut[at]
        open_nodes += [(left[at], rows[goes_left]), (right[at], rows[~goes_left])]


class BinnedRows:
    """The training rows as bins, written once, and the scans over them.

    A record holds the numbers of up to ``CHUNK`` rows as bytes: their bins by feature, what is left to explain, and, if some rows are
    ``drawn``, what draws hang on. So a scan costs little besides the sums.
    """

    def __init__(self, rows: DataFrame, edges: list[np.ndarray], drawn: bool = True):
        self.spark, self.edges, self.p = rows.sparkSession, edges, len(edges)
        self.sizes = [len(e) + 1 for e in edges]
        self.width = max(self.sizes, default=1)
        own, p = edges, self.p
        self.columns = ["bins", "left", "id"] if drawn else ["bins", "left"]

        def run(batches):
            for chunk in _chunks(batches):
                x = chunk.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                bins = np.stack([np.searchsorted(own[j], x[:, j], "left") for j in range(p)]).astype(np.uint8) if p else np.zeros((0, len(x)), np.uint8)
                yield _record(bins, *(column.to_numpy() for column in chunk.columns[1:]))

        self._write(rows.select("x", "y", *self.columns[2:]).mapInArrow(run, self.kind))

    @property
    def kind(self) -> str:
        return ", ".join(f"{name} binary" for name in self.columns)

    def _write(self, rows: DataFrame) -> None:
        path = shared_dir(self.spark)
        rows.write.parquet(path)
        self.rows = self.spark.read.parquet(path)
        self.tasks = self.rows.rdd.getNumPartitions()

    def subtract(self, base: float, trees: Sequence[tuple]) -> None:
        """Writes the rows again with ``left`` less the base and what the trees say."""
        p = self.p

        def run(batches):
            for bins, left, *ids in _records(batches, p):
                yield _record(bins, left - base - _said(bins, trees), *ids)

        self._write(self.rows.mapInArrow(run, self.kind))

    def histograms(self, growing: Sequence[Growing], wanted: Sequence[list[int]], base: float, pending: Sequence[tuple]) -> list[dict[int, np.ndarray]]:
        """Sums of gradient and weight by feature and bin for the wanted nodes of several trees, in one scan; wanted nodes have no children."""
        p, width = self.p, self.width
        work, first = [], 0
        for tree, nodes in zip(growing, wanted, strict=True):
            work.append((tree.spec, tree.routing(), {node: i * width for i, node in enumerate(nodes)}, first, len(nodes)))
            first += len(nodes)

        def run(batches):
            sums = np.zeros((2, first, p, width))
            for bins, left, *ids in _records(batches, p):
                gradient, known = base + _said(bins, pending) - left, {}
                for spec, routing, slot, lead, n in work:
                    weight = None if spec.rows == "all" else spec.weights(ids[0], known)
                    drawn = None if weight is None else np.flatnonzero(weight)
                    met = list(rows_by_leaf(bins if drawn is None else bins[:, drawn], *routing, slot))
                    if not met:
                        continue
                    at = np.concatenate([rows for _, rows in met])
                    own = np.repeat([slot[node] for node, _ in met], [len(rows) for _, rows in met])
                    if drawn is not None:
                        at = drawn[at]
                    w = None if weight is None else weight[at]
                    g = gradient[at] if w is None else gradient[at] * w
                    for j in spec.features:
                        cell = own + bins[j][at]
                        sums[0, lead : lead + n, j] += np.bincount(cell, g, n * width).reshape(n, width)
                        sums[1, lead : lead + n, j] += np.bincount(cell, w, n * width).reshape(n, width)
            flat = sums.reshape(2, -1)
            met = np.flatnonzero(flat[1])
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(flat[0, met]), pa.array(flat[1, met])], ["cell", "g", "h"])

        parts = self.rows.select(*self.columns).mapInArrow(run, "cell bigint, g double, h double")
        if self.tasks * first * p * width > MAX_CELLS:  # too many rows for the driver: Spark adds them up
            parts = parts.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        found, whole = parts.toArrow(), np.zeros((first * p * width, 2))
        np.add.at(whole, found["cell"].to_numpy(), np.stack([found["g"].to_numpy(), found["h"].to_numpy()], axis=1))
        whole = whole.reshape(first, p, width, 2)
        return [{node: whole[lead + i] for i, node in enumerate(nodes)} for nodes, (_, _, _, lead, _) in zip(wanted, work, strict=True)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``CHUNK``; the last one may be smaller."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, CHUNK - n)
            held.append(part)
            n, batch = n + part.num_rows, batch.slice(part.num_rows)
            if n == CHUNK:
                yield pa.concat_batches(held)
                held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _record(bins: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One record of the bins by feature and of columns of eight bytes a row."""
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (bins, *columns)], ["bins", "left", "id"][: 1 + len(columns)])


def _records(batches: Iterator[pa.RecordBatch], p: int) -> Iterator[list[np.ndarray]]:
    """Bins by feature, what is left, and the ids if there are any, of every record."""
    for batch in batches:
        for bins, left, *ids in zip(*batch.columns, strict=True):
            left = np.frombuffer(left.as_buffer(), float)
            yield [np.frombuffer(bins.as_buffer(), np.uint8).reshape(p, len(left)), left, *(np.frombuffer(i.as_buffer(), np.int64) for i in ids)]


def _said(bins: np.ndarray, trees: Sequence[tuple]) -> np.ndarray:
    """The sum of finished trees, given as routing and values; ``bins`` by feature."""
    out = np.zeros(bins.shape[1])
    for *routing, value in trees:
        for at, rows in rows_by_leaf(bins, *routing):
            out[rows] += value[at]
    return out


def grow_together(data: BinnedRows, specs: Sequence[Spec], settings: Mapping | Sequence[Mapping], base: float, pending: Sequence[tuple] = ()) -> list[Growing]:
    """Grows the trees side by side: each scan serves all of them, as far as its histograms stay within ``MAX_CELLS``; the rest waits for the
    next. ``settings`` are those of all trees, or of each."""
    each = [settings] * len(specs) if isinstance(settings, Mapping) else settings
    trees = [Growing(spec, own, data.sizes) for spec, own in zip(specs, each, strict=True)]
    steps = [tree.grow() for tree in trees]
    wanted = {i: next(step) for i, step in enumerate(steps)}
    found: dict[int, dict[int, np.ndarray]] = {i: {} for i in wanted}
    room = max(1, MAX_CELLS // (data.p * data.width))
    while wanted:
        turn: dict[int, list[int]] = {}
        left = room
        for i, nodes in wanted.items():
            missing = [n for n in nodes if n not in found[i]][:left]
            if missing:
                turn[i] = missing
                left -= len(missing)
            if not left:
                break
        summed = data.histograms([trees[i] for i in turn], list(turn.values()), base, pending)
        for i, hist in zip(turn, summed, strict=True):
            found[i].update(hist)
            if len(found[i]) == len(wanted[i]):
                whole, found[i] = found[i], {}
                try:
                    wanted[i] = steps[i].send(whole)
                except StopIteration:
                    del wanted[i]
    return trees


def drawn_specs(settings: Mapping, p: int) -> list[Spec]:
    """What is drawn for each tree: a subset of the ``p`` features and the seed of its row weights."""
    s = {**DEFAULTS, **settings}
    rng = np.random.default_rng(s["seed"])
    share = min(p, max(1, round(s["column_fraction"] * p))) if s["column_fraction"] else p
    kind = s["row_weights"] or ("poisson" if s["bagging"] else "all" if s["row_fraction"] >= 1 else "share")
    return [Spec(int(rng.integers(1 << 62)), np.sort(rng.choice(p, share, replace=False)), kind, s["row_fraction"]) for _ in range(s["n_trees"])]


class HistogramTrees(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Boosting or bagging of regression trees on histograms; see the module.

    ``growth`` level, leaf or symmetric; ``n_trees, max_depth, num_leaves, l2, learning_rate, row_fraction, column_fraction, min_leaf,
    min_split, max_bins, bagging, row_weights, key, seed``. Fractions are drawn for each tree; ``row_weights`` is all, share or
    poisson, by default poisson for bagging and a share of the rows for boosting with a ``row_fraction`` below one. Without ``key``, a row is known by its features
    and label, so equal rows share their draws. No rows are an error; NaN in the features counts as larger than all values.
    """

    settings = Param(Params._dummy(), "settings", "settings as JSON", TypeConverters.toString)

    def __init__(self, **settings):
        super().__init__()
        labels = {name: settings.pop(name) for name in ("labelCol", "featuresCol", "predictionCol") if name in settings}
        unknown = set(settings) - set(DEFAULTS)
        if unknown:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        self._set(settings=json.dumps({**DEFAULTS, **settings}), **labels)

    def setPredictionCol(self, name: str) -> HistogramTrees:
        return self._set(predictionCol=name)

    def _fit(self, dataset: DataFrame) -> TreeEnsembleModel:
        s = json.loads(self.getOrDefault(self.settings))
        if s["growth"] not in ("level", "leaf", "symmetric"):
            raise ValueError(f"growth is level, leaf or symmetric, not {s['growth']}")
        if s["growth"] == "symmetric" and not s["max_depth"]:
            raise ValueError("symmetric trees need a max_depth")
        if not 2 <= s["max_bins"] <= 256:
            raise ValueError("max_bins is from 2 to 256")
        label = F.col(quoted(self.getLabelCol())).cast("double")
        key = [F.col(quoted(s["key"]))] if s["key"] else [F.col("x"), F.col("y")]
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), label.alias("y"), *([quoted(s["key"])] if s["key"] else []))
        rows = rows.select("x", "y", F.xxhash64(*key).alias("id"))
        told = rows.agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.max(F.size("x")).alias("p")).first()
        if not told["n"]:
            raise ValueError("no training rows with a label")
        p = told["p"]
        specs = drawn_specs(s, p)
        data = BinnedRows(rows.where("y is not null"), feature_edges(rows, p, s["max_bins"]), any(spec.rows != "all" for spec in specs))
        if s["bagging"]:
            grown = grow_together(data, specs, {**s, "l2": 0.0}, 0.0)
            model = TreeEnsembleModel.of(0.0, p, [t.finished(data.edges, 1.0 / len(grown)) for t in grown])
        else:
            model = TreeEnsembleModel.of(told["mean"], p, self._boosted(data, specs, s, told["mean"]))
        return model._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())

    @staticmethod
    def _boosted(data: BinnedRows, specs: Sequence[Spec], s: Mapping, mean: float) -> list[Tree]:
        """One tree after the other on what those before leave over; rows are written again every ``REFRESH`` trees."""
        trees, base, pending = [], mean, []
        for i, spec in enumerate(specs, start=1):
            growing = grow_together(data, [spec], s, base, pending)[0]
            trees.append(growing.finished(data.edges, s["learning_rate"]))
            feature, cut, left, right = growing.routing()
            value = np.array([-n.g / (n.h + s["l2"]) * s["learning_rate"] if n.h + s["l2"] > 0 else 0.0 for n in growing.nodes])
            taken = np.array([n.taken for n in growing.nodes])
            pending.append((feature, cut, np.where(taken, left, -1), np.where(taken, right, -1), value))
            if i % REFRESH == 0 and i < len(specs):
                data.subtract(base, pending)
                base, pending = 0.0, []
        return trees
