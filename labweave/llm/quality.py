"""Document quality by a small convolutional network over bytes, written in numpy.

A text is cut into overlapping chunks that cover it from the first to the last byte. Bytes become learned vectors, learned filters run
over windows of bytes, and each filter keeps its largest answer in a chunk. The mean and the largest over all chunks enter one logistic
unit. The network is fitted by Adam on a bounded sample of labelled documents; its size is fixed by the constants below.

Defined cases: null and empty texts have no chunk and get the unit's answer to nothing found; texts are read whole; equal texts get equal
scores; without labelled rows of both classes every score is the share of the label (1 where nothing is labelled, so nothing is
rejected); extra columns are not read when scoring and kept when filtering.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labweave.llm.arrays import text_blocks
from labweave.llm.labelled import sample

CHUNK, STEP = 512, 448
WINDOW, STRIDE, DEPTH, FILTERS = 8, 2, 8, 24
PER_LABEL = 600
EPOCHS, BATCH, RATE = 14, 24, 8e-3
#: Chunks whose windows are laid out together.
TOGETHER = 256
PARAMETERS = ("embedding", "filters", "bias", "weights", "offset")


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all chunks (0 beyond a text's end), how many of them are text, and the row of each chunk."""
    lengths = np.diff(offsets)
    counts = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - CHUNK) // STEP)), 0)
    rows = np.repeat(np.arange(len(lengths)), counts)
    number = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[:-1][rows] + number * STEP
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < offsets[1:][rows][:, None]
    out = np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0).astype(np.uint8) if len(rows) else np.zeros((0, CHUNK), np.uint8)
    return out, np.minimum(CHUNK, offsets[1:][rows] - starts), rows


@dataclass
class ByteNetwork:
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 11) -> ByteNetwork:
        r = np.random.default_rng(seed)
        return cls(
            r.normal(0, 0.5, (256, DEPTH)).astype(np.float32), r.normal(0, (2 / (WINDOW * DEPTH)) ** 0.5, (WINDOW * DEPTH, FILTERS)).astype(np.float32),
            np.zeros(FILTERS, np.float32), r.normal(0, 0.1, 2 * FILTERS).astype(np.float32), np.zeros(1, np.float32),
        )

    def windows(self, block: np.ndarray) -> np.ndarray:
        """Embedded windows of some chunks, one row each."""
        vectors = self.embedding[block].reshape(len(block), CHUNK * DEPTH)
        seen = np.lib.stride_tricks.sliding_window_view(vectors, WINDOW * DEPTH, axis=1)[:, :: STRIDE * DEPTH]
        return np.ascontiguousarray(seen)

    def pooled(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest answer of each filter in each chunk, and the window where it is."""
        best, place = np.empty((len(block), FILTERS), np.float32), np.empty((len(block), FILTERS), np.int64)
        for i in range(0, len(block), TOGETHER):
            part = slice(i, i + TOGETHER)
            seen = self.windows(block[part])
            answers = (seen.reshape(-1, WINDOW * DEPTH) @ self.filters).reshape(len(seen), -1, FILTERS)
            place[part] = answers.argmax(axis=1)
            best[part] = np.take_along_axis(answers, place[part][:, None, :], axis=1)[:, 0]
        return np.maximum(best + self.bias, 0), place

    def largest(self, block: np.ndarray) -> np.ndarray:
        out = np.empty((len(block), FILTERS), np.float32)
        for i in range(0, len(block), TOGETHER):
            seen = self.windows(block[i : i + TOGETHER])
            out[i : i + TOGETHER] = (seen.reshape(-1, WINDOW * DEPTH) @ self.filters).reshape(len(seen), -1, FILTERS).max(axis=1)
        return np.maximum(out + self.bias, 0)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row."""
        n = len(offsets) - 1
        block, _, rows = chunks(data, offsets)
        features = np.zeros((n, 2 * FILTERS), np.float32)
        if len(rows):
            found = self.largest(block)
            heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            sizes = np.diff(np.append(heads, len(rows)))
            features[rows[heads], :FILTERS] = np.add.reduceat(found, heads) / sizes[:, None]
            features[rows[heads], FILTERS:] = np.maximum.reduceat(found, heads)
        z = features @ self.weights + self.offset[0]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def fit_network(texts: list[bytes], y: np.ndarray, weight: np.ndarray, seed: int = 11, epochs: int = EPOCHS) -> ByteNetwork:
    """Adam on the weighted logistic loss; gradients pass through the largest answers only."""
    net = ByteNetwork.fresh(seed)
    r = np.random.default_rng(seed + 1)
    cut = []
    for t in texts:
        block, _, _ = chunks(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        cut.append(block)
    moment = {p: (np.zeros_like(getattr(net, p)), np.zeros_like(getattr(net, p))) for p in PARAMETERS}
    steps, total = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            steps += 1
            grads = _gradients(net, [cut[j] for j in order[i : i + BATCH]], y[order[i : i + BATCH]], weight[order[i : i + BATCH]])
            rate = RATE * (1 - steps / (total + 1))
            for p in PARAMETERS:
                m, v = moment[p]
                m += 0.1 * (grads[p] - m)
                v += 0.001 * (grads[p] ** 2 - v)
                getattr(net, p)[...] -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    return net


def _gradients(net: ByteNetwork, blocks: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    out = {p: np.zeros_like(getattr(net, p)) for p in PARAMETERS}
    for block, target, importance in zip(blocks, y, weight):
        n = len(block)
        features = np.zeros(2 * FILTERS, np.float32)
        if n:
            found, place = net.pooled(block)
            top = found.argmax(axis=0)
            features = np.concatenate([found.mean(axis=0), found.max(axis=0)])
        p = 1 / (1 + np.exp(-np.clip(features @ net.weights + net.offset[0], -30, 30)))
        g = np.float32(importance * (p - target) / len(blocks))
        out["weights"] += g * features
        out["offset"] += g
        if not n:
            continue
        back = np.tile(g * net.weights[:FILTERS] / n, (n, 1))
        back[top, np.arange(FILTERS)] += g * net.weights[FILTERS:]
        back = (back * (found > 0)).astype(np.float32)
        at = place[:, :, None] * STRIDE + np.arange(WINDOW)  # bytes under each filter's best window
        seen = block[np.arange(n)[:, None, None], at]
        vectors = net.embedding[seen].reshape(n, FILTERS, WINDOW * DEPTH)
        out["bias"] += back.sum(axis=0)
        out["filters"] += np.einsum("nfw,nf->wf", vectors, back)
        flow = back[:, :, None] * net.filters.T[None]
        np.add.at(out["embedding"], seen.reshape(-1), flow.reshape(-1, DEPTH))
    for p in PARAMETERS[:4]:
        out[p] += 1e-5 * getattr(net, p)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", per_label: int = PER_LABEL) -> ByteNetwork:
    """Fit on at most ``per_label`` labelled documents of each class that may be learnt from; each counts for the rows it stands for."""
    chosen, stands_for = sample(docs, labels, label, per_label, key, text)
    rows = sorted((r["key"], r["y"], r["text"]) for r in chosen.select("key", "y", "text").collect())
    y = np.array([r[1] for r in rows], np.float32)
    if not 0 < y.sum() < len(y):
        net = ByteNetwork.fresh()
        net.weights[:] = 0
        net.offset[0] = -30 if len(y) and not y.sum() else 30
        return net
    weight = np.array([stands_for[int(v)] for v in y], np.float32)
    return fit_network([r[2].encode() for r in rows], y, weight / weight.mean())


def quality_scores(docs: DataFrame, model: ByteNetwork, key: str = "doc_id", text: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for row, data, offsets in text_blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(offsets) - 1), pa.array(model.score(data, offsets))], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def of_quality(docs: DataFrame, model: ByteNetwork, limit: float = 0.3, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that score ``limit`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        model = shared.value
        for batch in batches:
            scores = [model.score(data, offsets) for _, data, offsets in text_blocks(batch.column(at))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= limit))

    return docs.mapInArrow(run, docs.schema)
