"""Toxicity by the nearest labelled examples.

Terms are words and their beginnings, hashed. The vocabulary holds all terms of a bounded sample of labelled documents; none is left
out. A term weighs by its document frequency over all documents, and more the closer it goes with the label in the sample (a
chi-squared statistic). A text is compared with every example by exact cosine of these weights through an inverted index. The short
lists of rare terms are read whole; common terms, whose lists make up most of the index, are kept by blocks of examples with the largest
weight of each term in each block. What the rare terms gave and these maxima bound the cosines in a block; the best blocks are read
first, and then only those whose bound reaches the k-th best cosine. The nearest examples vote with weights that fall with distance, and
a logistic curve turns votes into a probability. It is fitted on the examples themselves, each once left out of its own vote, as a new
text would meet the others, and once with it, as an exact copy would.

Bounds: ``per_label`` examples and ``per_label_bytes`` bytes of text of each class; index and vocabulary are as large as these make them.
The driver gets the examples as places in the vocabulary, four bytes a term, and weighs and sorts them a part at a time.

Defined cases: terms that no example has count for nothing, in the norm neither; null and empty texts, and texts without any term of
the vocabulary, have no neighbours and get the share of the label
among such examples; ties go to the earlier example; equal texts get equal scores; without labelled rows of both classes every score is
the share of the label, or 0; extra columns are not read when scoring and kept when filtering.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labweave.llm.arrays import NOT_ALNUM, prefix_hashes, text_blocks, word_bounds, word_hashes
from labweave.llm.labelled import sample
from labweave.llm.shared import stored

PER_LABEL = 2000
#: The share of its weight that a term keeps without any tie to the label, and the chi-squared value that gives back half of the rest.
LEAST_SHARE, HALF_CHI = 0.1, 30.0
PREFIXES = (4, 5, 6, 7, 8)
NEIGHBOURS, BLOCK = 15, 64
#: Bytes of example texts of each class, at most; the first example is always taken.
PER_LABEL_BYTES = 1 << 24
#: A term is common if more than one of so many examples has it.
COMMON = 16
#: What rounding may do to a cosine at most; how many texts are looked at together.
SLACK, TOGETHER = 1e-5, 128
#: Bytes of texts that a task looks at together.
TEXT_BYTES = 1 << 20
#: Into how many parts the document frequencies are cut on their way to the driver.
PARTS = 256


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of all words and of their beginnings."""
    starts, ends = word_bounds(data, offsets, NOT_ALNUM)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    rows, hashes = [row], [word_hashes(data, starts, ends)]
    for long, hashed in prefix_hashes(data, starts, ends, PREFIXES):
        rows.append(row[long])
        hashes.append(hashed)
    return np.concatenate(rows), np.concatenate(hashes).view(np.int64)


class Vocabulary:
    """Sorted term hashes, with a table of leading bits that turns most other terms away; it is laid out where texts are read."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = (1 << max(16, (8 * len(hashes)).bit_length())) - 1

    @cached_property
    def table(self) -> np.ndarray:
        out = np.zeros(self.bits + 1, bool)
        out[self.hashes & self.bits] = True
        return out

    def __getstate__(self) -> dict:
        return {name: value for name, value in self.__dict__.items() if name != "table"}

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and number of occurrences of the vocabulary's terms, by row and term; each distinct word is looked up once."""
        none = np.zeros(0, np.int64)
        starts, ends = word_bounds(data, offsets, NOT_ALNUM)
        if not len(starts) or not len(self.hashes):
            return none, none, none
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
        distinct, first, word = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        words, hashes = [np.arange(len(distinct))], [distinct]
        for long, hashed in prefix_hashes(data, starts[first], ends[first], PREFIXES):
            words.append(long)
            hashes.append(hashed)
        words, hashes = np.concatenate(words), np.concatenate(hashes).view(np.int64)
        maybe = self.table[hashes & self.bits]
        words, hashes = words[maybe], hashes[maybe]
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        words, at = words[hit], at[hit]
        order = np.argsort(words, kind="stable")
        terms_of, heads = at[order], np.searchsorted(words[order], np.arange(len(distinct) + 1))
        pairs, times = np.unique(row * len(distinct) + word, return_counts=True)
        word = pairs % len(distinct)
        size = heads[word + 1] - heads[word]
        cells = np.repeat(pairs // len(distinct), size) * len(self.hashes) + terms_of[spread(heads[word], size)]
        order = np.argsort(cells, kind="stable")
        cells, times = cells[order], np.repeat(times, size)[order]
        fresh = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])[: len(cells)])
        return cells[fresh] // len(self.hashes), cells[fresh] % len(self.hashes), np.add.reduceat(times, fresh) if len(fresh) else none


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``first[i]`` to ``first[i] + size[i] - 1`` of every i, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(first - np.cumsum(size) + size, size)


@dataclass
class BlockMaxIndex:
    """Examples' unit vectors as postings by term. Examples have places, so that those alike lie in one block. For common terms, a matrix
    by block and the largest weight of each term in each block are laid out where the index is used."""

    heads: np.ndarray  # first posting of each term, one more than terms
    examples: np.ndarray  # place of the example of each posting
    weights: np.ndarray  # rounded to 32 bits; sums are taken in 64
    common: np.ndarray  # row of the term in ``dense``, or -1
    order: np.ndarray  # example at each place
    block: int = BLOCK

    @classmethod
    def build(cls, rows: np.ndarray, cols: np.ndarray, weights: np.ndarray, n_rows: int, n_terms: int, block: int = BLOCK) -> BlockMaxIndex:
        times = np.bincount(cols, minlength=n_terms)
        many = times * COMMON > n_rows
        common = np.where(many, np.cumsum(many) - 1, -1).astype(np.int32)
        # examples that share their heaviest common term lie together, so that blocks differ
        own = np.flatnonzero(many[cols])
        own = own[np.argsort(weights[own], kind="stable")]
        heaviest = np.full(n_rows, -1)
        heaviest[rows[own]] = cols[own]
        del own
        order = np.lexsort((np.arange(n_rows), heaviest)).astype(np.int32)
        place = np.empty(n_rows, np.int32)
        place[order] = np.arange(n_rows, dtype=np.int32)
        heads = np.append(0, np.cumsum(times))
        examples, kept = np.empty(len(cols), np.int32), np.empty(len(cols), np.float32)
        cuts = np.searchsorted(heads, np.linspace(0, len(cols), PARTS // 16 + 1)[:-1].astype(int))
        for a, b in zip(cuts, np.append(cuts[1:], n_terms), strict=True):  # some terms at a time, so that little is sorted together
            some = np.flatnonzero((cols >= a) & (cols < b))
            at = place[rows[some]]
            by_term = np.lexsort((at, cols[some]))
            examples[heads[a] : heads[b]], kept[heads[a] : heads[b]] = at[by_term], weights[some[by_term]]
        return cls(heads, examples, kept, common, order, block)

    @property
    def blocks(self) -> int:
        return max(1, -(-len(self.order) // self.block))

    @cached_property
    def dense(self) -> np.ndarray:
        """Weights of common terms by block, term and place in the block."""
        terms = np.flatnonzero(self.common >= 0)
        size = np.diff(self.heads)[terms]
        posting = spread(self.heads[terms], size)
        out = np.zeros((self.blocks, len(terms), self.block), np.float32)
        at = self.examples[posting]
        out[at // self.block, np.repeat(np.arange(len(terms)), size), at % self.block] = self.weights[posting]
        return out

    @cached_property
    def largest(self) -> np.ndarray:
        """The largest weight of each common term in each block."""
        return np.ascontiguousarray(self.dense.max(axis=2).T)

    def __getstate__(self) -> dict:
        return {name: value for name, value in self.__dict__.items() if name not in ("dense", "largest")}

    def forget(self) -> None:
        """Drops what is laid out again where the index is used next."""
        self.__dict__.pop("dense", None)
        self.__dict__.pop("largest", None)

    def lengths(self, cols: np.ndarray) -> np.ndarray:
        """How many postings are read of each term."""
        return np.where(self.common[cols] < 0, self.heads[cols + 1] - self.heads[cols], 0)

    def nearest(self, cols: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of largest positive cosine, exactly; ties go to the earlier one."""
        return self.nearest_of_all(np.array([0, len(cols)]), cols, weights, k, np.array([without]))[0]

    def nearest_of_all(
        self, heads: np.ndarray, cols: np.ndarray, weights: np.ndarray, k: int, without: np.ndarray, read: list[int] | None = None
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` for many texts; ``read`` receives how many blocks of common terms were read. Products in 32 bits find who may be
        among the ``k``, their cosines are then summed term by term in 64."""
        n, (blocks, terms, block) = len(heads) - 1, self.dense.shape
        text, common = np.repeat(np.arange(n), np.diff(heads)), self.common[cols]
        rare = np.empty((n, blocks, block))
        for i in range(n):  # one text's postings at a time stay in the processor's cache
            own = slice(heads[i], heads[i + 1])
            size = self.lengths(cols[own])
            posting = spread(self.heads[cols[own]], size)
            rare[i] = np.bincount(self.examples[posting], np.repeat(weights[own], size) * self.weights[posting], blocks * block).reshape(blocks, block)
        left_out = np.flatnonzero(without >= 0), self.place[without[without >= 0]]
        scores = rare.astype(np.float32)
        flat = scores.reshape(n, -1)

        def limits() -> np.ndarray:
            flat[left_out] = 0
            return np.partition(flat, -k, axis=1)[:, -k] if flat.shape[1] > k else np.zeros(n, np.float32)

        if terms:
            shares = np.zeros((n, terms), np.float32)
            shares[text[common >= 0], common[common >= 0]] = weights[common >= 0]
            flat[left_out] = 0
            bounds = scores.max(axis=2) + shares @ self.largest
            first = np.zeros((n, blocks), bool)
            np.put_along_axis(first, np.argsort(-bounds, axis=1, kind="stable")[:, : max(1, -(-2 * k // block))], True, axis=1)
            for rest in (False, True):  # the best blocks first, then those that still reach the k-th best
                some = ~first & (bounds > 0) & (bounds + SLACK >= limits()[:, None]) if rest else first
                if read is not None:
                    read.append(int(some.sum()))
                for b in np.flatnonzero(some.any(axis=0)):
                    rows = np.flatnonzero(some[:, b])
                    scores[rows, b] += shares[rows] @ self.dense[b] if len(rows) < n else shares @ self.dense[b]
        out, wide = [], rare.reshape(n, -1)
        for i, least in enumerate(np.maximum(limits() - SLACK, np.finfo(np.float32).tiny)):
            found = np.flatnonzero(flat[i] >= least)
            own = slice(heads[i], heads[i + 1])
            in_dense = common[own] >= 0
            grid = self.dense[found // block, common[own][in_dense][:, None], found % block]
            cosines = wide[i, found] + (weights[own][in_dense][:, None] * grid).sum(axis=0)
            names = self.order[found]
            best = np.lexsort((names, -cosines))[:k]
            out.append((names[best], cosines[best]))
        return out

    @cached_property
    def place(self) -> np.ndarray:
        """Where each example lies."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.arange(len(self.order))
        return out


@dataclass
class ToxicityModel:
    vocabulary: Vocabulary
    idf: np.ndarray
    index: BlockMaxIndex
    labels: np.ndarray
    ids: np.ndarray
    share: float  # of the label among texts without a term of the vocabulary
    curve: np.ndarray

    def vectors(self, rows: np.ndarray, times: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        weights = (1 + np.log(times)) * self.idf[cols]
        norms = np.sqrt(np.bincount(rows, weights * weights, n))
        return weights / np.where(norms > 0, norms, 1)[rows]

    def neighbours(self, heads: np.ndarray, cols: np.ndarray, weights: np.ndarray, selves: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The nearest examples of every row that has terms, with their cosines; ``selves`` are the examples that rows are, left out."""
        for first in range(0, len(heads) - 1, TOGETHER):
            part = heads[first : first + TOGETHER + 1]
            rows = first + np.flatnonzero(np.diff(part))
            if len(rows):
                own = slice(part[0], part[-1])
                without = np.full(len(rows), -1) if selves is None else selves[rows]
                ends = np.append(heads[rows], part[-1]) - part[0]
                found = self.index.nearest_of_all(ends, cols[own], weights[own], NEIGHBOURS, without)
                yield from ((int(r), *x) for r, x in zip(rows, found, strict=True))

    def vote(self, best: np.ndarray, cosines: np.ndarray) -> tuple[float, float]:
        """Share of the label among the neighbours, weighted by closeness, and the largest cosine."""
        weights = 1 / (0.05 + np.maximum(1 - cosines, 0))
        return float((weights * self.labels[best]).sum() / weights.sum()), float(cosines[0])

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(votes) @ self.curve, -30, 30)))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Score, nearest examples and their cosines for every row."""
        n = len(offsets) - 1
        rows, cols, times = self.vocabulary.counts(data, offsets)
        weights = self.vectors(rows, times, cols, n)
        heads = np.searchsorted(rows, np.arange(n + 1))
        votes, scored, near, cosines = [], [], [np.zeros(0, np.int64)] * n, [np.zeros(0)] * n
        for r, best, found in self.neighbours(heads, cols, weights):
            if len(best):
                votes.append(self.vote(best, found))
                scored.append(r)
                near[r], cosines[r] = best, found
        scores = np.full(n, self.share)
        if scored:
            scores[scored] = self.calibrated(np.array(votes))
        return scores, near, cosines


def _features(votes: np.ndarray) -> np.ndarray:
    vote, closest = votes[:, 0], votes[:, 1]
    return np.stack([np.ones(len(votes)), vote, closest, vote * closest], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Coefficients by Newton's method with a small ridge, which also serves classes that separate."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * beta)
        beta = beta + step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _example_hashes(rows: DataFrame) -> np.ndarray:
    """All distinct terms of the examples, sorted; bounded by the examples."""

    def run(batches):
        for batch in batches:
            for _, data, offsets in text_blocks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(terms(data, offsets)[1]))], ["term"])

    return np.sort(rows.select("text").mapInArrow(run, "term bigint").distinct().toArrow()["term"].to_numpy())


def _example_terms(rows: DataFrame, vocabulary: Vocabulary) -> pa.Table:
    """``key``, and as bytes the places in the vocabulary of each example's ``terms`` and how often each occurs in it, ``times``; these
    take one byte each where that is enough for the example, else four."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        vocabulary = shared.value
        for batch in batches:
            for row, data, offsets in text_blocks(batch.column(1), TEXT_BYTES):
                at, cols, times = vocabulary.counts(data, offsets)
                cuts = np.searchsorted(at, np.arange(len(offsets)))
                parts = [(cols[a:b], times[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                listed = [c.astype(np.int32).tobytes() for c, _ in parts], [t.astype(np.uint8 if t.max(initial=0) < 256 else np.int32).tobytes() for _, t in parts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(parts)), *(pa.array(x, pa.binary()) for x in listed)], ["key", "terms", "times"])

    found = rows.select("key", "text").mapInArrow(run, "key bigint, terms binary, times binary").toArrow()
    shared.destroy()
    return found


def _postings(found: pa.Table, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and number of occurrences of ``_example_terms`` by row, the place of the example in ``ids``, and term."""
    order = np.argsort(found["key"].to_numpy(), kind="stable")
    sizes, cols, times = [], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for i in order.tolist():
        own = np.frombuffer(found["terms"][i].as_buffer(), np.int32)
        said = found["times"][i].as_buffer()
        sizes.append(len(own))
        cols.append(own)
        times.append(np.frombuffer(said, np.uint8 if said.size == len(own) else np.int32))
    rows = np.repeat(np.searchsorted(ids, found["key"].to_numpy()[order]).astype(np.int32), sizes)
    narrow = np.uint8 if all(x.dtype == np.uint8 for x in times[1:]) else np.int32
    return rows, np.concatenate(cols), np.concatenate(times, dtype=narrow, casting="unsafe")


def _document_frequencies(docs: DataFrame, vocabulary: Vocabulary, text: str) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and how many there are. A task sends its counts in ``PARTS`` pieces."""
    size, shared = len(vocabulary.hashes), docs.sparkSession.sparkContext.broadcast(vocabulary)
    cuts = np.linspace(0, size, PARTS + 1).astype(int)

    def run(batches):
        vocabulary = shared.value
        found, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for _, data, offsets in text_blocks(batch.column(0), TEXT_BYTES):
                found += np.bincount(vocabulary.counts(data, offsets)[1], minlength=size)
                n += len(offsets) - 1
        pieces = [found[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] + [np.array([n]).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS + 1, dtype=np.int32)), pa.array(pieces, pa.binary())], ["part", "counts"])

    def summed(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in group["counts"].to_pylist())
        return pa.table([group["part"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])

    kind = "part int, counts binary"
    got = docs.select(text).mapInArrow(run, kind).groupBy("part").applyInArrow(summed, kind).toArrow()
    shared.destroy()
    pieces = dict(zip(got["part"].to_pylist(), got["counts"].to_pylist(), strict=True))
    if not pieces:
        return np.zeros(size, np.int64), 0
    return np.frombuffer(b"".join(pieces[i] for i in range(PARTS)), np.int64), int(np.frombuffer(pieces[PARTS], np.int64)[0])


def within_bytes(examples: list[tuple], most: int) -> list[tuple]:
    """Of ``(order, key, label, bytes)`` the first of each label until ``most`` bytes are reached; one at least."""
    kept, used = [], {}
    for order, key, y, size in sorted(examples, key=lambda e: (e[0], e[1])):
        used[y] = used.get(y, 0) + size
        if used[y] <= most or used[y] == size:
            kept.append((key, y))
    return sorted(kept)


def label_shares(cols: np.ndarray, y: np.ndarray, labelled: np.ndarray, n_terms: int) -> np.ndarray:
    """What share of its weight each term keeps, by its chi-squared statistic with the label; ``y`` is that of each posting's example."""
    n, positive = len(labelled), labelled.sum()
    a, both = np.bincount(cols, y, n_terms), np.bincount(cols, minlength=n_terms)
    b = both - a
    c, d = positive - a, n - positive - b
    chi = n * (a * d - b * c) ** 2 / np.maximum(1, both * (c + d) * float(positive) * float(n - positive))
    return LEAST_SHARE + (1 - LEAST_SHARE) * chi / (chi + HALF_CHI)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", per_label: int = PER_LABEL,
    per_label_bytes: int = PER_LABEL_BYTES,
) -> ToxicityModel:
    """Learn from a bounded sample of the labelled rows that may be learnt from; frequencies are those of all ``docs``."""
    chosen, stands_for = sample(docs, labels, label, per_label, key, text)
    chosen = stored(chosen)  # read for terms and labels; at most 2 * per_label texts
    listed = [tuple(r) for r in chosen.select(F.xxhash64("key", F.lit(29)), "key", "y", F.octet_length("text")).collect()]
    examples = within_bytes(listed, per_label_bytes)
    before, after = (np.bincount([e[i] for e in rows], minlength=2) for rows, i in ((listed, 2), (examples, 1))) if listed else (np.ones(2), np.ones(2))
    stands_for = {v: stands_for.get(v, 1.0) * before[v] / max(1, after[v]) for v in (0, 1)}
    ids, y = np.array([e[0] for e in examples], np.int64), np.array([e[1] for e in examples], np.float64)
    n, positive = len(y), float(y.sum())
    chosen = chosen if len(examples) == len(listed) else chosen.where(F.col("key").isin(ids.tolist()))
    hashes = _example_hashes(chosen)
    vocabulary = Vocabulary(hashes)
    rows, cols, times = _postings(_example_terms(chosen, vocabulary), ids)
    frequency, total = _document_frequencies(docs, vocabulary, text)
    idf = (np.log((1 + total) / (1 + frequency)) + 1e-3) * label_shares(cols, y[rows], y, len(hashes))
    model = ToxicityModel(vocabulary, idf, None, y, ids, 0.0, np.zeros(4))
    heads = np.searchsorted(rows, np.arange(n + 1))
    parts = [(a, min(a + TOGETHER, n)) for a in range(0, n, TOGETHER)]

    def vectors(a: int, b: int) -> np.ndarray:  # of some examples at a time, as the wide numbers of all take room
        own = slice(heads[a], heads[b])
        return model.vectors(rows[own] - a, times[own].astype(np.int64), cols[own], b - a)

    weights = np.empty(len(cols), np.float32)
    for a, b in parts:
        weights[heads[a] : heads[b]] = vectors(a, b)
    model.index = BlockMaxIndex.build(rows, cols, weights, n, len(hashes))
    del weights
    weight = np.array([stands_for[int(v)] for v in y])
    votes, voters, copies = [], [], []
    with_terms = np.flatnonzero(np.diff(heads))
    for a, b in parts:
        own = slice(heads[a], heads[b])
        for r, best, cosines in model.neighbours(heads[a : b + 1] - heads[a], cols[own], vectors(a, b), np.arange(a, b)):
            copies.append(model.vote(np.append(a + r, best[: NEIGHBOURS - 1]), np.append(1.0, cosines[: NEIGHBOURS - 1])))
            if len(best):
                votes.append(model.vote(best, cosines))
                voters.append(a + r)
    alone = np.setdiff1d(np.arange(n), voters)
    model.share = float((weight[alone] @ y[alone] + 0.5) / (weight[alone].sum() + 1)) if len(alone) else float((weight @ y) / max(weight.sum(), 1))
    if not positive:
        model.share = 0.0
    seen = np.append(voters, with_terms).astype(np.int64)
    if 0 < y[seen].sum() < len(seen):
        model.curve = logistic(_features(np.array(votes + copies)), y[seen], weight[seen])
    elif len(seen):
        p = min(max(float((weight @ y) / weight.sum()), 1e-6), 1 - 1e-6)
        model.curve = np.array([np.log(p / (1 - p)), 0, 0, 0])
    model.index.forget()
    return model


def toxicity_scores(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``score`` and the evidence: ids and cosines of the examples that voted, nearest first."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for row, data, offsets in text_blocks(batch.column(1), TEXT_BYTES):
                scores, near, cosines = model.score(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(scores)), pa.array(scores),
                        pa.array([model.ids[x] for x in near], pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64())),
                    ],
                    ["key", "score", "evidence", "cosines"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, score double, evidence array<bigint>, cosines array<double>").withColumnRenamed("key", key)


def without_toxic(docs: DataFrame, model: ToxicityModel, limit: float = 0.5, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that score below ``limit``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        model = shared.value
        for batch in batches:
            scores = [model.score(data, offsets)[0] for _, data, offsets in text_blocks(batch.column(at), TEXT_BYTES)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < limit))

    return docs.mapInArrow(run, docs.schema)
