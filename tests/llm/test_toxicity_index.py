"""Toxicity from text to score against plain cosines, and what the block maxima spare."""

from __future__ import annotations

import math
import pickle
import random
import re
from collections import Counter

import numpy as np
import pytest

from labweave.llm import toxicity
from labweave.llm.arrays import text_blocks

DOCS = "doc_id bigint, text string"


def plain_terms(text):
    """Words and their beginnings, as strings."""
    out = Counter()
    for word in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text or ""):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in word).encode()
        out[low, 0] += 1
        for width in toxicity.PREFIXES:
            if len(low) > width:
                out[low[:width], width] += 1
    return out


def made_texts(n, seed):
    r = random.Random(seed)
    syllables = "an be co di en fo gu hi it ka lo mu ne or pa qui re so tu ve".split()
    words = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(300)]
    return [" ".join(r.choices(words, weights=[1 / (i + 1) for i in range(300)], k=r.randint(0, 60))) + (" É nastyword" if i % 4 == 0 else "") for i in range(n)]


def test_scores_equal_plain_cosines(spark):
    texts = made_texts(160, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    counted = [plain_terms(t) for t in texts]
    ids, y = model.ids.tolist(), dict(zip(model.ids.tolist(), model.labels))
    known = set().union(*(counted[i] for i in ids))
    frequency = Counter(t for c in counted for t in c if t in known)
    p = sum(y.values())
    idf = {}
    for t in known:
        a = sum(y[i] for i in ids if t in counted[i])
        b = sum(1 - y[i] for i in ids if t in counted[i])
        c, d = p - a, len(ids) - p - b
        chi = len(ids) * (a * d - b * c) ** 2 / max(1, (a + b) * (c + d) * p * (len(ids) - p))
        share = toxicity.LEAST_SHARE + (1 - toxicity.LEAST_SHARE) * chi / (chi + toxicity.HALF_CHI)
        idf[t] = (math.log((1 + len(texts)) / (1 + frequency[t])) + 1e-3) * share

    def vector(i):
        v = {t: (1 + math.log(n)) * idf[t] for t, n in counted[i].items() if t in known}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / norm for t, x in v.items()}

    vectors = {i: vector(i) for i in range(160)}
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, model).collect()}
    for i in range(160):
        cosines = {j: sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()) for j in ids}
        best = sorted((j for j in ids if cosines[j] > 0), key=lambda j: -cosines[j])[: toxicity.NEIGHBOURS]
        assert np.allclose(got[i]["cosines"], [cosines[j] for j in best], atol=1e-6)
        assert np.allclose([cosines[j] for j in got[i]["evidence"]], got[i]["cosines"], atol=1e-6)
        if best:
            near = 1 / (0.05 + np.maximum(1 - np.array([cosines[j] for j in best]), 0))
            vote, first = float(near @ [y[j] for j in best] / near.sum()), cosines[best[0]]
            odds = float(np.array([1, vote, first, vote * first]) @ model.curve)
            assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-3) or len(got[i]["evidence"]) == toxicity.NEIGHBOURS
    assert sum((r["score"] >= 0.5) == (i % 4 == 0) for i, r in got.items()) > 155


def test_counts_equal_plain_counts():
    texts = ["aaaa aaaab aaaab", "", "Zz zz ZZ é é longlonglonglong longlonglonglos", None, "x"] + made_texts(40, 2)
    import pyarrow as pa

    (_, data, offsets), = text_blocks(pa.array(texts))
    rows, hashes = toxicity.terms(data, offsets)
    vocabulary = toxicity.Vocabulary(np.unique(hashes)[::2])  # half of the terms are known
    want = Counter((r, h) for r, h in zip(rows.tolist(), hashes.tolist()) if h in set(vocabulary.hashes.tolist()))
    r, c, n = vocabulary.counts(data, offsets)
    assert {(a, int(vocabulary.hashes[b])): t for a, b, t in zip(r.tolist(), c.tolist(), n.tolist())} == dict(want)
    assert (np.diff(r) >= 0).all()


def test_blocks_out_of_reach_are_not_read():
    r = np.random.default_rng(5)
    group = r.integers(0, 8, 1600)  # examples of eight kinds with common terms of their own
    own = (np.arange(240) // 30)[None, :] == group[:, None]
    dense = np.where(own, r.random((1600, 240)) < 0.5, 0.1 * (r.random((1600, 240)) < 0.01)) * r.random((1600, 240))
    rows, cols = np.nonzero(dense)
    index = toxicity.BlockMaxIndex.build(rows, cols, dense[rows, cols], 1600, 240)
    asked = [np.flatnonzero(dense[i]) for i in range(64)]
    heads = np.append(0, np.cumsum([len(a) for a in asked]))
    cols, weights, read = np.concatenate(asked), np.concatenate([dense[i, a] for i, a in enumerate(asked)]), []
    got = index.nearest_of_all(heads, cols, weights, 15, np.arange(64), read)
    assert sum(read) < 64 * index.blocks / 2
    exact = index.weights  # as rounded in the index
    held = np.zeros_like(dense)
    held[index.order[index.examples], np.repeat(np.arange(240), np.diff(index.heads))] = exact
    for i, (best, cosines) in enumerate(got):
        scores = held @ np.where(np.isin(np.arange(240), asked[i]), dense[i], 0)
        scores[i] = 0
        assert best.tolist() == np.argsort(-scores, kind="stable")[:15].tolist() and np.allclose(cosines, scores[best])


def test_examples_are_bounded_by_bytes():
    rows = [(5, 1, 0, 10), (1, 2, 0, 60), (2, 3, 0, 50), (3, 4, 1, 500), (4, 5, 1, 1), (9, 6, 0, 0)]
    assert toxicity.within_bytes(rows, 100) == [(2, 0), (4, 1)]
    assert toxicity.within_bytes(rows, 10_000) == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 0)]
    assert toxicity.within_bytes([], 5) == []


def test_lookup_table_is_not_sent():
    vocabulary = toxicity.Vocabulary(np.sort(np.random.default_rng(5).integers(-(1 << 62), 1 << 62, 20_000)))
    table = vocabulary.table.copy()
    sent = pickle.dumps(vocabulary)
    assert len(sent) < 8 * 20_000 + 2_000 < len(table)
    assert np.array_equal(pickle.loads(sent).table, table)


def test_driver_holds_examples_narrow(spark):
    """Four bytes for a term's place and one for its times, four for those of a text that repeats a term often; no matrix stays laid out."""
    texts = [t or "word" for t in made_texts(40, 3)] + ["often " * 300 + "once"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    rows = docs.withColumnRenamed("doc_id", "key")
    vocabulary = toxicity.Vocabulary(toxicity._example_hashes(rows))
    found = toxicity._example_terms(rows, vocabulary)
    bytes_of = {k.as_py(): (len(a.as_py()), len(n.as_py())) for k, a, n in zip(found["key"], found["terms"], found["times"], strict=True)}
    counted = [plain_terms(t) for t in texts]
    assert len(vocabulary.hashes) == len(set().union(*counted))
    assert bytes_of == {i: (4 * len(c), len(c) * (4 if i == 40 else 1)) for i, c in enumerate(counted)}
    at, _, times = toxicity._postings(found, np.arange(41))
    assert [sorted(times[at == i].tolist()) for i in range(41)] == [sorted(c.values()) for c in counted]
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(41)], "doc_id bigint, toxic int"))
    assert not {"dense", "largest"} & set(model.index.__dict__)
