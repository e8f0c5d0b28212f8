"""Text operators against brute-force versions, and their defined odd cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labweave.llm import components, labelled, minhash, packing, personal, pieces, quality, sharding, suite, tool_calls, toxicity, vector_search, winnowing
from labweave.llm.arrays import WHITE_SPACE, hashed_words, shingle_hashes, text_blocks

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Nulls in every column, empty and blank texts, a long one, ties and repeated rows.
ODD = [
    (1, None, "en", "a", 0), (2, "", None, None, None), (3, "  \n ", "en", "a", 4), (None, "some words without an id here", "en", "a", 1),
    (4, "word " * 40_000, "en", "b", 1), (5, "one two three four five six", "en", "a", 1), (6, "one two three four five six", "en", "a", 1),
    (6, "one two three four five six", "en", "a", 1), (7, "ONE two\tthree FOUR five six", "en", None, 1), (8, "é日本🙂 ▁ a@b.example +49 170 1234567", "de", "c", 2),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with columns whose names the operators use themselves."""
    rows = spark.createDataFrame(ODD, DOCS)
    return rows.withColumn("score", F.lit("x")).withColumn("id", F.lit("y")).withColumn("bucket", F.lit(0)).withColumn("size", F.lit("z")).withColumn("_at", F.lit(1))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(frame):
    return {r["doc_id"]: r["text"] for r in frame.select("doc_id", "text").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_groups(texts, n, percent=80):
    sets, root = {k: shingles(t, n) for k, t in texts.items()}, {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for k in sorted(sets):
        near = defaultdict(int)
        for s in sets[k]:
            for o in holders[s]:
                near[o] += 1
            holders[s].append(k)
        for o, both in near.items():
            if 100 * both >= percent * (len(sets[k]) + len(sets[o]) - both):
                a, b = sorted((find(k), find(o)))
                root[b] = a
    return {k: (len(sets[k]), find(k)) for k in sets}


# hashing


def test_shingles_against_sets():
    texts = ["a b", "", None, "  ", "A B", "a b c d e", "b a", "x", "a b c d a b c d"]
    _, data, offsets = next(text_blocks(pa.array(texts)))
    rows, hashes = shingle_hashes(*hashed_words(data, offsets, WHITE_SPACE), 4)
    found = defaultdict(set)
    for r, h in zip(rows.tolist(), hashes.tolist()):
        found[r].add(h)
    assert [len(found[i]) for i in range(len(texts))] == [len(shingles(t, 4)) for t in texts]
    assert found[0] == found[4] != found[6]
    assert found[5] < found[5] | found[8]


def test_text_blocks_cover_all_rows():
    column = pa.array(["abc", None, "", "x" * 100, "é"]).slice(1)
    blocks = list(text_blocks(column, 10))
    assert sum(len(o) - 1 for _, _, o in blocks) == 4
    assert b"".join(d.tobytes() for _, d, _ in blocks) == ("x" * 100 + "é").encode()


# 1 toxicity, 4 quality


def test_nearest_examples_are_exact():
    r = np.random.default_rng(2)
    dense = (r.random((300, 40)) < 0.2) * np.round(r.random((300, 40)), 1)
    rows, cols = np.nonzero(dense)
    index = toxicity.BlockMaxIndex.build(rows, cols, dense[rows, cols], 300, 40, block=toxicity.BLOCK)
    for _ in range(50):
        own = np.flatnonzero(r.random(40) < 0.2)
        if not len(own):
            continue
        weights = r.random(len(own))
        scores = dense[:, own] @ weights
        best, found = index.nearest(own, weights, 15)
        order = [i for i in np.lexsort((np.arange(300), -np.round(scores, 12))) if scores[i] > 0][:15]
        assert np.allclose(found, scores[order])
        assert set(best) == set(order) or np.isclose(found[-1], scores[order[-1]])


def test_nearest_examples_with_rare_and_common_terms():
    r = np.random.default_rng(4)
    share = np.where(np.arange(200) < 20, 0.5, 0.02)
    dense = (r.random((700, 200)) < share) * r.random((700, 200))
    rows, cols = np.nonzero(dense)
    index = toxicity.BlockMaxIndex.build(rows, cols, dense[rows, cols], 700, 200)
    assert 0 < index.dense.shape[1] < 200 and len(index.examples)
    for i in range(100):
        own = np.flatnonzero(r.random(200) < share)
        weights = r.random(len(own)) * np.where(own < 20, 0.05, 1)  # common terms weigh little, so blocks are left out
        scores = dense[:, own] @ weights
        without = i if i % 2 else -1
        if without >= 0:
            scores[without] = 0
        best, found = index.nearest(own, weights, 15, without)
        order = [x for x in np.argsort(-scores, kind="stable") if scores[x] > 0][:15]
        assert np.allclose(found, scores[order]) and np.allclose(scores[best], found) and len(set(best)) == len(order)


def test_toxic_texts_of_rare_wording_are_found(spark):
    """No term of a toxic example is in five examples of its kind, so none goes with the label."""
    r = random.Random(3)
    common, word = ["".join(r.choices("abcdefghijklm", k=6)) for _ in range(40)], lambda: "".join(r.choices("nopqrstuvwxyz", k=6))
    rows = [(i, " ".join(r.choices(common, k=20) + [word() for _ in range(4)]), "en", "s", 1) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame([*rows, *((1000 + row[0], *row[1:]) for row in rows)], DOCS)
    model = toxicity.fit(docs, labels)
    got = {x["doc_id"]: x for x in toxicity.toxicity_scores(docs, model).collect()}
    kept = {x["doc_id"] for x in toxicity.without_toxic(docs, model).select("doc_id").collect()}
    assert len(model.ids) > 30
    for i in model.ids.tolist():
        row = got[1000 + i]
        assert row["evidence"][0] == i and row["cosines"][0] == pytest.approx(1)
        assert (row["score"] >= 0.5) == (i % 3 == 0) == (1000 + i not in kept)


def test_every_term_of_the_examples_counts(spark):
    docs = spark.createDataFrame([(i, f"only{i} shared words", "en", "s", 1) for i in range(40)], DOCS)
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    texts = pa.array([f"only{i} shared words" for i in model.ids.tolist()])
    (_, data, offsets), = text_blocks(texts)
    assert set(toxicity.terms(data, offsets)[1].tolist()) == set(model.vocabulary.hashes.tolist())
    assert (model.idf > 0).all()


def test_labels_of_held_out_rows_are_never_read(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    kept = {r["key"] for r in labelled.training_labels(rows, "toxic").collect()}
    assert kept == {i for i in range(2000) if zlib.crc32(str(i).encode()) % 5}


def held_out_accuracy(spark, name, label, limit):
    scored = suite.QUERIES[name](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    return scored.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]


def test_toxicity_accuracy(spark):
    assert held_out_accuracy(spark, "op1_toxicity", "toxic", 0.5) > 0.95


def test_quality_accuracy(spark):
    assert held_out_accuracy(spark, "op4_quality", "quality", 0.3) > 0.95


def test_classifiers_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)] + [(None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    none = labels.limit(0)
    for module, scores, keep, label in ((toxicity, toxicity.toxicity_scores, toxicity.without_toxic, "toxic"), (quality, quality.quality_scores, quality.of_quality, "quality")):
        for known in (labels, none):
            model = module.fit(odd, known, label)
            got = scores(odd, model).collect()
            assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
            same = {r["score"] for r in got if r["doc_id"] in (5, 6)}
            assert len(same) == 1
            kept = keep(odd, model)
            assert kept.columns == odd.columns
        assert keep(odd, module.fit(odd, none, label)).count() == len(ODD)  # nothing is known, so nothing goes
        assert scores(empty, module.fit(empty, none, label)).count() == 0


def test_chunks_cover_every_byte():
    for n in (0, 1, quality.CHUNK - 1, quality.CHUNK, quality.CHUNK + 1, 3000):
        data = np.arange(1, n + 1).astype(np.uint8) | 1
        block, sizes, rows = quality.chunks(data, np.array([0, n]))
        assert len(block) == (0 if not n else 1 + max(0, -(-(n - quality.CHUNK) // quality.STEP)))
        assert not len(block) or (len(block) - 1) * quality.STEP + sizes[-1] == n


# 2 packing


def test_best_fit_is_the_tightest_compatible_bin():
    r = random.Random(4)
    sizes = sorted((r.randint(1, 60) for _ in range(400)), reverse=True)
    sources, clusters = [r.choice(["a", "a", "b", "c", None, *range(20)]) for _ in sizes], [r.choice([None, *range(100)]) for _ in sizes]
    bins, begins = packing.best_fit(sizes, sources, clusters, 100)
    held: list[list] = []
    for i, (size, source, cluster) in enumerate(zip(sizes, sources, clusters)):
        fits = [
            (100 - sum(sizes[j] for j in b) - size, n) for n, b in enumerate(held)
            if sum(sizes[j] for j in b) + size <= 100 and (source is None or all(sources[j] != source for j in b)) and (cluster is None or all(clusters[j] != cluster for j in b))
        ]
        want = min(fits)[1] if fits else len(held)
        assert bins[i] == want
        if want == len(held):
            held.append([])
        assert begins[i] == sum(sizes[j] for j in held[want])
        held[want].append(i)


def test_packing_keeps_every_byte_once(spark, docs, odd, empty):
    for rows in (docs, odd):
        got = packing.pack_texts(rows, capacity=4096, block_rows=64).toPandas()
        sizes = [len((t or "").encode()) + 1 for t in [r["text"] for r in rows.select("text").collect()]]
        assert got["length"].sum() == sum(sizes) and (got["used"] <= 4096).all()
        assert (got.groupby("bin")["length"].sum() == got.groupby("bin")["used"].first()).all()
        ends = got.sort_values(["bin", "at"])
        assert (ends["at"] == ends.groupby("bin")["length"].cumsum() - ends["length"]).all()
    source = dict(docs.select("doc_id", "source").collect())
    joined = packing.pack_texts(docs).toPandas()
    joined["source"] = joined["doc_id"].map(source)
    assert not joined.dropna().duplicated(["bin", "source"]).any()
    assert packing.pack_texts(empty).count() == 0


# 3 near duplicates


def test_groups_against_all_pairs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_groups(texts_of(rows), 4)
    got = suite.op3_minhash_near_dedup(spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in got)


def test_groups_of_edited_copies(spark):
    """Copies of one text with edits of their own at many rates: some link to the original only, some to none."""
    r = random.Random(9)
    base = [f"w{r.randint(0, 999)}" for _ in range(150)]
    texts = {0: " ".join(base)}
    for i in range(1, 120):
        copy = list(base)
        for _ in range(r.randint(0, 9)):
            copy[r.randrange(150)] = f"x{r.randint(0, 10**6)}"
        texts[i] = " ".join(copy)
    texts |= {200 + i: texts[i % 3] for i in range(60)}
    # the smallest id is a bad leader
    texts[-1] = " ".join([*base[:120], *(f"z{i}" for i in range(30))])
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), 4).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute_groups(texts, 4)


def test_groups_on_odd_rows(odd, empty):
    got = minhash.near_duplicates(odd, 4).collect()
    assert len(got) == len(ODD)
    by = {x["doc_id"]: x for x in got}
    assert [by[i]["n_shingles"] for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert by[5]["component_id"] == by[6]["component_id"] == by[7]["component_id"] == 5
    assert by[None]["kept"] and by[None]["component_id"] is None
    kept = minhash.without_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(x["doc_id"] or 0 for x in kept.collect()) == [0, 1, 2, 3, 4, 5, 8]
    assert minhash.near_duplicates(empty, 4).count() == 0


def test_min_max_agreement_estimates_similarity():
    r = np.random.default_rng(1)
    shared, own = r.integers(0, 2**63, 400).astype(np.uint64), r.integers(0, 2**63, (2, 100)).astype(np.uint64)
    got = []
    for i in range(30):
        pool = [np.concatenate([shared, own[j]]) ^ np.uint64(i * 7919) for j in (0, 1)]
        s = minhash.signatures(np.concatenate(pool), np.array([0, 500, 1000]))
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - 400 / 600) < 0.02


def test_components_of_chains_and_stars(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(r.randint(1000, 1100), r.randint(1000, 1100)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}


# 5 personal data


def brute_identifiers(t):
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and personal.luhn(d)],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15],
    }


def test_plain_identifiers_against_patterns(docs):
    r = random.Random(5)
    random_texts = ["".join(r.choice("a.@0123456789- +()_%é") for _ in range(r.randint(0, 80))) for _ in range(5000)]
    for t in [*random_texts, *texts_of(docs).values()]:
        assert personal.identifiers(t) == brute_identifiers(t)


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("mail john (at) example [dot] com now", "email", "john (at) example [dot] com"),
    ("john.doe at example dot co dot uk today", "email", "john.doe at example dot co dot uk"),
    ("јоhn@ехаmрlе.соm", "email", "јоhn@ехаmрlе.соm"),
    ("call plus four nine one seven zero one two three four five six seven now", "phone", "plus four nine one seven zero one two three four five six seven"),
    ("call ＋４９ １７０ １２３４５６７", "phone", "＋４９ １７０ １２３４５６７"),
    ("192 [.] 168 [.] 0 [.] 1", "ip", "192 [.] 168 [.] 0 [.] 1"),
    ("one nine two dot one six eight dot zero dot one x", "ip", "one nine two dot one six eight dot zero dot one"),
    ("four five three nine one four eight eight zero three four three six four six seven", "card", "four five three nine one four eight eight zero three four three six four six seven"),
])
def test_disguised_identifiers(text, kind, found):
    base, every = personal.find(text)
    assert not any(base.values())
    assert [text[a:b] for a, b in every[kind]] == [found]
    assert personal.redacted(text) == text.replace(found, f"<{kind.upper()}>")


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("mail john [at] example dot com now", "email", "john [at] example dot com"),
    ("mail john at example [dot] com now", "email", "john at example [dot] com"),
    ("mail john@example dot com now", "email", "john@example dot com"),
    ("mail john@mail dot example dot co (dot) uk now", "email", "john@mail dot example dot co (dot) uk"),
    ("host 192 dot 168 dot 1 dot 10 is up", "ip", "192 dot 168 dot 1 dot 10"),
    ("host 192 [dot] 168 dot one.10 is up", "ip", "192 [dot] 168 dot one.10"),
])
def test_mixed_disguises(text, kind, found):
    base, every = personal.find(text)
    assert not any(base.values())
    assert [text[a:b] for a, b in every[kind]] == [found]
    assert personal.redacted(text) == text.replace(found, f"<{kind.upper()}>")


def test_plain_domains_and_versions_are_not_disguises():
    for text in ("look at example.com, not at example.org", "see it at example.com (dot) now", "section 1.2 dot 3 only", "@ home. dot com"):
        assert not any(personal.find(text)[1].values())
    for text in ("a at b@" * 30_000 + " dot com", "1." * 100_000 + " dot @ at ", "a@b dot " * 30_000, "1 dot " * 50_000):
        personal.find(text)


def test_prose_has_no_disguised_identifiers():
    for text in ("look at the dot on the map", "un deux et trois", "meet at noon. one two", "un un un", "(at) last [dot]"):
        assert not any(personal.find(text)[1].values())


def test_long_hostile_texts_take_linear_time():
    for text in ("1" * 200_000, "1." * 100_000, "a@" * 50_000, "+" + "1 " * 100_000, "one " * 50_000, "[at " * 50_000, "a at b" + " dot c" * 20_000):
        personal.find(text)


def test_personal_columns_on_odd_rows(odd, empty):
    got = {r["doc_id"]: r for r in personal.personal_spans(odd).collect()}
    assert got[1]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[8]["spans"] == got[8]["base_spans"] and (got[8]["n_email"], got[8]["n_phone"]) == (1, 1)
    clean = personal.redact(odd)
    assert clean.columns == odd.columns
    after = {r["doc_id"]: r for r in clean.collect()}
    assert after[1]["text"] is None and after[8]["text"].endswith("<EMAIL> <PHONE>") and after[8]["n_chars"] == len(after[8]["text"]) and after[5]["n_chars"] == 1
    assert personal.personal_spans(empty).count() == 0


# 6 tool calls


def test_tool_calls_are_ordered_and_checked(spark):
    calls = spark.createDataFrame([
        (1, 5, "a", "search", '{"query": "x", "limit": 3}', []), (1, 1, "b", "search", '{ "limit":3,"query":"x\\u00e9" }', ["a"]), (1, 2, "c", "nothing", "{}", ["a", "b", "gone"]),
        (1, 3, "d", "search", '{"limit":99,"query":1,"more":2}', ["e"]), (1, 3, "e", "search", "[1]", ["d"]), (1, 3, "f", "search", None, None), (1, 9, "a", "search", "{}", ["f"]),
        (2, 0, "a", "search", '{"query":"y"}', []), (None, 0, "a", "search", "{}", []),
    ], "conv_id bigint, turn bigint, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, "a", 'said "yes"\n'), (1, "z", "lost"), (2, None, "x")], "conv_id bigint, call_id string, content string")
    got = {(r["conv_id"], r["call_id"]): r for r in tool_calls.link_tool_calls(calls, results, tool_calls.CONVERSATION_TOOLS).collect()}
    assert len(got) == 7
    assert {k[1]: r["level"] for k, r in got.items() if k[0] == 1} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "f": 0}
    assert got[1, "c"]["unresolved"] == 1 and got[1, "c"]["problems"] == "unknown tool"
    assert got[1, "d"]["problems"] == "limit: out of range;query: not string;more: unknown"
    assert got[1, "e"]["problems"] == got[1, "f"]["problems"] == "arguments: no object"
    assert got[2, "a"]["problems"] == "limit: missing" and not got[2, "a"]["linked"]
    assert got[1, "a"]["json"] == '{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search","result":"said \\"yes\\"\\n"}'
    assert got[1, "b"]["json"] == '{"arguments":{"limit":3,"query":"xé"},"id":"b","name":"search","result":null}'


def test_tool_calls_stay_in_the_jvm(spark):
    plan = suite.op6_tool_calls(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 7 sharding


def test_shards_match_the_mixture(spark, docs, empty, odd):
    for bucket_rows in (7, 20_000):
        got = sharding.stratified_shards(docs.select("doc_id", "source"), "doc_id", "source", 8, bucket_rows=bucket_rows).toPandas()
        counts = got.groupby("shard").size()
        assert len(got) == docs.count() and counts.max() - counts.min() <= 1
        assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
        mixture = got.groupby(["source", "shard"]).size().unstack(fill_value=0)
        assert (mixture.max(axis=1) - mixture.min(axis=1)).max() <= 2
        if bucket_rows == 7:
            first = got.sort_values("doc_id")[["doc_id", "shard", "slot"]].values.tolist()
    # brute force: seeded order inside each source, then fractions
    by = defaultdict(list)
    for r in docs.select("doc_id", "source").collect():
        by[r["source"]].append((hashlib.md5(f"17:{r['doc_id']}".encode()).hexdigest()[:13], r["doc_id"]))
    order = sorted((((i + 0.5) / len(v)), s, h, d) for s, v in by.items() for i, (h, d) in enumerate(sorted(v)))
    n = len(order)
    want = sorted([d, p * 8 // n, p - -(-(p * 8 // n) * n // 8)] for p, (_, _, _, d) in enumerate(order))
    assert first == want
    assert sharding.stratified_shards(odd.select("doc_id", "source"), "doc_id", "source", 3).count() == len(ODD)
    assert sharding.stratified_shards(empty.select("doc_id", "source"), "doc_id", "source", 3).count() == 0


def test_sharding_columns(spark, docs):
    got = {r["doc_id"]: r for r in suite.op7_sharding(spark, SF).collect()}
    for k, t in texts_of(docs).items():
        assert got[k]["size"] == len(t.encode()) + 1 and got[k]["text_crc32"] == zlib.crc32(t.encode())


# 8 exact search


def test_exact_search_against_brute_force(spark):
    r = np.random.default_rng(7)
    for scale, blocks in ((1, 37), (40, 4096)):
        base = np.round(r.normal(0, scale, (300, 24)), 1).astype(np.float32)
        base[50:120] = base[50]  # a very common vector
        rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(1000, None), (1001, [1.0, None]), (1002, [float("nan")]), (1003, [float("inf")]), (None, [1.0]), (1020, [0.5]), (1040, [])]
        vectors = vector_search.integer_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
        got = vector_search.exact_top(vectors, vectors.where("id % 20 = 0"), 20, block_rows=blocks).collect()
        whole = {i: np.floor(64 * v.astype(np.float64)).astype(np.int64) for i, v in enumerate(base)} | {1020: np.array([32] + [0] * 23), 1040: np.zeros(24, np.int64)}
        want = []
        for q in (i for i in whole if i % 20 == 0):
            order = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:20]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(order)]
        assert sorted(tuple(x) for x in got) == sorted(want)
    none = vectors.limit(0)
    assert vector_search.exact_top(none, none).count() == 0


def test_segment_bound_is_never_below():
    r = np.random.default_rng(3)
    a, b = r.normal(size=(40, 50)), r.normal(size=(60, 50))
    for segments in (1, 4, 16, 50):
        assert (vector_search.segment_statistics(a, segments) @ vector_search.segment_statistics(b, segments).T >= a @ b.T - 1e-9).all()


# 9 winnowing


def brute_winnow(codes, k, w):
    hashes = (winnowing.gram_hashes(codes, min(k, len(codes))) >> np.uint64(winnowing.BITS)).tolist() if len(codes) else []
    out = []
    for s in range(max(1, len(hashes) - w + 1) if hashes else 0):
        window = hashes[s : s + w]
        place = s + max(i for i, x in enumerate(window) if x == min(window))
        if not out or out[-1] != place:
            out.append(place)
    return out


def test_winnowing_against_windows(monkeypatch):
    r = random.Random(3)
    for piece in (winnowing.PIECE, 64):
        monkeypatch.setattr(winnowing, "PIECE", piece)
        for n in (0, 1, 3, 4, 8, 9, 200):
            codes = np.array([r.choice([97, 98]) for _ in range(n)], np.uint32)
            assert winnowing.winnow(codes, 4, 5)[1].tolist() == brute_winnow(codes, 4, 5)


def test_shared_passages_are_guaranteed():
    r = random.Random(1)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        passage = text(winnowing.K + winnowing.W - 1)
        a, b = (winnowing.winnow(winnowing.code_points(text(r.randint(0, 90)) + passage + text(r.randint(0, 90))))[0] for _ in range(2))
        assert set(a.tolist()) & set(b.tolist())


def test_edited_neighbours_against_lists(docs, odd, empty):
    for rows, size in ((docs, 30_000), (docs, 1 << 30), (odd.where("doc_id is not null").dropDuplicates(["doc_id"]), 10)):
        texts = {k: t or "" for k, t in texts_of(rows).items()}
        ids = sorted(texts, reverse=True)
        got = {r["doc_id"]: r for r in winnowing.edited_neighbours(rows, bucket_bytes=size).collect()}
        assert set(got) == set(ids)
        for i, k in enumerate(ids):
            other = texts[ids[(i + 1) % len(ids)]]
            cut = len(texts[k]) // 3
            edited = texts[k][: len(texts[k]) - cut] + other[:cut]
            own, new, beside = (set(winnowing.winnow(winnowing.code_points(t))[0].tolist()) for t in (texts[k], edited, other))
            near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
            r = got[k]
            assert (r["n_chars"], r["edited_sha256"]) == (len(texts[k]), hashlib.sha256(edited.encode()).hexdigest())
            assert (r["near_edited"], r["near_next"]) == (pytest.approx(near(own, new)), pytest.approx(near(own, beside)))
    same = {r["fingerprint"] for r in winnowing.edited_neighbours(odd).where("doc_id in (5, 6)").collect()}
    assert len(same) == 1 and winnowing.edited_neighbours(odd).count() == len(ODD)
    assert winnowing.edited_neighbours(empty).count() == 0


# 10 pieces


@pytest.fixture(scope="module")
def tokenizer():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=suite.tokenizer_model())


def test_pieces_equal_the_library(docs, tokenizer):
    model = pieces.PieceModel(pieces.read_model(suite.tokenizer_model()))
    r = random.Random(1)
    made = ["".join(r.choice("ab  \n\t▁é日🙂1٣.Thein\0​") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts = ["", " ", "  ", "▁", "a▁b", " ▁", "a" * 5000, "ab" * 3000, "日本" * 500, *made, *texts_of(docs).values()]
    for text, (ids, begins, ends) in zip(texts, pieces._encoded(model, pa.array(texts))):
        assert ids.tolist() == tokenizer.encode(text) and model.decode(ids) == tokenizer.decode(ids.tolist())
        assert b"".join(text.encode()[a:b] for a, b in zip(begins, ends)) == text.encode()


def test_normalising_keeps_offsets(tokenizer):
    """A model with a compiled character map and squeezed white space, made from the public one."""
    from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as schema

    proto = schema.ModelProto()
    proto.ParseFromString(pieces.read_model(suite.tokenizer_model()))
    rules = schema.ModelProto()
    rules.ParseFromString(SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = True
    serialized = proto.SerializeToString()
    library, model = SentencePieceProcessor(model_proto=serialized), pieces.PieceModel(serialized)
    for text in ["", " ", "  a  b ", "ｆｕｌｌ　ｗｉｄｔｈ", "ﬁne ① ½ x", "a\tb\n c", "é é", "日本🙂", "㌀ ok"]:
        ids, begins, ends = model.encode(text)
        assert ids.tolist() == library.encode(text)
        assert model.decode(ids) == library.decode(ids.tolist())
        assert (np.diff(begins) >= 0).all() and (begins <= ends).all() and (not len(ends) or ends[-1] <= len(text.encode()))


def test_round_trip_columns(docs, odd, empty, tokenizer):
    for rows in (docs, odd):
        got = pieces.round_trip(rows, suite.tokenizer_model()).collect()
        want = sorted(
            (k or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids).encode()).hexdigest())
            for k, ids in ((r["doc_id"], tokenizer.encode(r["text"] or "")) for r in rows.select("doc_id", "text").collect())
        )
        assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    back = pieces.decode(pieces.encode(docs, suite.tokenizer_model()), suite.tokenizer_model())
    assert texts_of(back) == texts_of(docs)
    assert pieces.round_trip(empty, suite.tokenizer_model()).count() == 0
