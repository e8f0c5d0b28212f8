"""The corpus pipeline stage by stage against plain Python."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labweave.llm import packing, personal, quality, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
ODD = [
    (90001, None, "en", "odd", 0), (90002, "", None, None, None), (90003, " \n ", "en", "odd", 3), (None, "a row without an id and some words", "en", "odd", 5),
    (90004, "long text " * 5000, "en", "odd", 50_000), (90005, "write to jane@mail.example or call +49 170 1234567 now", "en", "odd", 54),
    (90006, "one two three four five six seven eight", "en", "odd", 39), (90007, "one two three four five six seven eight", "de", "odd", 39),
    (90008, "a first text of an id that comes twice, nothing else", "en", "odd", 50), (90008, "quite another text under the very same number here", "en", "odd", 50),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"))
    docs.unionByName(spark.createDataFrame(ODD, DOCS)).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The table that each stage is given and the one that it returns."""
    out, docs = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, folder)
        result.write.parquet(f"{folder}/after-{name}")
        out[name] = docs, spark.read.parquet(f"{folder}/after-{name}")
        docs = out[name][1]
    return out


def rows_of(frame):
    return Counter(tuple(r) for r in frame.collect())


def words(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")


def shingles(text):
    w = [x for x in words(text) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_stages_are_the_dealt_ones_and_keep_the_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "personal_data", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns


@pytest.mark.parametrize(("name", "module", "scores", "label", "keeps"), [
    ("toxicity", toxicity, toxicity.toxicity_scores, "toxic", lambda s: s < 0.5), ("quality", quality, quality.quality_scores, "quality", lambda s: s >= 0.3),
])
def test_classifiers_drop_exactly_what_they_reject(spark, folder, stages, name, module, scores, label, keeps):
    before, after = stages[name]
    model = module.fit(before, spark.read.parquet(f"{folder}/labels.parquet"), label)
    by_text = {}
    for r in before.join(scores(before, model).select(F.col("doc_id").alias("_id"), "score"), F.col("doc_id").eqNullSafe(F.col("_id"))).where("doc_id <> 90008").collect():
        by_text[r["doc_id"], r["text"]] = r["score"]
    unique = rows_of(before.where("doc_id <> 90008 OR doc_id IS NULL"))
    want = Counter({r: n for r, n in unique.items() if r[0] is None or keeps(by_text[r[0], r[1]])})
    got = rows_of(after.where("doc_id <> 90008 OR doc_id IS NULL"))
    assert {k: v for k, v in got.items() if k[0] is not None} == {k: v for k, v in want.items() if k[0] is not None}
    assert not rows_of(after) - rows_of(before) and 0 < sum(got.values())


def test_one_document_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    docs = [tuple(r) for r in before.collect()]
    sets, root = [shingles(r[1]) for r in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, own in enumerate(sets):
        if docs[i][0] is None:
            continue
        near = Counter(j for s in own for j in holders[s])
        for s in own:
            holders[s].append(i)
        for j, both in near.items():
            if 100 * both >= 80 * (len(own) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(docs):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = Counter(r for i, r in enumerate(docs) if r[0] is None or not sets[i] or least[find(i)] == r[0])
    assert rows_of(after) == want and len(want) < len(docs)


def test_personal_data_gives_way_to_its_kind(stages):
    before, after = stages["personal_data"]
    want = Counter()
    for doc_id, text, lang, source, n_chars in (tuple(r) for r in before.collect()):
        clean = None if text is None else personal.redacted(text)
        want[doc_id, clean, lang, source, n_chars if clean == text else len(clean)] += 1
    assert rows_of(after) == want and any("<EMAIL>" in (r[1] or "") for r in want)


def test_bins_hold_every_byte_once_and_no_conflict(stages):
    before, after = stages["packing"]
    size = Counter()
    docs = {}
    for r in before.select("doc_id", "source", packing.text_size(F.col("text")).alias("s"), packing.text_cluster(F.col("text")).alias("c")).collect():
        size[r["doc_id"]] += r["s"]
        docs[r["doc_id"]] = r
    bins, held = defaultdict(list), Counter()
    for r in after.collect():
        held[r["doc_id"]] += r["length"]
        bins[r["bin"]].append(r)
    assert held == size
    twice = {r["doc_id"] for r in before.groupBy("doc_id").count().where("count > 1").collect()}
    for pieces in bins.values():
        assert sum(p["length"] for p in pieces) == pieces[0]["used"] <= packing.CAPACITY
        spans = sorted((p["at"], p["at"] + p["length"]) for p in pieces)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        known = [docs[p["doc_id"]] for p in pieces if p["doc_id"] not in twice]
        assert len({k["c"] for k in known}) == len(known)
        named = [k["source"] for k in known if k["source"] is not None]
        assert len(set(named)) == len(named)


def test_run_equals_the_stages_in_turn(spark, folder, stages):
    assert rows_of(corpus_pipeline.run(spark, folder)) == rows_of(stages["packing"][1])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
