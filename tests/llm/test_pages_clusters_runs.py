"""Site trees, pivot clusters and periodic runs against brute-force versions, and their defined odd cases."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labweave.llm import periodic_runs, pivot_clusters, site_trees, suite

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"
PAGES = "page_id bigint, url string, html string"


def odd_columns(rows):
    """Columns whose names the operators use themselves."""
    for name in ("key", "v", "w", "a", "id", "node", "host", "runs", "cluster", "part", "g", "p"):
        rows = rows.withColumn(name, F.lit("x"))
    return rows


# --- site trees


def article_of(page):
    """The blocks of the one article of a page made of headings and paragraphs only."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body).replace("<br>", " "))
    return "\n\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_the_article_of_every_page(spark):
    got = {r["page_id"]: r for r in suite.op11_site_trees(spark, SF).collect()}
    want = {r["page_id"]: article_of(r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def unmarked(i):
    """A page whose elements say nothing of their purpose: the frame repeats, the text does not."""
    words = random.Random(i)
    text = " ".join("".join(words.choice("abcdefgh") for _ in range(6)) for _ in range(30))
    return (
        f"<html><body><div class=q1><a href=/a>Start</a><a href=/b>Contact us</a></div><div class=q2><p>{text}.</p><p>page {i} &amp; more</p></div>"
        "<div class=q3><p>All prices include tax. Read our terms before you order anything from this shop, please.</p></div></body></html>"
    ), f"{text}.\n\npage {i} & more"


def test_branches_that_a_site_repeats_go(spark):
    made = [unmarked(i) for i in range(40)]
    rows = [(i, f"http://shop.example/{i}", page) for i, (page, _) in enumerate(made)]
    frame = spark.createDataFrame(rows, PAGES)
    want = {i: text for i, (_, text) in enumerate(made)}
    for limit in (site_trees.BROADCAST_NODES, 0):  # lists sent to all tasks, and joined with the pages
        got = {r["page_id"]: r["text"] for r in site_trees.extract_main_text(frame, broadcast_nodes=limit).collect()}
        assert got == want


def test_importance_equals_its_definition(spark):
    rows = [(i, "http://h.example/", unmarked(i)[0]) for i in range(7)] + [(9, "http://other.example/", unmarked(3)[0])]
    stats = site_trees.tree_statistics(spark.createDataFrame(rows, PAGES))
    got = {r["node"]: r["importance"] for r in site_trees.importances(stats).collect()}
    node = site_trees.digest("h.example", "/html/body/div.q2/p")
    counts = {}
    for _, _, page in rows[:7]:
        for b in site_trees.read_page(page)[0]:
            if b.path == "/html/body/div.q2/p":
                for x in site_trees.features(b):
                    counts.setdefault(x, {}).setdefault(page, 0)
                    counts[x][page] += 1
    entropies = [-sum(c / sum(of.values()) * math.log(c / sum(of.values()), 7) for c in of.values()) for of in counts.values()]
    assert got[node] == pytest.approx(1 - sum(entropies) / len(entropies))
    assert got[site_trees.digest("other.example", "/html/body/div.q2/p")] == 1.0  # a single page tells nothing


def test_copies_keep_their_text(spark):
    page, text = unmarked(1)
    got = site_trees.extract_main_text(spark.createDataFrame([(i, "http://c.example", f"<article>{page}</article>") for i in range(5)], PAGES)).collect()
    assert all(text in r["text"] for r in got)


def test_repeated_paragraph_in_articles_stays(spark):
    rows = [(i, "http://l.example", f"<nav>Home</nav><article><h1>T {i}</h1><p>own text of {i}</p><p>Licensed to all.</p><div class=ad>buy</div></article><footer>x</footer>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in site_trees.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"T {i}\n\nown text of {i}\n\nLicensed to all." for i in range(30)}


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("<p>x</p", "x"), ("<", "<"), ("a < b", "a < b"), ("<!-- open <p>no", ""), ("<script>if (a<b) {}</script>text", "text"), ("<script>never ends", ""),
    ("<article><header><h1>T</h1></header><p>one &amp; two&nbsp;&#51;</p><section class='comments'><article class=comment><p>c</p></article></section><aside>s</aside></article><p>out</p>", "T\n\none & two 3"),
    ("<p><b>open.<br><p>next", "open.\n\nnext"), ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>f", "a\n\nb\n\nc\n\nd\n\ne\n\nf"),
    ("<form><main><p>kept</p></main><p>not</p></form>", "kept"), ("<form><input><p>ask</p></form><p>text</p>", "text"), ("<p title='a>b'>q</p>", "q"),
    ("<div id=cookie-notice>c</div><div class='top menu'>m</div><p>a</p><p hidden>h</p><span class=advert>z</span>", "a"), ("<svg><text>q</text></svg>after", "after"),
    ("<header>site</header><div class='no-sidebar'>a\n\t b</div>", "a b"),
])
def test_mark_up(page, want):
    assert site_trees.main_text(site_trees.read_page(page or "")[0], lambda path: False) == want


def test_odd_pages(spark):
    rows = [(1, None, None), (1, "http://a.example", ""), (None, "no address", "<p>x</p>"), (2, "http://a.example", "<p>" + "long words " * 60_000), (2, "http://a.example", "<p>" + "long words " * 60_000)]
    got = site_trees.extract_main_text(odd_columns(spark.createDataFrame(rows, PAGES))).collect()
    assert sorted((r["page_id"] or 0, len(r["text"])) for r in got) == [(0, 1), (1, 0), (1, 0), (2, 659_999), (2, 659_999)]
    assert site_trees.extract_main_text(spark.createDataFrame([], PAGES)).count() == 0


# --- pivot clusters


def lloyd(rows, k, rounds):
    held = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), i, [math.floor(64 * x) for x in v]) for i, v in rows)
    centroids = [v for _, _, v in held[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, _, v in held:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    return sorted((i, *nearest(v)[::-1]) for _, i, v in held), centroids


@pytest.mark.parametrize(("n", "k"), [(300, 16), (5, 16), (40, 3)])
def test_clusters_equal_plain_rounds(spark, n, k):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=(n, 8)), 1)  # coarse, so that distances tie
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    placed, centroids = pivot_clusters.pivot_clusters(odd_columns(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)), k=k, width=8)
    want, final = lloyd(rows, k, 3)
    assert sorted(tuple(r) for r in placed.collect()) == want
    assert centroids.tolist() == final
    totals = pivot_clusters.with_inertia(placed, centroids).collect()
    assert {r["inertia"] for r in totals} == {sum(d for _, _, d in want)}
    assert {(r["cluster"], r["centroid_sha256"]) for r in totals} == {(c, hashlib.sha256(",".join(map(str, final[c])).encode()).hexdigest()) for _, c, _ in want}


def test_pivots_spare_exact_distances():
    rng = np.random.default_rng(0)
    centres = rng.integers(-2000, 2000, (16, 64))
    vectors = centres[rng.integers(0, 16, 3000)] + rng.integers(-40, 40, (3000, 64))
    pivots = pivot_clusters.spread_pivots(vectors[:64], 8)
    table = np.stack([pivot_clusters.squared(vectors, p) for p in pivots], axis=1)
    cluster, distance, exact = pivot_clusters.nearest_centroids(vectors, table, centres, pivots)
    every = ((vectors[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert exact < 3000 * 16 / 4


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [0.5, -0.01]), (7, [0.5, -0.01]), (None, [9.0, 9.0])]
    schema = "vec_id bigint, embedding array<double>"
    placed, centroids = pivot_clusters.pivot_clusters(spark.createDataFrame(rows, schema), k=2, width=2)
    assert sorted((r["vec_id"] or 0, r["cluster"], r["distance"]) for r in placed.collect()) == [(0, 0, 0), (7, 1, 0), (7, 1, 0)]  # both start at 7, the mean of all moves away
    none, centroids = pivot_clusters.pivot_clusters(spark.createDataFrame([], schema), k=2, width=2)
    assert none.count() == 0 and len(centroids) == 0
    assert pivot_clusters.with_inertia(none, centroids).count() == 0


# --- periodic runs


def brute_runs(x):
    n, out = len(x), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and x[i] == x[i + q]:
                i += 1
            length = i - s + q
            if length >= max(6, 4 * q) and not any(all(x[j] == x[j + p] for j in range(s, s + length - p)) for p in range(1, q)):
                out.add((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(600):
        texts, names, heads = [], [], []
        for t in range(3):
            k = rng.choice([1, 2, 2, 3, 6])
            x = [rng.randrange(k) for _ in range(rng.randint(0, 50))]
            if x and rng.random() < 0.6:
                a, p = rng.randrange(len(x)), rng.randint(1, 9)
                x = [v if i < a or a + (i - a) % p >= len(x) else x[a + (i - a) % p] for i, v in enumerate(x)]
            heads.append(len(names))
            names += [v + 10 * t for v in x]
            texts.append(x)
        want = [(s + h, length, q) for x, h in zip(texts, heads) for s, length, q in brute_runs(x)]
        got = periodic_runs.runs_of(np.array(names, np.int64))
        assert list(zip(*(v.tolist() for v in got))) == want


def test_words_are_compared_by_bytes_when_hashes_meet(monkeypatch):
    monkeypatch.setattr(periodic_runs, "word_hashes", lambda data, starts, ends, fold: np.zeros(len(starts), np.uint64))
    data = np.frombuffer("ab cd ab ef ab".encode(), np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 12]), np.array([2, 5, 8, 11, 14])
    names = periodic_runs.word_names(data, starts, ends, np.array([0, 0, 0, 0, 1]))
    assert names[0] == names[2] and len(set(names.tolist())) == 4


def looped(doc_id, text):
    w = plain_words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def digest_of(doc_id, text):
    w = looped(doc_id, text)
    runs = brute_runs(w)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    head = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    short = {i for i, t in docs if len(plain_words(t)) <= 1500}
    got = {r[0]: tuple(r) for r in suite.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs) and len(short) > 150
    assert {i: got[i] for i in short} == {i: digest_of(i, t) for i, t in docs if i in short}
    assert sum(r[1] > 0 for r in got.values()) > 5


def test_odd_texts(spark):
    loop = "a b " * 50_000
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "x " * 9), (4, loop), (4, loop), (5, "é é " * 7), (6, "one two three"), (7, "A a A a A a A a")]
    got = periodic_runs.periodic_runs(odd_columns(spark.createDataFrame(rows, DOCS))).collect()
    found = sorted(((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=str)
    assert found == sorted([
        (1, [], ""), (2, [], ""), (3, [], ""), (0, [(0, 9, 1)], "x"), (4, [(0, 100_000, 2)], "a b"), (4, [(0, 100_000, 2)], "a b"),
        (5, [(0, 7, 1)], "é é"), (6, [], "one two three"), (7, [(0, 8, 2)], "A a"),
    ], key=str)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
    tails = periodic_runs.looped_tails(odd_columns(spark.createDataFrame(rows + [(i, "p q r s t u v w x y z") for i in range(100, 140)], DOCS))).collect()
    assert all((plain_words(r["text"]) == looped(r["doc_id"], dict(rows).get(r["doc_id"], "p q r s t u v w x y z"))) for r in tails if r["doc_id"] is not None)


def test_a_task_is_given_few_long_texts_at_a_time(spark):
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab c "), 2000).alias("text"))
    found = periodic_runs.periodic_runs(docs)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) < 5 << 20  # all 30 MB before
    assert found.where("size(runs) = 1 and runs[0].length = 4000 and runs[0].period = 2").count() == 3000
