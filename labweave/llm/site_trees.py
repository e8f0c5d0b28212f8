"""Main text of web pages, with branches removed that a site repeats (site style trees).

A page is read into elements; block elements that lie under the same tags and classes are one node. The trees of all pages of a host are
merged: for every node, how many pages have it, in how many each sequence of children occurs (its presentation), and how often each page
holds each feature of its text (its content). Features are the words and link targets of short texts and the clauses of long ones. With
``m`` pages, a feature that occurs equally often in all of them has entropy 1 to the base ``m``, one that a single page holds has 0; a
node's content importance is one less the mean entropy of its features. A node with children of its own adds the entropy of its child
sequences, the more the fewer features it has. Branches whose importance is below ``LEAST_IMPORTANCE`` are removed from each page of the
host. Entropies need only sums of ``c`` and ``c log c``, so tasks send one row for each feature they met; a host with a third of all
pages is summed like any other.

What no text statistics can tell is taken from the mark-up: scripts, styles and hidden elements, forms, and elements that call themselves
menu, header, footer, sidebar, notice, advert or comment have no importance; inside ``article`` or ``main`` an unstyled block is the
article's own however often the site repeats it. If a page has such an element with text, the text outside it goes. If all that a page
holds is repeated elsewhere, its text stays: it is a copy, not a frame.

Defined cases: null and empty pages, and pages without text, give an empty text; a null address is a host of its own; repeated ids are
rows of their own; unclosed elements end where their parent ends, an unclosed comment or script at the end of the page; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labweave.llm.shared import stored

LEAST_IMPORTANCE = 0.35
#: How fast features take the weight from a node's presentation.
DAMPING = 0.9
#: Texts of up to so many words count by words, longer ones by clauses.
SHORT_WORDS = 8
#: Features that a task holds before it sums and sends them, and removable nodes that are sent to all tasks at most.
TASK_ROWS, BROADCAST_NODES = 1 << 18, 1 << 20
#: Into how many parts each host's pages are dealt where its removable nodes are joined instead.
PARTS = 64
PAGES, CONTENT, PRESENTATION = 0, 1, 2

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg object canvas select audio video".split())
BLOCKS = frozenset(
    "html head body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul legend optgroup option".split()
)
CLOSES_P = BLOCKS - frozenset("html head body caption tbody td tfoot th thead tr legend option optgroup".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS = {
    "li": ("li", frozenset("ul ol menu dir".split())), "dt": ("dt dd", frozenset(["dl"])), "dd": ("dt dd", frozenset(["dl"])),
    "option": ("option", frozenset(["select"])), "tr": ("tr td th", frozenset(["table"])), "td": ("td th", frozenset("tr table".split())),
    "th": ("td th", frozenset("tr table".split())), "tbody": ("tbody thead tfoot tr td th", frozenset(["table"])),
    "thead": ("tbody thead tfoot tr td th", frozenset(["table"])), "tfoot": ("tbody thead tfoot tr td th", frozenset(["table"])),
}
#: Scopes that an end tag does not reach through.
WALLS = frozenset("table td th caption body html".split())

NO_TEXT = frozenset("head nav footer aside form button menu dialog fieldset label input option datalist".split())
NO_TEXT_ROLES = frozenset("navigation contentinfo complementary search dialog alertdialog alert form menu menubar toolbar banner".split())
#: Parts of class names and ids that tell what is no article, wherever they stand, and those that tell it outside an article only.
FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion popup modal cookie "
    "cookies consent gdpr notice notices notification notifications newsletter subscribe sidebar sidebars menu menus nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager footer comment comments disqus respond replies share sharing social related recommended widget "
    "widgets login signup".split()
)
OUTER_WORDS = frozenset("header masthead topbar toolbar banner legal copyright search alert disclaimer".split())
NEGATIONS = frozenset("has with no without is".split())

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:>|\Z))|[^>]*+(?:>|\Z))", re.S
)
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
CLAUSE = re.compile(r"[.!?;:]\s+")


@dataclass(frozen=True, slots=True)
class Tag:
    """What a start tag's text says: its place in the tree, and whether it or what it holds can be an article's text."""

    style: str
    frame: bool
    outer: bool  # a frame unless it stands inside an article
    plain: bool
    link: str


_TAGS: dict[tuple[str, str], Tag] = {}


def read_tag(name: str, rest: str) -> Tag:
    known = _TAGS.get((name, rest))
    if known is None:
        if len(_TAGS) > 20_000:
            _TAGS.clear()
        values = {a.lower(): html.unescape(x or y or z) for a, x, y, z in ATTRIBUTE.findall(rest.rstrip(">").rstrip("/"))}
        classes = values.get("class", "").split()
        frame = name in NO_TEXT or "hidden" in values or values.get("aria-hidden") == "true"
        frame = frame or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", "")) is not None
        role = values.get("role", "").lower()
        frame, outer = frame or (role in NO_TEXT_ROLES and role != "banner"), name == "header" or role == "banner"
        if name not in ("html", "body"):
            for given in (*classes, values.get("id", ""), *([values["aria-label"]] if "aria-label" in values else [])):
                parts = {p.lower() for p in WORD_PARTS.findall(given)}
                if not parts & NEGATIONS:
                    frame, outer = frame or bool(parts & FRAME_WORDS), outer or bool(parts & OUTER_WORDS)
        style = name + "".join(f".{re.sub('[0-9]{3,}', '#', c)}" for c in sorted(classes))
        known = _TAGS[name, rest] = Tag(style, frame, outer, not classes and "id" not in values, values.get("href", "") if name == "a" else "")
    return known


@dataclass(slots=True)
class Open:
    name: str
    path: str
    frame: bool
    inside: bool  # an article
    plain: bool  # since the article began
    block: bool
    form: bool = False  # a frame only as part of a form
    children: list[str] = field(default_factory=list)


@dataclass(slots=True)
class Block:
    """One text of a page with the node it belongs to."""

    path: str
    text: str
    links: list[str]
    frame: bool
    inside: bool
    plain: bool


def read_page(page: str) -> tuple[list[Block], dict[str, set[str]]]:
    """The texts of a page in order, and the child sequences of each of its nodes."""
    blocks: list[Block] = []
    shapes: dict[str, set[str]] = {}
    stack = [Open("", "", False, False, True, True)]
    pieces: list[str] = []
    links: list[str] = []
    owner = stack[0]  # the nearest open block

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append(Block(owner.path, text, links.copy(), owner.frame or owner.form, owner.inside, owner.plain))
            pieces.clear()
        links.clear()

    def close(depth: int) -> None:
        nonlocal owner
        if any(e.block for e in stack[depth:]):
            flush()
        while len(stack) > depth:
            ended = stack.pop()
            if ended.block and ended.children:
                shapes.setdefault(ended.path, set()).add(" ".join(ended.children))
        owner = next(e for e in reversed(stack) if e.block)

    def close_named(names, walls: frozenset) -> None:
        """Closes the outermost open element of these names within the walls."""
        found = 0
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name in names:
                found = depth
                if len(names) == 1:
                    break
            elif stack[depth].name in walls:
                break
        if found:
            close(found)

    at = 0
    while True:
        found = TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            pieces.append(html.unescape(text) if "&" in text else text)
        if not found:
            break
        at = found.end()
        closing, name, rest = found.groups()
        if name is None:
            continue
        name = name.lower()
        if closing:
            if name == "br":
                pieces.append(" ")
            elif name in BLOCKS or name in HEADINGS:
                close_named(HEADINGS if name in HEADINGS else (name,), frozenset() if name in WALLS else WALLS)
            else:
                for depth in range(len(stack) - 1, 0, -1):  # inline elements end within their block
                    if stack[depth].name == name:
                        close(depth)
                        break
                    if stack[depth].block and stack[depth].name != "p":
                        break
            continue
        if name in RAW:
            if name != "svg" or not rest.endswith("/>"):
                end = RAW_ENDS[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "br" or name == "wbr":
            pieces.append(" " if name == "br" else "")
            continue
        if name == "hr":
            flush()
        if name in VOID:
            continue
        tag = read_tag(name, rest)
        block = name in BLOCKS
        if name in CLOSES_P:
            close_named(("p",), WALLS | frozenset(["button"]))
        if name in HEADINGS and stack[-1].name in HEADINGS:
            close(len(stack) - 1)
        if name in ENDS:
            ended, walls = ENDS[name]
            close_named(tuple(ended.split()), walls)
        if block:
            flush()
            owner.children.append(tag.style) if not owner.children or owner.children[-1] != tag.style else None
        if tag.link:
            links.append(tag.link)
        above = stack[-1]
        if name in ("article", "main") and not tag.frame:
            element = Open(name, "", above.frame, True, True, True)
        else:
            inside = above.inside
            frame = above.frame or (tag.frame and name not in ("form", "fieldset")) or (tag.outer and not inside)
            element = Open(name, "", frame, inside, above.plain and tag.plain, block, above.form or name in ("form", "fieldset"))
        if not block and element.frame and not above.frame:
            element.block, block = True, True
            flush()
        element.path = f"{owner.path}/{tag.style}" if block else owner.path
        stack.append(element)
        if block:
            owner = element
    close(1)
    flush()
    if stack[0].children:
        shapes.setdefault("", set()).add(" ".join(stack[0].children))
    return blocks, shapes


def features(block: Block) -> list[str]:
    words = block.text.split()
    return [*block.links, *(words if len(words) <= SHORT_WORDS else CLAUSE.split(block.text))]


def host_of(url: str | None) -> str:
    """The host's name; an address without one is a host of its own."""
    if url is None:
        return ""
    found = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url)
    return (found[1] if found else url).lower()


def digest(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts)) - (1 << 63)


STATISTICS = "node bigint, kind int, feature bigint, c bigint, s double"


def _summed(page: np.ndarray, node: np.ndarray, kind: np.ndarray, feature: np.ndarray) -> pa.RecordBatch:
    """Occurrences by node, kind and feature, and the sum over pages of ``c log c``."""
    order = np.lexsort((page, feature, kind, node))
    page, node, kind, feature = page[order], node[order], kind[order], feature[order]
    group = np.append(True, (node[1:] != node[:-1]) | (kind[1:] != kind[:-1]) | (feature[1:] != feature[:-1]))
    own = np.flatnonzero(group | np.append(True, page[1:] != page[:-1]))
    times = np.diff(np.append(own, len(page)))
    heads = np.flatnonzero(group[own])
    first = own[heads]
    sums = np.add.reduceat(times, heads), np.add.reduceat(times * np.log(times), heads)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (node[first], kind[first].astype(np.int32), feature[first], *sums)], ["node", "kind", "feature", "c", "s"])


def tree_statistics(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """The merged trees of all hosts: node, kind, feature, the number of occurrences ``c`` and the sum of ``c log c`` over pages.

    Pages of a node are counted under kind 0, whose feature is the host's digest; a child sequence counts once for each page.
    """

    def run(batches):
        for batch in batches:
            columns: tuple[list, list, list, list] = [], [], [], []
            for at, (address, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                host = host_of(address)
                blocks, shapes = read_page(text or "")
                nodes = {path: digest(host, path) for path in {b.path for b in blocks} | set(shapes)}
                found = [(node, PAGES, digest(host)) for node in nodes.values()]
                found += [(nodes[path], PRESENTATION, digest(*sorted(seen))) for path, seen in shapes.items()]
                found += [(nodes[b.path], CONTENT, digest(x)) for b in blocks for x in features(b)]
                columns[0].extend([at] * len(found))
                for column, values in zip(columns[1:], zip(*found, strict=True), strict=False):  # an empty page has found nothing
                    column.extend(values)
                if len(columns[0]) >= TASK_ROWS:
                    yield _summed(*(np.array(x, np.int64) for x in columns))
                    columns = [], [], [], []
            if columns[0]:
                yield _summed(*(np.array(x, np.int64) for x in columns))

    return pages.select(url, page).mapInArrow(run, STATISTICS).groupBy("node", "kind", "feature").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))


def importances(statistics: DataFrame) -> DataFrame:
    """``node``, ``host``, ``pages`` and ``importance`` of every node that holds text, from the merged trees."""
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    c = F.col("c").cast("double")
    nodes = statistics.groupBy("node").agg(
        F.max(F.when(F.col("kind") == PAGES, F.col("feature"))).alias("host"), of(PAGES, F.col("c")).alias("pages"),
        of(CONTENT, F.lit(1)).alias("l"), of(CONTENT, F.log(c) - F.col("s") / c).alias("content"), of(PRESENTATION, c * F.log(c)).alias("shapes"),
    )
    base = F.log(F.col("pages").cast("double"))
    content = 1 - F.col("content") / F.col("l") / base
    weight = 1 - F.pow(F.lit(DAMPING), F.col("l"))
    shapes = (base - F.col("shapes") / F.col("pages")) / base
    mixed = F.when(F.col("shapes").isNull(), content).otherwise(weight * content + (1 - weight) * F.greatest(content, shapes))
    return nodes.where(F.col("l") > 0).select("node", "host", "pages", F.when(F.col("pages") > 1, mixed).otherwise(1.0).alias("importance"))


def main_text(blocks: list[Block], removed) -> str:
    """The page's blocks without frames and removed branches, in order."""
    left = [b for b in blocks if not b.frame]
    if any(b.inside for b in left):
        left = [b for b in left if b.inside]
    kept = [b for b in left if (b.inside and b.plain) or not removed(b.path)]
    return "\n\n".join(b.text for b in (kept or left))


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """``key``, ``url`` and ``text`` of every page: its article, or an empty text.

    Nodes of low importance go to every task while there are at most ``broadcast_nodes`` of them; beyond that, each host's list meets its
    pages in a join, dealt into ``PARTS`` parts of a host so that no task holds all pages of one.
    """
    low = stored(importances(tree_statistics(pages, url, page)).where(F.col("importance") < LEAST_IMPORTANCE).select("node", "host"))
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    out = f"key {kinds[key]}, url {kinds[url]}, text string"

    def extracted(address, text, removed: frozenset | set) -> str:
        host, blocks = host_of(address), read_page(text or "")[0]
        return main_text(blocks, lambda path: digest(host, path) in removed)

    if low.count() <= broadcast_nodes:
        shared = pages.sparkSession.sparkContext.broadcast(frozenset(low.select("node").toArrow()["node"].to_pylist()))

        def run(batches):
            removed = shared.value
            for batch in batches:
                texts = [extracted(a, x, removed) for a, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["key", "url", "text"])

        return pages.select(key, url, page).mapInArrow(run, out).toDF(key, "url", "text")

    lists = low.groupBy("host").agg(F.collect_list("node").alias("nodes")).select("host", "nodes", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))

    def with_host(batches):
        for batch in batches:
            hosts = [digest(host_of(a)) for a in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hosts, pa.int64())], ["key", "url", "page", "host"])

    dealt = pages.select(key, url, page).mapInArrow(with_host, f"key {kinds[key]}, url {kinds[url]}, page string, host bigint")
    met = dealt.withColumn("part", F.pmod(F.xxhash64("key", "url", "page"), F.lit(PARTS)).cast("int")).join(lists, ["host", "part"], "left")

    def run_joined(batches):
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            texts = [extracted(a, x, set(nodes or ())) for a, x, nodes in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["key", "url", "text"])

    return met.select("key", "url", "page", "nodes").mapInArrow(run_joined, out).toDF(key, "url", "text")
