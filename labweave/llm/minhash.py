"""Near-duplicate groups by min-max hashing of word shingles.

Every permutation of the shingle hashes gives two values, its smallest and its largest, so half as many hash evaluations make a
signature of the same length, whose agreement estimates similarity without bias and with less variance. Four values make a band; texts
that share a band are candidates, and links are confirmed on the full shingle sets.

Texts with equal sets are one class from the start. In a bucket of candidates, members are first compared with one leader; whatever that
joins needs no further comparison, as only the groups are wanted. Of what a bucket still holds in different groups, members go whose own
shingles, shared with no other of them, leave too few for any link; the rest is compared with the bucket's most central member, and what
then remains in pairs that share one of their rarest shingles, unless signatures or set sizes rule a link out. So a large group of copies costs its size and
not its square.

With 32 bands of 4, a pair at similarity 0.8 is missed with a chance below 1e-7, and the signature test (95 of 128 bits) passes it with
a chance above 1 - 1e-7.

Defined cases: words are runs of bytes other than white space, A-Z lowered; a null, empty or blank text has no shingles and no links; a
text with fewer words than a shingle is one shingle; rows without an id take no part (``component_id`` null, kept); rows that share an
id but not their shingles are documents of their own, each with its own links, and only those linked to a smaller id go; rows that share
both are one document and stay or go together; extra columns are not read when grouping and kept when filtering.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labweave.llm.arrays import WHITE_SPACE, distinct_by_row, hashed_words, mix, shingle_hashes, stream, text_blocks
from labweave.llm.components import components
from labweave.llm.shared import stored

PERMUTATIONS, BAND = 64, 4
#: Bits of 128 in which two signatures must agree; at similarity 0.8 they agree in 115 on average, with a deviation of 3.4.
LEAST_BITS = 95

_FLIP, _FACTOR = stream(101, PERMUTATIONS), stream(102, PERMUTATIONS) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, back to back, and where each row begins."""
    words, heads = hashed_words(data, offsets, WHITE_SPACE)
    return distinct_by_row(*shingle_hashes(words, heads, width), len(offsets) - 1)


def signatures(hashes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Smallest, then largest values under each permutation, for rows that have shingles (consecutive ``heads`` differ)."""
    out = np.empty((len(heads) - 1, 2 * PERMUTATIONS), np.uint64)
    for i in range(PERMUTATIONS):
        values = (hashes ^ _FLIP[i]) * _FACTOR[i]
        out[:, i] = np.minimum.reduceat(values, heads[:-1])
        out[:, PERMUTATIONS + i] = np.maximum.reduceat(values, heads[:-1])
    return out


def sketches(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``id``, ``n_shingles``, a 128-bit digest of the set, band hashes, and one bit of each signature value."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in text_blocks(batch.column(1)):
                n = len(offsets) - 1
                hashes, heads = shingle_sets(data, offsets, width)
                full = np.flatnonzero(np.diff(heads))
                low, high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                bits = np.zeros((n, 2), np.uint64)
                bands = np.zeros((n, 2 * PERMUTATIONS // BAND), np.uint64)
                if len(full):
                    starts = np.append(heads[full], len(hashes))
                    low[full] = np.add.reduceat(mix(hashes + np.uint64(3)), starts[:-1])
                    high[full] = np.bitwise_xor.reduceat(mix(hashes + np.uint64(5)), starts[:-1])
                    signature = signatures(hashes, starts)
                    packed = np.packbits((mix(signature) & np.uint64(1)).astype(np.uint8), axis=1)
                    bits[full] = np.ascontiguousarray(packed).view(np.uint64)
                    rolled = np.broadcast_to(stream(103, bands.shape[1]), (len(full), bands.shape[1])).copy()
                    for j in range(BAND):
                        rolled = mix(rolled ^ signature[:, j::BAND])
                    bands[full] = rolled
                listed = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(np.diff(heads) > 0, bands.shape[1], 0))]).astype(np.int32)), pa.array(bands[full].view(np.int64).ravel()),
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(np.diff(heads)), *(pa.array(x.view(np.int64)) for x in (low, high)), listed, *(pa.array(bits[:, i].copy().view(np.int64)) for i in (0, 1))],
                    ["id", "n_shingles", "low", "high", "bands", "bits_a", "bits_b"],
                )

    return docs.select(F.col(key).cast("long"), text).mapInArrow(
        run, "id bigint, n_shingles bigint, low bigint, high bigint, bands array<bigint>, bits_a bigint, bits_b bigint"
    )


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose full shingle sets have 100 * intersection >= percent * union."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def run(batches):
        for batch in batches:
            kept = []
            for row, data, offsets in text_blocks(batch.column(2)):
                n = len(offsets) - 1
                ours, heads = shingle_sets(data, offsets, width)
                _, other, ends = next(text_blocks(batch.column(3).slice(row, n), 1 << 62))
                theirs, tails = shingle_sets(other, ends, width)
                # shingles of a pair's two sets side by side: each set is distinct, so a repeat is shared
                size_a, size_b = np.diff(heads), np.diff(tails)
                both, bounds = distinct_by_row(
                    np.concatenate([np.repeat(np.arange(n), size_a), np.repeat(np.arange(n), size_b)]), np.concatenate([ours, theirs]), n
                )
                union = np.diff(bounds)
                kept.append(row + np.flatnonzero((union > 0) & (100 * (size_a + size_b - union) >= percent * union)))
            if kept:
                take = pa.array(np.concatenate(kept))
                yield pa.RecordBatch.from_arrays([batch.column(i).take(take) for i in (0, 1)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _with_group(rows: DataFrame, groups: DataFrame, node: str, name: str) -> DataFrame:
    found = groups.select(F.col("node").alias(node), F.col("root").alias("_root"))
    return rows.join(found, node, "left").withColumn(name, F.coalesce("_root", node)).drop("_root")


def near_duplicates(docs: DataFrame, width: int, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (smallest id that links reach) and ``kept`` (the id is that one), a row for each row."""
    drawn = stored(sketches(docs, width, key, text))
    mixed = _mixed_ids(drawn)
    if mixed is None:
        return _grouped(docs, drawn, width, percent, key, text)
    numbered = _numbered(docs, drawn, mixed, key)
    found = _by_number(numbered, width, percent, key, text)
    return found.select(key, "n_shingles", "component_id", "kept")


def _mixed_ids(drawn: DataFrame) -> DataFrame | None:
    """``id`` of the rows that share an id but not their shingles; None if there are none."""
    shown = F.struct("n_shingles", "low", "high")
    mixed = stored(drawn.where("id is not null").groupBy("id").agg(F.min(shown).alias("_a"), F.max(shown).alias("_b")).where("_a <> _b").select("id"))
    return None if mixed.isEmpty() else mixed


def _numbered(docs: DataFrame, drawn: DataFrame, mixed: DataFrame, key: str) -> DataFrame:
    """The rows with ``_node``, their id, or a number of their own beyond all ids where rows of one id differ; written, so that it stays."""
    base = (drawn.agg(F.max("id")).first()[0] or 0) + 1
    asked = mixed.select(F.col("id").alias("_mixed"))
    own = F.monotonically_increasing_id() + F.lit(base)
    return stored(docs.join(asked, docs[key].cast("long") == F.col("_mixed"), "left").withColumn("_node", F.when(F.col("_mixed").isNotNull(), own).otherwise(docs[key].cast("long"))).drop("_mixed"))


def _by_number(numbered: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    """``_node``, ``key`` and the result by numbers, told in ids again: a group is named by the smallest id of its rows."""
    found = _grouped(numbered, stored(sketches(numbered, width, "_node", text)), width, percent, "_node", text)
    ids = numbered.select("_node", F.col(key).cast("long").alias(key))
    placed = found.select("_node", "n_shingles", F.col("component_id").alias("_root"))
    unnumbered = placed.where("_node is null").select("_node", F.lit(None).cast("long").alias(key), "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    told = placed.where("_node is not null").dropDuplicates(["_node"]).join(ids, "_node")
    least = told.groupBy("_root").agg(F.min(key).alias("component_id"))
    told = told.join(least, "_root").select("_node", key, "n_shingles", "component_id", (F.col(key) == F.col("component_id")).alias("kept"))
    return told.unionByName(unnumbered)


def _grouped(docs: DataFrame, drawn: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    """``near_duplicates`` of rows that have equal shingles where they share an id."""
    classes = drawn.where("n_shingles > 0 and id is not null").groupBy("low", "high").agg(F.min("id").alias("rep"))
    one = drawn.join(classes.select("low", "high", F.col("rep").alias("id")), ["low", "high", "id"], "left_semi")
    slim = one.select("id", "n_shingles", "bits_a", "bits_b")
    placed = one.select("id", F.explode("bands").alias("bucket"))
    leaders = placed.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("_last")).where("leader < _last").drop("_last")
    members = stored(placed.join(leaders, "bucket"))
    texts = stored(
        docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(members.select("id").distinct(), "id", "left_semi")
    )
    # each member against the leader it meets in most buckets
    met = members.where("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("times"))
    first = stored(met.groupBy("id").agg(F.max(F.struct("times", (-F.col("leader")).alias("to"))).alias("best")).select(F.col("id").alias("a"), (-F.col("best.to")).alias("b")))
    groups = stored(components(confirmed(first, texts, width, percent)))
    # against its other leaders, where that can still join groups
    rest = met.select(F.col("id").alias("a"), F.col("leader").alias("b")).join(first, ["a", "b"], "left_anti")
    groups = _joined(groups, rest, texts, slim, width, percent)
    # what a bucket still holds in different groups, less the members that can have no link there
    held = _with_group(members, groups, "id", "group").where("id <> leader").select("bucket", "id", "group")
    open_ = stored(_divided(held).join(slim, "id"))
    open_ = stored(_divided(_linkable(open_, texts, width, percent)))
    # the member with the fewest shingles of its own is the most central; what it joins needs no pairs
    own = (F.col("common") - F.col("n_shingles")).alias("own")
    hubs = open_.groupBy("bucket").agg(F.max(F.struct(own, (-F.col("id")).alias("to"))).alias("best")).select("bucket", (-F.col("best.to")).alias("hub"))
    spokes = open_.join(hubs, "bucket").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    groups = _joined(groups, spokes, texts, slim, width, percent)
    open_ = stored(_divided(_with_group(open_.drop("group"), groups, "id", "group")))
    pairs = _sharing(open_, texts, width, percent)
    groups = _joined(groups, pairs, texts, None, width, percent)
    member = drawn.join(classes, ["low", "high"], "left").withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("id")))
    found = _with_group(member.withColumn("rep", F.when(F.col("id").isNotNull(), F.col("rep"))), groups, "rep", "component_id")
    return found.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _divided(rows: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one group."""
    split = rows.groupBy("bucket").agg(F.min("group").alias("_low"), F.max("group").alias("_high")).where("_low < _high").select("bucket")
    return rows.join(split, "bucket", "left_semi")


def _listed(rows: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``id`` and ``shingle``: the full sets of the members in ``rows``."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in text_blocks(batch.column(1)):
                hashes, heads = shingle_sets(data, offsets, width)
                ids = batch.column(0).take(pa.array(row + np.repeat(np.arange(len(heads) - 1), np.diff(heads))))
                yield pa.RecordBatch.from_arrays([ids, pa.array(hashes.view(np.int64))], ["id", "shingle"])

    return texts.join(rows.select("id").distinct(), "id", "left_semi").select("id", "text").mapInArrow(run, "id bigint, shingle bigint")


def _partner(percent: int):
    """The least size of a partner, times 100."""
    return F.greatest(F.col("smallest") * 100, F.col("n_shingles") * percent)


def _sharing(rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` of different groups among the members in ``rows`` that can have a link; this is exact.

    Of two sets that share so much, each must hold one of the other's rarest shingles: as many as it may miss, and one more. Pairs meet
    on those only, and a shingle's largest group is not joined with itself.
    """
    smallest = rows.groupBy("bucket").agg(F.min("n_shingles").alias("smallest"))
    one = rows.join(smallest, "bucket").groupBy("id", "group", "n_shingles", "bits_a", "bits_b").agg(F.min("smallest").alias("smallest"))
    listed = stored(_listed(rows, texts, width))
    spread = listed.groupBy("shingle").agg(F.count("*").alias("spread"))
    rare = F.row_number().over(Window.partitionBy("id").orderBy("spread", "shingle"))
    missed = F.floor((F.col("n_shingles") * 100 * (100 + percent) - (F.col("n_shingles") * 100 + _partner(percent)) * percent) / (100 * (100 + percent)))
    ranked = listed.join(spread, "shingle").withColumn("rare", rare).where("spread > 1").join(one, "id").where(F.col("rare") <= missed + 1)
    tokens = stored(ranked.select("shingle", "id", "group", "n_shingles", "bits_a", "bits_b", "rare"))
    sizes = tokens.groupBy("shingle", "group").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max(F.struct("n", "group")).alias("most"), F.count("*").alias("groups"))
    asked = tokens.join(sizes.where("groups > 1").select("shingle", F.col("most.group").alias("most")), "shingle").where("group <> most").drop("most")
    other = tokens.select("shingle", *(F.col(c).alias(f"{c}_2") for c in ("id", "group", "n_shingles", "bits_a", "bits_b", "rare")))
    # what is left of either set from the shared shingle on bounds what they share
    left = F.least(F.col("n_shingles") - F.col("rare"), F.col("n_shingles_2") - F.col("rare_2")) + 1
    enough = left * (100 + percent) >= (F.col("n_shingles") + F.col("n_shingles_2")) * percent
    met = asked.join(other, "shingle").where((F.col("group") != F.col("group_2")) & enough & _possible(percent))
    return met.select(F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b")).distinct()


def _linkable(rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``rows`` with ``common``, the shingles that any other of them has too, less those whose number rules out every link.

    Two sets share at most the ``common`` of either, and a partner in the bucket has at least the bucket's smallest size; this is exact.
    A copy with edits of its own is so turned away by counting, not by comparing it with every other copy.
    """
    listed = _listed(rows, texts, width)
    alone = listed.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("_last")).where("id = _last").groupBy("id").agg(F.count("*").alias("alone"))
    smallest = rows.groupBy("bucket").agg(F.min("n_shingles").alias("smallest"))
    known = rows.drop("common").join(alone, "id", "left").withColumn("common", F.col("n_shingles") - F.coalesce("alone", F.lit(0))).drop("alone")
    fits = F.col("common") * 100 * (100 + percent) >= (F.col("n_shingles") * 100 + _partner(percent)) * percent
    return known.join(smallest, "bucket").where(fits).drop("smallest")


def _possible(percent: int):
    """What set sizes and signatures leave possible: sizes within the similarity, and bits that agree."""
    differing = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_a_2"))) + F.bit_count(F.col("bits_b").bitwiseXOR(F.col("bits_b_2")))
    least, most = F.least("n_shingles", "n_shingles_2"), F.greatest("n_shingles", "n_shingles_2")
    return (least * 100 >= most * percent) & (differing <= 2 * PERMUTATIONS - LEAST_BITS)


def _joined(groups: DataFrame, pairs: DataFrame, texts: DataFrame, slim: DataFrame | None, width: int, percent: int) -> DataFrame:
    """``groups`` after the links among ``pairs`` whose ends lie in different groups; the ends' groups are joined, not the ends."""
    placed = _with_group(_with_group(pairs, groups, "a", "_group_a"), groups, "b", "_group_b").where("_group_a <> _group_b")
    if slim is not None:
        placed = placed.join(slim.withColumnRenamed("id", "a"), "a").join(slim.select(F.col("id").alias("b"), *(F.col(c).alias(f"{c}_2") for c in ("n_shingles", "bits_a", "bits_b"))), "b").where(_possible(percent))
    links = confirmed(placed.select("a", "b"), texts, width, percent)
    edges = _with_group(_with_group(links, groups, "a", "_group_a"), groups, "b", "_group_b")
    moved = components(edges.select(F.col("_group_a").alias("a"), F.col("_group_b").alias("b")))
    nodes = groups.select("node", F.col("root").alias("old")).join(moved.select(F.col("node").alias("old"), F.col("root").alias("new")), "old", "left")
    fresh = moved.join(groups.select("node"), "node", "left_anti")
    return stored(nodes.select("node", F.coalesce("new", "old").alias("root")).unionByName(fresh.select("node", "root")))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, of one document of each group: the one with the smallest id."""
    drawn = stored(sketches(docs, width, key, text))
    mixed = _mixed_ids(drawn)
    if mixed is not None:
        numbered = _numbered(docs, drawn, mixed, key)
        gone = _by_number(numbered, width, percent, key, text).where("not kept").select(F.col("_node").alias("_gone"))
        return numbered.join(gone.distinct(), F.col("_node") == F.col("_gone"), "left_anti").drop("_node")
    gone = _grouped(docs, drawn, width, percent, key, text).where("not kept").select(F.col(key).alias("_gone"))
    return docs.join(gone.distinct(), docs[key].cast("long") == F.col("_gone"), "left_anti")
