"""Near duplicates where rows share an id."""

from __future__ import annotations

from pyspark.sql import functions as F

from labweave.llm import minhash

DOCS = "doc_id bigint, text string, source string"
X, Y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
NEAR_X = X + " end"


def grouped(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, 5).collect()), key=str)
    kept = sorted(((r["doc_id"], r["text"]) for r in minhash.without_near_duplicates(docs, 5).collect()), key=str)
    return got, kept


def test_a_text_of_a_repeated_id_that_has_no_duplicate_stays(spark):
    got, kept = grouped(spark, [(1, X, "a"), (2, X, "a"), (2, Y, "b"), (3, NEAR_X, None), (4, Y, "a"), (None, X, "a"), (5, "", "a"), (5, None, "a")])
    assert got == sorted([(1, 36, 1, True), (2, 36, 1, False), (2, 36, 2, True), (3, 37, 1, False), (4, 36, 2, False), (None, 36, None, True), (5, 0, 5, True), (5, 0, 5, True)], key=str)
    assert kept == sorted([(1, X), (2, Y), (None, X), (5, ""), (5, None)], key=str)


def test_rows_that_share_id_and_text_stay_together(spark):
    got, kept = grouped(spark, [(7, X, "a"), (7, X, "b"), (9, NEAR_X, "a"), (9, NEAR_X, "a")])
    assert got == [(7, 36, 7, True), (7, 36, 7, True), (9, 37, 7, False), (9, 37, 7, False)]
    assert kept == [(7, X), (7, X)]


def test_many_texts_of_one_id(spark):
    rows = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{j}_"), F.col("id") % 1500) for j in range(8)]).alias("text"))
    assert minhash.near_duplicates(rows, 5).where("component_id = 5 and kept").count() == 3000  # equal texts under one id are one document
    assert minhash.without_near_duplicates(rows.unionByName(rows.limit(10).withColumn("doc_id", F.lit(6).cast("long"))), 5).where("doc_id = 6").count() == 0
