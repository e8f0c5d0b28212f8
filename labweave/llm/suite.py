"""Registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labweave.llm import (
    minhash, packing, periodic_runs, personal, pieces, pivot_clusters, quality, sharding, site_trees, tool_calls, toxicity, vector_search, winnowing,
)
from labweave.llm.labelled import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_model() -> str:
    """Where the public tokenizer model lies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _judged(scores: DataFrame, limit: float, *more: str) -> DataFrame:
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"), *more)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _judged(toxicity.toxicity_scores(docs, model), 0.5, "evidence", "cosines")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _judged(quality.quality_scores(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 0.3)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_spans(table(spark, sf_dir, "documents"))


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.conversation_calls(table(spark, sf_dir, "conversations"))
    return tool_calls.link_tool_calls(calls, results, tool_calls.CONVERSATION_TOOLS)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    checksum = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "source", packing.text_size(F.col("text")).alias("size"), checksum.alias("text_crc32"))
    placed = sharding.stratified_shards(rows, "doc_id", "source", 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vector_search.integer_vectors(table(spark, sf_dir, "embeddings"))
    return vector_search.exact_top(vectors, vectors.where("id % 20 = 0"), k=20)


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_neighbours(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer_model())


def op11_site_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = site_trees.extract_main_text(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op12_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_clusters.with_inertia(*pivot_clusters.pivot_clusters(table(spark, sf_dir, "embeddings"), k=16, rounds=3, width=64))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.looped_tails(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = F.col("best")
    return found.withColumn("best", periodic_runs.longest_run(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_best_fit_packing, op3_minhash_near_dedup, op4_quality, op5_personal_data, op6_tool_calls, op7_sharding, op8_exact_top_k,
    op9_winnowing, op10_sentencepiece, op11_site_trees, op12_pivot_clusters, op13_periodic_runs,
)}

ORACLES: dict[str, str] = {
    "op6_tool_calls": r"""
WITH calls AS (
  SELECT conv_id, turn, 'c' || conv_id || '-' || turn AS call_id, 'c' || conv_id || '-' || (turn - 1) AS before,
    CASE role WHEN 'system' THEN 'configure' WHEN 'user' THEN 'search' ELSE 'summarise' END AS name, text,
    len(list_filter(string_split_regex(coalesce(text, ''), '[ \n]+'), lambda x: x <> '')) AS words
  FROM conversations
), placed AS (
  SELECT c.*, o.conv_id IS NOT NULL AS has_opening, b.conv_id IS NOT NULL AS has_before, b.name AS before_name, b.turn AS before_turn,
    r.conv_id IS NOT NULL AS linked, r.text AS content
  FROM calls c
  LEFT JOIN calls o ON o.conv_id = c.conv_id AND o.turn = 0
  LEFT JOIN calls b ON b.conv_id = c.conv_id AND b.turn = c.turn - 1
  LEFT JOIN calls r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 AND r.name = 'summarise'
), chain AS (
  -- a summary stands on the turn before it: how many summaries follow each other up to here, and what they begin with
  SELECT p.*, turn - coalesce(max(CASE WHEN name <> 'summarise' OR NOT has_before THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn), turn) AS above
  FROM placed p
), based AS (
  SELECT c.*, CASE WHEN r.name = 'search' AND r.turn > 0 AND r.has_opening THEN 1 ELSE 0 END AS base
  FROM chain c LEFT JOIN placed r ON r.conv_id = c.conv_id AND r.turn = c.turn - c.above
)
SELECT b.conv_id, b.turn, b.call_id, b.name, CAST(b.base + b.above AS INTEGER) AS level,
  CAST(CASE WHEN b.name = 'search' AND b.turn > 0 AND NOT b.has_opening THEN 1 WHEN b.name = 'summarise' AND NOT b.has_before THEN 1 ELSE 0 END AS BIGINT) AS unresolved,
  b.linked,
  CASE WHEN b.name = 'configure' THEN CASE WHEN b.text IS NULL THEN 'prompt: missing' WHEN b.text = '' THEN 'prompt: out of range' ELSE '' END
       WHEN b.name = 'search' THEN array_to_string(list_filter([CASE WHEN b.turn + 1 > 50 OR b.turn + 1 < 1 THEN 'limit: out of range' END,
         CASE WHEN b.text IS NULL THEN 'query: missing' WHEN b.text = '' THEN 'query: out of range' END], lambda x: x IS NOT NULL), ';')
       ELSE CASE WHEN b.words < 1 THEN 'words: out of range' ELSE '' END END AS problems,
  '{"arguments":' || CASE b.name
    WHEN 'configure' THEN CASE WHEN b.text IS NULL THEN '{}' ELSE '{"prompt":' || CAST(to_json(b.text) AS VARCHAR) || '}' END
    WHEN 'search' THEN '{"limit":' || (b.turn + 1) || CASE WHEN b.text IS NULL THEN '' ELSE ',"query":' || CAST(to_json(b.text) AS VARCHAR) END || '}'
    ELSE '{"source":"' || b.before || '","words":' || b.words || '}' END
    || ',"id":"' || b.call_id || '","name":"' || b.name || '","result":' || CASE WHEN b.content IS NULL THEN 'null' ELSE CAST(to_json(b.content) AS VARCHAR) END || '}' AS json
FROM based b
""",
    "op12_pivot_clusters": """
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS m FROM kept QUALIFY c < 16
)""" + "".join(f""", a{i} AS (
  SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept CROSS JOIN c{i}
  QUALIFY row_number() OVER (PARTITION BY vec_id, v ORDER BY d, c) = 1
), c{i + 1} AS (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m
  FROM (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{i} CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i) GROUP BY c
  UNION ALL SELECT c, m FROM c{i} WHERE c NOT IN (SELECT c FROM a{i})
)""" for i in range(3)) + """, placed AS (
  SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept CROSS JOIN c3
  QUALIFY row_number() OVER (PARTITION BY vec_id, v ORDER BY d, c) = 1
)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM placed JOIN c3 USING (c)
""",
}
