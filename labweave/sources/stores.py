"""Keyed artifact stores: models, selected features, result summaries."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from labweave.session import local_table

FEATURE_SCHEMA = "target string, model string, feature string, rank int"
RESULT_SCHEMA = "target string, model string, metric string, value double, status string"


def model_path(root: str, target: str, model: str) -> str:
    def clean(text: str) -> str:
        """A folder name; names that would meet after cleaning keep a checksum apart."""
        plain = "".join(c if c.isalnum() else "_" for c in text)
        return plain if plain == text else f"{plain}_{zlib.crc32(text.encode()):08x}"

    return f"{root.rstrip('/')}/target={clean(target)}/model={clean(model)}"


def save_model(fitted: PipelineModel, root: str, target: str, model: str) -> str:
    path = model_path(root, target, model)
    fitted.write().overwrite().save(path)
    return path


def load_model(root: str, target: str, model: str) -> PipelineModel:
    return PipelineModel.load(model_path(root, target, model))


def save_selected_features(selected: DataFrame, path: str) -> None:
    """Replace the lists of the (target, model) pairs present in ``selected`` only."""
    (
        selected.select("target", "model", "feature", "rank")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("target", "model")
        .parquet(path)
    )


def load_selected_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURE_SCHEMA).parquet(path)


def result_rows(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """Long result table from (target, model, metric, value, status) tuples; NaN becomes null."""
    table = local_table(spark, list(rows), RESULT_SCHEMA)
    return table.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def summarise_results(results: DataFrame, metrics: Iterable[str] = ("mse", "rmse", "r2")) -> DataFrame:
    """One row per (target, model): one column per metric, and whether the run failed."""
    return results.groupBy("target", "model").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics],
        F.max(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("failed"),
    )
