"""Batch models applied to a stream of rows."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(stream: DataFrame, model: Transformer, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Score arriving rows with a fitted pipeline and append them as Parquet.

    Preprocessing and model are row-wise, so no state, watermark or shuffle is involved;
    the file sink with a checkpoint makes every row appear once.
    """
    scored = model.transform(stream)
    columns = [c for c, kind in scored.dtypes if kind != "vector"]
    writer = scored.select(*columns).writeStream.format("parquet").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
