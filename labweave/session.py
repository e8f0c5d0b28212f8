"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Spark's limit of an Arrow batch, what it is unless set (ten thousand long texts stay below it), and what tasks on texts ask for.
BATCH_LIMIT, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 1 << 22


def build_session(app: str = "labweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; a cluster's own settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """A fresh sub-folder of ``spark.checkpoint.dir``.

    Without that setting only a local master may fall back to a temporary
    folder: on a cluster, executors would each see a different one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="labweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/labweave-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES``, or one row, for tasks on long texts; a limit that the session sets itself stays."""
    if spark.conf.get(BATCH_LIMIT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def materialised(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there: later uses neither repeat the work nor see another order of it."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def local_table(spark: SparkSession, rows: Iterable[tuple], schema: str | T.StructType) -> DataFrame:
    """A few driver-side rows as a local relation, whose size the optimizer knows."""
    parsed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows)) or [()] * len(parsed)
    target = to_arrow_schema(parsed)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target), parsed)
