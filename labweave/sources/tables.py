"""Scans and sinks: delimited text, sheet exports, nested JSON."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _file_system_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when the path, or any match of the glob, exists."""
    fs, hadoop_path = _file_system_path(spark, path)
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def text_encodings(spark: SparkSession, path: str) -> DataFrame:
    """``(path, utf8)`` per file: does every line decode as UTF-8?

    The splittable text source keeps the bytes of a line as they are, so a large file is
    checked by many tasks; only one flag per file is shuffled.
    """
    lines = spark.read.format("text").load(path)
    return (
        lines.select(F.col("_metadata.file_path").alias("path"), F.is_valid_utf8("value").alias("ok"))
        .groupBy("path")
        .agg(F.bool_and("ok").alias("utf8"))
    )


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType | str | None = None,
    fallback: str = "ISO-8859-1",
    encoding: str | None = None,
    multi_line: bool = False,
    **options: str,
) -> DataFrame:
    """CSV with a header; files that are not valid UTF-8 are read in ``fallback``.

    A given ``encoding`` skips the check and its extra scan. The schema is all-string by
    default (from the header); typing is a later step.
    Only the list of file names with their flags reaches the driver, never file content.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if encoding:
        groups = {encoding: paths}
    else:
        flags = reduce(DataFrame.unionByName, [text_encodings(spark, p) for p in paths]).collect()
        groups = {
            "UTF-8": sorted(unquote(r.path) for r in flags if r.utf8),
            fallback: sorted(unquote(r.path) for r in flags if not r.utf8),
        }
    parts = []
    for name, files in groups.items():
        if files:
            reader = spark.read.option("header", True).option("encoding", name).option("multiLine", multi_line)
            reader = reader.option("enforceSchema", False)  # a file whose header differs is an error, not read under another's
            for key, value in options.items():
                reader = reader.option(key, value)
            parts.append((reader.schema(schema) if schema else reader).csv(files))
    if not parts:
        raise FileNotFoundError(f"no data files under {paths}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=schema is None), parts)


def read_first(spark: SparkSession, candidates: Iterable[str], format: str = "parquet", **options: str) -> DataFrame:
    """The first candidate path that exists."""
    tried = list(candidates)
    for path in tried:
        if path_exists(spark, path):
            return spark.read.format(format).options(**options).load(path)
    raise FileNotFoundError(f"none of {tried} exists")


def read_existing(spark: SparkSession, candidates: Iterable[str], format: str = "parquet", **options: str) -> DataFrame:
    """All candidates that exist; missing ones are skipped."""
    found = [p for p in candidates if path_exists(spark, p)]
    if not found:
        raise FileNotFoundError("none of the given paths exists")
    return spark.read.format(format).options(**options).load(found)


def read_nested_json(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = True) -> DataFrame:
    """JSON documents with a declared schema; no inference pass."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def sheet_region(sheet: DataFrame, columns: Sequence[int], first: int, last: int, row: str = "_row") -> DataFrame:
    """Rows ``first + 1 .. last + 1`` and the columns at the given ordinals, in sheet order.

    ``first`` is the header row of the region. The range filter on ``_row`` is pushed
    into the Parquet scan.
    """
    ordinals = [c for c in sheet.columns if c != row]
    return sheet.filter(F.col(row).between(first + 1, last + 1)).select(row, *[ordinals[i] for i in sorted(columns)])


def write_delimited(df: DataFrame, path: str, mode: str = "overwrite", **options: str) -> None:
    """CSV with a header and no row index, one file per task."""
    df.write.mode(mode).options(header="true", **options).csv(path)
