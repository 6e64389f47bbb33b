"""Source trees and line-wise JSON as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source_files(spark: SparkSession, root: str, suffixes: list[str] | None = None, skip: list[str] | None = None, max_mb: float | None = None) -> DataFrame:
    """(path, size, text) of the files below root: suffixes lower-cased, `skip` as regular expressions.

    Bytes that are not UTF-8 are left out of the text. Sizes and paths are tested before contents are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if suffixes:
        files = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin([s.lower() for s in suffixes]))
    for pattern in skip or []:
        files = files.where(~F.col("path").rlike(pattern))
    if max_mb is not None:
        files = files.where(F.col("length") <= int(max_mb * 1024 * 1024))
    text = F.col("content").cast("string")
    mended = F.regexp_replace(F.make_valid_utf8(text), "\uFFFD", "")
    return files.select("path", F.col("length").alias("size"), F.when(F.is_valid_utf8(text), text).otherwise(mended).alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file with one JSON object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among the finished ones."""
    return rows.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
