"""Index tables on disk: Parquet, partitioned by strategy and repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Writes blocks, one folder for each strategy and repository; folders that occur are replaced."""
    blocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy", "repo").parquet(path)


def read_blocks(spark: SparkSession, path: str, strategy: str | None = None, repo: str | None = None) -> DataFrame:
    """Blocks of an index; the folders of other strategies and repositories are not read."""
    blocks = spark.read.parquet(path)
    for name, value in (("strategy", strategy), ("repo", repo)):
        blocks = blocks.where(F.col(name) == value) if value is not None else blocks
    return blocks


def write_results(rows: DataFrame, path: str, append: bool = False) -> None:
    """Result rows as one JSON object a line."""
    rows.write.mode("append" if append else "overwrite").json(path)
