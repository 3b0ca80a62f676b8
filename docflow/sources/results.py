"""The result store: a Parquet table partitioned by task type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import newest

COLUMNS = ("result_id", "document_id", "task_type", "result", "metadata", "created_at")
SCHEMA = (
    "result_id STRING, document_id STRING, result STRING, metadata STRING, created_at TIMESTAMP, task_type STRING"
)


def new_results(df: DataFrame) -> DataFrame:
    """Adds ``result_id`` and ``created_at`` to (document_id, task_type, result, metadata)."""
    return df.select(
        F.uuid().alias("result_id"), "document_id", "task_type", "result", "metadata",
        F.current_timestamp().alias("created_at"),
    )


def append_results(df: DataFrame, path: str) -> None:
    new_results(df).write.mode("append").partitionBy("task_type").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).select(*COLUMNS)


def get_result(results: DataFrame, result_id) -> DataFrame:
    return results.where(F.col("result_id") == result_id)


def query_results(results: DataFrame, limit: int, task_type=None, start=None, end=None) -> DataFrame:
    """Newest results; both time bounds are inclusive. The task filter prunes partitions."""
    out = results
    if task_type:
        out = out.where(F.col("task_type") == task_type)
    if start is not None:
        out = out.where(F.col("created_at") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("created_at") <= F.lit(end))
    return newest(out, "created_at", "result_id", limit)
