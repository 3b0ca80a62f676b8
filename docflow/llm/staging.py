"""Tables that operators write between their steps, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import scratch_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once and read from the written files.

    The files lie below ``spark.checkpoint.dir``, so a lost executor loses none of them; what follows
    starts from them instead of repeating the steps before.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
