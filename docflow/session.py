"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # JSON objects that repeat a key keep the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app="docflow", master=None, **extra):
    """A session with the settings the jobs expect; ``extra`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


_LOCAL: list[str] = []


def scratch_dir(spark, name):
    """A fresh folder below ``spark.checkpoint.dir``, which all executors can reach.

    Only a local session may do without that setting; its folders lie in one temporary folder of the process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="docflow-"))
        base = _LOCAL[0]
    return os.path.join(base, "docflow", f"{name}-{uuid.uuid4().hex}")


def written(df, name):
    """The rows of ``df``, written once to a fresh shared folder and read from there.

    What follows neither repeats the steps before nor loses them with an executor.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
