"""Tables that a stream adds to while others read and compact them.

Every micro-batch is a folder of its own under ``batches``. Compaction folds the finished batches into a snapshot
and then publishes it by one small file under ``versions``; the file appears as a whole, so a reader sees the table
either before or after and never between. Readers take the newest published snapshot and the batches since.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _if_there(read: Callable[[], DataFrame]) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


class LiveTable:
    """``fold`` turns the rows of some batches into fewer that say the same; rows hold ``batch_id`` for it.

    Without ``fold`` rows are only gathered: compaction writes the new batches together, as one more segment.
    There may be one stream and one compaction at a time, and any number of readers.
    """

    def __init__(self, spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame] | None = None, partition_by=()):
        self.spark, self.path, self.fold, self.partition_by = spark, path, fold, tuple(partition_by)

    def store(self, rows: DataFrame, batch_id: int) -> None:
        """The rows of a micro-batch; a batch that is replayed replaces its own rows."""
        rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_id", *self.partition_by).parquet(f"{self.path}/batches")

    def version(self) -> int:
        """The last batch in the published snapshot, -1 without one."""
        found = _if_there(lambda: self.spark.read.json(f"{self.path}/versions"))
        return -1 if found is None else int(found.agg(F.max("upto")).first()[0])

    def _batches(self) -> DataFrame | None:
        rows = _if_there(lambda: self.spark.read.parquet(f"{self.path}/batches"))
        return None if rows is None else rows.withColumn("batch_id", F.col("batch_id").cast("bigint"))

    def _snapshot(self, version: int) -> DataFrame | None:
        if version < 0:
            return None
        if self.fold:
            return self.spark.read.parquet(f"{self.path}/snapshots/upto={version}")
        return self.spark.read.parquet(f"{self.path}/snapshots").where(F.col("upto") <= version).drop("upto")

    def rows(self, before: int | None = None) -> DataFrame | None:
        """All rows as stored, with ``batch_id``, of batches below ``before``; None if nothing was ever stored."""
        version, batches = self.version(), self._batches()
        if before is not None and version >= before:
            raise ValueError(f"batch {version} is compacted; the rows before batch {before} are not to be had")
        if batches is None:
            return None
        later = batches.where(F.col("batch_id") > version)
        later = later if before is None else later.where(F.col("batch_id") < before)
        snapshot = self._snapshot(version)
        return later if snapshot is None else snapshot.unionByName(later, allowMissingColumns=True)

    def read(self, before: int | None = None) -> DataFrame | None:
        """The folded rows."""
        rows = self.rows(before)
        return rows if rows is None or self.fold is None else self.fold(rows)

    def compact(self) -> int:
        """Folds all batches but the newest, which may still be written or replayed; returns the version.

        The folders of the version before stay until the next compaction, for readers that have planned on them.
        """
        version, batches = self.version(), self._batches()
        newest = None if batches is None else batches.agg(F.max("batch_id")).first()[0]
        if newest is None or newest - 1 <= version:
            return version
        upto = newest - 1
        if self.fold:
            rows = self.fold(self.rows(before=newest))
        else:
            rows = batches.where(F.col("batch_id").between(version + 1, upto))
        writer = rows.hint("rebalance", *self.partition_by).write.mode("overwrite")
        writer = writer.partitionBy(*self.partition_by) if self.partition_by else writer
        writer.parquet(f"{self.path}/snapshots/upto={upto}")
        self.spark.range(1).select(F.lit(version).alias("after")).coalesce(1).write.mode("overwrite").json(f"{self.path}/versions/upto={upto}")
        self._clean(version)
        return upto

    def _clean(self, before: int) -> None:
        """Deletes what no reader of version ``before`` or later can need."""
        old = lambda folder, limit: [p for p, n in self._numbered(folder) if n < limit]
        # Batches up to ``before`` are in its snapshot and in the new one.
        for path in [*old("batches", before + 1), *old("versions", before), *(old("snapshots", before) if self.fold else [])]:
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _numbered(self, folder: str):
        """The numbered folders below one of the table's."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        system = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath() for s in system.listStatus(root)] if system.exists(root) else []
        return [(p, int(p.getName().split("=")[1])) for p in found if "=" in p.getName()]
