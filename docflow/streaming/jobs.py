"""Live versions of the log jobs.

Every job takes a streaming DataFrame and stores what each micro-batch adds in a live table, which is compacted
under the running stream after every ``COMPACT_EVERY`` batches (or by :func:`compact`). No late row is dropped:
readers put snapshot and batches together, and late rows change results like any others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, batch
from ..session import written
from .live_table import LiveTable

COMPACT_EVERY = 20


def _start(stream: DataFrame, checkpoint: str, available_now: bool, mode="append"):
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")


def _add(table: LiveTable, rows: DataFrame, batch_id: int) -> None:
    table.store(rows, batch_id)
    if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
        table.compact()


# --- audit ----------------------------------------------------------------------


def audit_entries(stream: DataFrame) -> DataFrame:
    """Adds entry id and UTC day to audit events; missing outcomes count as success."""
    return (
        stream.withColumn("entry_id", F.uuid())
        .withColumn("success", F.coalesce("success", F.lit(True)))
        .withColumn("day", F.to_date("ts"))
    )


def ingest_audit(stream: DataFrame, path: str, checkpoint: str, available_now=False,
                 callbacks: Iterable[Callable[[DataFrame], None]] = ()):
    """Appends audit events to a live table; read with :func:`live_audit`.

    Each callback sees every micro-batch; its errors never stop the log, but are stored as
    (batch_id, callback, error) in the table ``path`` + "-errors". A batch that is replayed after a
    failure replaces its own files, so entries are stored once.
    """
    callbacks = list(callbacks)

    def store(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        _add(audit_table(spark, path), rows, batch_id)
        if not callbacks:
            return
        stored, errors = spark.read.parquet(f"{path}/batches/batch_id={batch_id}"), []
        for callback in callbacks:
            try:
                callback(stored)
            except Exception as e:  # noqa: BLE001 - observers must not break the log
                errors.append((getattr(callback, "__name__", str(callback)), f"{type(e).__name__}: {e}"))
        if errors:
            LiveTable(spark, f"{path}-errors").store(spark.createDataFrame(errors, "callback string, error string"), batch_id)

    return _start(audit_entries(stream), checkpoint, available_now).foreachBatch(store).start()


def audit_table(spark: SparkSession, path: str) -> LiveTable:
    return LiveTable(spark, path)


def live_audit(spark: SparkSession, path: str) -> DataFrame | None:
    """All entries so far; None before the first micro-batch."""
    return audit_table(spark, path).read()


# --- batch jobs -----------------------------------------------------------------


def latest_item_states(rows: DataFrame) -> DataFrame:
    """Latest status per item of (job_id, item_id, status, ts, seq); ``seq`` orders equal times."""
    last = F.max_by(F.struct("status", "ts", "seq"), F.struct("ts", "seq")).alias("_s")
    return rows.groupBy("job_id", "item_id").agg(last).select("job_id", "item_id", "_s.*")


def progress_table(spark: SparkSession, path: str) -> LiveTable:
    return LiveTable(spark, path, lambda rows: latest_item_states(rows).withColumn("batch_id", F.lit(-1).cast("bigint")))


def job_progress_stream(stream: DataFrame, path: str, checkpoint: str, available_now=False):
    """Keeps the changed item states of each micro-batch; read with :func:`live_progress`."""

    def store(rows: DataFrame, batch_id: int) -> None:
        _add(progress_table(rows.sparkSession, path), latest_item_states(rows), batch_id)

    return _start(stream, checkpoint, available_now).foreachBatch(store).start()


def live_progress(spark: SparkSession, path: str) -> DataFrame:
    """Progress of all jobs as of the last finished micro-batch."""
    return batch.job_progress(progress_table(spark, path).read().drop("batch_id"))


# --- usage ----------------------------------------------------------------------

USAGE = ("request_count", "document_count", "processing_time_ms", "tokens_used")


def daily_usage(rows: DataFrame) -> DataFrame:
    """Sums per tenant and UTC day."""
    return rows.groupBy("tenant_id", F.to_date("ts").alias("day")).agg(*[F.sum(c).alias(c) for c in USAGE])


def usage_table(spark: SparkSession, path: str) -> LiveTable:
    added = lambda rows: rows.groupBy("tenant_id", "day").agg(*[F.sum(c).alias(c) for c in USAGE])
    return LiveTable(spark, path, lambda rows: added(rows).withColumn("batch_id", F.lit(-1).cast("bigint")))


def daily_usage_stream(stream: DataFrame, path: str, checkpoint: str, available_now=False):
    """Writes the sums of each micro-batch; read with :func:`live_usage`."""

    def store(rows: DataFrame, batch_id: int) -> None:
        _add(usage_table(rows.sparkSession, path), daily_usage(rows), batch_id)

    return _start(stream, checkpoint, available_now).foreachBatch(store).start()


def live_usage(spark: SparkSession, path: str) -> DataFrame:
    """Each tenant's sums per day, over all batches."""
    return usage_table(spark, path).read().drop("batch_id")


# --- rate limit -----------------------------------------------------------------

VERDICT = ("ts", "allowed", "remaining", "reset_at")


def _latest(rows: DataFrame, *key: str) -> DataFrame:
    """Of each key the row of its newest batch; a key's rows of one batch are in order of time."""
    fields = [c for c in rows.columns if c not in (*key, "batch_id")]
    order = ["batch_id", *[c for c in ("ts", "request_id") if c in fields]]
    return rows.groupBy(*key).agg(F.max_by(F.struct("batch_id", *fields), F.struct(*order)).alias("_v")).select(*key, "_v.*")


def verdict_table(spark: SparkSession, path: str) -> LiveTable:
    """All verdicts ever given, in folders by day; the one of the newest batch holds."""
    return LiveTable(spark, f"{path}/verdicts", partition_by=("day",))


def window_table(spark: SparkSession, path: str) -> LiveTable:
    """Per key its last request with the window that it lies in: all that later requests need."""
    return LiveTable(spark, f"{path}/windows", lambda rows: _latest(rows, "key"))


def judge_batch(rows: DataFrame, batch_id: int, path: str, limit=60, window_seconds=60) -> None:
    """Verdicts on one micro-batch of (key, request_id, ts).

    A key whose requests all come after its last one goes on from the window that is open: nothing but the new
    requests and one row per key is read. A key with a late request is judged anew from the window on that was
    open at that time; its earlier verdicts are read from that day on, those of other keys are not judged again.
    """
    spark = rows.sparkSession
    verdicts, windows = verdict_table(spark, path), window_table(spark, path)
    if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
        verdicts.compact()
        windows.compact()
    new = written(rows.where("ts IS NOT NULL").select("key", "request_id", F.col("ts").cast("timestamp").alias("ts")), "limit-batch")
    kept, opened = windows.read(before=batch_id), None
    if kept is not None:
        # What a key's new requests begin with, beside its last known request.
        first = new.groupBy("key").agg(F.min("ts").alias("_from"))
        last = kept.select(F.col("key").alias("_key"), F.col("ts").alias("_last"), "remaining", "reset_at")
        width = F.make_dt_interval(secs=F.lit(window_seconds))
        known = written(first.join(last, F.col("key").eqNullSafe(F.col("_key"))).select(
            "key", "_from", (F.col("_from") <= F.col("_last")).alias("late"), (F.col("reset_at") - width).alias("opened"),
            (F.lit(limit) - F.col("remaining")).cast("bigint").alias("used"), (F.col("reset_at") >= F.col("_from")).alias("goes_on")), "limit-keys")
        opened = known.where("NOT late AND goes_on").select("key", "opened", "used")
        earliest = known.where("late").agg(F.min("_from")).first()[0]
        if earliest is not None:
            late = known.where("late").select(F.col("key").alias("_key"), "_from")
            since = F.lit(earliest) - width
            stored = verdicts.rows(before=batch_id).where((F.col("day") >= F.to_date(since)) & (F.col("ts") >= since))
            again = _latest(stored, "key", "request_id").join(late, F.col("key").eqNullSafe(F.col("_key"))).where(F.col("ts") >= F.col("_from") - width)
            again = written(again.select("key", "request_id", "ts", "reset_at", "_from"), "limit-again")
            # The window that was open at the first late request began at one of the requests before it.
            begun = again.where(F.col("ts") < F.col("_from")).groupBy(F.col("key").alias("_of")).agg(F.max("reset_at").alias("_reset"))
            start = F.when(F.col("_reset") >= F.col("_from"), F.col("_reset") - width).otherwise(F.col("_from"))
            old = again.join(begun, F.col("key").eqNullSafe(F.col("_of")), "left").where(F.col("ts") >= F.coalesce(start, F.col("_from")))
            new = new.unionByName(old.select("key", "request_id", "ts"))
    judged = access.rate_limit(new, limit, window_seconds, opened=opened)
    judged = judged.select("key", "request_id", "ts", "allowed", F.col("remaining").cast("int").alias("remaining"), "reset_at", F.to_date("ts").alias("day"))
    judged = written(judged, "limit-judged")
    verdicts.store(judged, batch_id)
    windows.store(_latest(judged.withColumn("batch_id", F.lit(batch_id)), "key").drop("day", "batch_id"), batch_id)


def rate_limit_stream(stream: DataFrame, path: str, checkpoint: str, limit=60, window_seconds=60, available_now=False):
    """The batch rate limit on a stream of (key, request_id, ts); read with :func:`live_limits`.

    The open window of every key is carried from batch to batch (:func:`judge_batch`). A late request gets its
    verdict and corrects those behind it.
    """

    def store(rows: DataFrame, batch_id: int) -> None:
        judge_batch(rows, batch_id, path, limit, window_seconds)

    return _start(stream, checkpoint, available_now).foreachBatch(store).start()


def live_limits(spark: SparkSession, path: str) -> DataFrame:
    """The latest verdict on each request."""
    return _latest(verdict_table(spark, path).read(), "key", "request_id").select("key", "request_id", *VERDICT)


# --- compaction -----------------------------------------------------------------


def compact(table: LiveTable, *others: LiveTable) -> None:
    """Folds the finished batches of live tables; streams and readers may go on meanwhile."""
    for one in (table, *others):
        one.compact()
