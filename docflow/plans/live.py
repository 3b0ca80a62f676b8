"""Queries that run the streaming jobs to completion over the event files and read the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_dir
from ..streaming import jobs
from . import inputs as I
from . import logs as L
from .catalog import query


def event_stream(spark, sf, name="events"):
    """The files of a table as a stream; times carry the session's zone."""
    schema = I.table(spark, sf, name).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in schema.names else stream


def _finish(run) -> None:
    run.awaitTermination()


@query("ingest_audit", f"""
WITH {L.AUDIT}
SELECT action, tenant_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (NOT success) AS failed, true AS all_ids
FROM audit GROUP BY ALL""")
def ingest_audit(spark, sf):
    path, check = scratch_dir(spark, "audit"), scratch_dir(spark, "audit-state")
    e = event_stream(spark, sf)
    entries = e.select("ts", I._mapped("event_type", I.ACTIONS).alias("action"), I.text(F.col("user_id") % 10).alias("tenant_id"),
                       (F.col("event_type") != "error").alias("success"))
    _finish(jobs.ingest_audit(entries, path, check, available_now=True))
    stored = jobs.live_audit(spark, path)
    return stored.groupBy("action", "tenant_id", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n"), F.count_if(~F.col("success")).alias("failed"),
        (F.count_distinct("entry_id") == F.count("*")).alias("all_ids"))


_STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"


@query("job_progress_stream", f"""
WITH last AS (
  SELECT user_id % 20 AS job, user_id AS item, arg_max({_STATUS}, (ts, event_id)) AS status FROM events GROUP BY 1, 2)
SELECT CAST(job AS VARCHAR) AS job_id, count(*) AS total_items, count(*) FILTER (status IN ('completed', 'failed')) AS processed_items,
       count(*) FILTER (status = 'failed') AS failed_items,
       CAST(count(*) FILTER (status IN ('completed', 'failed')) AS DOUBLE) / count(*) * 100 AS progress
FROM last GROUP BY job""")
def job_progress_stream(spark, sf):
    path, check = scratch_dir(spark, "progress"), scratch_dir(spark, "progress-state")
    states = dict(zip(("signup", "view", "click", "purchase", "error"), ("pending", "processing", "processing", "completed", "failed")))
    e = event_stream(spark, sf)
    items = e.select(I.text(F.col("user_id") % 20).alias("job_id"), I.text(F.col("user_id")).alias("item_id"),
                     I._mapped("event_type", states).alias("status"), "ts", F.col("event_id").alias("seq"))
    _finish(jobs.job_progress_stream(items, path, check, available_now=True))
    return jobs.live_progress(spark, path)


@query("daily_usage_stream", f"WITH {L.USAGE} SELECT * FROM daily")
def daily_usage_stream(spark, sf):
    path, check = scratch_dir(spark, "usage"), scratch_dir(spark, "usage-state")
    e = event_stream(spark, sf)
    usage = e.select(
        I.text(F.col("user_id")).alias("tenant_id"), "ts", F.lit(1).cast("bigint").alias("request_count"),
        (F.col("event_id") % 4).alias("document_count"), F.floor("value").cast("bigint").alias("processing_time_ms"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens_used"))
    _finish(jobs.daily_usage_stream(usage, path, check, available_now=True))
    return jobs.live_usage(spark, path).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("rate_limit_stream", L.RATE)
def rate_limit_stream(spark, sf):
    path, check = scratch_dir(spark, "limit"), scratch_dir(spark, "limit-state")
    e = event_stream(spark, sf)
    asked = e.select(F.concat(F.lit("key-"), I.text(F.col("user_id"))).alias("key"), F.col("event_id").alias("request_id"), "ts")
    _finish(jobs.rate_limit_stream(asked, path, check, L.LIMIT, L.WINDOW, available_now=True))
    return jobs.live_limits(spark, path).select("request_id", "allowed", "remaining", L.iso("reset_at").alias("reset_at"))


