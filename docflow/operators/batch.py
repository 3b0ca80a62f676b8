"""Batch jobs over an item table (job_id, item_id, file_path, status, ...)."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import in_ranges

DONE = ("completed", "failed")


def spread_by_cost(items: DataFrame, cost: str, tasks: int) -> DataFrame:
    """The items dealt to ``tasks`` tasks so that each has about the same share of the cost.

    An item weighs its cost and the mean cost, so that many small ones are spread too. Ordered from the heaviest, items
    go to the task that their place on the line of all weights falls into; one heavier than a task's share
    is alone in its task, and the tasks it covers beyond that stay empty. Missing costs count as 0.
    """
    price = F.greatest(F.coalesce(F.col(cost).cast("double"), F.lit(0.0)), F.lit(0.0))
    total, count = items.agg(F.sum(price), F.count("*")).first()
    mean = max((total or 0.0) / max(count, 1), 1.0)
    share = ((total or 0.0) + mean * count) / tasks or 1.0
    ties = [c for c, kind in items.dtypes if kind in ("string", "bigint", "int")]
    ranged = in_ranges(items.withColumn("_weight", price + mean), [F.col("_weight").desc(), *ties], "batch-items")
    sizes = ranged.groupBy("_range").agg(F.sum("_weight").alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    offsets = sizes.select(F.col("_range").alias("_of"), earlier.alias("_before"))
    inside = F.coalesce(F.sum("_weight").over(W.partitionBy("_range").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    placed = ranged.withColumn("_inside", inside).join(offsets, F.col("_range") == F.col("_of"))
    task = F.least(F.floor((F.col("_before") + F.col("_inside")) / share), F.lit(tasks - 1)).cast("int")
    return placed.withColumn("_task", task).repartitionById(tasks, "_task").select(*items.columns)


def run_batch(items: DataFrame, make_handler: Callable, keys=("job_id", "item_id", "file_path"), cost: str | None = None, tasks: int | None = None) -> DataFrame:
    """Applies a handler to every item; an exception marks only its own item as failed.

    ``make_handler()`` is called once per partition and returns ``item: dict -> dict``. With ``cost``, a column such
    as the file's size, items are dealt out by it first (:func:`spread_by_cost`); ``tasks`` is the number of shuffle
    partitions if not given. Without it they stay where they are.
    """
    keys = list(keys)
    if cost is not None:
        items = spread_by_cost(items, cost, tasks or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    schema += ", status string, result string, error string, processing_time_ms int"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        handler = make_handler()
        for batch in batches:
            rows = []
            for item in batch.to_dict("records"):
                start = time.perf_counter()
                result = error = None
                try:
                    result = json.dumps(handler(item), ensure_ascii=False, default=str)
                except Exception as e:  # noqa: BLE001 - any failure belongs to the item
                    error = str(e)
                spent = int((time.perf_counter() - start) * 1000)
                state = "failed" if error is not None else "completed"
                rows.append((*[item[k] for k in keys], state, result, error, spent))
            yield pd.DataFrame(
                rows, columns=[*keys, "status", "result", "error", "processing_time_ms"]
            )

    return items.mapInPandas(work, schema)


def create_items(files: DataFrame, job_id: str, task_type: str, path="path") -> DataFrame:
    """Pending items of a new job, one per file."""
    return files.select(
        F.lit(job_id).alias("job_id"), F.uuid().alias("item_id"), F.col(path).alias("file_path"),
        F.lit(task_type).alias("task_type"), F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("int").alias("processing_time_ms"),
    )


def _counts():
    done = F.col("status").isin(*DONE)
    return (
        F.count("item_id").alias("total_items"),
        F.count_if(done).alias("processed_items"),
        F.count_if(F.col("status") == "failed").alias("failed_items"),
    )


def _with_progress(counted: DataFrame) -> DataFrame:
    share = F.when(F.col("total_items") == 0, F.lit(0.0)).otherwise(
        F.col("processed_items") / F.when(F.col("total_items") > 0, F.col("total_items")) * 100
    )
    return counted.withColumn("progress", share)


def job_progress(items: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Counts and percentage per job; jobs without items show 0."""
    counted = items.groupBy("job_id").agg(*_counts())
    if jobs is not None:
        counted = jobs.select("job_id").join(counted, "job_id", "left").na.fill(0)
    return _with_progress(counted)


def job_status(items: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Final state per finished job: failed when every item failed, else completed."""
    state = items.groupBy("job_id").agg(F.every(F.col("status") == "failed").alias("_all"))
    if jobs is not None:
        state = jobs.select("job_id").join(state, "job_id", "left")
    return state.select(
        "job_id", F.when(F.coalesce("_all", F.lit(False)), "failed").otherwise("completed").alias("status")
    )


def jobs_by_status(jobs: DataFrame, status: str | None = None) -> DataFrame:
    return jobs if not status else jobs.where(F.col("status") == status)


def cancel_jobs(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pending jobs among ``ids`` (column job_id) become cancelled; ``changed`` says which."""
    asked = ids.select("job_id").distinct().withColumn("_asked", F.lit(True))
    marked = jobs.join(asked, "job_id", "left")
    hit = F.coalesce("_asked", F.lit(False)) & (F.col("status") == "pending")
    return marked.withColumn("changed", hit).withColumn(
        "status", F.when(F.col("changed"), "cancelled").otherwise(F.col("status"))
    ).drop("_asked")


def job_results(items: DataFrame, job_id) -> DataFrame:
    return items.where(F.col("job_id") == job_id).select(
        "item_id", "file_path", "status", "result", "error", "processing_time_ms"
    )
