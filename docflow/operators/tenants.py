"""Tenants, quotas and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import dims


def tenant_quota(tenants: DataFrame, quotas: DataFrame) -> DataFrame:
    """Tenants with the quota of their tier; unknown tiers get the defaults.

    ``quotas`` is the four-row tier table.
    """
    joined = tenants.join(quotas, "tier", "left")
    filled = []
    for name, value in zip(dims.QUOTA_COLUMNS, dims.DEFAULT_QUOTA):
        default = F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value).cast("bigint")
        filled.append(F.coalesce(name, default).alias(name))
    return joined.select(*tenants.columns, *filled)


def tenant_state(events: DataFrame) -> DataFrame:
    """Current tenants from their events (tenant_id, seq, event, name, tier).

    ``create`` starts a tenant anew, ``update_tier`` and ``deactivate`` change an existing one;
    events before the first creation have no effect. Only the latest creation, tier change and
    deactivation of a tenant are kept while aggregating.
    """
    made = F.col("event") == "create"
    created = F.max(F.when(made, F.col("seq")))
    tier_event = F.col("event").isin("create", "update_tier")
    last = events.groupBy("tenant_id").agg(
        created.alias("_created"),
        F.max_by(F.when(made, F.col("name")), F.when(made, F.col("seq"))).alias("name"),
        F.max_by(F.when(tier_event, F.col("tier")), F.when(tier_event, F.col("seq"))).alias("tier"),
        F.max(F.when(F.col("event") == "deactivate", F.col("seq"))).alias("_off"),
    )
    return last.where(F.col("_created").isNotNull()).select(
        "tenant_id", "name", "tier",
        F.coalesce(F.col("_off") < F.col("_created"), F.lit(True)).alias("is_active"),
    )


def workspaces(tenants: DataFrame, requested: DataFrame) -> DataFrame:
    """A ``Default`` workspace per tenant plus the requested ones of known tenants."""
    default = tenants.select("tenant_id", F.lit("Default").alias("name"), F.lit(True).alias("is_default"))
    own = requested.join(tenants.select("tenant_id"), "tenant_id", "left_semi").select(
        "tenant_id", "name", F.lit(False).alias("is_default"))
    return default.unionByName(own)


def _reason(over_day: Column) -> Column:
    return (
        F.when(F.col("_name").isNull(), F.lit("Tenant not found"))
        .when(~F.col("is_active"), F.lit("Tenant is deactivated"))
        .when(
            ~F.array_contains("allowed_tasks", F.col("task_type")),
            F.concat(F.lit("Task '"), "task_type", F.lit("' not allowed in "), "tier", F.lit(" tier")),
        )
        .when(
            F.col("document_count") > F.col("max_documents_per_batch"),
            F.concat(F.lit("Batch size "), F.col("document_count").cast("string"), F.lit(" exceeds limit "),
                     F.col("max_documents_per_batch").cast("string")),
        )
        .when(over_day, F.concat(F.lit("Daily request limit ("), F.col("max_requests_per_day").cast("string"),
                                 F.lit(") reached")))
    )


def check_quota(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """Verdict per request: the first rule it breaks gives the reason.

    ``requests``: request_id, ts, tenant_id, task_type, document_count; ``tenants`` as given by
    :func:`tenant_quota`. Only granted requests use up the day. Eligible requests are counted per minute;
    the sums say in which minute a day's limit falls. Earlier minutes are granted, later ones refused, and
    only the requests of that minute are ranked.
    """
    limits = tenants.select(
        "tenant_id", F.col("tenant_id").alias("_name"), "tier", "is_active", "allowed_tasks",
        "max_documents_per_batch", "max_requests_per_day",
    )
    judged = requests.join(limits, "tenant_id", "left").select(
        *requests.columns, "max_requests_per_day", _reason(F.lit(False)).alias("_early"), _reason(F.lit(True)).alias("_late"),
        F.to_date("ts").alias("_day"), (F.hour("ts") * 60 + F.minute("ts")).alias("_minute"))
    key = ["tenant_id", "_day"]
    counted = judged.where(F.col("_early").isNull()).groupBy(*key, "_minute").agg(
        F.count("*").alias("_n"), F.max("max_requests_per_day").alias("_limit"))
    before = F.sum("_n").over(W.partitionBy(*key).orderBy("_minute")) - F.col("_n")
    full = counted.withColumn("_before", before).where((F.col("_before") <= F.col("_limit")) & (F.col("_before") + F.col("_n") > F.col("_limit"))).select(
        F.col("tenant_id").alias("_t"), F.col("_day").alias("_d"), F.col("_minute").alias("_m"), "_before", "_limit")
    same_day = (F.col("tenant_id") == F.col("_t")) & (F.col("_day") == F.col("_d"))
    verdict = lambda over: F.coalesce("_early", F.when(over, F.col("_late"))).alias("reason")
    on_edge = F.col("_early").isNull() & (F.col("_minute") == F.col("_m"))
    clear = judged.join(full, same_day, "left").where(~F.coalesce(on_edge, F.lit(False))).select(
        *requests.columns, verdict(F.coalesce(F.col("_minute") > F.col("_m"), F.lit(False))))
    place = F.col("_before") + F.row_number().over(W.partitionBy(*key, "_minute").orderBy("ts", "request_id"))
    edge = judged.join(full, same_day & (F.col("_minute") == F.col("_m"))).where(F.col("_early").isNull()).select(
        *requests.columns, verdict(place > F.col("_limit")))
    return clear.unionByName(edge).select(*requests.columns, F.col("reason").isNull().alias("allowed"), "reason")


def daily_usage(usage: DataFrame) -> DataFrame:
    """Sums per tenant and UTC day of (tenant_id, ts, request_count, document_count,
    processing_time_ms, tokens_used)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return usage.groupBy("tenant_id", F.to_date("ts").alias("day")).agg(
        *[total(c) for c in ("request_count", "document_count", "processing_time_ms", "tokens_used")]
    )


def usage_on(tenants: DataFrame, usage: DataFrame, day) -> DataFrame:
    """Each tenant's usage of one UTC day, zeros for a tenant without any."""
    wanted = F.lit(day).cast("date")
    sums = daily_usage(usage.where(F.to_date("ts") == wanted)).drop("day")
    return tenants.select("tenant_id").join(sums, "tenant_id", "left").na.fill(0).withColumn("day", wanted)


def usage_summary(tenants: DataFrame, usage: DataFrame, days: int | None = None, today=None) -> DataFrame:
    """Totals and mean time per request for each tenant, zeros without usage.

    All recorded days count unless ``days`` is given together with ``today``.
    """
    seen = usage
    if days is not None:
        seen = usage.where(F.to_date("ts") > F.date_sub(F.lit(today).cast("date"), days))
    sums = seen.groupBy("tenant_id").agg(
        F.sum("request_count").alias("total_requests"), F.sum("document_count").alias("total_documents"),
        F.sum("processing_time_ms").alias("total_processing_ms"),
    )
    joined = tenants.select("tenant_id").join(sums, "tenant_id", "left").na.fill(0)
    mean = F.expr("total_processing_ms div greatest(total_requests, 1)")
    return joined.withColumn("avg_processing_ms", mean)
