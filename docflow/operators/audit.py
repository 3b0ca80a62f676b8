"""Audit log queries: (entry_id, ts, action, tenant_id, user_id, resource_type, resource_id, success, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import newest


def keep_last(audit: DataFrame, n: int) -> DataFrame:
    """Only the newest ``n`` entries."""
    return newest(audit, "ts", "entry_id", n)


def _matching(audit: DataFrame, start=None, end=None, success_only=False, **equal) -> DataFrame:
    out = audit
    for column, value in equal.items():
        if value:  # empty text means no filter
            out = out.where(F.col(column) == value)
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("ts") <= F.lit(end))
    return out.where("success") if success_only else out


def query_audit(audit: DataFrame, limit: int, tenant_id=None, user_id=None, action=None, resource_type=None,
                start=None, end=None, success_only=False) -> DataFrame:
    """Newest matching entries; both time bounds are inclusive."""
    hits = _matching(audit, start, end, success_only, tenant_id=tenant_id, user_id=user_id,
                     action=action, resource_type=resource_type)
    return newest(hits, "ts", "entry_id", limit)


def compliance_report(audit: DataFrame, tenant_id=None, start=None, end=None) -> DataFrame:
    """Per tenant: events, distinct users (empty ones aside) and failures among all entries of the
    period; all tenants when none is named."""
    return _matching(audit, start, end, tenant_id=tenant_id).groupBy("tenant_id").agg(
        F.count("*").alias("total_events"),
        F.count_distinct(F.nullif("user_id", F.lit(""))).alias("unique_users"),
        F.count_if(~F.col("success")).alias("failed_actions"),
    )


def action_breakdown(audit: DataFrame, tenant_id=None, start=None, end=None) -> DataFrame:
    """Entries of the period per tenant and action."""
    return _matching(audit, start, end, tenant_id=tenant_id).groupBy("tenant_id", "action").agg(F.count("*").alias("n"))
