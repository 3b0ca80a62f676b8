"""Queries over audit logs, metrics, tenants, access and webhooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import access, audit, metrics, tenants, webhooks
from ..sources import sinks
from . import inputs as I
from .catalog import query


def _case(column, mapping):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def iso(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


ISO = "%Y-%m-%d %H:%M:%S.%f"

# --- audit ----------------------------------------------------------------------

AUDIT = f"""
audit AS (
  SELECT event_id AS entry_id, ts, {_case('event_type', I.ACTIONS)} AS action,
         CAST(user_id % 10 AS VARCHAR) AS tenant_id,
         CASE WHEN user_id % 13 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS user_id,
         CASE WHEN event_type IN ('view', 'purchase', 'error') THEN 'document' END AS resource_type,
         json_extract_string(props, '$.k') AS resource_id, event_type <> 'error' AS success
  FROM events)
"""


@query("keep_last", "SELECT event_id AS entry_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000")
def keep_last(spark, sf):
    return audit.keep_last(I.audit(spark, sf), 5000).select("entry_id")


@query("query_audit", f"""
WITH {AUDIT}
SELECT entry_id, action, user_id, resource_id FROM audit
WHERE tenant_id = '3' AND resource_type = 'document' AND ts >= '2024-01-05' AND ts <= '2024-01-25' AND success
ORDER BY ts DESC, entry_id DESC LIMIT 100""")
def query_audit(spark, sf):
    found = audit.query_audit(
        I.audit(spark, sf), limit=100, tenant_id="3", user_id="", resource_type="document",
        start="2024-01-05", end="2024-01-25", success_only=True)
    return found.select("entry_id", "action", "user_id", "resource_id")


REPORTED = f"""
WITH {AUDIT},
kept AS (SELECT * FROM audit WHERE ts >= '2024-01-03' AND ts <= '2024-01-28')
"""


@query("compliance_report", f"""{REPORTED}
SELECT tenant_id, count(*) AS total_events, count(DISTINCT nullif(user_id, '')) AS unique_users,
       count(*) FILTER (NOT success) AS failed_actions
FROM kept GROUP BY tenant_id""")
def compliance_report(spark, sf):
    return audit.compliance_report(I.audit(spark, sf), start="2024-01-03", end="2024-01-28")


@query("action_breakdown", f"{REPORTED} SELECT tenant_id, action, count(*) AS n FROM kept GROUP BY tenant_id, action")
def action_breakdown(spark, sf):
    return audit.action_breakdown(I.audit(spark, sf), start="2024-01-03", end="2024-01-28")


@query("export_audit", f"""
WITH {AUDIT}
SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END
       || ',' || action || ',' || tenant_id || ',' || user_id || ',' || coalesce(resource_type, '') || ','
       || coalesce(resource_id, '') || ',' || CASE WHEN success THEN 'True' ELSE 'False' END AS value
FROM audit""")
def export_audit(spark, sf):
    return sinks.audit_lines(I.audit(spark, sf), "csv")


# --- metrics --------------------------------------------------------------------

OBS = f"""
obs AS (
  SELECT event_id, event_type AS name, ts, CAST(value AS DECIMAL(18,2)) AS value,
         {_case('event_type', I.KINDS)} AS kind,
         CASE event_type WHEN 'purchase' THEN 'purchase'
           WHEN 'error' THEN 'error{{code="' || CAST(user_id % 2 AS VARCHAR) || '",src="api"}}'
           ELSE event_type || '{{k="' || json_extract_string(props, '$.k') || '"}}' END AS key
  FROM events),
counters AS (SELECT key, CAST(sum(value) AS DOUBLE) AS value FROM obs WHERE kind = 'counter' GROUP BY key),
gauges AS (
  SELECT key, CAST(value AS DOUBLE) AS value FROM obs WHERE kind = 'gauge'
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1),
last_1000 AS (
  SELECT key, name, ts, event_id, value FROM obs WHERE kind = 'histogram'
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) <= 1000),
ranked AS (
  SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY value) - 1 AS place,
         count(*) OVER (PARTITION BY key) AS n FROM obs WHERE kind = 'histogram'),
stats AS (
  SELECT key, count(*) AS count, CAST(sum(value) AS DOUBLE) AS sum,
         CAST(sum(value) AS DOUBLE) / count(*) AS avg, CAST(min(value) AS DOUBLE) AS min, CAST(max(value) AS DOUBLE) AS max,
         CAST(max(value) FILTER (place = floor(n * CAST(0.50 AS DOUBLE))) AS DOUBLE) AS p50,
         CAST(max(value) FILTER (place = floor(n * CAST(0.95 AS DOUBLE))) AS DOUBLE) AS p95,
         CAST(max(value) FILTER (place = floor(n * CAST(0.99 AS DOUBLE))) AS DOUBLE) AS p99
  FROM ranked GROUP BY key)
"""


def _double(df, *columns):
    return df.select(*[F.col(c).cast("double").alias(c) if c in columns else F.col(c) for c in df.columns])


STATS = ("sum", "min", "max", "p50", "p95", "p99")


def _stats(df):
    # The mean is taken of the exact sum, as the SQL does.
    return _double(df, *STATS, "value").withColumn("avg", F.col("sum") / F.col("count"))


@query("metric_key", f"WITH {OBS} SELECT event_id AS obs_id, key FROM obs")
def metric_key(spark, sf):
    return metrics.add_metric_key(I.observations(spark, sf)).select("obs_id", "key")


@query("counters", f"WITH {OBS} SELECT * FROM counters")
def counters(spark, sf):
    return _double(metrics.counters(I.observations(spark, sf)), "value")


@query("gauges", f"WITH {OBS} SELECT * FROM gauges")
def gauges(spark, sf):
    return _double(metrics.gauges(I.observations(spark, sf)), "value")


@query("last_1000", f"WITH {OBS} SELECT key, event_id AS obs_id FROM last_1000")
def last_1000(spark, sf):
    return metrics.last_1000(I.observations(spark, sf), 1000).select("key", "obs_id")


@query("histogram_stats", f"WITH {OBS} SELECT * FROM stats")
def histogram_stats(spark, sf):
    return _stats(metrics.histogram_stats(I.observations(spark, sf)))


@query("all_metrics", f"""
WITH {OBS}
SELECT 'counter' AS family, key, value, CAST(NULL AS BIGINT) AS count, CAST(NULL AS DOUBLE) AS sum, NULL AS avg, NULL AS min,
       NULL AS max, NULL AS p50, NULL AS p95, NULL AS p99 FROM counters
UNION ALL SELECT 'gauge', key, value, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM gauges
UNION ALL SELECT 'histogram', key, NULL, count, sum, avg, min, max, p50, p95, p99 FROM stats""")
def all_metrics(spark, sf):
    return _stats(metrics.all_metrics(I.observations(spark, sf)))


@query("default_metrics", f"""
WITH {OBS}
SELECT key, value FROM counters UNION ALL SELECT key, value FROM gauges
UNION ALL SELECT k, CAST(0 AS DOUBLE) FROM (VALUES ('requests_total'), ('errors_total'), ('model_loaded'),
  ('active_jobs'), ('gpu_utilization_percent'), ('gpu_memory_used_mb')) AS d(k)""")
def default_metrics(spark, sf):
    obs = I.observations(spark, sf)
    values = _double(metrics.counters(obs).unionByName(metrics.gauges(obs)), "value")
    return metrics.default_metrics(values, dims.default_metrics(spark))


@query("request_timer", """
SELECT event_id AS obs_id, 'request_ms' AS name, 'histogram' AS kind, 'request_ms{task="' || event_type || '"}' AS key,
       floor(value * 1000) / 1000 AS value
FROM events
UNION ALL
SELECT event_id, 'request_ms_total', 'counter',
       'request_ms_total{status="' || CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END || '",task="' || event_type || '"}', 1.0
FROM events""")
def request_timer(spark, sf):
    e = I.table(spark, sf, "events")
    start = F.col("ts").cast("timestamp")
    micros = F.floor(F.col("value") * 1000).cast("bigint")
    timed = e.select(
        F.col("event_id").alias("obs_id"), start.alias("started"),
        F.timestamp_micros(F.unix_micros(start) + micros).alias("ended"),
        (F.col("event_type") == "error").alias("failed"), F.create_map(F.lit("task"), "event_type").alias("labels"))
    seen = metrics.request_timer(timed, "request_ms")
    return metrics.add_metric_key(seen).select("obs_id", "name", "kind", "key", "value")


@query("export_prometheus", f"""
WITH {OBS}, every AS (
  SELECT 'counter' AS family, key, split_part(key, '{{', 1) AS name, value, NULL AS count, NULL AS sum FROM counters
  UNION ALL SELECT 'gauge', key, split_part(key, '{{', 1), value, NULL, NULL FROM gauges
  UNION ALL SELECT 'histogram', key, split_part(key, '{{', 1), NULL, count, sum FROM stats)
SELECT key, 0 AS line_no, '# TYPE ' || name || ' ' || family AS value FROM every
UNION ALL SELECT key, 1, key || ' ' || CAST(value AS VARCHAR) FROM every WHERE family <> 'histogram'
UNION ALL SELECT key, 1, name || '_count' || substr(key, length(name) + 1) || ' ' || CAST(count AS VARCHAR) FROM every WHERE family = 'histogram'
UNION ALL SELECT key, 2, name || '_sum' || substr(key, length(name) + 1) || ' ' || CAST(sum AS VARCHAR) FROM every WHERE family = 'histogram'""")
def export_prometheus(spark, sf):
    return sinks.prometheus_lines(I.observations(spark, sf)).select("key", "line_no", "value")


# --- tenants --------------------------------------------------------------------

TIERS = ("free", "starter", "professional", "enterprise", "trial")
_TIER = "CASE c_custkey % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TIERS)) + " END"


def _quota_case(i):
    rows = {**{t: q[i] for t, q in dims.TIER_QUOTAS.items()}, "trial": dims.DEFAULT_QUOTA[i]}
    value = lambda v: "'" + ",".join(v) + "'" if isinstance(v, list) else str(v)
    return "CASE tier " + " ".join(f"WHEN '{t}' THEN {value(v)}" for t, v in rows.items()) + " END"


TENANTS = f"""
tenants AS (
  SELECT CAST(c_custkey AS VARCHAR) AS tenant_id, c_name AS name, {_TIER} AS tier, c_acctbal >= 0 AS is_active FROM customer),
quotas AS (
  SELECT *, CAST({_quota_case(0)} AS BIGINT) AS per_day, CAST({_quota_case(1)} AS BIGINT) AS per_batch,
         {_quota_case(4)} AS tasks, CAST({_quota_case(5)} AS BIGINT) AS retention FROM tenants)
"""


@query("tenant_quota", f"""
WITH {TENANTS}
SELECT tenant_id, tier, per_day AS max_requests_per_day, per_batch AS max_documents_per_batch, tasks AS allowed_tasks,
       retention AS retention_days FROM quotas""")
def tenant_quota(spark, sf):
    q = tenants.tenant_quota(I.tenants(spark, sf), dims.tier_quotas(spark))
    return q.select("tenant_id", "tier", "max_requests_per_day", "max_documents_per_batch",
                    F.array_join("allowed_tasks", ",").alias("allowed_tasks"), "retention_days")


REQUESTS = """
requests AS (
  SELECT event_id AS request_id, ts, CAST(user_id * 20 AS VARCHAR) AS tenant_id, CAST(user_id AS VARCHAR) AS user_id,
         CASE event_id % 5 WHEN 0 THEN 'ocr' WHEN 1 THEN 'layout' WHEN 2 THEN 'table' WHEN 3 THEN 'ner' ELSE 'invoice' END AS task_type,
         event_id % 25 AS document_count, 'key-' || CAST(user_id AS VARCHAR) AS key
  FROM events)
"""

# The daily limits of the tiers are far above a test user's requests, so the query lowers them.
DAY_LIMIT = 2


@query("check_quota", f"""
WITH {TENANTS}, {REQUESTS},
judged AS (
  SELECT r.*, q.tier, q.per_batch,
         CASE WHEN q.tenant_id IS NULL THEN 'Tenant not found'
              WHEN NOT q.is_active THEN 'Tenant is deactivated'
              WHEN NOT list_contains(string_split(q.tasks, ','), r.task_type)
                THEN 'Task ''' || r.task_type || ''' not allowed in ' || q.tier || ' tier'
              WHEN r.document_count > q.per_batch
                THEN 'Batch size ' || r.document_count || ' exceeds limit ' || q.per_batch END AS early
  FROM requests r LEFT JOIN quotas q ON q.tenant_id = r.tenant_id),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, CAST(ts AS DATE), early IS NULL ORDER BY ts, request_id) AS place FROM judged)
SELECT request_id, early IS NULL AND place <= {DAY_LIMIT} AS allowed,
       CASE WHEN early IS NOT NULL THEN early WHEN place > {DAY_LIMIT} THEN 'Daily request limit ({DAY_LIMIT}) reached' END AS reason
FROM placed""")
def check_quota(spark, sf):
    quotas = tenants.tenant_quota(I.tenants(spark, sf), dims.tier_quotas(spark))
    lowered = quotas.withColumn("max_requests_per_day", F.lit(DAY_LIMIT).cast("bigint"))
    return tenants.check_quota(I.requests(spark, sf), lowered).select("request_id", "allowed", "reason")


def _tenant_events(spark, sf):
    """Event stream of tenants: creation, tier changes, deactivation, from the events table."""
    e = I.table(spark, sf, "events")
    kinds = {"signup": "create", "purchase": "update_tier", "error": "deactivate"}
    tier = F.get(F.array(*map(F.lit, TIERS[:4])), (F.col("event_id") % 4).cast("int"))
    return e.where(F.col("event_type").isin(*kinds)).select(
        I.text(F.col("user_id")).alias("tenant_id"), F.col("event_id").alias("seq"),
        I._mapped("event_type", kinds).alias("event"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("T"), I.text(F.col("event_id")))).alias("name"),
        F.when(F.col("event_type") != "error", tier).alias("tier"))


# update_tier before the first creation is ignored only when a later creation resets the tier, which
# it always does, so the latest creation or change after the latest creation decides.
TENANT_STATE = """
ev AS (
  SELECT CAST(user_id AS VARCHAR) AS tenant_id, event_id AS seq, event_type,
         CASE event_id % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'starter' WHEN 2 THEN 'professional' ELSE 'enterprise' END AS tier
  FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
made AS (SELECT tenant_id, max(seq) AS created FROM ev WHERE event_type = 'signup' GROUP BY tenant_id),
state AS (
  SELECT m.tenant_id, 'T' || m.created AS name,
         arg_max(e.tier, e.seq) FILTER (e.event_type <> 'error') AS tier,
         count(*) FILTER (e.event_type = 'error') = 0 AS is_active
  FROM made m JOIN ev e ON e.tenant_id = m.tenant_id AND e.seq >= m.created GROUP BY m.tenant_id, m.created)
"""


@query("tenant_state", f"WITH {TENANT_STATE} SELECT * FROM state")
def tenant_state(spark, sf):
    return tenants.tenant_state(_tenant_events(spark, sf))


@query("workspaces", f"""
WITH {TENANTS}
SELECT tenant_id, 'Default' AS name, true AS is_default FROM tenants
UNION ALL
SELECT CAST(o_custkey * 2 AS VARCHAR), 'Workspace ' || o_orderkey, false FROM orders
WHERE CAST(o_custkey * 2 AS VARCHAR) IN (SELECT tenant_id FROM tenants)""")
def workspaces(spark, sf):
    wanted = I.table(spark, sf, "orders").select(
        I.text(F.col("o_custkey") * 2).alias("tenant_id"),
        F.concat(F.lit("Workspace "), I.text(F.col("o_orderkey"))).alias("name"))
    return tenants.workspaces(I.tenants(spark, sf), wanted)


USAGE = """
usage AS (
  SELECT CAST(user_id AS VARCHAR) AS tenant_id, ts, 1 AS request_count, event_id % 4 AS document_count,
         CAST(floor(value) AS BIGINT) AS processing_time_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_used
  FROM events),
daily AS (
  SELECT tenant_id, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(request_count) AS BIGINT) AS request_count,
         CAST(sum(document_count) AS BIGINT) AS document_count, CAST(sum(processing_time_ms) AS BIGINT) AS processing_time_ms,
         CAST(sum(tokens_used) AS BIGINT) AS tokens_used
  FROM usage GROUP BY 1, 2)
"""


@query("daily_usage", f"WITH {USAGE} SELECT * FROM daily")
def daily_usage(spark, sf):
    return tenants.daily_usage(I.usage(spark, sf)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("usage_on_day", f"""
WITH {USAGE}, {TENANTS}, wanted AS (SELECT min(day) AS day FROM daily)
SELECT t.tenant_id, wanted.day, coalesce(request_count, 0) AS request_count, coalesce(document_count, 0) AS document_count,
       coalesce(processing_time_ms, 0) AS processing_time_ms, coalesce(tokens_used, 0) AS tokens_used
FROM tenants t CROSS JOIN wanted LEFT JOIN daily d ON d.tenant_id = t.tenant_id AND d.day = wanted.day""")
def usage_on_day(spark, sf):
    """The first day of the log, for all tenants."""
    usage = I.usage(spark, sf)
    day = usage.agg(F.min(F.to_date("ts"))).first()[0]
    return tenants.usage_on(I.tenants(spark, sf), usage, day).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("usage_summary", f"""
WITH {USAGE}, {TENANTS},
sums AS (SELECT tenant_id, sum(request_count) AS r, sum(document_count) AS d, sum(processing_time_ms) AS p FROM usage GROUP BY 1)
SELECT t.tenant_id, CAST(coalesce(r, 0) AS BIGINT) AS total_requests, CAST(coalesce(d, 0) AS BIGINT) AS total_documents,
       CAST(coalesce(p, 0) AS BIGINT) AS total_processing_ms,
       CAST(coalesce(p, 0) // greatest(coalesce(r, 0), 1) AS BIGINT) AS avg_processing_ms
FROM tenants t LEFT JOIN sums s ON s.tenant_id = t.tenant_id""")
def usage_summary(spark, sf):
    return tenants.usage_summary(I.tenants(spark, sf), I.usage(spark, sf))


# --- access ---------------------------------------------------------------------

KEYS = """
api_keys AS (
  SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS key_id, CAST(c_custkey % 10 AS VARCHAR) AS tenant_id,
         CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 30 AS INTEGER)) END AS expires_at,
         c_acctbal >= 0 AS is_active
  FROM customer),
resolved AS (
  SELECT event_id AS request_id, ts, k.key_id, coalesce(k.is_active AND (k.expires_at IS NULL OR ts <= k.expires_at), false) AS valid
  FROM events e LEFT JOIN api_keys k ON k.c_custkey = e.user_id)
"""


@query("resolve_keys", f"WITH {KEYS} SELECT request_id, key_id, valid FROM resolved")
def resolve_keys(spark, sf):
    return access.resolve_keys(I.requests(spark, sf), I.api_keys(spark, sf)).select("request_id", "key_id", "valid")


@query("last_used", f"WITH {KEYS} SELECT key_id, strftime(max(ts), '{ISO}') AS last_used FROM resolved WHERE valid GROUP BY key_id")
def last_used(spark, sf):
    used = access.last_used(access.resolve_keys(I.requests(spark, sf), I.api_keys(spark, sf)))
    return used.select("key_id", iso("last_used").alias("last_used"))


@query("keys_of_tenant", "SELECT CAST(c_custkey AS VARCHAR) AS key_id, c_acctbal >= 0 AS is_active FROM customer WHERE c_custkey % 10 = 4")
def keys_of_tenant(spark, sf):
    return access.keys_of_tenant(I.api_keys(spark, sf), "4").select("key_id", "is_active")


_ROLE_NAMES = ("admin", "manager", "user", "readonly", "guest")
GRANTS = "grants(role_no, permission) AS (VALUES " + ", ".join(
    f"({i}, '{p}')" for i, r in enumerate(_ROLE_NAMES) for p in dims.ROLES.get(r, [])) + ")"


@query("role_permissions", f"""
WITH {GRANTS}
SELECT CAST(c_custkey AS VARCHAR) AS user_id, permission FROM customer JOIN grants ON role_no = c_custkey % 5
UNION SELECT CAST(c_custkey AS VARCHAR), 'tenant:manage' FROM customer WHERE c_custkey % 4 = 0""")
def role_permissions(spark, sf):
    return access.users_permissions(I.users(spark, sf), dims.role_permissions(spark)).select("user_id", "permission")


_ASKED = "(VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(dims.PERMISSIONS)) + ")"


@query("check_permissions", f"""
WITH {GRANTS}, asked AS (
  SELECT event_id, user_id * 12 AS u, permission FROM events JOIN {_ASKED} AS p(no, permission) ON no = event_id % 11)
SELECT event_id AS request_id, permission,
       EXISTS (SELECT 1 FROM customer WHERE c_custkey = u)
       AND ((u % 4 = 0 AND permission = 'tenant:manage')
            OR EXISTS (SELECT 1 FROM grants g WHERE g.role_no = u % 5 AND g.permission = asked.permission)) AS permitted
FROM asked""")
def check_permissions(spark, sf):
    e = I.table(spark, sf, "events")
    permission = F.get(F.array(*map(F.lit, dims.PERMISSIONS)), (F.col("event_id") % 11).cast("int"))
    asked = e.select(F.col("event_id").alias("request_id"), I.text(F.col("user_id") * 12).alias("user_id"),
                     permission.alias("permission"))
    checked = access.check_permissions(asked, I.users(spark, sf), dims.role_permissions(spark))
    return checked.select("request_id", "permission", "permitted")


LIMIT, WINDOW = 2, 86400
RATE = f"""
WITH RECURSIVE r AS (
  SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk(user_id, n, event_id, ts, start, used, allowed) AS (
  SELECT user_id, n, event_id, ts, ts, 1, true FROM r WHERE n = 1
  UNION ALL
  SELECT r.user_id, r.n, r.event_id, r.ts,
         CASE WHEN r.ts > w.start + INTERVAL {WINDOW} SECOND THEN r.ts ELSE w.start END,
         CASE WHEN r.ts > w.start + INTERVAL {WINDOW} SECOND THEN 1 WHEN w.used < {LIMIT} THEN w.used + 1 ELSE w.used END,
         r.ts > w.start + INTERVAL {WINDOW} SECOND OR w.used < {LIMIT}
  FROM walk w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1)
SELECT event_id AS request_id, allowed, CASE WHEN allowed THEN {LIMIT} - used ELSE 0 END AS remaining,
       strftime(start + INTERVAL {WINDOW} SECOND, '{ISO}') AS reset_at
FROM walk"""


def _limited(requests, ranges=None):
    out = access.rate_limit(requests, LIMIT, WINDOW, ranges=ranges)
    return out.select("request_id", "allowed", "remaining", iso("reset_at").alias("reset_at"))


@query("rate_limit", RATE)
def rate_limit(spark, sf):
    return _limited(I.requests(spark, sf))


@query("rate_limit_hot_keys", RATE.replace("user_id", "hot").replace("FROM events)", "FROM (SELECT *, user_id % 2 AS hot FROM events))"))
def rate_limit_hot_keys(spark, sf):
    """Two keys with half of all requests each, so that a key lies in many ranges."""
    hot = F.concat(F.lit("key-"), I.text(F.col("user_id").cast("bigint") % 2))
    return _limited(I.requests(spark, sf).withColumn("key", hot), 24)


# --- webhooks -------------------------------------------------------------------

SUBS = """
subs AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS webhook_id, n_nationkey AS k,
         CASE WHEN n_nationkey % 4 <> 0 THEN 'secret-' || n_nationkey END AS secret, n_nationkey % 7 <> 0 AS active
  FROM nation),
wanted AS (
  SELECT webhook_id, secret, 'extraction.completed' AS event_type FROM subs WHERE active AND k % 2 = 0
  UNION ALL SELECT webhook_id, secret, 'extraction.failed' FROM subs WHERE active AND k % 3 = 0
  UNION ALL SELECT webhook_id, secret, 'batch.progress' FROM subs WHERE active AND k % 5 = 0)
"""
HOOKS = f"""
hooks AS (
  SELECT event_id, {_case('event_type', I.HOOK_EVENTS)} AS event_type, ts,
         CASE WHEN event_id % 2 = 0 THEN 'job-' || user_id END AS job_id, json_extract_string(props, '$.k') AS k
  FROM events),
bodies AS (
  SELECT event_id, event_type,
         '{{"event_type":"' || event_type || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","job_id":'
         || coalesce('"' || job_id || '"', 'null') || ',"document_id":"' || event_id || '","data":{{"k":"' || k || '"}}}}' AS payload
  FROM hooks)
"""


@query("fan_out", f"""
WITH {SUBS}, {HOOKS} SELECT event_id, webhook_id, h.event_type FROM hooks h JOIN wanted w ON w.event_type = h.event_type""")
def fan_out(spark, sf):
    return webhooks.fan_out(I.hook_events(spark, sf), I.subscriptions(spark, sf)).select("event_id", "webhook_id", "event_type")


@query("payloads", f"WITH {HOOKS} SELECT event_id, payload FROM bodies")
def payloads(spark, sf):
    return webhooks.payloads(I.hook_events(spark, sf)).select("event_id", "payload")


# HMAC by its definition, with the key block padded and flipped byte by byte.
_BLOCK = ("array_to_string(list_transform(range(64), lambda i: printf('%02x', xor(CASE WHEN i < length(secret) "
          "THEN ascii(substr(secret, CAST(i + 1 AS INTEGER), 1)) ELSE 0 END, {}))), '')")


@query("sign_payloads", f"""
WITH {SUBS}, {HOOKS},
pads AS (SELECT *, {_BLOCK.format(0x36)} AS inner_pad, {_BLOCK.format(0x5c)} AS outer_pad FROM wanted)
SELECT event_id, webhook_id, CASE WHEN secret IS NOT NULL THEN
  sha256(unhex(outer_pad || sha256(unhex(inner_pad || hex(encode(payload)))))) END AS signature
FROM bodies b JOIN pads p ON p.event_type = b.event_type""")
def sign_payloads(spark, sf):
    subs = webhooks.with_signing_keys(I.subscriptions(spark, sf))
    sent = webhooks.fan_out(webhooks.payloads(I.hook_events(spark, sf)), subs)
    return webhooks.sign_payloads(sent).select("event_id", "webhook_id", "signature")


ATTEMPTS = """
tries AS (
  SELECT event_id, user_id % 25 AS hook, ts, CAST(t AS BIGINT) AS t, (event_id * 7 + t * 3) % 8 AS mark
  FROM events, unnest(range(1, CAST(event_id % 4 + 2 AS BIGINT))) AS u(t)),
last AS (
  SELECT event_id, hook, ts, max(t) AS t, min(t) FILTER (mark = 0) AS won,
         arg_max(mark, t) FILTER (mark < 6) AS answered FROM tries GROUP BY event_id, hook, ts),
deliveries AS (
  SELECT event_id AS delivery_id, CAST(hook AS VARCHAR) AS webhook_id,
         CASE WHEN won IS NOT NULL THEN 'success' WHEN t >= 3 THEN 'failed' ELSE 'pending' END AS status,
         CAST(coalesce(won, t) AS INTEGER) AS attempts, ts + to_seconds(5 * coalesce(won, t)) AS last_attempt,
         CASE WHEN won IS NOT NULL THEN 200 WHEN answered IS NOT NULL THEN 500 END AS response_code,
         CASE WHEN won IS NOT NULL THEN 'answer 0' WHEN answered IS NOT NULL THEN 'answer ' || answered END AS response_body,
         CASE WHEN won IS NULL AND t < 3 THEN CAST(5 * t AS INTEGER) END AS next_wait_seconds,
         coalesce(won, t) > 3 AS over_limit
  FROM last)
"""


def _deliveries(spark, sf):
    return webhooks.delivery_state(I.attempts(spark, sf), I.subscriptions(spark, sf))


@query("delivery_state", f"""
WITH {ATTEMPTS} SELECT * EXCLUDE (last_attempt), strftime(last_attempt, '{ISO}') AS last_attempt FROM deliveries""")
def delivery_state(spark, sf):
    return _deliveries(spark, sf).withColumn("last_attempt", iso("last_attempt"))


@query("delivery_history", f"""
WITH {ATTEMPTS} SELECT delivery_id, attempts FROM deliveries WHERE webhook_id = '7' AND status = 'failed'
ORDER BY last_attempt DESC, delivery_id DESC LIMIT 100""")
def delivery_history(spark, sf):
    return webhooks.delivery_history(_deliveries(spark, sf), 100, "7", "failed").select("delivery_id", "attempts")


@query("subscriptions_state", """
SELECT CAST(user_id AS VARCHAR) AS webhook_id, 'https://hooks.example.com/' || event_id AS url
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events
      WHERE event_type IN ('signup', 'error'))
WHERE rn = 1 AND event_type = 'signup'""")
def subscriptions_state(spark, sf):
    e = I.table(spark, sf, "events").where(F.col("event_type").isin("signup", "error"))
    changes = e.select(
        I.text(F.col("user_id")).alias("webhook_id"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", "register").otherwise("unregister").alias("event"),
        F.concat(F.lit("https://hooks.example.com/"), I.text(F.col("event_id"))).alias("url"))
    return webhooks.subscriptions_state(changes)
