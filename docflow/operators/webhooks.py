"""Webhook tables: who gets which event, what is sent, how deliveries went. No HTTP."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import newest, salted_join


def subscriptions_state(changes: DataFrame) -> DataFrame:
    """Current subscriptions from register/unregister events (webhook_id, seq, event, ...):
    the latest event of an id decides."""
    kept = [c for c in changes.columns if c not in ("webhook_id", "seq", "event")]
    row = F.struct("event", *kept)
    last = changes.groupBy("webhook_id").agg(F.max_by(row, "seq").alias("_r"))
    return last.where(F.col("_r.event") == "register").select("webhook_id", *[F.col("_r")[c].alias(c) for c in kept])


def fan_out(events: DataFrame, subscriptions: DataFrame, salts: int | None = None) -> DataFrame:
    """One row per event and active subscription listing its type.

    The subscriptions are unfolded to (type, webhook), so this is an equi-join. There are only
    seven types, so the join is salted: no type ends up in a single task. ``salts`` is the number of
    tasks per type, as many as there are shuffle partitions if not given.
    """
    listed = subscriptions.where("active").withColumn("event_type", F.explode(F.array_distinct("events"))).drop("events", "active")
    salts = salts or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return salted_join(events, listed, "event_type", salts)


def payloads(events: DataFrame, out="payload") -> DataFrame:
    """Adds the JSON body: event type, time, job, document and data; nulls are kept."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
    body = F.struct("event_type", stamp, "job_id", "document_id", "data")
    return events.withColumn(out, F.to_json(body, {"ignoreNullFields": "false"}))


def _pad(key: Column, mask: int) -> Column:
    """The 64-byte key block of HMAC-SHA256 with every byte flipped by ``mask``, as binary."""
    short = F.when(F.length(key) > 64, F.unhex(F.sha2(key, 256))).otherwise(key)
    digits = F.rpad(F.hex(short), 128, "0")
    flipped = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.lpad(
            F.hex(F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(mask)).cast("bigint")), 2, "0"),
    )
    return F.unhex(F.array_join(flipped, ""))


def with_signing_keys(subscriptions: DataFrame, secret="secret") -> DataFrame:
    """Adds the two HMAC key blocks of each secret, so signing a payload is only two hashes."""
    key = F.col(secret).cast("binary")
    some = F.length(F.coalesce(secret, F.lit(""))) > 0
    return subscriptions.withColumn("_inner", F.when(some, _pad(key, 0x36))).withColumn(
        "_outer", F.when(some, _pad(key, 0x5C)))


def sign_payloads(deliveries: DataFrame, payload="payload", out="signature") -> DataFrame:
    """HMAC-SHA256 hex of each payload (rows from :func:`with_signing_keys`), null without secret."""
    inner = F.unhex(F.sha2(F.concat("_inner", F.col(payload).cast("binary")), 256))
    return deliveries.withColumn(out, F.sha2(F.concat("_outer", inner), 256)).drop("_inner", "_outer")


def delivery_state(attempts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """State of each delivery from its attempts (delivery_id, webhook_id, attempt_no, ts, code,
    body, error).

    The first success (code 2xx) ends the delivery; with all tries used up it failed; otherwise it
    is pending and the wait is delay times the number of the last attempt. Attempts beyond the
    subscription's retry count count like any other, and ``over_limit`` marks their delivery. A
    delivery whose subscription is gone has no limit and no wait, and is pending until a success.
    """
    limits = subscriptions.select("webhook_id", "retry_count", "retry_delay_seconds")
    tried = attempts.join(limits, "webhook_id", "left")
    success = F.coalesce(F.col("code").between(200, 299), F.lit(False))
    first = tried.groupBy("delivery_id", "webhook_id").agg(
        F.min(F.when(success, F.col("attempt_no"))).alias("_won"),
        F.min_by(F.struct("ts", "code", "body"), F.when(success, F.col("attempt_no"))).alias("_win"),
        F.max("attempt_no").alias("_last"),
        F.max_by(F.struct("ts"), "attempt_no").alias("_end"),
        # an attempt without an answer leaves the previous answer in place
        F.max_by(F.struct("code", "body"), F.when(F.col("code").isNotNull(), F.col("attempt_no"))).alias("_answer"),
        F.max("retry_count").alias("_tries"), F.max("retry_delay_seconds").alias("_delay"),
    )
    won = F.col("_won").isNotNull()
    status = F.when(won, "success").when(F.col("_last") >= F.col("_tries"), "failed").otherwise("pending")
    return first.select(
        "delivery_id", "webhook_id", status.alias("status"),
        F.when(won, F.col("_won")).otherwise(F.col("_last")).alias("attempts"),
        F.when(won, F.col("_win.ts")).otherwise(F.col("_end.ts")).alias("last_attempt"),
        F.when(won, F.col("_win.code")).otherwise(F.col("_answer.code")).alias("response_code"),
        F.when(won, F.col("_win.body")).otherwise(F.col("_answer.body")).alias("response_body"),
        F.when(status == "pending", F.col("_delay") * F.col("_last")).alias("next_wait_seconds"),
        F.coalesce(F.when(won, F.col("_won")).otherwise(F.col("_last")) > F.col("_tries"), F.lit(False)).alias("over_limit"),
    )


def delivery_history(deliveries: DataFrame, limit: int, webhook_id=None, status=None, ts="last_attempt") -> DataFrame:
    """The last ``limit`` matching deliveries, oldest first."""
    out = deliveries
    if webhook_id:
        out = out.where(F.col("webhook_id") == webhook_id)
    if status:
        out = out.where(F.col("status") == status)
    return newest(out, ts, "delivery_id", limit).orderBy(ts, "delivery_id")
