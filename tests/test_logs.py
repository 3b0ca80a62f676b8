import hashlib
import hmac
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow import dims
from docflow.functions import ranking
from docflow.operators import access, audit, media, metrics, tenants, webhooks

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


# --- ordering helpers -----------------------------------------------------------


def test_bucketed_helpers_equal_plain_windows(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i, rng.randint(0, 50), rng.randint(0, 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, t int, v int").repartition(5)
    bucket = F.floor(F.col("t") / 7)
    plain = {}
    for k in "ab":
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))
        total = 0
        for n, (_, i, _, v) in enumerate(mine):
            total += v
            plain[i] = (n + 1, total)
    ranks = {r["i"]: r["rank"] for r in ranking.bucketed_rank(df, ["k"], bucket, ["t", "i"]).collect()}
    sums = {r["i"]: r["s"] for r in ranking.bucketed_running_sum(df, ["k"], bucket, ["t", "i"], F.col("v"), "s").collect()}
    assert {i: (ranks[i], sums[i]) for i in ranks} == plain
    leads = {r["i"]: r["next_v"] for r in ranking.bucketed_lead(df, ["k"], F.floor(F.col("i") / 7), "i", "v").collect()}
    for k in "ab":
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        assert [leads[r[1]] for r in mine] == [r[3] for r in mine[1:]] + [None]


def test_top_per_key(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3).repartition(7)
    top = ranking.top_per_key(df, ["k"], [F.col("id").desc()], 5, salts=4)
    assert sorted(r["id"] for r in top.collect()) == list(range(985, 1000))
    assert [r["id"] for r in ranking.top_per_key(df, [], [F.col("id").desc()], 3, salts=4).collect()] == [999, 998, 997]


def test_salted_join(spark):
    left = spark.range(200).withColumn("k", F.when(F.col("id") < 150, 0).otherwise(F.col("id") % 5))
    right = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (9, "d")], "k int, v string")
    got = ranking.salted_join(left, right, "k", 4)
    want = left.join(right, "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


# --- audit ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def entries(spark):
    rows = [
        (f"{i:03d}", at(i), ["auth.login", "document.uploaded"][i % 2], f"t{i % 3}", "" if i == 0 else f"u{i % 4}", "document", i % 5 != 0)
        for i in range(60)]
    return spark.createDataFrame(rows, "entry_id string, ts timestamp, action string, tenant_id string, user_id string, resource_type string, success boolean")


def test_audit_queries(entries):
    assert [r["entry_id"] for r in audit.keep_last(entries, 3).collect()] == ["059", "058", "057"]
    assert [r["entry_id"] for r in audit.keep_last(entries, 2000).collect()][:2] == ["059", "058"]
    found = audit.query_audit(entries, 100, tenant_id="t0", user_id="", start=at(3), end=at(9)).collect()
    assert [r["entry_id"] for r in found] == ["009", "006", "003"]
    assert audit.query_audit(entries, success_only=True, limit=1000).count() == 48
    assert audit.query_audit(entries, 100, action="auth.login", resource_type="x").count() == 0
    assert audit.query_audit(entries, 100).count() == 60 and audit.query_audit(entries, limit=7).count() == 7


def test_compliance(entries):
    report = audit.compliance_report(entries, "t0", at(0), at(30)).collect()
    assert [tuple(r) for r in report] == [("t0", 11, 4, 3)]
    assert audit.compliance_report(entries).count() == 3
    counts = {(r["tenant_id"], r["action"]): r["n"] for r in audit.action_breakdown(entries, "t1").collect()}
    assert counts == {("t1", "auth.login"): 10, ("t1", "document.uploaded"): 10}


# --- metrics ------------------------------------------------------------------------


def observe(spark, rows):
    return spark.createDataFrame(rows, "name string, labels map<string,string>, kind string, ts timestamp, obs_id long, value double")


def test_counters_gauges_and_keys(spark):
    obs = observe(spark, [
        ("req", {"b": "2", "a": "1"}, "counter", at(0), 1, 1.0), ("req", {"a": "1", "b": "2"}, "counter", at(1), 2, 2.5),
        ("req", {}, "counter", at(1), 3, 1.0), ("load", None, "gauge", at(5), 4, 7.0), ("load", None, "gauge", at(5), 5, 8.0), ("load", None, "gauge", at(1), 6, 9.0)])
    assert {r["key"]: r["value"] for r in metrics.counters(obs).collect()} == {'req{a="1",b="2"}': 3.5, "req": 1.0}
    assert {r["key"]: r["value"] for r in metrics.gauges(obs).collect()} == {"load": 8.0}
    both = metrics.counters(obs).unionByName(metrics.gauges(obs))
    filled = {r["key"]: r["value"] for r in metrics.default_metrics(both, dims.default_metrics(spark)).collect()}
    assert len(filled) == 9 and filled["errors_total"] == 0.0


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 5000])
def test_histograms(spark, n):
    rng = random.Random(n)
    values = [float(rng.randint(0, 10**6)) for _ in range(n)]
    obs = observe(spark, [("ms", {"k": "v"}, "histogram", at(i), i, v) for i, v in enumerate(values)]).repartition(3)
    row = metrics.histogram_stats(obs).collect()
    kept = sorted(values)
    size = len(kept)
    pick = lambda p: kept[min(int(size * p), size - 1)]
    assert len(row) == 1 and row[0]["key"] == 'ms{k="v"}'
    assert (row[0]["count"], row[0]["min"], row[0]["max"]) == (size, kept[0], kept[-1])
    assert (row[0]["p50"], row[0]["p95"], row[0]["p99"]) == (pick(0.5), pick(0.95), pick(0.99))
    assert math.isclose(row[0]["sum"], sum(kept)) and math.isclose(row[0]["avg"], sum(kept) / size)
    assert metrics.histogram_stats(obs.where("false")).count() == 0
    assert metrics.last_1000(obs, 1000).count() == min(n, 1000)


def test_histogram_of_equal_and_negative_values(spark):
    values = [1.0] * 3000 + [-2.5, -2.5, 0.0, 1e12]
    row = metrics.histogram_stats(observe(spark, [("ms", {}, "histogram", at(i), i, v) for i, v in enumerate(values)])).first()
    assert (row["count"], row["min"], row["p50"], row["p99"], row["max"]) == (3004, -2.5, 1.0, 1.0, 1e12)


def test_reports_count_every_entry(spark):
    rows = spark.range(25_000).select(
        F.lit("t").alias("tenant_id"), F.col("id").cast("string").alias("entry_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").cast("string").alias("user_id"),
        (F.col("id") % 2 == 0).alias("success"), F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("action"))
    report = audit.compliance_report(rows).first()
    assert (report["total_events"], report["unique_users"], report["failed_actions"]) == (25_000, 25_000, 12_500)
    assert {r["action"]: r["n"] for r in audit.action_breakdown(rows).collect()} == {"a": 5000, "b": 20_000}


def test_timer(spark):
    df = spark.createDataFrame([(1, at(0), at(1.5), False, {"e": "x"}), (2, at(0), at(2), True, {"status": "old"})],
                               "obs_id long, started timestamp, ended timestamp, failed boolean, labels map<string,string>")
    seen = metrics.add_metric_key(metrics.request_timer(df, "t")).collect()
    assert {(r["key"], r["value"]) for r in seen} == {
        ('t{e="x"}', 1500.0), ('t_total{e="x",status="success"}', 1.0), ('t{status="old"}', 2000.0), ('t_total{status="error"}', 1.0)}


# --- tenants ------------------------------------------------------------------------


def test_quota_reasons(spark):
    rows = [("a", "A", "free", True), ("b", "B", "free", False), ("c", "C", "gold", True)]
    ts = tenants.tenant_quota(spark.createDataFrame(rows, "tenant_id string, name string, tier string, is_active boolean"), dims.tier_quotas(spark))
    quota = {r["tenant_id"]: (r["max_documents_per_batch"], r["retention_days"]) for r in ts.collect()}
    assert quota == {"a": (5, 1), "b": (5, 1), "c": (10, 7)}
    lowered = ts.withColumn("max_requests_per_day", F.lit(2).cast("bigint"))
    asked = [
        (1, at(0), "x", "ocr", 1), (2, at(1), "b", "nope", 99), (3, at(2), "a", "invoice", 99), (4, at(3), "a", "ocr", 6),
        (5, at(4), "a", "ocr", 5), (6, at(5), "a", "layout", 1), (7, at(6), "a", "ocr", 1), (8, at(86400), "a", "ocr", 1)]
    df = spark.createDataFrame(asked, "request_id long, ts timestamp, tenant_id string, task_type string, document_count int")
    got = {r["request_id"]: r["reason"] for r in tenants.check_quota(df, lowered).collect()}
    assert got == {
        1: "Tenant not found", 2: "Tenant is deactivated", 3: "Task 'invoice' not allowed in free tier", 4: "Batch size 6 exceeds limit 5",
        5: None, 6: None, 7: "Daily request limit (2) reached", 8: None}


def test_tenant_state(spark):
    rows = [
        ("a", 1, "create", "A", "free"), ("a", 2, "update_tier", None, "starter"), ("b", 1, "deactivate", None, None), ("b", 2, "create", "B", "free"),
        ("c", 1, "create", "C", "free"), ("c", 2, "deactivate", None, None), ("d", 1, "update_tier", None, "free"),
        ("e", 1, "create", "E", "free"), ("e", 2, "update_tier", None, "starter"), ("e", 3, "create", "E2", "enterprise")]
    got = {tuple(r) for r in tenants.tenant_state(spark.createDataFrame(rows, "tenant_id string, seq int, event string, name string, tier string")).collect()}
    assert got == {("a", "A", "starter", True), ("b", "B", "free", True), ("c", "C", "free", False), ("e", "E2", "enterprise", True)}


def test_usage(spark):
    rows = [("a", at(0), 1, 2, 100, 5), ("a", at(10), 2, 0, 51, 5), ("a", at(90000), 1, 1, 0, 0)]
    usage = spark.createDataFrame(rows, "tenant_id string, ts timestamp, request_count long, document_count long, processing_time_ms long, tokens_used long")
    days = [tuple(r)[2:] for r in tenants.daily_usage(usage).orderBy("day").collect()]
    assert days == [(3, 2, 151, 10), (1, 1, 0, 0)]
    who = spark.createDataFrame([("a",), ("z",)], "tenant_id string")
    assert {tuple(r) for r in tenants.usage_summary(who, usage).collect()} == {("a", 4, 3, 151, 37), ("z", 0, 0, 0, 0)}
    recent = tenants.usage_summary(who, usage, days=1, today="2024-01-02")
    assert recent.where("tenant_id = 'a'").first()["total_requests"] == 1
    spaces = tenants.workspaces(who, spark.createDataFrame([("a", "w"), ("q", "w")], "tenant_id string, name string"))
    assert {tuple(r) for r in spaces.collect()} == {("a", "Default", True), ("z", "Default", True), ("a", "w", False)}


# --- access -------------------------------------------------------------------------


def test_keys(spark):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    keys = spark.createDataFrame([
        ("k1", digest("one"), "t", None, True), ("k2", digest("two"), "t", at(10), True), ("k3", digest("drei ü"), "u", None, False)],
        "key_id string, key_hash string, tenant_id string, expires_at timestamp, is_active boolean")
    asked = spark.createDataFrame([(1, at(0), "one"), (2, at(10), "two"), (3, at(11), "two"), (4, at(0), "drei ü"), (5, at(0), "no"), (6, at(7), "one")],
                                  "request_id int, ts timestamp, key string")
    resolved = access.resolve_keys(asked, keys)
    assert {r["request_id"]: (r["key_id"], r["valid"]) for r in resolved.collect()} == {
        1: ("k1", True), 2: ("k2", True), 3: ("k2", False), 4: ("k3", False), 5: (None, False), 6: ("k1", True)}
    assert {r["key_id"]: r["last_used"] for r in access.last_used(resolved).collect()} == {"k1": at(7), "k2": at(10)}
    assert access.keys_of_tenant(keys, "t").count() == 2


def test_permissions(spark):
    users = spark.createDataFrame([("a", "admin", [], True), ("r", "readonly", ["batch:create"], False), ("g", "ghost", None, True)],
                                  "user_id string, role string, permissions array<string>, is_active boolean")
    asked = spark.createDataFrame([("a", "tenant:manage"), ("r", "batch:create"), ("r", "batch:read"), ("r", "audit:read"), ("g", "batch:read"), ("x", "batch:read")],
                                  "user_id string, permission string")
    got = [r["permitted"] for r in access.check_permissions(asked, users, dims.role_permissions(spark)).orderBy("user_id", "permission").collect()]
    assert got == [True, False, False, True, True, False]
    sizes = {r["role"]: r["count"] for r in dims.role_permissions(spark).groupBy("role").count().collect()}
    assert sizes == {"admin": 11, "manager": 9, "user": 5, "readonly": 2}


def walk(times, limit, window):
    """The rule, one request after the other."""
    out, start, used = [], None, 0
    for t in times:
        if start is None or t > start + window:
            start, used = t, 0
        ok = used < limit
        used += ok
        out.append((ok, limit - used if ok else 0, start + window))
    return out


@pytest.mark.parametrize("chunk", [None, 3, 40])
def test_rate_limit(spark, chunk):
    rng = random.Random(5)
    rows, want = [], {}
    for key, n, step in (("busy", 300, 3), ("calm", 40, 30), ("edge", 30, 5), ("once", 1, 1)):
        t, times = 1000, []
        for _ in range(n):
            t += rng.choice([0, step, step, 10]) if key != "edge" else 5
            times.append(t)
        for j, (t, verdict) in enumerate(zip(times, walk(times, 3, 10))):
            ident = len(rows)
            rows.append((ident, key, at(t)))
            want[ident] = (verdict[0], verdict[1], at(verdict[2]))
    df = spark.createDataFrame(rows, "request_id long, key string, ts timestamp").repartition(6)
    got = access.rate_limit(df, 3, 10, ranges=chunk)
    assert {r["request_id"]: (r["allowed"], r["remaining"], r["reset_at"]) for r in got.collect()} == want


def test_rate_limit_survives_small_arrow_batches(spark):
    df = spark.range(500).select(
        F.col("id").alias("request_id"), F.lit("k").alias("key"), F.timestamp_seconds(F.col("id") * 3).alias("ts"))
    want = walk([3 * i for i in range(500)], 2, 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        for how in ({}, {"ranges": 9}):
            got = access.rate_limit(df, 2, 60, **how).orderBy("request_id").collect()
            assert [(r["allowed"], r["remaining"]) for r in got] == [w[:2] for w in want]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_chunk_steps_cover_every_inherited_window():
    rng = np.random.default_rng(2)
    for _ in range(200):
        window, begin = int(rng.integers(1, 30)), 100
        times = np.sort(rng.integers(begin, begin + 60, size=rng.integers(1, 25)))
        weights = rng.integers(1, 4, size=len(times))
        bounds, exits, counts = access.chunk_steps(times, weights, window)
        for start in range(begin - window - 5, int(times[0]) + 1):
            i = int(np.searchsorted(bounds, start + window, side="right"))
            open_at, n = start, 0
            for t, w in zip(times.tolist(), weights.tolist()):
                if t > open_at + window:
                    open_at, n = t, 0
                n += w
            if i < len(bounds):
                assert (exits[i], counts[i]) == (open_at, n)
            else:
                assert open_at == start


def test_window_places_equal_a_walk():
    rng = np.random.default_rng(4)
    for _ in range(200):
        window, sizes = int(rng.integers(1, 40)), rng.integers(1, 30, size=rng.integers(1, 6))
        runs = [np.sort(rng.integers(0, 120, size=n)) for n in sizes]
        weights = rng.integers(1, 3, size=sizes.sum())
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        inherited = {k: (int(runs[k][0] - rng.integers(0, 60)), int(rng.integers(1, 9))) for k in range(len(runs)) if rng.random() < 0.5}
        begin, place = access.window_places(np.concatenate(runs), weights, starts, inherited, window)
        at_row = 0
        for k, times in enumerate(runs):
            opened, n = inherited.get(k, (None, 0))
            for t in times.tolist():
                if opened is None or t > opened + window:
                    opened, n = t, 0
                n += int(weights[at_row])
                assert (begin[at_row], place[at_row]) == (opened, n)
                at_row += 1


def test_one_histogram_of_close_values_lies_in_many_ranges(spark):
    """Exact percentiles of a key whose distinct values all lie between 100 and 101."""
    n = 60_000
    values = spark.range(n).select((F.lit(100) + F.pmod(F.col("id") * 7919, F.lit(n)) / F.lit(float(n))).alias("value"))
    obs = values.select(F.lit("h").alias("name"), F.lit(None).cast("map<string,string>").alias("labels"), F.lit("histogram").alias("kind"), "value")
    obs = obs.unionByName(spark.createDataFrame([("g", None, "histogram", v) for v in (1.0, 1.0, 2.0, None)] + [("e", None, "histogram", None)],
                                                "name string, labels map<string,string>, kind string, value double"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counted = metrics._counted(obs, ("histogram",))
        assert counted.where("key = 'h'").select("_range").distinct().count() >= 3
        got = {r["key"]: r for r in metrics.histogram_stats(obs).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [got["h"][p] for p in ("p50", "p95", "p99")] == [100 + int(n * p) / n for p in (0.5, 0.95, 0.99)] and got["h"]["count"] == n
    assert tuple(got["g"][c] for c in ("count", "sum", "min", "max", "p50", "p99")) == (3, 4.0, 1.0, 2.0, 1.0, 2.0)
    assert got["e"]["count"] == 0 and got["e"]["p50"] is None


# --- webhooks -----------------------------------------------------------------------


def test_signatures_equal_the_standard_library(spark):
    secrets = ["s", "ü" * 10, "k" * 64, "long" * 40, None, ""]
    subs = spark.createDataFrame([(str(i), ["batch.completed"], s, True) for i, s in enumerate(secrets)],
                                 "webhook_id string, events array<string>, secret string, active boolean")
    events = spark.createDataFrame([(1, "batch.completed", at(0), None, "d", {"x": "é"})],
                                   "event_id int, event_type string, ts timestamp, job_id string, document_id string, data map<string,string>")
    sent = webhooks.fan_out(webhooks.payloads(events), webhooks.with_signing_keys(subs))
    rows = webhooks.sign_payloads(sent).collect()
    assert len(rows) == 6
    for r in rows:
        secret = secrets[int(r["webhook_id"])]
        want = hmac.new(secret.encode(), r["payload"].encode(), hashlib.sha256).hexdigest() if secret else None
        assert r["signature"] == want
        assert r["payload"] == ('{"event_type":"batch.completed","timestamp":"2024-01-01T00:00:00.000000","job_id":null,'
                                '"document_id":"d","data":{"x":"é"}}')


def test_fan_out_and_state(spark):
    changes = spark.createDataFrame([
        ("a", 1, "register", ["batch.failed"], True), ("a", 2, "register", ["batch.completed", "batch.completed"], True), ("b", 1, "register", ["batch.completed"], False),
        ("c", 1, "register", ["batch.completed"], True), ("c", 2, "unregister", None, None)], "webhook_id string, seq int, event string, events array<string>, active boolean")
    subs = webhooks.subscriptions_state(changes)
    assert {r["webhook_id"] for r in subs.collect()} == {"a", "b"}
    events = spark.createDataFrame([(1, "batch.completed"), (2, "batch.failed"), (3, "batch.completed")], "event_id int, event_type string")
    assert sorted((r["event_id"], r["webhook_id"]) for r in webhooks.fan_out(events, subs).collect()) == [(1, "a"), (3, "a")]


def test_deliveries(spark):
    subs = spark.createDataFrame([("w", 3, 5)], "webhook_id string, retry_count int, retry_delay_seconds int")
    rows = [
        ("ok", 1, 500, "x", None), ("ok", 2, 201, "y" * 1500, None), ("bad", 1, 500, "a", None), ("bad", 2, None, None, "timeout"), ("bad", 3, None, None, "timeout"),
        ("wait", 1, 503, "b", None), ("wait", 2, None, None, "e"), ("extra", 1, 400, "", None), ("extra", 2, 400, "", None), ("extra", 3, 400, "", None), ("extra", 4, 200, "", None), ("gone", 1, 500, "", None)]
    attempts = spark.createDataFrame([(d, "removed" if d == "gone" else "w", n, at(n), c, b, e) for d, n, c, b, e in rows],
                                     "delivery_id string, webhook_id string, attempt_no int, ts timestamp, code int, body string, error string")
    state = webhooks.delivery_state(attempts, subs)
    got = {r["delivery_id"]: (r["status"], r["attempts"], r["response_code"], r["next_wait_seconds"]) for r in state.collect()}
    assert got == {"ok": ("success", 2, 201, None), "bad": ("failed", 3, 500, None), "wait": ("pending", 2, 503, 10), "extra": ("success", 4, 200, None), "gone": ("pending", 1, 500, None)}
    assert [r["delivery_id"] for r in state.where("over_limit").collect()] == ["extra"]
    assert len(state.where("delivery_id = 'ok'").first()["response_body"]) == 1500
    assert [r["delivery_id"] for r in webhooks.delivery_history(state, 100, status="failed").collect()] == ["bad"]
    assert [r["delivery_id"] for r in webhooks.delivery_history(state, 2, "w").collect()] == ["bad", "extra"]


# --- frames -------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 7, 128])
def test_even_samples(spark, n):
    sizes = {"a": 1, "b": 5, "c": 300}
    rows = [(g, i) for g, size in sizes.items() for i in range(size)]
    df = spark.createDataFrame(rows, "g string, i int").repartition(5)
    got = media.sample_evenly(df, "g", "i", F.floor(F.col("i") / 40), n).orderBy("g", "sample_no").collect()
    for g, size in sizes.items():
        want = np.linspace(0, size - 1, num=n, dtype=int).tolist()
        assert [r["i"] for r in got if r["g"] == g] == want


def test_grid_and_tokens(spark):
    df = spark.createDataFrame([(0, 100, 50), (9, 100, 50)], "sample_no int, width int, height int")
    assert [tuple(r)[3:] for r in media.grid_positions(df).orderBy("sample_no").collect()] == [(0, 0, 0, 0), (1, 1, 100, 50)]
    v = spark.createDataFrame([(64, 280, 420), (3, 29, 29)], "frames int, height int, width int")
    assert [r["tokens"] for r in media.video_tokens(v).collect()] == [int(64 / 2 * 280 / 28 * 420 / 28), int(3 / 2 * 29 / 28 * 29 / 28)]
    assert spark.range(1).select(media.grid_rows(F.lit(9))).first()[0] == 2
