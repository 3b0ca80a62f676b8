"""Operator inputs derived from the given tables, row by row or by plain aggregation.

The SQL twin of each derivation stands in ``sql.py``; both read whole tables.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table dealt out to as many tasks as shuffles have: costly row-by-row work that follows is shared evenly,
    whatever files the table came in."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def text(c) -> F.Column:
    return c.cast("string")


# --- orders and lines -------------------------------------------------------------

MONEY, EXACT = "decimal(18,2)", "decimal(20,4)"


def _cents(c, digits=12) -> F.Column:
    """Whole cents as an exact amount; short decimals stay on Spark's fast path."""
    return c.cast("bigint").cast(f"decimal({digits},0)") * F.lit(Decimal("0.01"))


def line_items(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    price = _cents(F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")))
    quantity = F.col("l_quantity").cast("int").cast("decimal(4,0)")
    extended = _cents(F.round(F.col("l_extendedprice") * 100))
    rate = lambda c: _cents(F.round(F.col(c) * 100), 3)
    staged = li.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), quantity.alias("quantity"),
        price.alias("unit_price"), (F.col("l_partkey") % 7 == 0).alias("_extra"),
        (extended * rate("l_tax")).alias("tax"), (extended * rate("l_discount")).alias("discount"))
    extra = F.when(F.col("_extra"), 1).otherwise(0).cast("decimal(3,0)")
    return staged.select(
        "doc_id", "line_no", F.col("quantity").cast(MONEY).alias("quantity"), F.col("unit_price").cast(MONEY).alias("unit_price"),
        (F.col("quantity") * F.col("unit_price") + extra).cast(MONEY).alias("amount"), "tax", "discount")


def summary(spark, sf) -> DataFrame:
    """One row per order; some subtotals and totals are off on purpose."""
    sums = line_items(spark, sf).groupBy("doc_id").agg(
        *[F.sum(c).cast(EXACT).alias(c) for c in ("amount", "tax", "discount")])
    zero = F.lit(0).cast(EXACT)
    joined = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id")).join(sums, "doc_id", "left")
    amount, tax, discount = (F.coalesce(c, zero) for c in ("amount", "tax", "discount"))
    subtotal = amount + F.when(F.col("doc_id") % 11 == 0, 5).otherwise(0).cast("decimal(3,0)")
    total = subtotal + tax - discount + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0).cast("decimal(3,0)")
    return joined.select(
        "doc_id", subtotal.cast(EXACT).alias("subtotal"), tax.alias("tax"), discount.alias("discount"),
        total.cast(EXACT).alias("total"))


def _written(date: F.Column, form: F.Column) -> F.Column:
    """A date in one of seven forms."""
    forms = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy")
    out = F.lit(None).cast("string")
    for i, pattern in enumerate(forms):
        out = F.when(form == i, F.date_format(date, pattern)).otherwise(out)
    return out


def doc_dates(spark, sf) -> DataFrame:
    """Two dates per order, as text; some deliveries lie before the order."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    later = F.date_add(day, ((key % 19) - 4).cast("int"))
    o = spread(o)
    both = F.array(
        F.struct(F.lit("order_date").alias("field"), _written(day, key % 7).alias("value")),
        F.struct(F.lit("delivery_date").alias("field"), _written(later, (key + 3) % 7).alias("value")),
    )
    return o.select(key.alias("doc_id"), F.explode(both).alias("x")).select("doc_id", "x.*")


# --- field values -------------------------------------------------------------------


def field_values(spark, sf) -> DataFrame:
    """Contact and number texts per customer, valid and not, long form with type."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    s = text(k)

    def pick(*options):
        out = F.lit(None).cast("string")
        for i, option in enumerate(options):
            out = F.when(k % len(options) == i, option).otherwise(out)
        return out

    cat = lambda *parts: F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])
    values = {
        "email": pick(cat("user", s, "@example.com"), cat("user", s, "@example"), cat("u.", s, "+x@mail.example.org"),
                      cat("user ", s, "@example.com"), cat("user", s, ".example.com")),
        "phone": pick(cat("+1 (555) ", F.lpad(s, 7, "0")), cat("555-", F.lpad(s, 4, "0")), cat("12", s), cat("+49 30 ", F.lpad(s, 12, "1")),
                      cat("tel ", F.lpad(s, 9, "0"))),
        "date": pick(cat("2024-", text(k % 14), "-", text(k % 31)), cat(text(k % 33), "/", text(k % 14), "/2023"),
                     cat("March ", text(k % 33), ", 2022"), cat(text(k % 33), " Feb 2021"), cat("24-1-", text(k % 28 + 1))),
        "currency": pick(cat("$", s, ".50"), cat("€ 1,", F.lpad(s, 3, "0")), cat(s, " USD"), cat("-", s), cat("1.2.", s)),
        "url": pick(cat("https://example.com/", s), cat("HTTP://Example.org?q=", s), cat("ftp://example.com/", s),
                    cat("https:///", s), cat("http://a b/", s)),
        "percentage": pick(cat(text(k % 130), "%"), cat(" ", text(k % 100), ".5 % "), cat("-", s, "%"), cat("p", s), cat(text(k % 101))),
        "integer": pick(s, cat("1,", F.lpad(s, 3, "0")), cat(s, ".0"), cat("- ", s), cat("0x", s)),
        "note": pick(cat("free text ", s), s, s, s, s),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in values.items()])
    return c.select(k.alias("doc_id"), F.explode(rows).alias("x")).select(
        "doc_id", "x.field", "x.value", F.col("x.field").alias("type"))


# --- logs ---------------------------------------------------------------------------

ACTIONS = {
    "view": "document.processed", "purchase": "document.exported", "click": "auth.login",
    "error": "document.deleted", "signup": "admin.user_created",
}


def _mapped(c, mapping) -> F.Column:
    out = F.lit(None).cast("string")
    for key, value in mapping.items():
        out = F.when(F.col(c) == key, F.lit(value)).otherwise(out)
    return out


def audit(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("entry_id"), "ts", _mapped("event_type", ACTIONS).alias("action"),
        text(F.col("user_id") % 10).alias("tenant_id"),
        F.when(F.col("user_id") % 13 == 0, "").otherwise(text(F.col("user_id"))).alias("user_id"),
        F.when(F.col("event_type").isin("view", "purchase", "error"), "document").alias("resource_type"),
        F.get_json_object("props", "$.k").alias("resource_id"),
        (F.col("event_type") != "error").alias("success"),
    )


KINDS = {"click": "counter", "view": "counter", "signup": "gauge", "purchase": "histogram", "error": "histogram"}


def observations(spark, sf) -> DataFrame:
    """Counters and gauges by label ``k``; purchases without labels, errors by code and source."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    empty = F.create_map().cast("map<string,string>")
    by_k = F.create_map(F.lit("k"), k)
    two = F.create_map(F.lit("src"), F.lit("api"), F.lit("code"), text(F.col("user_id") % 2))
    labels = F.when(F.col("event_type") == "purchase", empty).when(F.col("event_type") == "error", two).otherwise(by_k)
    return e.select(
        F.col("event_type").alias("name"), labels.alias("labels"), _mapped("event_type", KINDS).alias("kind"),
        "ts", F.col("event_id").alias("obs_id"), F.col("value").cast("decimal(18,2)").alias("value"),
    )


def requests(spark, sf) -> DataFrame:
    """Every tenth tenant number exists; task, size and key follow from the event."""
    e = table(spark, sf, "events")
    u, i = F.col("user_id"), F.col("event_id")
    tasks = ("ocr", "layout", "table", "ner", "invoice")
    task = F.get(F.array(*map(F.lit, tasks)), (i % 5).cast("int"))
    return e.select(
        i.alias("request_id"), "ts", text(u * 20).alias("tenant_id"), text(u).alias("user_id"),
        task.alias("task_type"), (i % 25).alias("document_count"), F.concat(F.lit("key-"), text(u)).alias("key"),
    )


def tenants(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    tiers = F.array(*map(F.lit, ("free", "starter", "professional", "enterprise", "trial")))
    return c.select(
        text(F.col("c_custkey")).alias("tenant_id"), F.col("c_name").alias("name"),
        F.get(tiers, (F.col("c_custkey") % 5).cast("int")).alias("tier"), (F.col("c_acctbal") >= 0).alias("is_active"),
    )


def usage(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        text(F.col("user_id")).alias("tenant_id"), "ts", F.lit(1).cast("bigint").alias("request_count"),
        (F.col("event_id") % 4).alias("document_count"),
        F.floor(F.col("value")).cast("bigint").alias("processing_time_ms"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens_used"),
    )


def api_keys(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    expires = F.when(k % 3 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((k % 30).cast("int")))
    return c.select(
        text(k).alias("key_id"), F.sha2(F.concat(F.lit("key-"), text(k)).cast("binary"), 256).alias("key_hash"),
        text(k % 10).alias("tenant_id"), expires.alias("expires_at"), (F.col("c_acctbal") >= 0).alias("is_active"),
    )


def users(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    roles = F.array(*map(F.lit, ("admin", "manager", "user", "readonly", "guest")))
    extra = F.when(k % 4 == 0, F.array(F.lit("tenant:manage"))).otherwise(F.array().cast("array<string>"))
    return c.select(
        text(k).alias("user_id"), F.get(roles, (k % 5).cast("int")).alias("role"), extra.alias("permissions"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
    )


def subscriptions(spark, sf) -> DataFrame:
    """One per nation."""
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    one = lambda cond, name: F.when(cond, F.lit(name))
    events = F.array_compact(F.array(
        one(k % 2 == 0, "extraction.completed"), one(k % 3 == 0, "extraction.failed"), one(k % 5 == 0, "batch.progress")))
    return n.select(
        text(k).alias("webhook_id"), F.concat(F.lit("https://hooks.example.com/"), text(k)).alias("url"),
        events.alias("events"), F.when(k % 4 != 0, F.concat(F.lit("secret-"), text(k))).alias("secret"),
        (k % 7 != 0).alias("active"), F.lit(3).alias("retry_count"), F.lit(5).alias("retry_delay_seconds"),
    )


HOOK_EVENTS = {
    "view": "extraction.completed", "purchase": "batch.completed", "click": "batch.progress",
    "error": "extraction.failed", "signup": "extraction.started",
}


def hook_events(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id"), _mapped("event_type", HOOK_EVENTS).alias("event_type"), "ts",
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("job-"), text(F.col("user_id")))).alias("job_id"),
        text(F.col("event_id")).alias("document_id"), F.struct(F.get_json_object("props", "$.k").alias("k")).alias("data"),
    )


def attempts(spark, sf) -> DataFrame:
    """Up to four tries per event; the answer of each follows from the event and the try."""
    e = table(spark, sf, "events")
    tries = e.select("event_id", "ts", "user_id", F.explode(F.sequence(F.lit(1), (F.col("event_id") % 4 + 1).cast("int"))).alias("attempt_no"))
    mark = (F.col("event_id") * 7 + F.col("attempt_no") * 3) % 8
    return tries.select(
        F.col("event_id").alias("delivery_id"), text(F.col("user_id") % 25).alias("webhook_id"), "attempt_no",
        (F.col("ts") + F.make_dt_interval(secs=F.col("attempt_no") * 5)).alias("ts"),
        F.when(mark == 0, 200).when(mark < 6, 500).alias("code"),
        F.when(mark < 6, F.concat(F.lit("answer "), text(mark))).alias("body"),
        F.when(mark >= 6, F.lit("timeout")).alias("error"),
    )


# --- batch, pages, chat ---------------------------------------------------------------


def batch_items(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    joined = d.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 1, "completed").otherwise("failed")
    return joined.select(
        F.col("source").alias("job_id"), text(F.col("doc_id")).alias("item_id"),
        F.concat("lang", F.lit("/"), text(F.col("doc_id")), F.lit(".txt")).alias("file_path"), status.alias("status"),
        F.when(F.col("quality") == 1, F.concat(F.lit("ok "), text(F.col("doc_id")))).alias("result"),
        F.when(F.col("quality") == 0, F.lit("low quality")).alias("error"),
        (F.col("n_chars") % 5000).cast("int").alias("processing_time_ms"),
    )


def pages(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    words = text(F.length("text"))
    data = F.create_map(
        F.lit("role"), F.concat(F.lit('"'), "role", F.lit('"')),
        F.lit("sizes"), F.concat(F.lit("["), words, F.lit(","), text(F.col("turn")), F.lit("]")),
    )
    return c.select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"), "text",
        F.when(F.col("role") != "system", data).alias("data"))


def chat(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations")


# --- responses --------------------------------------------------------------------------


def fenced(body: F.Column, key: F.Column) -> F.Column:
    """The text around a JSON body: json fence, plain fence, bare in prose, or cut short."""
    return (
        F.when(key % 4 == 0, F.concat(F.lit("Here is the result:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(key % 4 == 1, F.concat(F.lit("```\n"), body, F.lit("\n```")))
        .when(key % 4 == 2, F.concat(F.lit("The answer is "), body, F.lit(" as asked.")))
        .otherwise(F.concat(F.lit("```json\n"), F.expr("substring(_b, 1, length(_b) - 3)")))
    )


def responses(spark, sf, body: F.Column, task="invoice") -> DataFrame:
    """One response per order around a JSON body built from the order's columns."""
    o = spread(table(spark, sf, "orders")).withColumn("_b", body)
    return o.select(
        F.col("o_orderkey").alias("doc_id"), F.lit(task).alias("task_type"), fenced(F.col("_b"), F.col("o_orderkey")).alias("text"))
