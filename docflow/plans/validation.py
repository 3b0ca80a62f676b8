"""Queries over totals, dates, formats and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import formats
from ..functions.shared import unfold
from ..operators import validate as V
from . import inputs as I
from .catalog import query

# --- totals ---------------------------------------------------------------------

LINES = """
line_items AS (
  SELECT l_orderkey AS doc_id, CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
         CAST(floor(l_extendedprice * 100 / l_quantity) / 100 AS DECIMAL(18,2)) AS unit_price,
         CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS tax,
         CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS discount,
         CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END AS extra
  FROM lineitem),
lines AS (
  SELECT *, CAST(quantity * unit_price + extra AS DECIMAL(18,2)) AS amount FROM line_items),
per_doc AS (
  SELECT doc_id, count(*) AS n_lines, sum(amount) AS amount, sum(tax) AS tax, sum(discount) AS discount,
         sum(CASE WHEN extra = 1 THEN 1 ELSE 0 END) AS n_wrong
  FROM lines GROUP BY doc_id),
reported AS (
  SELECT o_orderkey AS doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_wrong, 0) AS n_wrong,
         coalesce(amount, 0) AS amount, coalesce(tax, 0) AS tax, coalesce(discount, 0) AS discount,
         CASE WHEN o_orderkey % 11 = 0 THEN 5 ELSE 0 END AS off_sub,
         CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS off_total
  FROM orders LEFT JOIN per_doc ON doc_id = o_orderkey)
"""

MONEY_OUT = ("calculated_subtotal", "reported_subtotal", "expected_total", "reported_total")


def _doubles(df):
    return df.select(*[F.col(c).cast("double").alias(c) if c in MONEY_OUT else F.col(c) for c in df.columns])


@query("check_invoice", f"""
WITH {LINES}
SELECT doc_id, n_lines, CAST(amount AS DOUBLE) AS calculated_subtotal,
       CAST(amount + off_sub AS DOUBLE) AS reported_subtotal,
       CAST(amount + off_sub + tax - discount AS DOUBLE) AS expected_total,
       CAST(amount + off_sub + tax - discount + off_total AS DOUBLE) AS reported_total,
       n_lines > 0 AND off_sub > 0 AS subtotal_error, off_total > 0 AS total_error,
       CAST(n_wrong AS BIGINT) AS n_warnings,
       NOT (n_lines > 0 AND off_sub > 0) AND off_total = 0 AS is_valid
FROM reported""")
def check_invoice(spark, sf):
    return _doubles(V.check_invoice(I.line_items(spark, sf), I.summary(spark, sf)))


@query("invoice_messages", f"""
WITH {LINES},
sums AS (
  SELECT doc_id, CAST(amount AS DOUBLE) AS calculated, CAST(amount + off_sub AS DOUBLE) AS reported, n_lines, off_sub, off_total,
         CAST(amount + off_sub + tax - discount AS DECIMAL(38, 4)) AS expected, CAST(amount + off_sub + tax - discount + off_total AS DECIMAL(38, 4)) AS total
  FROM reported)
SELECT doc_id, format('Subtotal mismatch: calculated {{:.2f}}, reported {{:.2f}}', calculated, reported) AS error FROM sums WHERE n_lines > 0 AND off_sub > 0
UNION ALL
SELECT doc_id, 'Total mismatch: expected ' || CAST(round(expected, 2)::DECIMAL(38, 2) AS VARCHAR) || ', reported ' || CAST(round(total, 2)::DECIMAL(38, 2) AS VARCHAR)
FROM sums WHERE off_total > 0""")
def invoice_messages(spark, sf):
    return V.invoice_messages(V.check_invoice(I.line_items(spark, sf), I.summary(spark, sf)))


@query("check_totals", f"""
WITH {LINES}
SELECT doc_id, n_lines, CAST(n_wrong AS BIGINT) AS n_line_errors, CAST(amount AS DOUBLE) AS calculated_subtotal,
       CAST(amount + off_sub + tax - discount AS DOUBLE) AS expected_total,
       amount > 0 AND off_sub > 0 AS subtotal_error,
       off_total > 0 AND (amount + off_sub + tax - discount + off_total) > 0 AS total_error,
       n_wrong = 0 AND NOT (amount > 0 AND off_sub > 0)
         AND NOT (off_total > 0 AND (amount + off_sub + tax - discount + off_total) > 0) AS is_valid
FROM reported""")
def check_totals(spark, sf):
    return _doubles(V.check_totals(I.line_items(spark, sf), I.summary(spark, sf)))


@query("line_errors", f"""
WITH {LINES}
SELECT doc_id, CAST(quantity * unit_price AS DOUBLE) AS expected, CAST(amount AS DOUBLE) AS reported
FROM lines WHERE extra = 1""")
def line_errors(spark, sf):
    rows = V.line_errors(I.line_items(spark, sf))
    return rows.select("doc_id", F.col("expected").cast("double").alias("expected"), F.col("reported").cast("double").alias("reported"))


# --- dates ----------------------------------------------------------------------


def _written(date, form):
    patterns = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%B %-d, %Y", "%b %-d, %Y", "%-d %B %Y")
    cases = " ".join(f"WHEN {i} THEN strftime({date}, '{p}')" for i, p in enumerate(patterns))
    return f"CASE {form} {cases} END"


def _as_read(date, form):
    # Month-first texts with a day up to 12 are read day first.
    return (f"CASE WHEN {form} = 2 AND day({date}) <= 12 THEN make_date(year({date}), day({date}), month({date})) "
            f"ELSE CAST({date} AS DATE) END")


DATES = f"""
days AS (
  SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS a, o_orderkey % 7 AS fa,
         CAST(o_orderdate AS DATE) + CAST(o_orderkey % 19 - 4 AS INTEGER) AS b, (o_orderkey + 3) % 7 AS fb
  FROM orders),
doc_dates AS (
  SELECT doc_id, 'order_date' AS field, {_written('a', 'fa')} AS value, {_as_read('a', 'fa')} AS parsed FROM days
  UNION ALL
  SELECT doc_id, 'delivery_date', {_written('b', 'fb')}, {_as_read('b', 'fb')} FROM days)
"""


@query("parse_date", f"""
WITH {DATES} SELECT doc_id, field, value, strftime(parsed, '%Y-%m-%d') AS parsed FROM doc_dates""")
def parse_date(spark, sf):
    parsed = V.parse_date(I.doc_dates(spark, sf))
    return parsed.withColumn("parsed", F.date_format("parsed", "yyyy-MM-dd"))


@query("date_consistency", f"""
WITH {DATES}
SELECT b.doc_id, b.field AS before_field, a.field AS after_field,
       strftime(b.parsed, '%Y-%m-%d') AS before_date, strftime(a.parsed, '%Y-%m-%d') AS after_date,
       b.field || ' (' || b.value || ') should be before ' || a.field || ' (' || a.value || ')' AS error
FROM doc_dates b JOIN doc_dates a ON a.doc_id = b.doc_id
WHERE b.field = 'order_date' AND a.field = 'delivery_date' AND b.parsed > a.parsed""")
def date_consistency(spark, sf):
    broken = V.date_consistency(I.doc_dates(spark, sf), dims.date_rules(spark))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return broken.select("doc_id", "before_field", "after_field", iso("before_date"), iso("after_date"), "error")


# --- formats --------------------------------------------------------------------


def _pick(*options):
    return f"CASE c_custkey % {len(options)} " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options)) + " END"


K = "CAST(c_custkey AS VARCHAR)"


def _mod(n):
    return f"CAST(c_custkey % {n} AS VARCHAR)"


def _lpad(n, fill="0"):
    # lpad that also shortens, as in Spark
    return f"lpad({K}, {n}, '{fill}')"


VALUES = {
    "email": _pick(f"'user' || {K} || '@example.com'", f"'user' || {K} || '@example'", f"'u.' || {K} || '+x@mail.example.org'",
                   f"'user ' || {K} || '@example.com'", f"'user' || {K} || '.example.com'"),
    "phone": _pick(f"'+1 (555) ' || {_lpad(7)}", f"'555-' || {_lpad(4)}", f"'12' || {K}", f"'+49 30 ' || {_lpad(12, '1')}",
                   f"'tel ' || {_lpad(9)}"),
    "date": _pick(f"'2024-' || {_mod(14)} || '-' || {_mod(31)}", f"{_mod(33)} || '/' || {_mod(14)} || '/2023'",
                  f"'March ' || {_mod(33)} || ', 2022'", f"{_mod(33)} || ' Feb 2021'",
                  "'24-1-' || CAST(c_custkey % 28 + 1 AS VARCHAR)"),
    "currency": _pick(f"'$' || {K} || '.50'", f"'€ 1,' || {_lpad(3)}", f"{K} || ' USD'", f"'-' || {K}", f"'1.2.' || {K}"),
    "url": _pick(f"'https://example.com/' || {K}", f"'HTTP://Example.org?q=' || {K}", f"'ftp://example.com/' || {K}",
                 f"'https:///' || {K}", f"'http://a b/' || {K}"),
    "percentage": _pick(f"{_mod(130)} || '%'", f"' ' || {_mod(100)} || '.5 % '", f"'-' || {K} || '%'", f"'p' || {K}", _mod(101)),
    "integer": _pick(K, f"'1,' || {_lpad(3)}", f"{K} || '.0'", f"'- ' || {K}", f"'0x' || {K}"),
    "note": _pick(f"'free text ' || {K}", K, K, K, K),
}
FIELD_VALUES = "field_values AS (" + " UNION ALL ".join(
    f"SELECT c_custkey AS doc_id, '{f}' AS field, {v} AS value FROM customer" for f, v in VALUES.items()) + ")"

# The verdict of each option, worked out from the number inside the text rather than by parsing it.
_C = "doc_id"
_DAY_OK = {
    # y-m-d: month 1..12 and a day that exists in that month of 2024
    0: f"{_C} % 14 BETWEEN 1 AND 12 AND {_C} % 31 BETWEEN 1 AND day(last_day(make_date(2024, greatest(1, least(12, {_C} % 14))::INT, 1)))",
    # day/month (or month/day) of 2023
    1: (f"({_C} % 14 BETWEEN 1 AND 12 AND {_C} % 33 BETWEEN 1 AND day(last_day(make_date(2023, greatest(1, least(12, {_C} % 14))::INT, 1)))) "
        f"OR ({_C} % 33 BETWEEN 1 AND 12 AND {_C} % 14 BETWEEN 1 AND day(last_day(make_date(2023, greatest(1, least(12, {_C} % 33))::INT, 1))))"),
    2: f"{_C} % 33 BETWEEN 1 AND 31",
    3: f"{_C} % 33 BETWEEN 1 AND 28",
    4: "false",
}
VERDICT = {
    "email": f"{_C} % 5 IN (0, 2)",
    "phone": f"CASE {_C} % 5 WHEN 0 THEN length(CAST({_C} AS VARCHAR)) <= 11 WHEN 1 THEN true "
             f"WHEN 2 THEN length(CAST({_C} AS VARCHAR)) BETWEEN 5 AND 13 WHEN 3 THEN false ELSE false END",
    "date": f"CASE {_C} % 5 " + " ".join(f"WHEN {i} THEN {c}" for i, c in _DAY_OK.items()) + " END",
    "currency": f"{_C} % 5 IN (0, 1, 3)",
    "url": f"{_C} % 5 IN (0, 1, 4)",
    "percentage": f"CASE {_C} % 5 WHEN 0 THEN {_C} % 130 <= 100 WHEN 1 THEN true WHEN 2 THEN {_C} = 0 WHEN 3 THEN false ELSE true END",
    "integer": f"{_C} % 5 IN (0, 1, 3)",
}
# 555-dddd is seven digits; +49 30 with twelve more is sixteen, one or two too many.
VERDICT["phone"] = (
    f"CASE {_C} % 5 WHEN 0 THEN true WHEN 1 THEN true "
    f"WHEN 2 THEN length(CAST({_C} AS VARCHAR)) BETWEEN 5 AND 13 ELSE false END"
)


def _format_query(kind):
    @query(f"valid_{kind}", f"""
    WITH {FIELD_VALUES}
    SELECT doc_id, value, {VERDICT[kind]} AS is_valid FROM field_values WHERE field = '{kind}'""")
    def run(spark, sf):
        rows = I.field_values(spark, sf).where(F.col("field") == kind)
        return V.check_format(rows, kind).select("doc_id", "value", "is_valid")

    return run


for _kind in formats.CHECKS:
    _format_query(_kind)

_ANY = "CASE field " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in VERDICT.items()) + " ELSE true END"
_LABEL = "CASE field WHEN 'url' THEN 'URL' ELSE field END"
_ERROR = (
    f"CASE WHEN field = 'percentage' AND doc_id % 5 <> 3 THEN 'Percentage out of range: ' || value "
    f"ELSE 'Invalid ' || {_LABEL} || ' format: ' || value END"
)


@query("validate_field", f"""
WITH {FIELD_VALUES}
SELECT doc_id, field, {_ANY} AS is_valid, CASE WHEN NOT ({_ANY}) THEN {_ERROR} END AS error FROM field_values""")
def validate_field(spark, sf):
    return V.validate_field(I.field_values(spark, sf)).select("doc_id", "field", "is_valid", "error")


@query("validate_fields", f"""
WITH {FIELD_VALUES}
SELECT doc_id, field, {_ERROR} AS error FROM field_values
WHERE field IN ('email', 'date') AND NOT ({_ANY})""")
def validate_fields(spark, sf):
    specs = dims.preset_specs(spark).where(F.col("type").isin("email", "date") & F.col("name").isin("email", "date"))
    specs = specs.select("name", "type").distinct()
    return V.validate_fields(I.field_values(spark, sf).drop("type"), specs).select("doc_id", "field", "error")


@query("to_number", f"""
WITH {FIELD_VALUES}
SELECT doc_id, value, CAST(CASE doc_id % 5
    WHEN 0 THEN doc_id + 0.5 WHEN 1 THEN CAST('1' || lpad(CAST(doc_id AS VARCHAR), 3, '0') AS BIGINT)
    WHEN 3 THEN -doc_id ELSE 0 END AS DOUBLE) + 0.0 AS number
FROM field_values WHERE field = 'currency'""")
def to_number(spark, sf):
    rows = I.field_values(spark, sf).where(F.col("field") == "currency")
    return V.to_number(rows).select("doc_id", "value", (F.col("number") + 0.0).alias("number"))


# --- records --------------------------------------------------------------------


def records(spark, sf):
    """One nested JSON record per order."""
    o = I.spread(I.table(spark, sf, "orders"))
    k = F.col("o_orderkey")
    s = I.text(k)
    c = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    name = F.when(k % 4 == 0, '""').when(k % 4 == 1, "null").otherwise(c('"Vendor ', s, '"'))
    items = F.when(k % 3 == 0, "[]").otherwise(c("[", s, "]"))
    discount = F.when(k % 5 == 0, "0").when(k % 5 == 1, "false").when(k % 5 == 2, '""').otherwise(c('"', s, '"'))
    reason = F.when(k % 2 == 0, "null").otherwise('"sale"')
    body = c('{"header": {"vendor_name": ', name, ', "number": ', s, '}, "items": ', items,
             ', "discount": ', discount, ', "discount_reason": ', reason, ', "priority": "', F.col("o_orderpriority"), '"}')
    return o.select(k.alias("doc_id"), body.alias("data"))


@query("required_fields", """
SELECT o_orderkey AS doc_id, f AS field FROM orders,
  (VALUES ('header.vendor_name'), ('header.date'), ('items'), ('discount')) AS r(f)
WHERE CASE f WHEN 'header.vendor_name' THEN o_orderkey % 4 IN (0, 1) WHEN 'header.date' THEN true
             WHEN 'items' THEN o_orderkey % 3 = 0 ELSE o_orderkey % 5 = 2 END""")
def required_fields(spark, sf):
    wanted = ["header.vendor_name", "header.date", "items", "discount"]
    found = V.required_fields(records(spark, sf), wanted)
    return unfold(found, ["doc_id"], "missing", "_n", "field").drop("_n")


@query("field_dependencies", """
SELECT o_orderkey AS doc_id, 'discount' AS if_field, f AS field, f || ' is required when discount is present' AS error
FROM orders, (VALUES ('discount_reason'), ('items'), ('header.vendor_name')) AS r(f)
WHERE o_orderkey % 5 IN (3, 4)
  AND CASE f WHEN 'discount_reason' THEN o_orderkey % 2 = 0 WHEN 'items' THEN false ELSE o_orderkey % 4 IN (0, 1) END""")
def field_dependencies(spark, sf):
    rules = [("discount", ["discount_reason", "items", "header.vendor_name"])]
    return V.field_dependencies(records(spark, sf), rules)


@query("cross_references", """
SELECT o_orderkey AS doc_id, 'priority' AS primary_field, 'level' AS secondary_field,
       o_orderpriority AS primary_value, 'x' || o_orderpriority AS secondary_value
FROM orders WHERE o_orderkey % 6 = 0
UNION ALL
SELECT o_orderkey, 'header.number', 'number', CAST(o_orderkey AS VARCHAR), CAST(o_orderkey + 1 AS VARCHAR)
FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey > 0""")
def cross_references(spark, sf):
    o = I.spread(I.table(spark, sf, "orders"))
    k = F.col("o_orderkey")
    level = F.when(k % 6 == 0, F.concat(F.lit("x"), "o_orderpriority")).otherwise(
        F.concat(F.lit("  "), F.upper("o_orderpriority"), F.lit(" ")))
    number = k + F.when(k % 4 == 0, 1).otherwise(0)
    second = o.select(k.alias("doc_id"), F.to_json(F.struct(level.alias("level"), number.alias("number"))).alias("data"))
    return V.cross_references(records(spark, sf), second, [("priority", "level"), ("header.number", "number")])


@query("apply_schema", """
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS vendor_name,
       c_acctbal AS balance, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS nation,
       c_custkey % 2 = 0 AS active,
       CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'vendor_name: missing' ELSE 'vendor_name: type' END ELSE '' END
       || CASE WHEN c_custkey % 4 = 0 THEN '|nation: type' ELSE '' END AS violations
FROM customer""")
def apply_schema(spark, sf):
    c = I.table(spark, sf, "customer")
    k = F.col("c_custkey")
    name = F.when(k % 6 == 0, "").when(k % 3 == 0, '"vendor_name": 7, ').otherwise(F.concat(F.lit('"vendor_name": "'), "c_name", F.lit('", ')))
    nation = F.when(k % 4 == 0, '"n/a"').otherwise(I.text(F.col("c_nationkey")))
    body = F.concat(
        F.lit("{"), name, F.lit('"balance": "'), I.text(F.col("c_acctbal")), F.lit('", "nation": '), nation,
        F.lit(', "active": '), F.when(k % 2 == 0, "true").otherwise('"no"'), F.lit("}"))
    spec = [("vendor_name", "text", True), ("balance", "number", False), ("nation", "integer", False), ("active", "boolean", True)]
    typed = V.apply_schema(c.select(k.alias("doc_id"), body.alias("data")), spec)
    marks = F.array_join(F.transform("violations", lambda v: F.when(F.startswith(v, F.lit("vendor")), v).otherwise(F.concat(F.lit("|"), v))), "")
    return typed.select("doc_id", "vendor_name", "balance", "nation", "active", marks.alias("violations"))
