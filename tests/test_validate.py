import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from docflow import dims
from docflow.functions import formats
from docflow.operators import shape
from docflow.operators import validate as V

VERDICTS = {
    "email": (["a@b.co", "x.y+z%1@mail-1.example.org", "a@b.co\n"], ["a@b", "@b.co", "a b@c.de", "", "a@b.c1", "a@b.co\n\n"]),
    "phone": (["+1-555-123-4567", "(555) 123.4567", "1234567", "٣٣٣٣٣٣٣"], ["123456", "1" * 16, "call me", "+", "++12345678"]),
    "date": (["2024-01-15", "2024-1-5", "15/01/2024", "01/15/2024", "15-01-2024", "January 15, 2024", "jan 5,  2024", "5 March 2024",
              "05 Mar 2024", " 2024-01-15 ", "May 1, 2024"],
             ["24-01-15", "2024-02-30", "2024/01/15", "15.01.2024", "", "2024-13-01", "Janu 5, 2024", "0000-01-01", "32/01/2024", "Mar 5 2024"]),
    "currency": (["$1,234.56", "€ 5", "₹1e3", "-.5", "5.", "nan", "Infinity", "1_000"], ["1d", "abc", "", "1.2.3", "$", "1__0", "5 USD"]),
    "url": (["https://example.com", "HTTP://a.b/c", "http://a b"], ["ftp://x.y", "https:///x", "http://", "example.com", "https://.x"]),
    "percentage": (["50%", "0", "100 %", "99.9%%", " 5 "], ["101", "-1%", "%", "abc", "nan"]),
    "integer": (["1,000", " -5 ", "+3", "1_000"], ["1.0", "", "x", "1e3", "--1"]),
}


@pytest.mark.parametrize("kind", list(VERDICTS))
def test_formats(apply, kind):
    good, bad = VERDICTS[kind]
    got = apply(formats.CHECKS[kind], good + bad)
    assert dict(zip(good + bad, got)) == {**dict.fromkeys(good, True), **dict.fromkeys(bad, False)}


def test_unknown_types_are_valid(spark):
    df = spark.createDataFrame([("x", "email"), ("x", "note"), ("150", "percentage"), ("q", "url")], "value string, type string")
    rows = V.validate_field(df).collect()
    assert [r["is_valid"] for r in rows] == [False, True, False, False]
    assert [r["error"] for r in rows] == ["Invalid email format: x", None, "Percentage out of range: 150", "Invalid URL format: q"]


def test_fields_against_specs(spark):
    fields = spark.createDataFrame(
        [(1, "email", "bad"), (1, "total", "$5"), (1, "extra", "??"), (2, "email", ""), (2, "email", None)], "doc_id int, field string, value string")
    specs = spark.createDataFrame([("email", "email"), ("total", "currency"), ("free", None)], "name string, type string")
    assert [(r["doc_id"], r["field"], r["error"]) for r in V.validate_fields(fields, specs).collect()] == [(1, "email", "Invalid email format: bad")]


# Date forms in the order they are tried.
FORMS = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%B %d, %Y", "%b %d, %Y", "%d %B %Y")


def test_dates_against_strptime(apply):
    rng = random.Random(11)
    texts = ["03/04/2024", "2024-1-5", "24-01-05", "2024-02-30", "29 February 2023", "29 February 2024", "2024-01- 5", "12/31/1999", "7/ 7/2020"]
    for _ in range(400):
        d = date(rng.randint(1, 9999), rng.randint(1, 12), rng.randint(1, 28))
        text = datetime(d.year, d.month, d.day).strftime(rng.choice(FORMS).replace("%Y", f"{d.year:04d}"))
        spot = rng.randrange(len(text))
        noise = rng.choice(["", "", "", " ", "1", "/", "x"])
        texts.append(text[:spot] + noise + text[spot + rng.randint(0, 1):] if rng.random() < 0.5 else text)

    def model(text):
        for form in FORMS:
            try:
                return datetime.strptime(text.strip(), form).date()
            except ValueError:
                pass
        return None

    assert dict(zip(texts, apply(formats.parse_date, texts))) == {t: model(t) for t in texts}


def test_numbers(apply, spark):
    cases = {"$1,234.50": 1234.5, "€ 5": 5.0, "abc": 0.0, None: 0.0, "": 0.0, "1_0": 10.0, "1d": 0.0}
    assert apply(formats.to_number, list(cases)) == list(cases.values())
    df = spark.createDataFrame([(1.5,), (None,)], "value double")
    assert [r["number"] for r in V.to_number(df).collect()] == [1.5, 0.0]


def test_date_rules(spark):
    rows = [
        (1, "start_date", "2024-12-31"), (1, "end_date", "01/01/2024"), (2, "start_date", "2024-01-01"), (2, "end_date", "2024-01-01"),
        (3, "invoice_date", "2024-05-01"), (3, "due_date", "someday"), (4, "order_date", "5 May 2024"), (4, "delivery_date", "4 May 2024"),
        (5, "end_date", "2024-01-01"),
    ]
    dates = spark.createDataFrame(rows, "doc_id int, field string, value string")
    got = V.date_consistency(dates, dims.date_rules(spark)).orderBy("doc_id").collect()
    assert [r["error"] for r in got] == [
        "start_date (2024-12-31) should be before end_date (01/01/2024)", "order_date (5 May 2024) should be before delivery_date (4 May 2024)"]
    own = V.date_consistency(dates, dims.date_rules(spark, [("end_date", "start_date")]))
    assert own.count() == 0
    both = spark.createDataFrame([(1, "a", "2024-01-02"), (1, "b", "2024-01-01"), (1, "c", "2023-01-01")], "doc_id int, field string, value string")
    chain = V.date_consistency(both, dims.date_rules(spark, [("a", "b"), ("b", "c"), ("c", "a")]))
    assert [r["rule_no"] for r in chain.orderBy("rule_no").collect()] == [0, 1]


LINES = "doc_id int, line_no int, quantity string, unit_price string, amount string"
SUMMARY = "doc_id int, subtotal string, tax string, discount string, total string"


def totals(spark, fn, lines, summary):
    a = spark.createDataFrame(lines, LINES)
    b = spark.createDataFrame(summary, SUMMARY)
    return {r["doc_id"]: r for r in fn(a, b).collect()}


def test_totals(spark):
    lines = [
        (1, 1, "2", "10.0", "20.0"), (1, 2, "1", "$15.00", "15"),      # fine
        (2, 1, None, None, "10"), (2, 2, None, None, "20"),             # subtotal off
        (3, 1, None, None, "100"),                                      # total off
        (4, 1, "5", "10", "40"),                                        # line off
        (5, 1, "3", "7", "0"), (5, 2, None, "4", None),                 # no amounts: 21, and a null quantity is 0
        (6, 1, None, None, "33.33"), (6, 2, None, None, "33.33"), (6, 3, None, None, "33.34"),
        (8, 1, None, None, "9"),                                        # no summary
    ]
    summary = [
        (1, "35", "3.5", "0", "38.5"), (2, "100", "10", "0", "110"), (3, "100", "10", "5", "200"), (4, "40", None, None, "40"),
        (5, "0", "0", "0", "0"), (6, "100", "0", None, "100"), (7, "10", "1", "0", "11"),
    ]
    got = totals(spark, V.check_totals, lines, summary)
    flags = {i: (r["n_line_errors"], r["subtotal_error"], r["total_error"], r["is_valid"]) for i, r in got.items()}
    assert flags == {
        1: (0, False, False, True), 2: (0, True, False, False), 3: (0, False, True, False), 4: (1, False, False, False),
        5: (0, False, False, True), 6: (0, False, False, True), 7: (0, False, False, True), 8: (0, False, False, True)}
    assert got[5]["calculated_subtotal"] == 21.0 and got[5]["expected_total"] == 21.0 and got[7]["expected_total"] == 11.0
    errors = V.line_errors(spark.createDataFrame(lines, LINES)).collect()
    assert [(r["doc_id"], r["error"]) for r in errors] == [(4, "Line 1: quantity * unit_price (50.00) != amount (40.00)")]


def test_audit_in_place_equals_the_tables(spark):
    bodies = [
        '{"line_items": [{"quantity": 2, "unit_price": "$10", "amount": 25}, {"unit_price": 4}, {"quantity": null, "unit_price": 5}, null, 7],'
        ' "summary": {"subtotal": "30", "tax": "1,000.5", "discount": 2, "total": 12}}',
        '{"line_items": [], "summary": {"subtotal": 3, "total": 3}}', '{"line_items": [{"amount": "9"}]}', "no object", None, "",
        '{"line_items": "x", "summary": {"total": 5, "tax": 6}}', '{"line_items": [{"quantity": 1, "unit_price": 2, "amount": 2}], "summary": {"subtotal": 2, "total": 2}}']
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(bodies)], "doc_id int, text string, errors int").drop("errors")
    got = {r["doc_id"]: r for r in V.audit_invoices(df).collect()}
    assert len(got) == len(bodies)
    assert got[0]["errors"] == [
        "Line 1: quantity * unit_price (20.00) != amount (25.00)", "Subtotal mismatch: calculated 29.00, reported 30.00",
        "Total mismatch: subtotal (30.00) + tax (1000.50) - discount (2.00) = 1028.50, but total is 12.00"]
    assert not got[0]["is_valid"] and got[7]["is_valid"] and got[2]["calculated_subtotal"] == 9.0
    assert got[6]["errors"] == ["Total mismatch: subtotal (0.00) + tax (6.00) - discount (0.00) = 6.00, but total is 5.00"]
    tables = V.check_totals(shape.invoice_line_items(df), shape.invoice_summary(df))
    for r in tables.collect():
        same = ("n_lines", "n_line_errors", "calculated_subtotal", "expected_total", "subtotal_error", "total_error", "is_valid")
        assert [r[c] for c in same] == [got[r["doc_id"]][c] for c in same], r
    plan = V.audit_invoices(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_invoice(spark):
    lines = [
        (1, 1, "2", "10", "20"), (2, 1, "2", "10", "25"), (3, 1, None, None, "30"), (5, 1, "1", "9.99", "10"), (6, 1, None, None, None)]
    summary = [
        (1, "20", "2", "0", "22"), (2, "25", None, None, "25"), (3, None, None, None, None), (4, "0", "0", "0", "5"), (5, "10", None, None, "10"),
        (6, None, None, None, None)]
    got = totals(spark, V.check_invoice, lines, summary)
    flags = {i: (r["subtotal_error"], r["total_error"], r["n_warnings"], r["is_valid"]) for i, r in got.items()}
    assert flags == {
        1: (False, False, 0, True), 2: (False, False, 1, True), 3: (True, False, 1, False), 4: (False, True, 0, False),
        5: (False, False, 0, True), 6: (False, False, 0, True)}
    a, b = spark.createDataFrame(lines, LINES), spark.createDataFrame(summary, SUMMARY)
    texts = sorted(r["error"] for r in V.invoice_messages(V.check_invoice(a, b)).collect())
    assert texts == ["Subtotal mismatch: calculated 30.00, reported 0.00", "Total mismatch: expected 0.00, reported 5.00"]


RECORDS = [
    (1, '{"a": "x", "n": {"m": 1}, "l": [1]}'), (2, '{"a": "", "n": {"m": 0}, "l": []}'), (3, '{"a": null, "n": 5, "l": false}'), (4, "{}"), (5, "broken")]


def test_required_fields(spark):
    df = V.required_fields(spark.createDataFrame(RECORDS, "doc_id int, data string"), ["a", "n.m", "l"])
    assert {r["doc_id"]: r["missing"] for r in df.collect()} == {1: [], 2: ["a", "l"], 3: ["a", "n.m"], 4: ["a", "n.m", "l"], 5: ["a", "n.m", "l"]}


def test_dependencies(spark):
    records = [
        (1, '{"d": 10, "r": "sale"}'), (2, '{"d": 10, "r": ""}'), (3, '{"d": 0}'), (4, '{"d": "0"}'), (5, '{"d": false}'), (6, '{"d": [], "r": null}'),
        (7, '{"d": {"x": 1}, "r": []}'), (8, '{"d": 0.0}')]
    df = V.field_dependencies(spark.createDataFrame(records, "doc_id int, data string"), [("d", ["r"])])
    got = {r["doc_id"]: r["error"] for r in df.collect()}
    assert got == {2: "r is required when d is present", 4: "r is required when d is present"}


def test_cross_references(spark):
    a = spark.createDataFrame([(1, '{"v": {"n": "ACME  Corp "}, "t": 5}'), (2, '{"v": {"n": "A"}, "t": 0}'), (3, '{"t": 1}')], "doc_id int, data string")
    b = spark.createDataFrame([(1, '{"vendor": "acme corp", "total": 6}'), (2, '{"vendor": "B", "total": 9}'), (4, "{}")], "doc_id int, data string")
    got = [(r["doc_id"], r["primary_field"], r["primary_value"], r["secondary_value"])
           for r in V.cross_references(a, b, [("v.n", "vendor"), ("t", "total")]).orderBy("doc_id").collect()]
    assert got == [(1, "t", "5", "6"), (2, "v.n", "A", "B")]


def test_schema(spark):
    spec = [("name", "text", True), ("total", "number", False), ("n", "integer", True), ("ok", "boolean", False), ("tags", "list", False)]
    rows = [
        (1, '{"name": "x", "total": "1.5", "n": 3.0, "ok": "yes", "tags": ["a"]}'), (2, '{"name": 5, "total": null, "n": "4"}'),
        (3, '{"n": 1.5, "ok": 7, "tags": [1]}'), (4, "broken")]
    got = {r["doc_id"]: r for r in V.apply_schema(spark.createDataFrame(rows, "doc_id int, data string"), spec).collect()}
    assert tuple(got[1])[2:] == ("x", 1.5, 3, True, ["a"], [])
    assert got[2]["violations"] == ["name: type"] and got[2]["n"] == 4
    assert got[3]["violations"] == ["name: missing", "n: type", "ok: type", "tags: type"]
    assert got[4]["violations"] == ["name: missing", "n: missing"]
    assert V.type_name("business_card") == "BusinessCard"
    assert V.record_schema(spec).simpleString() == "struct<name:string,total:double,n:bigint,ok:boolean,tags:array<string>>"
    assert not V.record_schema(spec)["name"].nullable
    assert got[1]["total"] is not None and F is not None
