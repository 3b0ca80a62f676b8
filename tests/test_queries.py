"""Every named query against its SQL on the smallest tables, and what its plan looks like."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_points
from docflow.operators import parse, shape

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def counted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    same = lambda v: None if isinstance(v, float) and math.isnan(v) else (type(v).__name__, v)
    return Counter(tuple(same(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(entry_points.queries()))
def test_query(spark, con, name):
    df = entry_points.queries()[name](spark, SF)
    got = df.collect()
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert counted(df.columns, got) == counted(columns, cur.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1500


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["check_invoice", "daily_usage", "action_breakdown"])
def test_scans_read_only_what_they_need(spark, name):
    text = plan(entry_points.queries()[name](spark, SF))
    assert "l_returnflag" not in text and "l_shipdate" not in text and "FileScan parquet" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


ROW_JOBS = [
    parse.parse_json, parse.parse_boxes, parse.loose_boxes, parse.extract_pairs, parse.parse_xml_points, parse.decode_points,
    shape.invoice_line_items, shape.fields_long, shape.entities_by_type, shape.form_elements, shape.contract_parts, shape.tables_csv,
]


@pytest.mark.parametrize("job", ROW_JOBS, ids=lambda j: j.__name__)
def test_row_jobs_do_not_shuffle(spark, job):
    df = job(spark.createDataFrame([(1, "x")], "doc_id int, text string"))
    text = plan(df)
    assert "Exchange" not in text
    # the optimizer must not repeat a search, for instance to filter on its result
    written = df._jdf.queryExecution().analyzed().toString()
    assert text.count("```json(") <= written.count("```json(")


def test_filters_reach_the_scan(spark):
    text = plan(entry_points.queries()["query_audit"](spark, SF))
    assert "PushedFilters: [IsNotNull(" in text and "TakeOrderedAndProject" in text


def test_python_only_where_needed(spark):
    with_python = {
        n for n in ("check_quota", "histogram_stats", "sign_payloads", "resolve_keys", "sample_evenly", "pair_turns", "check_totals", "rate_limit", "decode_points")
        if any(mark in plan(entry_points.queries()[n](spark, SF)) for mark in ("MapInArrow", "ArrowEvalPython", "BatchEvalPython"))}
    assert with_python == {"rate_limit"}


def test_dimension_tables_are_the_small_side(spark):
    """Rules and types are sent to the facts; no fact table is dealt out by a field name."""
    text = plan(entry_points.queries()["date_consistency"](spark, SF))
    assert "BuildRight" in text and "BuildLeft" not in text and "hashpartitioning(field" not in text
    text = plan(entry_points.queries()["validate_fields"](spark, SF))
    assert "BuildRight" in text and "hashpartitioning(field" not in text
