"""Queries over model responses.

Each order gives one response: a JSON body built from its columns, put into a json fence, a plain
fence, bare prose, or cut short, by order key modulo 4. The SQL works from the columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import html, parse, prompts, route, shape, validate
from . import inputs as I
from .catalog import ORACLE, query

def K():
    """The order key all derived values follow from."""
    return F.col("o_orderkey")


def S():
    return K().cast("string")

READABLE = "o_orderkey % 4 <> 3"


def c(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def repeat(n, build):
    """JSON texts of items 1..n joined by commas."""
    return F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), build), ",")


def items_sql(n):
    return f"orders, unnest(range(1, CAST({n} + 1 AS BIGINT))) AS u(i)"


def box_json(i):
    s = lambda x: x.cast("string")
    return c('{"x1":', s(i), ',"y1":', s(i * 2), ',"x2":', s(i * 10 + K() % 50), ',"y2":', s(i * 20), "}")


BOX_COLS = ("bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2")
BOX_SQL = "CAST(i AS BIGINT) AS x1, CAST(i * 2 AS BIGINT) AS y1, CAST(i * 10 + o_orderkey % 50 AS BIGINT) AS x2, CAST(i * 20 AS BIGINT) AS y2"

# --- invoices ---------------------------------------------------------------------


def invoice_body():
    price = ((K() % 100) + F.lit(0.25)).cast("string")
    amount = lambda i: (i * ((K() % 100) + F.lit(0.25))).cast("string")
    item = lambda i: c('{"description":"Item ', i.cast("string"), '","quantity":', i.cast("string"),
                       ',"unit_price":', price, ',"amount":"$', amount(i), '"}')
    lines = F.when(K() % 5 == 0, F.lit("")).otherwise(repeat(K() % 4 + 1, item))
    return c('{"header":{"vendor_name":"Vendor ', F.col("o_custkey").cast("string"), '","invoice_number":"INV-', S(),
             '","date":"', F.date_format("o_orderdate", "yyyy-MM-dd"), '","due_date":null},"line_items":[', lines,
             '],"summary":{"subtotal":', price, ',"tax":"€1,', F.lpad((K() % 1000).cast("string"), 3, "0"),
             '.00","total":', S(), ',"currency":"USD"},"payment":{"method":"', F.col("o_orderpriority"), '"}}')


def invoices(spark, sf):
    return I.responses(spark, sf, invoice_body())


@query("parse_json", f"""
SELECT o_orderkey AS doc_id, 'invoice' AS task_type, {READABLE} AS found,
       CASE WHEN {READABLE} THEN 'INV-' || o_orderkey END AS invoice_number FROM orders""")
def parse_json(spark, sf):
    read = parse.parse_json(invoices(spark, sf))
    return read.select("doc_id", "task_type", F.col("json").isNotNull().alias("found"),
                       F.get_json_object("json", "$.header.invoice_number").alias("invoice_number"))


@query("invoice_header", f"""
SELECT o_orderkey AS doc_id, CASE WHEN {READABLE} THEN 'Vendor ' || o_custkey END AS vendor_name,
       CASE WHEN {READABLE} THEN 'INV-' || o_orderkey END AS invoice_number,
       CASE WHEN {READABLE} THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, CAST(NULL AS VARCHAR) AS due_date FROM orders""")
def invoice_header(spark, sf):
    return shape.invoice_header(invoices(spark, sf)).select("doc_id", "vendor_name", "invoice_number", "date", "due_date")


@query("invoice_line_items", f"""
SELECT o_orderkey AS doc_id, CAST(i AS INTEGER) AS line_no, 'Item ' || i AS description, CAST(i AS VARCHAR) AS quantity,
       CAST(o_orderkey % 100 + CAST(0.25 AS DOUBLE) AS VARCHAR) AS unit_price,
       '$' || CAST(i * (o_orderkey % 100 + CAST(0.25 AS DOUBLE)) AS VARCHAR) AS amount
FROM {items_sql('o_orderkey % 4 + 1')} WHERE {READABLE} AND o_orderkey % 5 <> 0""")
def invoice_line_items(spark, sf):
    return shape.invoice_line_items(invoices(spark, sf)).select(
        "doc_id", "line_no", "description", "quantity", "unit_price", "amount")


@query("invoice_summary", f"""
SELECT o_orderkey AS doc_id, CASE WHEN {READABLE} THEN CAST(o_orderkey % 100 + CAST(0.25 AS DOUBLE) AS VARCHAR) END AS subtotal,
       CASE WHEN {READABLE} THEN '€1,' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '.00' END AS tax,
       CASE WHEN {READABLE} THEN CAST(o_orderkey AS VARCHAR) END AS total, CASE WHEN {READABLE} THEN 'USD' END AS currency,
       CAST(CASE WHEN {READABLE} AND o_orderkey % 5 <> 0 THEN o_orderkey % 4 + 1 ELSE 0 END AS INTEGER) AS item_count
FROM orders""")
def invoice_summary(spark, sf):
    return shape.invoice_summary(invoices(spark, sf)).select("doc_id", "subtotal", "tax", "total", "currency", "item_count")


@query("invoice_payment", f"""
SELECT o_orderkey AS doc_id, CASE WHEN {READABLE} THEN o_orderpriority END AS method FROM orders""")
def invoice_payment(spark, sf):
    return shape.invoice_payment(invoices(spark, sf)).select("doc_id", "method")


@query("audit_responses", f"""
WITH lines AS (
  SELECT o_orderkey AS doc_id, CASE WHEN {READABLE} AND o_orderkey % 5 <> 0 THEN o_orderkey % 4 + 1 ELSE 0 END AS n,
         o_orderkey % 100 + CAST(0.25 AS DOUBLE) AS price, CAST(1000 + o_orderkey % 1000 AS DOUBLE) AS tax, {READABLE} AS ok FROM orders),
sums AS (
  SELECT *, price * n * (n + 1) / 2 AS subtotal, CASE WHEN ok THEN price ELSE 0 END AS reported,
         CASE WHEN ok THEN tax ELSE 0 END AS t, CASE WHEN ok THEN CAST(doc_id AS DOUBLE) ELSE 0 END AS total FROM lines),
flags AS (
  SELECT *, subtotal > 0 AND reported > 0 AND abs(subtotal - reported) > 0.01 AS subtotal_error,
         total > 0 AND abs(reported + t - total) > 0.01 AS total_error FROM sums)
SELECT doc_id, CAST(n AS BIGINT) AS n_lines, CAST(0 AS BIGINT) AS n_line_errors, subtotal AS calculated_subtotal, reported + t AS expected_total,
       subtotal_error, total_error, NOT subtotal_error AND NOT total_error AS is_valid,
       array_to_string(list_filter([CASE WHEN subtotal_error THEN format('Subtotal mismatch: calculated {{:.2f}}, reported {{:.2f}}', subtotal, reported) END,
                    CASE WHEN total_error THEN format('Total mismatch: subtotal ({{:.2f}}) + tax ({{:.2f}}) - discount (0.00) = {{:.2f}}, but total is {{:.2f}}',
                                                      CASE WHEN reported > 0 THEN reported ELSE subtotal END, t, reported + t, total) END],
                   lambda x: x IS NOT NULL), '; ') AS errors
FROM flags""")
def audit_responses(spark, sf):
    """The way from raw text to verdict, every response in place."""
    return validate.audit_invoices(invoices(spark, sf).select("doc_id", "text")).withColumn("errors", F.array_join("errors", "; "))


# --- boxes ------------------------------------------------------------------------


def ocr_body():
    """1 to 3 text boxes; a single one comes back as an object, which counts as a box itself."""
    item = lambda i: c('{"text":"line ', i.cast("string"), " of ", S(), ' with a long tail","bbox":', box_json(i), "}")
    return c("[", repeat(K() % 3 + 1, item), "]")


def ocr(spark, sf):
    return I.responses(spark, sf, ocr_body(), "ocr")


# Two items cut short leave the first one as the only whole object, which is read as a box.
_CUT_ONE = "(o_orderkey % 4 = 3 AND {n} = 2 AND i = 1)"
_OCR = f"FROM {items_sql('o_orderkey % 3 + 1')} WHERE ({READABLE} OR {_CUT_ONE.format(n='o_orderkey % 3 + 1')})"
_OCR_N = f"CAST(CASE WHEN {READABLE} THEN o_orderkey % 3 + 1 ELSE 1 END AS INTEGER)"


@query("parse_json_array", f"""
SELECT o_orderkey AS doc_id, CAST(CASE WHEN {READABLE} THEN o_orderkey % 3 + 1 END AS INTEGER) AS n FROM orders""")
def parse_json_array(spark, sf):
    read = parse.parse_json_array(ocr(spark, sf))
    return read.select("doc_id", F.json_array_length("json").alias("n"))


@query("parse_boxes", f"SELECT o_orderkey AS doc_id, CAST(i - 1 AS INTEGER) AS box_no, {_OCR_N} AS box_count, {BOX_SQL} {_OCR}")
def parse_boxes(spark, sf):
    return parse.parse_boxes(ocr(spark, sf)).select("doc_id", "box_no", "box_count", *BOX_COLS)


@query("labelled_boxes", """
SELECT o_orderkey AS doc_id, 0 AS box_no, 'Title of ' || o_orderkey AS label, CAST(o_orderkey % 7 AS BIGINT) AS x1, CAST(100 AS BIGINT) AS x2 FROM orders
UNION ALL SELECT o_orderkey, 1, 'Body', CAST(o_orderkey AS BIGINT), 200 FROM orders
UNION ALL SELECT o_orderkey, 2, 'foot note', 1, 3 FROM orders""")
def labelled_boxes(spark, sf):
    o = I.spread(I.table(spark, sf, "orders"))
    body = c("Title of ", S(), ": [", (K() % 7).cast("string"), ', 2, 100, 40]\n"Body": [', S(), ",60,  200, 300]\nfoot note : (1, 2, 3,4)")
    rows = parse.parse_boxes(o.select(K().alias("doc_id"), body.alias("text")))
    return rows.select("doc_id", "box_no", "label", "bbox.x1", "bbox.x2")


@query("ocr_lines", f"""
SELECT o_orderkey AS doc_id, CAST(i - 1 AS INTEGER) AS line_no, 'line ' || i || ' of ' || o_orderkey || ' with a long tail' AS text,
       {_OCR_N} AS box_count {_OCR}""")
def ocr_lines(spark, sf):
    return shape.ocr_lines(ocr(spark, sf)).select("doc_id", "line_no", "text", "box_count")


@query("ocr_counts", f"SELECT o_orderkey AS doc_id, CAST(CASE WHEN {READABLE} THEN o_orderkey % 3 + 1 WHEN o_orderkey % 3 + 1 = 2 THEN 1 ELSE 0 END AS INTEGER) AS box_count FROM orders")
def ocr_counts(spark, sf):
    return shape.ocr_counts(ocr(spark, sf)).select("doc_id", "box_count")


@query("annotate_boxes", f"""
SELECT o_orderkey AS doc_id, CAST(i - 1 AS INTEGER) AS box_no,
       CASE i WHEN 1 THEN '#FF0000' WHEN 2 THEN '#00FF00' ELSE '#0000FF' END AS colour {_OCR}""")
def annotate_boxes(spark, sf):
    return shape.annotate_boxes(parse.parse_boxes(ocr(spark, sf))).select("doc_id", "box_no", "colour")


@query("region_labels", f"""
SELECT o_orderkey AS doc_id, CAST(i - 1 AS INTEGER) AS line_no,
       substr('line ' || i || ' of ' || o_orderkey || ' with a long tail', 1, 20) || '...' AS draw_label {_OCR}""")
def region_labels(spark, sf):
    return shape.region_labels(shape.ocr_lines(ocr(spark, sf))).select("doc_id", "line_no", "draw_label")


def _grid_body():
    item = lambda i: c('{"bbox_2d":[', (i * 100).cast("string"), ",", (i * 7).cast("string"), ",", (K() % 90).cast("string"),
                       ',14],"text_content":"t', i.cast("string"), '","label":"b"}')
    return c("[", repeat(K() % 3 + 2, item), "]")


_SCALED = """
WITH boxes AS (
  SELECT o_orderkey AS doc_id, CAST(i - 1 AS INTEGER) AS box_no,
         CAST(trunc(CAST(i * 100 AS DOUBLE) / 560 * 1000) AS BIGINT) AS xa, CAST(trunc(CAST(o_orderkey % 90 AS DOUBLE) / 560 * 1000) AS BIGINT) AS xb,
         CAST(trunc(CAST(i * 7 AS DOUBLE) / 280 * 700) AS BIGINT) AS ya, CAST(trunc(CAST(14 AS DOUBLE) / 280 * 700) AS BIGINT) AS yb
  FROM {src})
SELECT doc_id, box_no, least(xa, xb) AS x1, least(ya, yb) AS y1, greatest(xa, xb) AS x2, greatest(ya, yb) AS y2 FROM boxes"""


# Only responses that open with a json fence are lists here; a cut one loses its last item.
@query("rescale_boxes", _SCALED.format(src=items_sql("o_orderkey % 3 + 2") + " WHERE o_orderkey % 4 = 0 OR (o_orderkey % 4 = 3 AND i <= o_orderkey % 3 + 1)"))
def rescale_boxes(spark, sf):
    boxes = parse.loose_boxes(I.responses(spark, sf, _grid_body(), "spatial_understanding"))
    sized = shape.grid_to_input(boxes.withColumn("grid_w", F.lit(40)).withColumn("grid_h", F.lit(20)))
    sized = sized.withColumn("width", F.lit(1000)).withColumn("height", F.lit(700))
    return shape.rescale_boxes(sized).select("doc_id", "box_no", *BOX_COLS)


@query("repair_truncated", """
SELECT o_orderkey AS doc_id, CAST(CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 3 + 2 WHEN 3 THEN o_orderkey % 3 + 1 END AS INTEGER) AS n FROM orders""")
def repair_truncated(spark, sf):
    read = parse.repair_truncated(I.responses(spark, sf, _grid_body(), "spatial_understanding"))
    return read.select("doc_id", F.size("items").alias("n"))


@query("strip_fence", """
SELECT o_orderkey AS doc_id, o_orderkey % 4 IN (0, 3) AS changed,
       CASE WHEN o_orderkey % 4 = 0 THEN 'O-' || o_orderkey || E'\\n' WHEN o_orderkey % 4 = 3 THEN substr('O-' || o_orderkey, 1, length('O-' || o_orderkey) - 3) END AS body
FROM orders""")
def strip_fence(spark, sf):
    stripped = parse.strip_fence(I.responses(spark, sf, c("O-", S()), "ocr"))
    changed = F.col("body") != F.col("text")
    return stripped.select("doc_id", changed.alias("changed"), F.when(changed, F.col("body")).alias("body"))


_GRID_TEXT = """
'[' || array_to_string(list_transform(range(1, o_orderkey % 3 + 3), lambda i: '{"bbox_2d":[' || i * 100 || ',' || i * 7 || ',' || o_orderkey % 90
  || ',14],"text_content":"t' || i || '","label":"b"}'), ',') || ']'"""


@query("page_text", f"""
WITH bodies AS (SELECT o_orderkey, o_orderkey % 9 + 1 AS page, {_GRID_TEXT} AS b FROM orders),
texts AS (
  SELECT *, CASE o_orderkey % 4 WHEN 0 THEN E'Here is the result:\\n```json\\n' || b || E'\\n```\\nDone.' WHEN 1 THEN E'```\\n' || b || E'\\n```'
                                WHEN 2 THEN 'The answer is ' || b || ' as asked.' ELSE E'```json\\n' || substr(b, 1, length(b) - 3) END AS text
  FROM bodies)
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 'ok' ELSE 'unreadable' END AS status,
       '--- Page ' || page || E' (Plain Text) ---\\n' ||
       CASE WHEN o_orderkey % 4 = 0 THEN array_to_string(list_transform(range(1, o_orderkey % 3 + 3), lambda i: 't' || i), E'\\n')
            ELSE 'Error parsing OCR JSON for page ' || page || E'\\nRaw response (after fence removal):\\n' || replace(text, E'```json\\n', '') END AS plain,
       '--- Page ' || page || E' (Raw OCR Output) ---\\n' || text || E'\\n\\n' AS raw
FROM texts""")
def page_text(spark, sf):
    responses = I.responses(spark, sf, _grid_body(), "ocr").withColumn("page_no", F.col("doc_id") % 9 + 1)
    return shape.page_text(responses).select("doc_id", "status", "plain", "raw")


@query("parse_bbox", """
SELECT o_orderkey AS doc_id, CAST(CASE o_orderkey % 6 WHEN 5 THEN NULL ELSE o_orderkey % 300 END AS BIGINT) AS x1,
       CAST(CASE o_orderkey % 6 WHEN 5 THEN NULL ELSE 7 END AS BIGINT) AS y1,
       CAST(CASE o_orderkey % 6 WHEN 5 THEN NULL ELSE o_orderkey END AS BIGINT) AS x2 FROM orders""")
def parse_bbox(spark, sf):
    a, b = (K() % 300).cast("string"), S()
    form = (
        F.when(K() % 6 == 0, c("[", a, ", 7, ", b, ", 9]"))
        .when(K() % 6 == 1, c('{"x1": ', a, ', "y1": 7.9, "x2": "', b, '", "y2": 9}'))
        .when(K() % 6 == 2, c("box (", a, ",7,  ", b, ",9)"))
        .when(K() % 6 == 3, c("at ", a, ", 7, ", b, ", 9 px"))
        .when(K() % 6 == 4, c('{"x1": null, "box": [', a, ",7,", b, ",9]}"))
        .otherwise(c(a, ", 7, ", b)))
    boxes = parse.parse_bbox(I.spread(I.table(spark, sf, "orders")).select(K().alias("doc_id"), form.alias("text")))
    return boxes.select("doc_id", *BOX_COLS[:3])


@query("parse_xml_points", f"""
SELECT o_orderkey AS doc_id, CAST(i - 1 AS INTEGER) AS point_no, CAST(i * 10 AS BIGINT) AS x, CAST(o_orderkey AS BIGINT) AS y
FROM {items_sql('o_orderkey % 4')}""")
def parse_xml_points(spark, sf):
    point = lambda i: c('<point x="', (i * 10).cast("string"), '"  y="', S(), '" />')
    body = F.when(K() % 4 == 0, F.lit("no points")).otherwise(repeat(K() % 4, point))
    return parse.parse_xml_points(I.spread(I.table(spark, sf, "orders")).select(K().alias("doc_id"), body.alias("text")))


@query("decode_points", """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 <> 3 THEN 2 END AS n, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderkey AS VARCHAR) END AS x2,
       CASE WHEN o_orderkey % 4 <> 3 THEN 'order & ' || o_orderkey END AS alt, CASE WHEN o_orderkey % 4 <> 3 THEN 'the order' END AS phrase FROM orders""")
def decode_points(spark, sf):
    end = F.when(K() % 4 == 3, "</point>").otherwise("</points>")
    body = c('```xml\n<points x1="1" y1="2" x2="', S(), '" y2="4" alt="order &amp; ', S(), '"> the order ', end, "\n```")
    read = parse.decode_points(I.spread(I.table(spark, sf, "orders")).select(K().alias("doc_id"), body.alias("text")))
    d = F.col("decoded")
    return read.select(
        "doc_id", F.when(d.isNotNull(), F.size("decoded.points")).alias("n"), F.get("decoded.points", F.lit(1))["x"].alias("x2"),
        F.col("decoded.alt").alias("alt"), F.col("decoded.phrase").alias("phrase"))


# --- text and markup ----------------------------------------------------------------


@query("clean_html", r"""
WITH styled AS (
  SELECT page_id, replace(replace(html, '<p>', '<p style="color: red; font-size: 12px">'), '<h1>', '<h1 style="">') AS html FROM pages),
a AS (SELECT page_id, regexp_replace(html, 'color:\s*[^;]+;?', '', 'g') AS html FROM styled),
b AS (SELECT page_id, regexp_replace(html, 'background-color:\s*[^;]+;?', '', 'g') AS html FROM a),
d AS (SELECT page_id, regexp_replace(html, '\s*style="\s*"', '', 'g') AS html FROM b),
e AS (SELECT page_id, regexp_replace(html, '\n\s*\n', E'\n', 'g') AS html FROM d)
SELECT page_id, trim(html, E' \n\t\r') AS html FROM e""")
def clean_html(spark, sf):
    styled = F.replace(
        F.replace("html", F.lit("<p>"), F.lit('<p style="color: red; font-size: 12px">')), F.lit("<h1>"), F.lit('<h1 style="">'))
    return parse.clean_html(I.spread(I.table(spark, sf, "pages")).select("page_id", styled.alias("html")))


def _boxed_pages(spark, sf):
    boxed = F.replace("html", F.lit("<p>"), F.lit('<p data-bbox="30 10 20 40" style="color: red">'))
    return I.spread(I.table(spark, sf, "pages")).select("page_id", boxed.alias("html"))


@query("html_boxes", """
SELECT page_id, 'p' AS tag, CAST((length(html) - length(replace(html, '<p>', ''))) / 3 AS BIGINT) AS n,
       CAST(40 AS BIGINT) AS x1, CAST(5 AS BIGINT) AS y1, CAST(60 AS BIGINT) AS x2, CAST(20 AS BIGINT) AS y2
FROM pages WHERE contains(html, '<p>')""")
def html_boxes(spark, sf):
    pages = _boxed_pages(spark, sf)
    sizes = {"resized_w": 500, "resized_h": 400, "width": 1000, "height": 200}
    for name, value in sizes.items():
        pages = pages.withColumn(name, F.lit(value))
    boxes = html.html_boxes(pages)
    return boxes.groupBy("page_id", "tag", "bbox").agg(F.count("*").alias("n")).select("page_id", "tag", "n", *BOX_COLS)


@query("clean_document_html")
def clean_document_html(spark, sf):
    return html.clean_document_html(_boxed_pages(spark, sf)).select("page_id", "cleaned")


_QUOTED = r'"([^"]+)"\s*:\s*"([^"]*)"'
_PLAIN = r"([^:\n=]+)\s*[:=]\s*([^\n]+)"


@query("extract_pairs", rf"""
WITH found AS (
  SELECT doc_id, unnest(list_zip(
    list_concat(regexp_extract_all(text, '{_QUOTED}', 1), regexp_extract_all(text, '{_PLAIN}', 1)),
    list_concat(regexp_extract_all(text, '{_QUOTED}', 2), regexp_extract_all(text, '{_PLAIN}', 2)),
    range(len(regexp_extract_all(text, '{_QUOTED}', 1)) + len(regexp_extract_all(text, '{_PLAIN}', 1))))) AS p
  FROM documents),
pairs AS (
  SELECT doc_id, trim(trim(p[1], E' \n\t\r'), '"') AS key, trim(trim(p[2], E' \n\t\r'), '"') AS value, p[3] AS place FROM found)
SELECT doc_id, key, value FROM pairs WHERE key <> ''
QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY place) = 1""")
def extract_pairs(spark, sf):
    return parse.extract_pairs(I.spread(I.table(spark, sf, "documents")).select("doc_id", "text")).select("doc_id", "key", "value")


@query("response_pairs", f"""
SELECT o_orderkey AS doc_id, k AS key, CASE k WHEN 'Order' THEN CAST(o_orderkey AS VARCHAR) WHEN 'Priority' THEN o_orderpriority
       WHEN 'status' THEN o_orderstatus WHEN 'paid' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'True' ELSE 'true' END
       WHEN 'due' THEN 'None' WHEN 'rate' THEN '1.5' END AS value
FROM orders, (VALUES ('Order'), ('Priority'), ('status'), ('paid'), ('due'), ('rate')) AS p(k)
WHERE CASE o_orderkey % 4 WHEN 0 THEN k IN ('status', 'paid', 'due', 'rate') ELSE k IN ('Order', 'Priority', 'status', 'paid') END""")
def response_pairs(spark, sf):
    obj = c('{"status": "', F.col("o_orderstatus"), '", "paid": true, "due": null, "rate": 1.50}')
    plain = c('Order: ', S(), '\nPriority =\n ', F.col("o_orderpriority"), '\n"status" : "', F.col("o_orderstatus"),
              '"\npaid: true\nOrder: again\n')
    body = F.when(K() % 4 == 0, obj).otherwise(plain)
    pairs = parse.extract_pairs(I.spread(I.table(spark, sf, "orders")).select(K().alias("doc_id"), body.alias("text")))
    return pairs.select("doc_id", "key", "value")


@query("clean_response", """
SELECT conv_id, turn, trim(text, E' \\n\\t\\r') AS text FROM conversations""")
def clean_response(spark, sf):
    marked = F.concat(F.lit(" \n<|im_start|>assistant\n"), "text", F.lit("<|im_end|>\n<|im_start|>user\n"))
    turns = I.chat(spark, sf).select("conv_id", "turn", marked.alias("text"))
    return parse.clean_response(turns)


@query("parse_tool_calls", """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 <> 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'computer_use' ELSE 'mobile_use' END END AS name,
       CASE WHEN o_orderkey % 4 <> 3 THEN CASE o_orderkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'left_click' ELSE 'type' END END AS action,
       CASE WHEN o_orderkey % 4 <> 3 AND o_orderkey % 3 <> 2 THEN CAST(o_orderkey AS DOUBLE) END AS x,
       o_orderkey % 4 <> 3 AND (o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND o_orderkey % 2 = 0)) AS is_click FROM orders""")
def parse_tool_calls(spark, sf):
    action = F.when(K() % 3 == 0, "click").when(K() % 3 == 1, "left_click").otherwise("type")
    point = F.when(K() % 3 == 2, '"text": "x"').otherwise(c('"coordinate": [', S(), ", 20]"))
    tool = F.when(K() % 2 == 0, "computer_use").otherwise("mobile_use")
    call = c('{"name": "', tool, '", "arguments": {"action": "', action, '", ', point, "}}")
    call = F.when(K() % 4 == 3, F.substring(call, 1, 30)).otherwise(call)
    rows = I.spread(I.table(spark, sf, "orders")).select(
        K().alias("doc_id"), c("I will act.\n<tool_call>\n", call, "\n</tool_call>").alias("text"),
        F.when(K() % 2 == 0, "computer").otherwise("mobile").alias("device"))
    calls = parse.parse_tool_calls(rows)
    return calls.select("doc_id", "name", "action", F.get("coordinate", F.lit(0)).alias("x"), "is_click")


@query("prior_steps", f"""
SELECT o_orderkey AS doc_id, CAST(i AS INTEGER) AS step, 'mobile_use' AS name, 'open' || i AS action FROM {items_sql('o_orderkey % 3 + 1')}""")
def prior_steps(spark, sf):
    step = lambda i: c("Step ", i.cast("string"), ': {"name": "mobile_use", "arguments": {"action": "open', i.cast("string"), '", "text": "a"}}; ')
    body = c("The user query: open. Done: ", repeat(K() % 3 + 1, step))
    return parse.prior_steps(I.spread(I.table(spark, sf, "orders")).select(K().alias("doc_id"), body.alias("text")))


@query("word_count", r"""
SELECT doc_id, CAST(CASE WHEN trim(text, E' \n\t\r') = '' THEN 0
  ELSE len(regexp_split_to_array(trim(text, E' \n\t\r'), '\s+')) END AS INTEGER) AS word_count FROM documents""")
def word_count(spark, sf):
    return shape.add_word_count(I.spread(I.table(spark, sf, "documents"))).select("doc_id", "word_count")


# --- layout -----------------------------------------------------------------------


def layout_body():
    item = lambda i: c('{"type":"', F.when(i == 1, "header").otherwise("paragraph"), '"',
                       F.when(i == 1, ',"level":2').otherwise(""), ',"title":"Part ', i.cast("string"),
                       '","order":', (5 - i).cast("string"), ',"bbox":', box_json(i), "}")
    return c("[", repeat(K() % 3 + 2, item), "]")


def layouts(spark, sf):
    return I.responses(spark, sf, layout_body(), "layout")


_LAYOUT = f"FROM {items_sql('o_orderkey % 3 + 2')} WHERE ({READABLE} OR {_CUT_ONE.format(n='o_orderkey % 3 + 2')})"


@query("layout_elements", f"""
SELECT o_orderkey AS doc_id, CAST(i - 1 AS INTEGER) AS element_no, CASE WHEN i = 1 THEN 'header2' ELSE 'paragraph' END AS label,
       CAST(CASE WHEN {READABLE} THEN o_orderkey % 3 + 2 ELSE 1 END AS INTEGER) AS element_count {_LAYOUT}""")
def layout_elements(spark, sf):
    return shape.layout_elements(layouts(spark, sf)).select("doc_id", "element_no", "label", "element_count")


@query("sections", f"SELECT o_orderkey AS doc_id, CAST(i - 1 AS INTEGER) AS section_no, 'Part ' || i AS label, {BOX_SQL} {_LAYOUT}")
def sections(spark, sf):
    return shape.sections(layouts(spark, sf)).select("doc_id", "section_no", "label", *BOX_COLS)


@query("reading_order", f"""
SELECT o_orderkey AS doc_id, CAST(5 - i AS DOUBLE) AS "order", CAST(5 - i AS VARCHAR) AS label,
       CASE WHEN i = 1 THEN 'header' ELSE 'paragraph' END AS type {_LAYOUT}""")
def reading_order(spark, sf):
    return shape.reading_order(layouts(spark, sf)).select("doc_id", "order", "label", "type")


# --- tables -----------------------------------------------------------------------


def table_body():
    head = F.when(K() % 5 == 0, F.lit("")).otherwise('"headers":["no","note"],')
    row = lambda i: c("[", i.cast("string"), ',"a, ', S(), ' \\"q\\""]')
    first = c("{", head, '"rows":[', repeat(K() % 3 + 1, row), "]}")
    second = F.when(K() % 2 == 0, c(',{"headers":["x"],"rows":[["', F.col("o_orderpriority"), '"],[""]]}')).otherwise("")
    return c('{"tables":[', first, second, "]}")


def tables(spark, sf):
    return I.responses(spark, sf, table_body(), "table")


_CELL = "'a, ' || o_orderkey || ' \"q\"'"
CELLS = f"""
cells AS (
  SELECT o_orderkey AS doc_id, 0 AS table_no, CAST(i - 1 AS INTEGER) AS row_no, 0 AS col_no, CASE WHEN o_orderkey % 5 <> 0 THEN 'no' END AS header, CAST(i AS VARCHAR) AS value
  FROM {items_sql('o_orderkey % 3 + 1')} WHERE {READABLE}
  UNION ALL SELECT o_orderkey, 0, CAST(i - 1 AS INTEGER), 1, CASE WHEN o_orderkey % 5 <> 0 THEN 'note' END, {_CELL}
  FROM {items_sql('o_orderkey % 3 + 1')} WHERE {READABLE}
  UNION ALL SELECT o_orderkey, 1, 0, 0, 'x', o_orderpriority FROM orders WHERE {READABLE} AND o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, 1, 1, 0, 'x', '' FROM orders WHERE {READABLE} AND o_orderkey % 2 = 0)
"""


@query("table_cells", f"WITH {CELLS} SELECT * FROM cells")
def table_cells(spark, sf):
    return shape.table_cells(tables(spark, sf)).select("doc_id", "table_no", "row_no", "col_no", "header", "value")


@query("tables_csv", f"""
SELECT o_orderkey AS doc_id, CAST(CASE WHEN {READABLE} THEN CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END ELSE 0 END AS INTEGER) AS table_count,
  CASE WHEN {READABLE} THEN CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE E'no,note\\r\\n' END
    || array_to_string(list_transform(range(1, o_orderkey % 3 + 2), lambda i: i || ',"a, ' || o_orderkey || ' ""q""' || '"' || E'\\r\\n'), '')
    || CASE WHEN o_orderkey % 2 = 0 THEN E'\\n\\nx\\r\\n' || o_orderpriority || E'\\r\\n""\\r\\n' ELSE '' END END AS csv
FROM orders""")
def tables_csv(spark, sf):
    return shape.tables_csv(tables(spark, sf)).select("doc_id", "table_count", "csv")


@query("table_frame", f"WITH {CELLS} SELECT doc_id, row_no, value AS x FROM cells WHERE table_no = 1")
def table_frame(spark, sf):
    return shape.table_frame(tables(spark, sf), ["x"], index=1).select("doc_id", "row_no", "x")


# --- fields and entities ------------------------------------------------------------


def fields_body():
    fields = c('"invoice_number":{"value":"INV-', S(), '","confidence":0.5,"bbox":', box_json(F.lit(1)), '},"total":{"value":',
               (K() % 100 + F.lit(0.5)).cast("string"), '},"note":"plain text","vendor_name":{"value":null,"confidence":1}')
    return F.when(K() % 2 == 0, c('{"fields":{', fields, "}}")).otherwise(c("{", fields, "}"))


def field_responses(spark, sf):
    return I.responses(spark, sf, fields_body(), "field_extraction")


_FIELD = """CASE f WHEN 'invoice_number' THEN 'INV-' || o_orderkey WHEN 'total' THEN CAST(o_orderkey % 100 + CAST(0.5 AS DOUBLE) AS VARCHAR)
            WHEN 'note' THEN 'plain text' END"""
_FIELDS = f"FROM orders, (VALUES ('invoice_number'), ('total'), ('note'), ('vendor_name')) AS x(f) WHERE {READABLE}"


@query("fields_long", f"""
SELECT o_orderkey AS doc_id, f AS field, {_FIELD} AS value, CASE f WHEN 'invoice_number' THEN CAST(0.5 AS DOUBLE) WHEN 'vendor_name' THEN 1.0 END AS confidence,
       CASE f WHEN 'invoice_number' THEN CAST(10 + o_orderkey % 50 AS BIGINT) END AS x2, 4 AS field_count {_FIELDS}""")
def fields_long(spark, sf):
    return shape.fields_long(field_responses(spark, sf)).select(
        "doc_id", "field", "value", "confidence", F.col("bbox.x2").alias("x2"), "field_count")


@query("field_specs", f"""
SELECT 'invoice' AS preset, f AS name, CASE f WHEN 'total' THEN 'currency' ELSE 'string' END AS type,
       count(CASE WHEN f <> 'vendor_name' THEN 1 END) AS filled {_FIELDS} AND f <> 'note' GROUP BY f""")
def field_specs(spark, sf):
    """How often each field of the invoice preset is filled."""
    found = shape.fields_long(field_responses(spark, sf))
    specs = dims.preset_specs(spark).where(F.col("preset") == "invoice")
    joined = found.join(specs, found["field"] == specs["name"])
    return joined.groupBy("preset", "name", "type").agg(F.count("value").alias("filled"))


@query("normalise_specs", f"""
SELECT o_orderkey AS doc_id, f AS name, CASE f WHEN 'total' THEN 'currency' ELSE 'text' END AS type, true AS required,
       CASE f WHEN 'invoice_number' THEN 'Invoice ID' WHEN 'total' THEN 'Total amount' ELSE 'Vendor/company name' END AS description, 'none' AS validator
{_FIELDS} AND f <> 'note'""")
def normalise_specs(spark, sf):
    specs = shape.normalise_specs(dims.template_specs(spark)).where(F.col("preset") == "invoice").drop("preset", "pos")
    found = shape.fields_long(field_responses(spark, sf)).select("doc_id", "field")
    return found.join(specs, F.col("field") == F.col("name")).drop("field")


ENTITY_NAMES = ("PERSON", "DATE", "MONEY", "SHAPE")


def entities_body():
    kind = lambda i: F.get(F.array(*map(F.lit, ENTITY_NAMES)), ((K() + i * i) % 4).cast("int"))
    item = lambda i: c('{"text":"entity number ', i.cast("string"), " of ", S(), '"',
                       F.when((K() + i) % 5 == 0, F.lit("")).otherwise(c(',"type":"', kind(i), '"')),
                       ',"confidence":0.25,"bbox":', box_json(i), "}")
    return c('{"entities":[', repeat(K() % 5 + 1, item), "]}")


def entity_responses(spark, sf):
    return I.responses(spark, sf, entities_body(), "ner")


_KIND = "CASE (o_orderkey + i * i) % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'DATE' WHEN 2 THEN 'MONEY' ELSE 'SHAPE' END"
ENTITIES = f"""
entities AS (
  SELECT o_orderkey AS doc_id, CAST(i - 1 AS INTEGER) AS entity_no, 'entity number ' || i || ' of ' || o_orderkey AS text,
         CASE WHEN (o_orderkey + i) % 5 = 0 THEN 'UNKNOWN' ELSE {_KIND} END AS type, CAST(0.25 AS DOUBLE) AS confidence, CAST(i * 20 AS BIGINT) AS y2
  FROM {items_sql('o_orderkey % 5 + 1')} WHERE {READABLE})
"""


@query("entities_long", f"WITH {ENTITIES} SELECT * FROM entities")
def entities_long(spark, sf):
    return shape.entities_long(entity_responses(spark, sf)).select(
        "doc_id", "entity_no", "text", "type", "confidence", F.col("bbox.y2").alias("y2"))


@query("entities_by_type", f"""
WITH {ENTITIES}, totals AS (SELECT doc_id, count(*) AS n, count(DISTINCT type) AS t FROM entities GROUP BY doc_id)
SELECT e.doc_id, e.type, CAST(count(*) AS INTEGER) AS n, string_agg(e.text, '|' ORDER BY e.entity_no) AS texts,
       CAST(any_value(totals.n) AS INTEGER) AS entity_count, CAST(any_value(totals.t) AS INTEGER) AS type_count
FROM entities e JOIN totals ON totals.doc_id = e.doc_id GROUP BY e.doc_id, e.type""")
def entities_by_type(spark, sf):
    grouped = shape.entities_by_type(entity_responses(spark, sf))
    return grouped.select("doc_id", "type", "n", F.array_join("texts", "|").alias("texts"), "entity_count", "type_count")


@query("entity_filter", f"WITH {ENTITIES} SELECT doc_id, entity_no, type FROM entities WHERE type IN ('PERSON', 'MONEY')")
def entity_filter(spark, sf):
    kept = shape.entity_filter(shape.entities_long(entity_responses(spark, sf)), "PERSON,MONEY,SHAPE")
    return kept.select("doc_id", "entity_no", "type")


@query("entity_labels", f"WITH {ENTITIES} SELECT doc_id, entity_no, type || ': entity number ' || (entity_no + 1) AS draw_label FROM entities")
def entity_labels(spark, sf):
    labelled = shape.region_labels(shape.entities_long(entity_responses(spark, sf)), kind="type")
    return labelled.select("doc_id", "entity_no", F.trim("draw_label").alias("draw_label"))


# --- forms and contracts ------------------------------------------------------------


def form_body():
    field = lambda i: c('{"key":"A rather long field key ', i.cast("string"), '","value":"', S(), '","bbox":', box_json(i), "}")
    box = lambda i: c('{"label":"Box number ', i.cast("string"), ' here","checked":', F.when((K() + i) % 2 == 0, "true").otherwise("false"),
                      ',"bbox":', box_json(i), "}")
    return c('{"fields":[', repeat(K() % 2 + 1, field), '],"checkboxes":[', repeat(K() % 3 + 1, box),
             '],"signatures":[{"type":"stamp","name":"', F.col("o_orderpriority"), '"}]}')


def forms(spark, sf):
    return I.responses(spark, sf, form_body(), "form")


_COUNTS = "CAST(o_orderkey % 2 + 1 AS INTEGER) AS field_count, CAST(o_orderkey % 3 + 1 AS INTEGER) AS checkbox_count, 1 AS signature_count"


@query("form_elements", f"""
SELECT o_orderkey AS doc_id, 'field' AS element, CAST(i - 1 AS INTEGER) AS pos, 'A rather long field key ' || i AS name, CAST(NULL AS BOOLEAN) AS checked,
       'A rather long field ' AS label, '#00FF00' AS colour, {_COUNTS} FROM {items_sql('o_orderkey % 2 + 1')} WHERE {READABLE}
UNION ALL
SELECT o_orderkey, 'checkbox', CAST(i - 1 AS INTEGER), 'Box number ' || i || ' here', (o_orderkey + i) % 2 = 0,
       CASE WHEN (o_orderkey + i) % 2 = 0 THEN '☑ ' ELSE '☐ ' END || 'Box number ' || i || ' he', '#0000FF', {_COUNTS} FROM {items_sql('o_orderkey % 3 + 1')} WHERE {READABLE}
UNION ALL
SELECT o_orderkey, 'signature', 0, o_orderpriority, NULL, NULL, NULL, {_COUNTS} FROM orders WHERE {READABLE}""")
def form_elements(spark, sf):
    return shape.form_elements(forms(spark, sf)).select(
        "doc_id", "element", "pos", "name", "checked", "label", "colour", "field_count", "checkbox_count", "signature_count")


def contract_body():
    party = lambda i: c('{"name":"Party ', i.cast("string"), " of ", S(), '","role":"', F.when(i == 1, "Buyer").otherwise("Seller"), '"}')
    clause = lambda i: c('{"number":"', i.cast("string"), '","title":"Clause ', i.cast("string"), '"}')
    other = F.when(K() % 3 == 0, c(',"other_dates":[{"name":"renewal","date":"', S(), '"}]')).otherwise("")
    return c('{"parties":[', repeat(K() % 2 + 1, party), '],"dates":{"effective_date":"', F.date_format("o_orderdate", "yyyy-MM-dd"), '"', other,
             '},"clauses":[', repeat(K() % 3 + 1, clause), '],"obligations":[{"party":"Party 1","obligation":"pay"}],"key_terms":{"duration":"',
             (K() % 36).cast("string"), ' months"}}')


def contracts(spark, sf):
    return I.responses(spark, sf, contract_body(), "contract")


@query("contract_parts", f"""
WITH parts AS (
  SELECT o_orderkey, 'parties' AS part, i - 1 AS pos, 'Party ' || i || ' of ' || o_orderkey AS name FROM {items_sql('o_orderkey % 2 + 1')}
  UNION ALL SELECT o_orderkey, 'dates', 0, 'effective_date' FROM orders
  UNION ALL SELECT o_orderkey, 'dates', 1, 'other_dates' FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 'clauses', i - 1, 'Clause ' || i FROM {items_sql('o_orderkey % 3 + 1')}
  UNION ALL SELECT o_orderkey, 'obligations', 0, 'Party 1' FROM orders
  UNION ALL SELECT o_orderkey, 'key_terms', 0, 'duration' FROM orders)
SELECT o_orderkey AS doc_id, part, CAST(pos AS INTEGER) AS pos, name, CAST(o_orderkey % 2 + 1 AS INTEGER) AS party_count,
       CAST(o_orderkey % 3 + 1 AS INTEGER) AS clause_count, 1 AS obligation_count FROM parts WHERE {READABLE}""")
def contract_parts(spark, sf):
    return shape.contract_parts(contracts(spark, sf)).select(
        "doc_id", "part", "pos", "name", "party_count", "clause_count", "obligation_count")


@query("parties", f"""
SELECT o_orderkey AS doc_id, CAST(i - 1 AS INTEGER) AS party_no, 'Party ' || i || ' of ' || o_orderkey AS name,
       CASE WHEN i = 1 THEN 'Buyer' ELSE 'Seller' END AS role FROM {items_sql('o_orderkey % 2 + 1')} WHERE {READABLE}""")
def parties(spark, sf):
    return shape.parties(contracts(spark, sf)).select("doc_id", "party_no", "name", "role")


@query("key_dates", f"""
SELECT o_orderkey AS doc_id, 'effective_date' AS name, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE {READABLE}
UNION ALL SELECT o_orderkey, 'renewal', CAST(o_orderkey AS VARCHAR) FROM orders WHERE {READABLE} AND o_orderkey % 3 = 0""")
def key_dates(spark, sf):
    return shape.key_dates(contracts(spark, sf)).select("doc_id", "name", "date")


# --- prompts and routing --------------------------------------------------------------


def _literal(text):
    return "'" + text.replace("'", "''") + "'"


def _schema_text(preset):
    lines = "\n".join(f"- {n} ({k}): {d}" for n, k, d in dims.PRESETS[preset])
    return prompts.FIELDS_HEAD + lines + prompts.FIELDS_TAIL


def _ner_text(types):
    lines = "\n".join(f"- {k}: {v}" for k, v in dims.ENTITY_TYPES.items() if k in types)
    return prompts.ENTITIES_HEAD + lines + prompts.ENTITIES_TAIL


_PROMPT = f"""CASE WHEN doc_id % 50 = 7 THEN 'Read ' || doc_id ELSE CASE doc_id % 8
  WHEN 0 THEN {_literal(prompts.OCR)} WHEN 1 THEN {_literal(prompts.LAYOUT)} WHEN 2 THEN {_literal(prompts.TABLE)}
  WHEN 3 THEN CASE WHEN doc_id % 3 = 0 THEN {_literal(_schema_text('receipt'))} ELSE {_literal(_schema_text('invoice'))} END
  WHEN 4 THEN {_literal(_ner_text(('DATE', 'URL')))}
  WHEN 5 THEN {_literal(prompts.FORM_HEAD + prompts.FORM_SIGNATURES + prompts.FORM_TAIL)}
  WHEN 6 THEN {_literal(prompts.INVOICE_HEAD + 'receipt' + prompts.INVOICE_TAIL)}
  ELSE {_literal(prompts.CONTRACT_HEAD + prompts.CONTRACT_CLAUSES + prompts.CONTRACT_TAIL)} END END"""
_ORDERED = ("ocr", "layout", "table", "field_extraction", "ner", "form", "invoice", "contract")


@query("build_prompts", f"""
SELECT doc_id, {_PROMPT} AS user_prompt, CASE doc_id % 8 {' '.join(f"WHEN {i} THEN {_literal(prompts.SYSTEM[t])}" for i, t in enumerate(_ORDERED))} END AS system_prompt,
       lang || '/' || doc_id AS image FROM documents""")
def build_prompts(spark, sf):
    d = I.spread(I.table(spark, sf, "documents"))
    k = F.col("doc_id")
    docs = d.select(
        "doc_id", F.concat("lang", F.lit("/"), k.cast("string")).alias("image"),
        F.get(F.array(*map(F.lit, _ORDERED)), (k % 8).cast("int")).alias("task_type"),
        F.when(k % 50 == 7, F.concat(F.lit("Read "), k.cast("string"))).otherwise("").alias("custom_prompt"),
        F.when(k % 3 == 0, "receipt").otherwise("unknown").alias("preset"),
        F.array(F.lit("URL"), F.lit("DATE")).alias("entity_types"), F.lit("receipt").alias("document_type"),
        F.lit(False).alias("with_checkboxes"), F.lit(None).cast("boolean").alias("with_signatures"),
        F.lit(True).alias("with_clauses"), F.lit(False).alias("with_obligations"))
    built = prompts.build_prompts(docs, prompts.schema_prompts(dims.preset_specs(spark)))
    message = lambda i: F.get("messages", F.lit(i))
    return built.select(
        "doc_id", F.get(message(1)["content"], F.lit(1))["text"].alias("user_prompt"),
        F.get(message(0)["content"], F.lit(0))["text"].alias("system_prompt"),
        F.get(message(1)["content"], F.lit(0))["image"].alias("image"))


_ROUTED = ("line_no", "entity_no", "text", "type", "quantity", "amount", "y2", "box_count")


def _routed_sql(task, given):
    """The rows of one task's own SQL, with null for what it does not have."""
    have = {**{n: n for n in _ROUTED}, **given}
    kinds = dict(zip(_ROUTED, ("INTEGER", "INTEGER", "VARCHAR", "VARCHAR", "VARCHAR", "VARCHAR", "BIGINT", "INTEGER")))
    cols = ", ".join(f"CAST({have[n] or 'NULL'} AS {kinds[n]}) AS {n}" for n in _ROUTED)
    return f"SELECT doc_id, '{task}' AS task_type, {cols} FROM ({ORACLE[given['from']]})"


_ROUTE_SQL = " UNION ALL ".join((
    _routed_sql("ocr", {"from": "ocr_lines", "y2": "(line_no + 1) * 20", "entity_no": None, "type": None, "quantity": None, "amount": None}),
    _routed_sql("ner", {"from": "entities_long", "line_no": None, "quantity": None, "amount": None, "box_count": None}),
    _routed_sql("invoice", {"from": "invoice_line_items", "entity_no": None, "text": None, "type": None, "y2": None, "box_count": None})))


@query("route_by_task", _ROUTE_SQL)
def route_by_task(spark, sf):
    """Three kinds of responses in one table, read in one pass."""
    o = I.spread(I.table(spark, sf, "orders"))
    kinds = {"ocr": ocr_body(), "ner": entities_body(), "invoice": invoice_body()}
    bodies = F.array(*[F.struct(F.lit(t).alias("task_type"), b.alias("_b")) for t, b in kinds.items()])
    mixed = o.select("o_orderkey", F.explode(bodies).alias("x")).select("o_orderkey", "x.*").select(
        F.col("o_orderkey").alias("doc_id"), "task_type", I.fenced(F.col("_b"), F.col("o_orderkey")).alias("text"))
    return route.route_by_task(mixed, list(kinds)).select("doc_id", "task_type", *[F.col("bbox.y2").alias("y2") if n == "y2" else n for n in _ROUTED])
