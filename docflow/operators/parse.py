"""Responses (free text) to structured columns.

Every job takes a DataFrame with a text column and works row by row in native expressions, so
none of them shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_text as J
from ..functions.boxes import CORNERS, box_or_null, make_box
from ..functions.shared import let, unfold
from ..functions.text import WS, as_col, strip, strip_quotes
from ..functions.xml_text import read_element

# Textual forms of boxes, points, pairs, tags and chat markers.
_N = r"(\d+)"
_FOUR = rf"{_N},\s*{_N},\s*{_N},\s*{_N}"
BOX_FORMS = (rf"\[{_FOUR}\]", rf"\({_FOUR}\)", _FOUR)
LABELLED_BOX = rf'"?((?:\G|(?<![^":\[\]]))[^":\[\]]++)"?\s*:\s*[\[\(]{_FOUR}[\]\)]'
POINT = r'<point\s+x="(\d+)"\s+y="(\d+)"\s*/>'
QUOTED_PAIR = r'"([^"]+)"\s*:\s*"([^"]*)"'
PLAIN_PAIR = rf"(?:\G|(?<![^:\n=]))([^:\n=]++){WS}*[:=]{WS}*([^\n]+)"
TOOL_CALL = r"(?s)<tool_call>\n(.*?)(?:\n</tool_call>|<tool_call>\n|\z)"
STEP = r"(?s)Step (\d+):\s*(\{.*?\})\s*;"
LINE_ENDS = r"\r\n|[\r\x0B\x0C\x1C-\x1E\x85  ]"


def parse_json(df: DataFrame, text="text", out="json") -> DataFrame:
    """Adds the first JSON value found in the text (as JSON text), or null."""
    return df.withColumn(out, J.find_json(text))


def parse_json_array(df: DataFrame, text="text", out="json") -> DataFrame:
    """Adds the first JSON array found in the text, or null."""
    return df.withColumn(out, J.find_json_array(text))


FENCE = r"(?s)(?:\A|\n)```json(?:\n|\z)(.*?)(?:```|\z)"


def fence_body(text) -> Column:
    """Text between a line that is exactly a json fence and the next fence; else unchanged."""
    col = as_col(text)
    lines = F.regexp_replace(F.regexp_replace(col, LINE_ENDS, "\n"), r"\n\z", "")
    body = let(lines, lambda t: F.when(t.rlike(FENCE), F.regexp_extract(t, FENCE, 1)).otherwise(col))
    return F.when(F.contains(col, F.lit("```json")), body).otherwise(col)


def strip_fence(df: DataFrame, text="text", out="body") -> DataFrame:
    return df.withColumn(out, fence_body(text))


def loose_items(text) -> Column:
    """Elements of a list that may be cut short: null when even the repaired text is no list."""

    def mend(body):
        head = F.regexp_extract(body, r'(?s)^(.*"\})', 1)
        fixed = F.concat(F.coalesce(F.nullif(head, F.lit("")), F.substring(body, 1, 1)), F.lit("]"))
        return F.when(J.is_loose_json(body), body).otherwise(let(fixed, lambda t: F.when(J.is_loose_json(t), t)))

    whole = let(fence_body(text), mend)
    read = lambda t: F.from_json(F.when(J.is_array(t), t), "ARRAY<STRING>", {"allowSingleQuotes": "true"})
    return let(whole, read)


def repair_truncated(df: DataFrame, text="text", out="items") -> DataFrame:
    """Adds the elements (JSON texts) of a possibly truncated list."""
    return df.withColumn(out, loose_items(text))


def _json_box(v: Column) -> Column:
    """Box of an object with x1..y2 or of a list of four."""
    whole = lambda at: box_or_null(make_box(*[let(a, J.variant_int) for a in at]))
    kind = J.kind(v)
    return F.when(kind.startswith("OBJECT"), whole([J.variant_at(v, n) for n in CORNERS])).when(
        kind.startswith("ARRAY") & F.try_variant_get(v, "$[4]", "variant").isNull(),
        whole([F.try_variant_get(v, f"$[{i}]", "variant") for i in range(4)]),
    )


def read_box(text) -> Column:
    """One box from JSON with x1..y2, a JSON list of four, or four digits groups in the text."""
    col = as_col(text)
    found = [
        F.when(
            col.rlike(form),
            let(F.regexp_extract(col, form, 0), lambda t: let(
                F.transform(F.regexp_extract_all(t, F.lit(r"(\d+)")), lambda d: d.try_cast("bigint")),
                lambda n: make_box(*[n[i] for i in range(4)]))),
        )
        for form in BOX_FORMS
    ]
    return F.coalesce(let(J.read_json(col), _json_box), *found)


def parse_bbox(df: DataFrame, text="text", out="bbox") -> DataFrame:
    return df.withColumn(out, read_box(text))


def _labelled(col: Column) -> Column:
    group = lambda g: F.regexp_extract_all(col, F.lit(LABELLED_BOX), F.lit(g))
    zipped = F.arrays_zip(*[group(g).alias(n) for g, n in enumerate(("label", *CORNERS), 1)])
    return F.transform(
        zipped,
        lambda m: F.to_json(
            F.struct(
                strip(m["label"]).alias("label"),
                make_box(*[m[n].try_cast("bigint") for n in CORNERS]).alias("bbox"),
            )
        ),
    )


def box_array(text) -> Column:
    """The list of labelled boxes (JSON texts) of a response.

    A JSON object counts only when it is a box itself; JSON of another kind gives nothing; then
    a JSON array is taken as it is; last, ``label: [a, b, c, d]`` in the text.
    """
    col = as_col(text)
    none = F.array().cast("array<string>")
    corners = F.array(*map(F.lit, CORNERS))
    is_box = lambda keys: F.array_contains(keys, "bbox") | (F.size(F.array_intersect(keys, corners)) == 4)
    from_object = lambda obj: F.when(
        J.is_object(obj) & F.coalesce(let(F.json_object_keys(obj), is_box), F.lit(False)), F.array(obj)).otherwise(none)
    from_array = lambda arr: F.when(J.json_truthy(arr), J.list_items(arr)).otherwise(_labelled(col))
    pick = lambda obj: F.when(J.json_truthy(obj), from_object(obj)).otherwise(
        let(J.find_json_array(col), from_array))
    return let(J.find_json(col), pick)


def box_items(df: DataFrame, text="text", out="items") -> DataFrame:
    """Adds the list of labelled boxes of a response."""
    return df.withColumn(out, box_array(text))


ITEM = (
    "STRUCT<label STRING, text STRING, text_content STRING, type STRING, level STRING, "
    "title STRING, `order` STRING, color STRING, bbox STRING, bbox_2d ARRAY<DOUBLE>, "
    "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE>"
)


def item_box(item: Column) -> Column:
    """Box of an item: its ``bbox`` list or object, else its own corners."""
    box = item["bbox"]
    by_place = lambda a: box_or_null(make_box(*[F.get(a, F.lit(i)) for i in range(4)]))
    by_name = lambda o: box_or_null(make_box(*[o[n] for n in CORNERS]))
    return (
        F.when(box.isNull(), by_name(item))
        .when(J.is_array(box), let(F.from_json(box, "ARRAY<DOUBLE>"), by_place))
        .when(J.is_object(box), let(F.from_json(box, "STRUCT<x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE>"), by_name))
    )


NAMES = ("label", "text", "text_content", "type", "level", "title", "order", "color", "bbox_2d")


def _box_rows(listed: DataFrame, rest) -> DataFrame:
    counted = listed.withColumn("box_count", F.size("_items"))
    rows = unfold(counted, [*rest, "box_count"], "_items", "box_no", "item").withColumn("_i", F.from_json("item", ITEM))
    i = F.col("_i")
    return rows.select(*rest, "box_count", "box_no", "item", *[i[n].alias(n) for n in NAMES], item_box(i).alias("bbox"))


def parse_boxes(df: DataFrame, text="text") -> DataFrame:
    """One row per box: position ``box_no``, the item's JSON, its known members and its box.

    The source text is left behind; it would be repeated once per box.
    """
    return _box_rows(box_items(df, text, "_items"), [c for c in df.columns if c != text])


def loose_boxes(df: DataFrame, text="text") -> DataFrame:
    """Like :func:`parse_boxes` for list responses that may be cut short or single-quoted."""
    return _box_rows(repair_truncated(df, text, "_items"), [c for c in df.columns if c != text])


def parse_xml_points(df: DataFrame, text="text") -> DataFrame:
    """One row per ``<point x=".." y=".."/>``."""
    xs = F.regexp_extract_all(text, F.lit(POINT), F.lit(1))
    ys = F.regexp_extract_all(text, F.lit(POINT), F.lit(2))
    rest = [c for c in df.columns if c != text]
    rows = unfold(df, rest, F.arrays_zip(xs.alias("x"), ys.alias("y")), "point_no", "p")
    return rows.select(
        *rest, "point_no", F.col("p.x").try_cast("bigint").alias("x"), F.col("p.y").try_cast("bigint").alias("y"))


def _decoded(names, values, first) -> Column:
    at = lambda name: F.get(values, (F.array_position(names, name) - 1).cast("int"))
    pairs = F.floor((F.size(names) - 1) / 2).cast("int")
    numbers = F.when(pairs > 0, F.sequence(F.lit(1), pairs)).otherwise(F.array().cast("array<int>"))
    point = lambda n: F.struct(at(F.concat(F.lit("x"), n.cast("string"))).alias("x"), at(F.concat(F.lit("y"), n.cast("string"))).alias("y"))
    return F.struct(F.transform(numbers, point).alias("points"), at(F.lit("alt")).alias("alt"), first.alias("phrase"))


def decode_points(df: DataFrame, text="text", out="decoded") -> DataFrame:
    """Adds points, alternative text and phrase of one XML element; null for bad XML.

    A document type and prefixed names count as bad.
    """
    bare = F.replace(F.replace(as_col(text), F.lit("```xml"), F.lit("")), F.lit("```"), F.lit(""))
    return df.withColumn(out, read_element(bare, _decoded))


def clean_markup(html) -> Column:
    """Drops colour styles, empty style attributes and blank lines, in that order."""
    col = as_col(html)
    col = F.regexp_replace(col, rf"color:{WS}*[^;]+;?", "")
    col = F.regexp_replace(col, rf"background-color:{WS}*[^;]+;?", "")
    col = F.regexp_replace(col, rf'{WS}*style="{WS}*"', "")
    col = F.regexp_replace(col, rf"\n{WS}*\n", "\n")
    return strip(col)


def clean_html(df: DataFrame, html="html", out="html") -> DataFrame:
    return df.withColumn(out, clean_markup(html))


def pair_items(text) -> Column:
    """Quoted pairs, then plain ones, trimmed; empty keys dropped; still with repeats."""

    def pairs(pattern):
        col = as_col(text)
        zipped = F.arrays_zip(
            F.regexp_extract_all(col, F.lit(pattern), F.lit(1)).alias("k"),
            F.regexp_extract_all(col, F.lit(pattern), F.lit(2)).alias("v"),
        )
        return F.transform(
            zipped, lambda m: F.struct(strip_quotes(m["k"]).alias("key"), strip_quotes(m["v"]).alias("value"))
        )

    both = F.concat(pairs(QUOTED_PAIR), pairs(PLAIN_PAIR))
    return F.filter(both, lambda p: F.length(p["key"]) > 0)


def extract_pairs(df: DataFrame, text="text") -> DataFrame:
    """One row per key and value. JSON objects give their entries, other text its pairs."""
    rest = [c for c in df.columns if c != text]
    shown = lambda e: F.struct(e["key"].alias("key"), let(e["value"], J.show_value).alias("value"))
    entries = lambda obj: F.transform(F.map_entries(J.object_items(obj)), shown)
    pick = lambda obj: F.when(J.is_object(obj) & J.json_truthy(obj), entries(obj)).otherwise(pair_items(text))
    # First occurrence wins: sort by key and place inside the row, keep the head of each run.
    placed = lambda p, i: F.struct(p["key"].alias("key"), i.alias("pos"), p["value"].alias("value"))
    heads = lambda pairs: F.filter(
        pairs, lambda p, i: F.coalesce(F.get(pairs, i - 1)["key"] != p["key"], F.lit(True)))
    found = let(F.array_sort(F.transform(let(J.find_json(text), pick), placed)), heads)
    return unfold(df, rest, found, "_n", "_p").select(
        *rest, F.col("_p.pos").alias("pos"), F.col("_p.key").alias("key"), F.col("_p.value").alias("value")
    )


def clean_response(df: DataFrame, text="text", out="text") -> DataFrame:
    """Removes chat markers and surrounding blanks."""
    col = F.regexp_replace(as_col(text), r"<\|im_end\|>", "")
    col = F.regexp_replace(col, rf"^{WS}*<\|im_start\|>assistant{WS}*", "")
    col = F.regexp_replace(col, rf"{WS}*<\|im_start\|>user{WS}*", "")
    return df.withColumn(out, strip(col))


CALL = (
    "STRUCT<name STRING, arguments STRUCT<action STRING, coordinate ARRAY<DOUBLE>, "
    "coordinate2 ARRAY<DOUBLE>, text STRING, keys ARRAY<STRING>, button STRING, "
    "time DOUBLE, status STRING, pixels DOUBLE>>"
)


def parse_tool_calls(df: DataFrame, text="text", device="device") -> DataFrame:
    """Adds name, action, coordinate and ``is_click`` of the call in a response.

    ``device`` names a column holding ``computer`` (any action containing click) or
    ``mobile`` (exactly click).
    """
    raw = F.regexp_extract(as_col(text), TOOL_CALL, 1)
    read = df.withColumn("_raw", raw).withColumn(
        "_call", F.from_json(F.when(J.is_json("_raw"), F.col("_raw")), CALL)
    )
    action = F.col("_call.arguments.action")
    click = F.when(as_col(device) == "computer", F.contains(action, F.lit("click"))).otherwise(action == "click")
    return read.select(
        *df.columns,
        F.col("_call.name").alias("name"),
        action.alias("action"),
        F.col("_call.arguments.coordinate").alias("coordinate"),
        F.coalesce(click, F.lit(False)).alias("is_click"),
    )


def prior_steps(df: DataFrame, text="text") -> DataFrame:
    """One row per earlier step listed in a query text (``Step n: {json};``)."""
    rest = [c for c in df.columns if c != text]
    numbers = F.regexp_extract_all(text, F.lit(STEP), F.lit(1))
    calls = F.regexp_extract_all(text, F.lit(STEP), F.lit(2))
    rows = unfold(df, rest, F.arrays_zip(numbers.alias("n"), calls.alias("c")), "_n", "_s")
    call = F.from_json(F.when(J.is_json(F.col("_s.c")), F.col("_s.c")), CALL)
    return rows.withColumn("_c", call).select(
        *rest, F.col("_s.n").cast("int").alias("step"), F.col("_c.name").alias("name"),
        F.col("_c.arguments.action").alias("action"),
    )
