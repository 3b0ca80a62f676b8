"""Parsed responses to long tables, one job per kind of task.

A response holds all its elements, so everything here is explode and projection inside one row:
no job in this module shuffles. Columns other than the text are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import json_text as J
from ..functions.boxes import BOX, ordered_box, scaled
from ..functions.shared import let, unfold
from ..functions.text import as_col, shorten, word_count
from . import parse as P


def _rest(df: DataFrame, *drop) -> list[str]:
    return [c for c in df.columns if c not in drop]


def read_object(text, schema: str) -> Column:
    """The JSON object in a response, read with a schema (null if none)."""
    return let(J.find_json(text), lambda obj: F.from_json(F.when(J.is_object(obj), obj), schema))


def _read(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Keys of the response plus ``_r``, its JSON object."""
    return df.select(*_rest(df, text), read_object(text, schema).alias("_r"))


def _none(item: str) -> Column:
    return F.array().cast(f"array<{item}>")


def _or_empty(c: Column, item: str) -> Column:
    return F.coalesce(c, _none(item))


# --- OCR --------------------------------------------------------------------


def ocr_lines(df: DataFrame, text="text") -> DataFrame:
    """Text boxes of a page: ``line_no``, text, box, and the page's number of boxes."""
    rows = P.parse_boxes(df, text)
    return rows.select(
        *_rest(df, text), F.col("box_no").alias("line_no"),
        F.coalesce("text", "text_content").alias("text"), "bbox", "box_count",
    )


def ocr_counts(df: DataFrame, text="text") -> DataFrame:
    """Number of boxes per page, pages without any included."""
    return P.box_items(df, text, "_i").select(*_rest(df, text), F.size("_i").alias("box_count"))


def add_word_count(df: DataFrame, text="text", out="word_count") -> DataFrame:
    return df.withColumn(out, word_count(text))


def page_text(df: DataFrame, text="text", page="page_no") -> DataFrame:
    """Plain text of a page (its ``text_content`` items by line) beside the raw response."""
    body = P.fence_body(text)
    read = df.withColumn("_body", body).withColumn("_loose", J.is_loose_json("_body"))
    items = F.from_json(
        F.when(J.is_array("_body") & F.col("_loose"), F.col("_body")), "ARRAY<STRING>", {"allowSingleQuotes": "true"}
    )
    lines = F.filter(
        F.transform(items, lambda i: F.when(J.is_object(i), F.get_json_object(i, "$.text_content"))),
        lambda t: t.isNotNull(),
    )
    number = F.col(page).cast("string")
    status = (
        F.when(items.isNotNull(), F.lit("ok")).when(F.col("_loose"), F.lit("not_a_list")).otherwise(F.lit("unreadable"))
    )
    note = (
        F.when(F.col("status") == "ok", F.array_join("_lines", "\n"))
        .when(F.col("status") == "not_a_list",
              F.concat(F.lit("OCR response was not a list of text objects. Raw:\n"), F.col("_body")))
        .otherwise(F.concat(F.lit("Error parsing OCR JSON for page "), number,
                            F.lit("\nRaw response (after fence removal):\n"), F.col("_body")))
    )
    staged = read.withColumn("status", status).withColumn("_lines", lines)
    return staged.select(
        *_rest(df, text),
        "status",
        F.concat(F.lit("--- Page "), number, F.lit(" (Plain Text) ---\n"), note).alias("plain"),
        F.concat(F.lit("--- Page "), number, F.lit(" (Raw OCR Output) ---\n"), F.col(text), F.lit("\n\n")).alias("raw"),
    )


# --- layout -----------------------------------------------------------------


def layout_elements(df: DataFrame, text="text") -> DataFrame:
    rows = P.parse_boxes(df, text)
    label = F.when(
        F.col("type").isNotNull(), F.concat(F.col("type"), F.coalesce("level", F.lit("")))
    ).otherwise(F.col("label"))
    return rows.select(
        *_rest(df, text), F.col("box_no").alias("element_no"), "type", "level", label.alias("label"),
        "bbox", F.col("box_count").alias("element_count"),
    )


def sections(df: DataFrame, text="text") -> DataFrame:
    rows = P.parse_boxes(df, text)
    return rows.select(
        *_rest(df, text), F.col("box_no").alias("section_no"), "title",
        F.coalesce("title", "label").alias("label"), "bbox", F.col("box_count").alias("section_count"),
    )


def reading_order(df: DataFrame, text="text") -> DataFrame:
    """Elements with their order number, ready to be sorted by (document, ``order``)."""
    rows = P.parse_boxes(df, text)
    return rows.select(
        *_rest(df, text), F.col("box_no").alias("element_no"), F.col("order").try_cast("double").alias("order"),
        "type", F.coalesce("order", "label").alias("label"), "bbox", F.col("box_count").alias("element_count"),
    )


# --- tables -----------------------------------------------------------------

TABLE = "STRUCT<bbox STRING, headers ARRAY<STRING>, rows ARRAY<ARRAY<STRING>>>"
TABLES = f"STRUCT<tables ARRAY<{TABLE}>>"


def _tables(df: DataFrame, text: str) -> DataFrame:
    return _read(df, text, TABLES).withColumn("_tables", F.col("_r.tables")).drop("_r")


def table_cells(df: DataFrame, text="text") -> DataFrame:
    """One row per cell: table, row and column number from 0, header (null without), value."""
    keys = _rest(df, text)
    by_table = unfold(_tables(df, text), keys, "_tables", "table_no", "_t")
    by_row = unfold(by_table, [*keys, "table_no", F.col("_t.headers").alias("_h")], "_t.rows", "row_no", "_row")
    cells = unfold(by_row, [*keys, "table_no", "row_no", "_h"], "_row", "col_no", "value")
    return cells.select(
        *keys, "table_no", "row_no", "col_no",
        F.get(F.coalesce("_h", _none("string")), F.col("col_no")).alias("header"), "value",
    )


def _csv_row(cells: Column) -> Column:
    field = lambda c: F.when(
        c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    ).otherwise(F.coalesce(c, F.lit("")))
    line = F.array_join(F.transform(cells, field), ",")
    # A single empty field is written as a quoted one, so the row does not vanish.
    lone = (F.size(cells) == 1) & (F.coalesce(F.get(cells, F.lit(0)), F.lit("")) == "")
    return F.concat(F.when(lone, F.lit('""')).otherwise(line), F.lit("\r\n"))


def tables_csv(df: DataFrame, text="text") -> DataFrame:
    """All tables of a response as CSV text (null without tables) and their number."""

    def table(t):
        head = F.when(F.size(F.coalesce(t["headers"], _none("string"))) > 0, _csv_row(t["headers"])).otherwise(F.lit(""))
        rows = F.coalesce(t["rows"], _none("array<string>"))
        return F.concat(head, F.array_join(F.transform(rows, _csv_row), ""))

    tables = F.col("_tables")
    count = F.size(_or_empty(tables, TABLE))
    return _tables(df, text).select(
        *_rest(df, text),
        F.when(count > 0, F.array_join(F.transform(tables, table), "\n\n")).alias("csv"),
        count.alias("table_count"),
    )


def table_frame(df: DataFrame, columns, index=0, text="text") -> DataFrame:
    """The ``index``-th table of each response as wide rows; responses without it give none.

    ``columns`` are the header names to read; a table without headers is read by position.
    """
    keys = _rest(df, text)
    picked = _tables(df, text).select(*keys, F.get("_tables", F.lit(index)).alias("_t"))
    rows = unfold(picked, [*keys, F.coalesce("_t.headers", _none("string")).alias("_h")], "_t.rows", "row_no", "_row")

    def cell(i, name):
        by_name = F.get("_row", (F.array_position("_h", name) - 1).cast("int"))
        return F.when(F.size("_h") > 0, by_name).otherwise(F.get("_row", F.lit(i))).alias(name)

    return rows.select(*keys, "row_no", *[cell(i, c) for i, c in enumerate(columns)])


# --- fields and entities ------------------------------------------------------


def field_map(text) -> Column:
    """Extracted fields by name, as variants."""

    def inner(top):
        named = F.get(F.map_values(F.map_filter(top, lambda k, _: k == "fields")), F.lit(0))
        nested = let(named, lambda v: F.when(J.kind(v).startswith("OBJECT"), v.cast("map<string,variant>")))
        return F.when(F.map_contains_key(top, F.lit("fields")), nested).otherwise(top)

    return let(let(J.find_json(text), J.object_items), inner)


def field_entry(e) -> Column:
    """Name, value (as text), confidence and box (as text) of an entry of :func:`field_map`."""
    v = e["value"]
    boxed = J.kind(v).startswith("OBJECT")
    shown = lambda x: F.when(~J.is_missing(x), J.show_value(x))
    own = F.when(boxed, F.try_variant_get(v, "$.value", "variant")).otherwise(v)
    return F.struct(
        e["key"].alias("field"), let(own, shown).alias("value"),
        F.when(boxed, F.try_variant_get(v, "$.confidence", "double")).alias("confidence"),
        F.when(boxed, F.try_variant_get(v, "$.bbox", "string")).alias("bbox"),
    )


def fields_long(df: DataFrame, text="text") -> DataFrame:
    """One row per extracted field: value (as text), confidence, box, and the field count."""
    keys = _rest(df, text)
    read = df.select(*keys, field_map(text).alias("_f")).select(
        *keys, F.size("_f").alias("field_count"), F.transform(F.map_entries("_f"), field_entry).alias("_f"))
    rows = unfold(read, [*keys, "field_count"], "_f", "_n", "_x")
    box = F.from_json("_x.bbox", "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE").cast(BOX)
    return rows.select(*keys, "_x.field", "_x.value", "_x.confidence", box.alias("bbox"), "field_count")


def normalise_specs(specs: DataFrame) -> DataFrame:
    """Field specs with defaults filled: type text, not required, no description, no validator."""
    fill = {"name": "", "type": "text", "required": False, "description": "", "validator": "none"}
    return specs.select(
        *[F.coalesce(c, F.lit(fill[c])).alias(c) if c in fill else F.col(c) for c in specs.columns]
    )


def compact_specs(specs: DataFrame) -> DataFrame:
    """Inverse of :func:`normalise_specs`: empty descriptions and ``none`` validators are null."""
    return specs.withColumn("description", F.nullif("description", F.lit(""))).withColumn(
        "validator", F.nullif(F.nullif("validator", F.lit("")), F.lit("none"))
    )


ENTITY = "STRUCT<text STRING, type STRING, confidence DOUBLE, bbox STRING>"


ENTITIES = f"STRUCT<entities ARRAY<{ENTITY}>>"


def entity_items(r) -> Column:
    """The entities of a parsed response; one without a type is ``UNKNOWN``."""
    return F.transform(_or_empty(r["entities"], ENTITY), lambda e: e.withField("type", F.coalesce(e["type"], F.lit("UNKNOWN"))))


def _entities(df: DataFrame, text: str) -> DataFrame:
    return _read(df, text, ENTITIES).select(*_rest(df, text), entity_items(F.col("_r")).alias("_entities"))


def entities_long(df: DataFrame, text="text") -> DataFrame:
    rows = unfold(_entities(df, text), _rest(df, text), "_entities", "entity_no", "_e")
    return rows.select(
        *_rest(df, text), "entity_no", F.col("_e.text").alias("text"), F.col("_e.type").alias("type"),
        F.col("_e.confidence").alias("confidence"),
        F.from_json("_e.bbox", "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE").cast(BOX).alias("bbox"),
    )


def entities_by_type(df: DataFrame, text="text") -> DataFrame:
    """Per response and type: number of entities and their texts, with the response's totals."""
    keys = _rest(df, text)
    rows = _entities(df, text).withColumn("_types", F.array_distinct("_entities.type"))
    sizes = (F.size("_entities").alias("entity_count"), F.size("_types").alias("type_count"))
    rows = unfold(rows, [*keys, "_entities", *sizes], "_types", "_n", "type")
    same = F.filter("_entities", lambda e: e["type"] == F.col("type"))
    return rows.select(
        *keys, "type", F.size(same).alias("n"), F.transform(same, lambda e: e["text"]).alias("texts"),
        "entity_count", "type_count",
    )


def wanted_types(types=None) -> list[str]:
    """Known entity types among the requested ones (list or comma-separated text); all if none
    are named or the text is ``all``."""
    if not types or types == "all":
        return list(dims.ENTITY_TYPES)
    asked = types.split(",") if isinstance(types, str) else types
    return [t for t in dims.ENTITY_TYPES if t in asked]


def entity_filter(entities: DataFrame, types=None) -> DataFrame:
    """Entities of the requested known types."""
    return entities.where(F.col("type").isin(wanted_types(types)))


# --- forms ------------------------------------------------------------------

FORM = (
    "STRUCT<fields ARRAY<STRUCT<key STRING, value STRING, type STRING, required BOOLEAN, bbox STRING>>, "
    "checkboxes ARRAY<STRUCT<label STRING, checked BOOLEAN, `group` STRING, bbox STRING>>, "
    "signatures ARRAY<STRUCT<type STRING, name STRING, date STRING, bbox STRING>>>"
)


def form_items(r) -> Column:
    """Fields, checkboxes and signatures of a parsed form as one list of (pos, e)."""

    def element(kind, name, value, checked, label, colour):
        def build(e):
            boxed = e["bbox"].isNotNull()
            return F.struct(
                F.lit(kind).alias("element"), name(e).cast("string").alias("name"),
                value(e).cast("string").alias("value"), checked(e).cast("boolean").alias("checked"),
                F.when(boxed, label(e)).alias("label"), F.when(boxed, F.lit(colour)).alias("colour"),
                e["bbox"].alias("bbox"),
            )

        return build

    null = lambda e: F.lit(None)
    mark = lambda e: F.when(F.coalesce(e["checked"], F.lit(False)), "☑ ").otherwise("☐ ")
    parts = (
        ("fields", element("field", lambda e: e["key"], lambda e: e["value"], null,
                           lambda e: F.substring(F.coalesce(e["key"], F.lit("field")), 1, 20), dims.FIELD_COLOUR)),
        ("checkboxes", element("checkbox", lambda e: e["label"], lambda e: e["group"],
                               lambda e: F.coalesce(e["checked"], F.lit(False)),
                               lambda e: F.concat(mark(e), F.substring(F.coalesce(e["label"], F.lit("")), 1, 15)),
                               dims.CHECKBOX_COLOUR)),
        ("signatures", element("signature", lambda e: e["name"], lambda e: e["type"], null,
                               lambda e: F.lit("Signature"), dims.SIGNATURE_COLOUR)),
    )
    typed = [F.transform(r[name], build) for name, build in parts]
    numbered = [F.transform(t, lambda e, i: F.struct(i.alias("pos"), e.alias("e"))) for t in typed]
    item = (
        "struct<pos:int,e:struct<element:string,name:string,value:string,checked:boolean,"
        "label:string,colour:string,bbox:string>>"
    )
    return F.concat(*[_or_empty(n, item) for n in numbered])


def form_elements(df: DataFrame, text="text") -> DataFrame:
    """Fields, checkboxes and signatures of a form in one table.

    ``label`` and ``colour`` are what a drawing would show; both are null without a box.
    """
    keys = _rest(df, text)
    r = F.col("_r")
    read = _read(df, text, FORM)
    size = lambda name: F.coalesce(F.size(r[name]), F.lit(0))
    counts = [size(n).alias(c) for n, c in (
        ("fields", "field_count"), ("checkboxes", "checkbox_count"), ("signatures", "signature_count"))]
    rows = unfold(read, [*keys, *counts], form_items(r), "_n", "_x")
    return rows.select(*keys, "_x.e.element", F.col("_x.pos").alias("pos"), "_x.e.name", "_x.e.value",
                       "_x.e.checked", "_x.e.label", "_x.e.colour", "_x.e.bbox",
                       "field_count", "checkbox_count", "signature_count")


# --- invoices ---------------------------------------------------------------

HEADER_FIELDS = (
    "vendor_name", "vendor_address", "vendor_phone", "vendor_email", "invoice_number",
    "date", "due_date", "customer_name", "customer_address",
)
ITEM_FIELDS = ("description", "quantity", "unit_price", "amount", "tax_rate")
SUMMARY_FIELDS = ("subtotal", "tax", "discount", "total", "currency")
PAYMENT_FIELDS = ("method", "terms", "bank_details")


def _strings(names):
    return "STRUCT<" + ", ".join(f"`{n}` STRING" for n in names) + ">"


INVOICE = (
    f"STRUCT<header {_strings(HEADER_FIELDS)}, line_items ARRAY<STRING>, "
    f"summary {_strings(SUMMARY_FIELDS)}, payment {_strings(PAYMENT_FIELDS)}>"
)


def _invoice_part(df, text, part, names) -> DataFrame:
    read = _read(df, text, INVOICE)
    return read.select(*_rest(df, text), *[F.col("_r")[part][n].alias(n) for n in names])


def invoice_header(df: DataFrame, text="text") -> DataFrame:
    return _invoice_part(df, text, "header", HEADER_FIELDS)


def invoice_summary(df: DataFrame, text="text") -> DataFrame:
    items = F.coalesce(F.size("_r.line_items"), F.lit(0)).alias("item_count")
    read = _read(df, text, INVOICE)
    return read.select(*_rest(df, text), *[F.col("_r.summary")[n].alias(n) for n in SUMMARY_FIELDS], items)


def invoice_payment(df: DataFrame, text="text") -> DataFrame:
    return _invoice_part(df, text, "payment", PAYMENT_FIELDS)


def invoice_lines(r) -> Column:
    """The lines of a parsed invoice, each with whether it names a quantity."""
    named = lambda t: F.coalesce(F.array_contains(F.json_object_keys(t), "quantity"), F.lit(False))
    return F.transform(r["line_items"], lambda t: F.struct(F.from_json(t, _strings(ITEM_FIELDS)).alias("line"), named(t).alias("has_quantity")))


def read_invoice(df: DataFrame, text="text") -> DataFrame:
    """Keys of the response, its ``summary`` and ``lines``: the line objects with ``has_quantity``, in order.

    A line without a quantity and one whose quantity is null are told apart by the names in the line.
    """
    return _read(df, text, INVOICE).select(*_rest(df, text), F.col("_r.summary").alias("summary"), invoice_lines(F.col("_r")).alias("lines"))


def invoice_line_items(df: DataFrame, text="text") -> DataFrame:
    """One row per line, numbered from 1; amounts stay text so currency marks survive."""
    rows = unfold(read_invoice(df, text), _rest(df, text), "lines", "_p", "_l")
    return rows.select(
        *_rest(df, text), (F.col("_p") + 1).alias("line_no"), *[F.col("_l.line")[n].alias(n) for n in ITEM_FIELDS], "_l.has_quantity")


# --- contracts --------------------------------------------------------------

CONTRACT = (
    "STRUCT<parties ARRAY<STRING>, dates MAP<STRING,STRING>, clauses ARRAY<STRING>, "
    "obligations ARRAY<STRING>, key_terms MAP<STRING,STRING>>"
)
PART_NAME = {"parties": "name", "clauses": "title", "obligations": "party"}


def contract_items(r) -> Column:
    """All parts of a parsed contract as one list of (part, pos, name, value)."""

    def listed(part):
        build = lambda e, i: F.struct(
            F.lit(part).alias("part"), i.alias("pos"),
            F.get_json_object(e, f"$.{PART_NAME[part]}").alias("name"), e.alias("value"))
        return F.transform(r[part], build)

    def mapped(part):
        build = lambda e, i: F.struct(
            F.lit(part).alias("part"), i.alias("pos"), e["key"].alias("name"), e["value"].alias("value"))
        return F.transform(F.map_entries(r[part]), build)

    item = "struct<part:string,pos:int,name:string,value:string>"
    parts = [listed("parties"), mapped("dates"), listed("clauses"), listed("obligations"), mapped("key_terms")]
    return F.concat(*[_or_empty(p, item) for p in parts])


def contract_parts(df: DataFrame, text="text") -> DataFrame:
    """Parties, dates, clauses, obligations and key terms: ``part``, ``pos``, ``name``, ``value``.

    For list parts the value is the element's JSON, for dates and terms the plain value.
    """
    keys = _rest(df, text)
    r = F.col("_r")
    size = lambda n: F.coalesce(F.size(r[n]), F.lit(0))
    counts = [size(n).alias(c) for n, c in (
        ("parties", "party_count"), ("clauses", "clause_count"), ("obligations", "obligation_count"))]
    rows = unfold(_read(df, text, CONTRACT), [*keys, *counts], contract_items(r), "_n", "_x")
    return rows.select(*keys, "_x.part", "_x.pos", "_x.name", "_x.value",
                       "party_count", "clause_count", "obligation_count")


PARTY = "STRUCT<name STRING, role STRING, address STRING, representative STRING>"


def parties(df: DataFrame, text="text") -> DataFrame:
    rows = unfold(_read(df, text, f"STRUCT<parties ARRAY<{PARTY}>>"), _rest(df, text), "_r.parties", "party_no", "_p")
    return rows.select(*_rest(df, text), "party_no", "_p.*")


def key_dates(df: DataFrame, text="text") -> DataFrame:
    """Named dates of a contract, the entries of ``other_dates`` included."""
    read = _read(df, text, "STRUCT<dates MAP<STRING,STRING>>")
    pair = "struct<name:string,date:string>"
    named = F.transform(
        F.map_entries(F.map_filter("_r.dates", lambda k, _: k != "other_dates")),
        lambda e: F.struct(e["key"].alias("name"), e["value"].alias("date")),
    )
    other = F.from_json(F.try_element_at("_r.dates", F.lit("other_dates")), "ARRAY<STRUCT<name STRING, date STRING>>")
    every = F.concat(_or_empty(named, pair), _or_empty(other, pair))
    return unfold(read, _rest(df, text), every, "_n", "_d").select(*_rest(df, text), "_d.name", "_d.date")


# --- boxes for drawing --------------------------------------------------------


def rescale_boxes(df: DataFrame, in_w="in_w", in_h="in_h", w="width", h="height", corners="bbox_2d", out="bbox") -> DataFrame:
    """Model-input corners to picture pixels, upper left corner first."""
    at = [F.get(as_col(corners), F.lit(i)) for i in range(4)]
    xs = [scaled(at[i], as_col(in_w), as_col(w)) for i in (0, 2)]
    ys = [scaled(at[i], as_col(in_h), as_col(h)) for i in (1, 3)]
    return df.withColumn(out, ordered_box(xs[0], ys[0], xs[1], ys[1]))


def grid_to_input(df: DataFrame, rows="grid_h", cols="grid_w", patch=14) -> DataFrame:
    """Input size in pixels from the patch grid."""
    return df.withColumn("in_w", as_col(cols) * patch).withColumn("in_h", as_col(rows) * patch)


def annotate_boxes(boxes: DataFrame, number="box_no") -> DataFrame:
    """Draw list: own colour or palette by position; rows without a box are left out."""
    palette = F.array(*map(F.lit, dims.COLOURS))
    picked = F.get(palette, F.pmod(F.col(number), F.lit(len(dims.COLOURS))).cast("int"))
    colour = F.coalesce("color", picked) if "color" in boxes.columns else picked
    return boxes.where(F.col("bbox").isNotNull()).withColumn("colour", colour)


def region_labels(df: DataFrame, text="text", kind=None, out="draw_label") -> DataFrame:
    """Short label: first 20 characters of the text, or ``type: text[:15]`` for entities."""
    col = F.coalesce(as_col(text), F.lit(""))
    if kind is None:
        return df.withColumn(out, shorten(col, 20))
    return df.withColumn(
        out, F.concat(F.coalesce(as_col(kind), F.lit("")), F.lit(": "), F.substring(col, 1, 15))
    )
