"""One pass over a mixed response table: every row is read the way its task type asks for.

A task is an expression that turns a response's text into a list of typed elements. The lists of all wanted
tasks are brought to one shape, a CASE over the task type picks the one to compute, and the result is unfolded
once, so the table is scanned once however many tasks it holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import let, unfold
from . import parse, shape

Task = Callable[[Column], Column]


def _boxes(row) -> Task:
    """Boxes of a response, each as ``row(position, members, box, number of boxes)``."""
    def build(text):
        one = lambda t, i, n: let(F.from_json(t, parse.ITEM), lambda b: F.struct(*row(i, b, parse.item_box(b), n)))
        return let(parse.box_array(text), lambda all_: F.transform(all_, lambda t, i: one(t, i, F.size(all_))))
    return build


def _ocr(i, b, box, n):
    return i.alias("line_no"), F.coalesce(b["text"], b["text_content"]).alias("text"), box.alias("bbox"), n.alias("box_count")


def _layout(i, b, box, n):
    label = F.when(b["type"].isNotNull(), F.concat(b["type"], F.coalesce(b["level"], F.lit("")))).otherwise(b["label"])
    return i.alias("element_no"), b["type"].alias("type"), b["level"].alias("level"), label.alias("label"), box.alias("bbox"), n.alias("element_count")


def _table(text) -> Column:
    cell = lambda t, r, h: lambda v, c: F.struct(
        t.alias("table_no"), r.alias("row_no"), c.alias("col_no"), F.get(F.coalesce(h, F.array().cast("array<string>")), c).alias("header"), v.alias("value"))
    rows = lambda x, t: F.flatten(F.transform(x["rows"], lambda row, r: F.transform(row, cell(t, r, x["headers"]))))
    return F.flatten(F.transform(shape.read_object(text, shape.TABLES)["tables"], rows))


def _box_of(text) -> Column:
    return F.from_json(text, "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE").cast(shape.BOX)


def _fields(text) -> Column:
    row = lambda n: lambda e: let(shape.field_entry(e), lambda x: F.struct(
        x["field"].alias("field"), x["value"].alias("value"), x["confidence"].alias("confidence"), _box_of(x["bbox"]).alias("bbox"), n.alias("field_count")))
    return let(shape.field_map(text), lambda m: F.transform(F.map_entries(m), row(F.size(m))))


def _ner(text) -> Column:
    return let(shape.read_object(text, shape.ENTITIES), lambda r: F.transform(shape.entity_items(r), lambda e, i: F.struct(
        i.alias("entity_no"), e["text"].alias("text"), e["type"].alias("type"), e["confidence"].alias("confidence"), _box_of(e["bbox"]).alias("bbox"))))


def _sizes(r, names) -> list[Column]:
    return [F.coalesce(F.size(r[n]), F.lit(0)).alias(c) for n, c in names.items()]


def _form(text) -> Column:
    counts = {"fields": "field_count", "checkboxes": "checkbox_count", "signatures": "signature_count"}
    names = ("element", "name", "value", "checked", "label", "colour", "bbox")
    return let(shape.read_object(text, shape.FORM), lambda r: F.transform(shape.form_items(r), lambda x: F.struct(
        x["pos"].alias("pos"), *[x["e"][n].alias(n) for n in names], *_sizes(r, counts))))


def _invoice(text) -> Column:
    return let(shape.read_object(text, shape.INVOICE), lambda r: F.transform(shape.invoice_lines(r), lambda x, i: F.struct(
        (i + 1).alias("line_no"), *[x["line"][n].alias(n) for n in shape.ITEM_FIELDS], x["has_quantity"].alias("has_quantity"))))


def _contract(text) -> Column:
    counts = {"parties": "party_count", "clauses": "clause_count", "obligations": "obligation_count"}
    return let(shape.read_object(text, shape.CONTRACT), lambda r: F.transform(shape.contract_items(r), lambda x: F.struct(
        *[x[n].alias(n) for n in ("part", "pos", "name", "value")], *_sizes(r, counts))))


TASKS: dict[str, Task] = {
    "ocr": _boxes(_ocr), "layout": _boxes(_layout), "table": _table, "field_extraction": _fields, "ner": _ner,
    "form": _form, "invoice": _invoice, "contract": _contract,
}


def register(task_type: str, task: Task) -> None:
    """Adds or replaces the expression of a task type: from a response's text to an array of structs."""
    TASKS[task_type] = task


def task_for(task_type: str) -> Task:
    if task_type not in TASKS:
        raise ValueError(f"No handler registered for task type: {task_type}")
    return TASKS[task_type]


def route_by_task(df: DataFrame, tasks, task_col="task_type", text="text") -> DataFrame:
    """The elements of all responses of the given tasks: the other columns, then the tasks' members by name.

    Members that a task does not have are null. A name that two tasks use for different types is text, a struct
    as JSON. Responses of other tasks give no rows.
    """
    tasks = list(dict.fromkeys(tasks))
    kinds = {t: df.select(task_for(t)(F.col(text)).alias("x")).schema["x"].dataType.elementType for t in tasks}
    members: dict[str, T.DataType] = {}
    for kind in kinds.values():
        for f in kind.fields:
            members[f.name] = f.dataType if members.get(f.name, f.dataType) == f.dataType else T.StringType()

    def as_common(kind):
        def value(x, name):
            mine = {f.name: f.dataType for f in kind.fields}.get(name)
            if mine is None:
                return F.lit(None).cast(members[name])
            if mine == members[name]:
                return x[name]
            return F.to_json(x[name]) if isinstance(mine, (T.StructType, T.ArrayType, T.MapType)) else x[name].cast("string")
        return lambda x: F.struct(*[value(x, name).alias(name) for name in members])

    case = F.lit(None)
    for t in reversed(tasks):
        case = F.when(F.col(task_col) == t, F.transform(task_for(t)(F.col(text)), as_common(kinds[t]))).otherwise(case)
    rest = [c for c in df.columns if c != text]
    return unfold(df.where(F.col(task_col).isin(tasks)), rest, case, "_n", "_x").select(*rest, *[F.col(f"_x.`{n}`").alias(n) for n in members])
