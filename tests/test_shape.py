import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow import dims
from docflow.operators import prompts, route, shape


def fence(value):
    return "```json\n" + json.dumps(value) + "\n```"


BOX = {"x1": 0, "y1": 1, "x2": 20, "y2": 30}


def test_ocr_and_counts(responses):
    df = responses(fence([{"text": "a", "bbox": BOX}, {"text": "b", "bbox": BOX}]), "plain")
    assert [(r["line_no"], r["text"], r["box_count"]) for r in shape.ocr_lines(df).orderBy("line_no").collect()] == [(0, "a", 2), (1, "b", 2)]
    assert [r["box_count"] for r in shape.ocr_counts(df).orderBy("doc_id").collect()] == [2, 0]


def test_word_count(responses):
    df = responses("two  words", "", " \n", "a\tb\nc d")
    assert [r["word_count"] for r in shape.add_word_count(df).orderBy("doc_id").collect()] == [2, 0, 0, 4]


def test_page_text(responses):
    df = responses(fence([{"text_content": "a"}, {"x": 1}, {"text_content": "b"}]), fence({"a": 1}), "oops")
    rows = shape.page_text(df).orderBy("doc_id").collect()
    assert [r["status"] for r in rows] == ["ok", "not_a_list", "unreadable"]
    assert rows[0]["plain"] == "--- Page 1 (Plain Text) ---\na\nb"
    assert rows[2]["raw"] == "--- Page 1 (Raw OCR Output) ---\noops\n\n"


def test_layout_labels(responses):
    items = [{"type": "header", "level": 1, "title": "T", "order": 2, "bbox": BOX}, {"label": "own", "bbox": BOX}]
    df = responses(fence(items))
    assert [r["label"] for r in shape.layout_elements(df).orderBy("element_no").collect()] == ["header1", "own"]
    assert [r["label"] for r in shape.sections(df).orderBy("section_no").collect()] == ["T", "own"]
    assert [(r["order"], r["label"]) for r in shape.reading_order(df).orderBy("element_no").collect()] == [(2.0, "2"), (None, "own")]


TABLES = {"tables": [
    {"headers": ["a", "b"], "rows": [[1, 'x, "y"'], ["z", None]]},
    {"rows": [["only"], [""]]},
]}


def test_tables(responses):
    df = responses(fence(TABLES), "none")
    cells = [(r["table_no"], r["row_no"], r["col_no"], r["header"], r["value"])
             for r in shape.table_cells(df).orderBy("table_no", "row_no", "col_no").collect()]
    assert cells == [(0, 0, 0, "a", "1"), (0, 0, 1, "b", 'x, "y"'), (0, 1, 0, "a", "z"), (0, 1, 1, "b", None),
                     (1, 0, 0, None, "only"), (1, 1, 0, None, "")]
    out = shape.tables_csv(df).orderBy("doc_id").collect()
    assert out[0]["csv"] == 'a,b\r\n1,"x, ""y"""\r\nz,\r\n\n\nonly\r\n""\r\n'
    assert (out[0]["table_count"], out[1]["csv"], out[1]["table_count"]) == (2, None, 0)
    wide = [(r["b"], r["a"]) for r in shape.table_frame(df, ["b", "a"]).orderBy("row_no").collect()]
    assert wide == [('x, "y"', "1"), (None, "z")]
    assert shape.table_frame(df, ["0"], index=1).count() == 2
    assert shape.table_frame(df, ["0"], index=5).count() == 0


def test_fields(responses):
    named = {"a": {"value": "x", "confidence": 0.9, "bbox": BOX}, "b": 2.5, "c": {"value": None}, "d": True}
    df = responses(fence({"fields": named}), fence(named), fence({"fields": [1]}), "none")
    rows = shape.fields_long(df).orderBy("doc_id", "field").collect()
    one = [("a", "x", 0.9), ("b", "2.5", None), ("c", None, None), ("d", "True", None)]
    assert [(r["field"], r["value"], r["confidence"]) for r in rows] == one * 2
    assert {r["field_count"] for r in rows} == {4} and rows[0]["bbox"]["y2"] == 30


def test_repeated_keys_take_the_last_value(responses):
    df = responses('{"a": 1, "b": 2, "a": {"value": 3}}')
    assert [(r["field"], r["value"]) for r in shape.fields_long(df).orderBy("field").collect()] == [("a", "3"), ("b", "2")]


def test_specs(spark):
    full = shape.normalise_specs(dims.template_specs(spark))
    assert full.where("description is null or validator is null").count() == 0
    back = shape.compact_specs(full)
    assert back.where("preset = 'business_card' and validator is not null").count() == 2
    counts = dims.preset_specs(spark).groupBy("preset").count().collect()
    assert {r["preset"]: r["count"] for r in counts} == {"invoice": 9, "receipt": 7, "id_card": 6, "business_card": 7}


def test_entities(responses):
    df = responses(fence({"entities": [
        {"text": "Ann", "type": "PERSON", "confidence": 0.5, "bbox": BOX}, {"text": "Bob", "type": "PERSON"}, {"text": "?"}]}), "none")
    rows = shape.entities_long(df).orderBy("entity_no").collect()
    assert [r["type"] for r in rows] == ["PERSON", "PERSON", "UNKNOWN"]
    grouped = {r["type"]: (r["n"], r["texts"], r["entity_count"], r["type_count"]) for r in shape.entities_by_type(df).collect()}
    assert grouped == {"PERSON": (2, ["Ann", "Bob"], 3, 2), "UNKNOWN": (1, ["?"], 3, 2)}
    assert shape.entity_filter(shape.entities_long(df), "PERSON,NOPE").count() == 2
    assert shape.wanted_types() == shape.wanted_types("all") == list(dims.ENTITY_TYPES)
    assert shape.wanted_types(["URL", "X", "DATE"]) == ["DATE", "URL"]


def test_forms(responses):
    df = responses(fence({
        "fields": [{"key": "k" * 30, "value": "v", "bbox": BOX}, {"value": "w"}],
        "checkboxes": [{"label": "agree to everything", "checked": True, "bbox": BOX}],
        "signatures": [{"type": "stamp", "bbox": BOX}]}), fence({"fields": []}))
    rows = shape.form_elements(df).orderBy("element", "pos").collect()
    assert [(r["element"], r["label"], r["colour"]) for r in rows] == [
        ("checkbox", "☑ agree to everyt", "#0000FF"), ("field", "k" * 20, "#00FF00"), ("field", None, None),
        ("signature", "Signature", "#FF00FF")]
    assert (rows[0]["field_count"], rows[0]["checkbox_count"], rows[0]["signature_count"]) == (2, 1, 1)


def test_invoice_parts(responses):
    df = responses(fence({
        "header": {"vendor_name": "V"}, "line_items": [{"description": "d", "amount": "$5.00", "quantity": 2}],
        "summary": {"total": 5}, "payment": {"method": "cash"}}), "none")
    assert [r["vendor_name"] for r in shape.invoice_header(df).orderBy("doc_id").collect()] == ["V", None]
    items = shape.invoice_line_items(df).collect()
    assert [(r["line_no"], r["amount"], r["quantity"]) for r in items] == [(1, "$5.00", "2")]
    assert [(r["total"], r["item_count"]) for r in shape.invoice_summary(df).orderBy("doc_id").collect()] == [("5", 1), (None, 0)]
    assert shape.invoice_payment(df).where("method = 'cash'").count() == 1


def test_contracts(responses):
    df = responses(fence({
        "parties": [{"name": "A", "role": "Buyer"}], "dates": {"effective_date": "d1", "other_dates": [{"name": "n", "date": "d2"}]},
        "clauses": [{"title": "t"}], "obligations": [], "key_terms": {"duration": "1y"}}))
    rows = [(r["part"], r["name"]) for r in shape.contract_parts(df).orderBy("part", "pos").collect()]
    assert rows == [("clauses", "t"), ("dates", "effective_date"), ("dates", "other_dates"), ("key_terms", "duration"), ("parties", "A")]
    assert [(r["name"], r["date"]) for r in shape.key_dates(df).orderBy("name").collect()] == [("effective_date", "d1"), ("n", "d2")]
    assert [(r["name"], r["role"]) for r in shape.parties(df).collect()] == [("A", "Buyer")]


def test_rescaled_and_drawn_boxes(spark):
    df = spark.createDataFrame(
        [(0, [700.0, 0.0, 14.0, 140.0], None), (24, [0.0, 0.0, 1.0, 1.0], "#123456"), (25, None, None)], "box_no int, bbox_2d array<double>, color string")
    sized = shape.grid_to_input(df.withColumn("grid_w", F.lit(50)).withColumn("grid_h", F.lit(20)))
    sized = sized.withColumn("width", F.lit(1000)).withColumn("height", F.lit(100))
    boxes = shape.rescale_boxes(sized)
    assert tuple(boxes.where("box_no = 0").first()["bbox"]) == (20, 0, 1000, 50)
    drawn = shape.annotate_boxes(boxes.withColumn("bbox", F.when(F.col("bbox.x1").isNotNull(), F.col("bbox"))))
    assert {r["box_no"]: r["colour"] for r in drawn.collect()} == {0: "#FF0000", 24: "#123456"}


def test_labels(spark):
    df = spark.createDataFrame([("x" * 21, "DATE"), ("y" * 20, None)], "text string, type string")
    assert [r["draw_label"] for r in shape.region_labels(df).collect()] == ["x" * 20 + "...", "y" * 20]
    assert [r["draw_label"] for r in shape.region_labels(df, kind="type").collect()] == ["DATE: " + "x" * 15, ": " + "y" * 15]


JOBS = {
    "ocr": shape.ocr_lines, "layout": shape.layout_elements, "table": shape.table_cells, "field_extraction": shape.fields_long,
    "ner": shape.entities_long, "form": shape.form_elements, "invoice": shape.invoice_line_items, "contract": shape.contract_parts}


def test_routing_equals_every_job_in_one_scan(spark, tmp_path):
    box = {"x1": 1, "y1": 2, "x2": 3, "y2": 4}
    bodies = {
        "ocr": [{"text": "a", "bbox": [4, 3, 2, 1]}, {"text_content": "b"}], "layout": [{"type": "h", "level": 1, "bbox": box}, {"label": "x"}],
        "table": TABLES, "field_extraction": {"fields": {"n": {"value": "v", "confidence": 0.5, "bbox": box}, "m": 3, "z": None}},
        "ner": {"entities": [{"text": "a", "confidence": 1, "bbox": box}, {"type": "DATE"}]},
        "form": {"fields": [{"key": "k", "value": 1, "bbox": box}], "checkboxes": [{"label": "l", "checked": True, "group": "g", "bbox": box}], "signatures": [{"name": "s"}]},
        "invoice": {"line_items": [{"quantity": None, "amount": "$1"}, {"amount": 2}], "summary": {}},
        "contract": {"parties": [{"name": "p"}], "dates": {"d": "2024"}, "obligations": [{"party": "q"}], "key_terms": {"t": 1}}}
    rows = [(i, t, fence(b)) for i, (t, b) in enumerate(bodies.items())]
    rows += [(100 + i, t, text) for t in bodies for i, text in enumerate([None, "", "no json", "{}", "[]", fence([1]), '{"a": '])] + [(900, "other", "x"), (901, None, "y")]
    spark.createDataFrame(rows, "doc_id int, task_type string, text string").write.parquet(str(tmp_path / "r"))
    df = spark.read.parquet(str(tmp_path / "r"))
    out = route.route_by_task(df, list(JOBS))
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = out.collect()
    for task, job in JOBS.items():
        want = job(df.where(F.col("task_type") == task))
        names = want.columns
        plain = lambda v, name: json.dumps(v.asDict(), separators=(",", ":")) if hasattr(v, "asDict") and isinstance(out.schema[name].dataType, T.StringType) else v
        mine = sorted(str([r[n] for n in names]) for r in got if r["task_type"] == task)
        assert mine == sorted(str([plain(r[n], n) for n in names]) for r in want.collect()), task
        assert all(r[n] is None for r in got if r["task_type"] == task for n in out.columns if n not in names)


def test_routing(spark):
    df = spark.createDataFrame(
        [(1, "ner", fence({"entities": [{"text": "a"}]})), (2, "table", fence(TABLES)), (3, "other", "x")],
        "doc_id int, task_type string, text string")
    out = route.route_by_task(df, ["ner", "table"])
    assert {r["task_type"]: r["count"] for r in out.groupBy("task_type").count().collect()} == {"ner": 1, "table": 6}
    with pytest.raises(ValueError, match="No handler"):
        route.route_by_task(df, ["other"])
    route.register("other", lambda text: F.array(F.struct(F.upper(text).alias("shout"))))
    assert [r["shout"] for r in route.route_by_task(df, ["other"]).collect()] == ["X"]
    del route.TASKS["other"]


def test_prompts(spark):
    schema = ("doc_id int, image string, task_type string, custom_prompt string, preset string, entity_types array<string>, "
              "document_type string, with_checkboxes boolean, with_signatures boolean, with_clauses boolean, with_obligations boolean")
    rows = [
        (0, "i", "field_extraction", "", "id_card", None, None, None, None, None, None),
        (1, "i", "field_extraction", None, None, None, None, None, None, None, None),
        (2, "i", "ner", None, None, ["DATE"], None, None, None, None, None),
        (3, "i", "form", None, None, None, None, False, True, None, None),
        (4, "i", "invoice", None, None, None, "receipt", None, None, None, None),
        (5, "i", "contract", "mine", None, None, None, None, None, None, None),
    ]
    built = prompts.build_prompts(spark.createDataFrame(rows, schema), prompts.schema_prompts(dims.preset_specs(spark)))
    got = {r["doc_id"]: r for r in built.collect()}
    text = {i: r["user_prompt"] for i, r in got.items()}
    assert "- id_number (string): ID/document number\n- expiry_date (date): Expiration date" in text[0]
    assert text[1].startswith("Extract the following fields from this document:\n\n- invoice_number (string): Invoice number or ID\n")
    assert "- DATE: Dates and times" in text[2] and "PERSON" not in text[2]
    assert "Signatures**" in text[3] and "Checkboxes" not in text[3]
    assert text[4].startswith("Parse this receipt and extract all information.") and text[5] == "mine"
    system, user = got[5]["messages"]
    assert system["role"] == "system" and "contract analysis" in system["content"][0]["text"]
    assert [p["type"] for p in user["content"]] == ["image", "text"] and user["content"][0]["image"] == "i"
