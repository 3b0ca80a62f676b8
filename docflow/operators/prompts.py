"""Prompt texts and message arrays for document tables.

The texts below are fixed values. A document row names its task and options; the prompt of a
schema is built once per schema (a few rows) and joined, not once per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims

SYSTEM = {
    "ocr": (
        "You are a helpful assistant specialized in optical character recognition and text extraction. "
        "Extract all text from the image accurately, preserving the layout and structure as much as possible."
    ),
    "layout": (
        "You are a helpful assistant specialized in document layout analysis. Identify and locate different "
        "structural elements in documents such as headers, paragraphs, tables, figures, lists, and other components."
    ),
    "table": (
        "You are a helpful assistant specialized in extracting tables from documents. Identify tables, extract "
        "their structure including headers and cells, and convert them to structured formats like JSON or CSV."
    ),
    "field_extraction": (
        "You are a helpful assistant specialized in extracting specific fields from documents. Extract only the "
        "requested fields and provide confidence scores for each extracted value."
    ),
    "ner": (
        "You are a helpful assistant specialized in Named Entity Recognition (NER). Identify and extract named "
        "entities from text in images, categorizing them by type such as person names, organizations, dates, "
        "locations, and monetary values."
    ),
    "form": (
        "You are a helpful assistant specialized in form understanding. Extract key-value pairs, detect checkboxes "
        "and radio buttons, identify signatures, and understand form structure from document images."
    ),
    "invoice": (
        "You are a helpful assistant specialized in invoice and receipt parsing. Extract vendor information, line "
        "items, taxes, totals, dates, and payment details from invoice and receipt documents with high accuracy."
    ),
    "contract": (
        "You are a helpful assistant specialized in contract analysis. Extract key information from contracts "
        "including parties involved, dates, terms, clauses, obligations, and important provisions."
    ),
}

OCR = "Extract all text from this image. Preserve the layout and structure."

LAYOUT = """\
Analyze the layout of this document. Identify all structural elements including headers, paragraphs, tables, figures, lists, and captions. For each element, provide:
- type: the element type (header, paragraph, table, figure, list, caption, etc.)
- bbox: bounding box coordinates (x1, y1, x2, y2)
- level: hierarchy level for headers (1, 2, 3...)

Return as JSON array:
```json
[{"type": "header", "level": 1, "bbox": {"x1": 0, "y1": 0, "x2": 500, "y2": 50}}]
```"""

TABLE = """\
Extract all tables from this image. For each table:
1. Identify the table boundaries (bounding box)
2. Extract headers (column names)
3. Extract all rows of data

Return as JSON:
```json
{
  "tables": [
    {
      "bbox": {"x1": 0, "y1": 0, "x2": 500, "y2": 300},
      "headers": ["Column1", "Column2"],
      "rows": [
        ["value1", "value2"],
        ["value3", "value4"]
      ]
    }
  ]
}
```"""

FIELDS_HEAD = "Extract the following fields from this document:\n\n"
FIELDS_TAIL = """

Return as JSON with field names as keys. For each field, provide:
- value: the extracted value
- confidence: confidence score (0.0 to 1.0)
- bbox: bounding box coordinates (optional)

Example:
```json
{
  "fields": {
    "field_name": {
      "value": "extracted value",
      "confidence": 0.95,
      "bbox": {"x1": 0, "y1": 0, "x2": 100, "y2": 50}
    }
  }
}
```"""

ENTITIES_HEAD = "Extract all named entities from this image. Identify:\n\n"
ENTITIES_TAIL = """

Return as JSON array of entities:
```json
{
  "entities": [
    {
      "text": "entity text",
      "type": "ENTITY_TYPE",
      "confidence": 0.95,
      "bbox": {"x1": 0, "y1": 0, "x2": 100, "y2": 50}
    }
  ]
}
```"""

FORM_HEAD = """\
Analyze this form and extract the following information:

1. **Key-Value Pairs**: All form fields with their labels and values
"""
FORM_CHECKBOXES = "2. **Checkboxes/Radio Buttons**: All selection controls with their state (checked/unchecked)\n"
FORM_SIGNATURES = "3. **Signatures**: Detect any signature fields or handwritten signatures\n"
FORM_TAIL = """
Return as JSON:
```json
{
  "fields": [
    {
      "key": "field label",
      "value": "field value",
      "type": "text|date|number|dropdown",
      "required": true,
      "bbox": {"x1": 0, "y1": 0, "x2": 100, "y2": 50}
    }
  ],
  "checkboxes": [
    {
      "label": "checkbox label",
      "checked": true,
      "group": "group name if radio button",
      "bbox": {"x1": 0, "y1": 0, "x2": 20, "y2": 20}
    }
  ],
  "signatures": [
    {
      "type": "handwritten|digital|stamp",
      "name": "signer name if visible",
      "date": "date if present",
      "bbox": {"x1": 0, "y1": 0, "x2": 200, "y2": 100}
    }
  ]
}
```"""

INVOICE_HEAD = "Parse this "
INVOICE_TAIL = """ and extract all information.

Return as JSON with this structure:
```json
{
  "header": {
    "vendor_name": "Company Name",
    "vendor_address": "Full address",
    "vendor_phone": "Phone number",
    "vendor_email": "Email",
    "invoice_number": "INV-001",
    "date": "2024-01-15",
    "due_date": "2024-02-15",
    "customer_name": "Customer",
    "customer_address": "Address"
  },
  "line_items": [
    {
      "description": "Item description",
      "quantity": 1,
      "unit_price": 10.00,
      "amount": 10.00,
      "tax_rate": 0.1
    }
  ],
  "summary": {
    "subtotal": 10.00,
    "tax": 1.00,
    "discount": 0.00,
    "total": 11.00,
    "currency": "USD"
  },
  "payment": {
    "method": "Bank Transfer",
    "terms": "Net 30",
    "bank_details": "Account info if present"
  }
}
```

Extract all visible information. Use null for missing fields."""

CONTRACT_HEAD = """\
Analyze this contract document and extract:

1. **Parties**: All parties involved with their roles
2. **Dates**: Effective date, termination date, and other key dates
"""
CONTRACT_CLAUSES = "3. **Clauses**: Key clauses with their titles and summaries\n"
CONTRACT_OBLIGATIONS = "4. **Obligations**: What each party must do\n"
CONTRACT_TAIL = """\
5. **Key Terms**: Important terms like payment, duration, termination conditions

Return as JSON:
```json
{
  "parties": [
    {
      "name": "Party Name",
      "role": "Buyer/Seller/Service Provider/Client",
      "address": "Address if present",
      "representative": "Signing person"
    }
  ],
  "dates": {
    "effective_date": "2024-01-15",
    "termination_date": "2025-01-15",
    "signing_date": "2024-01-10"
  },
  "clauses": [
    {
      "number": "1",
      "title": "Clause Title",
      "summary": "Brief summary of clause content",
      "type": "standard|custom|boilerplate"
    }
  ],
  "obligations": [
    {
      "party": "Party name",
      "obligation": "What they must do",
      "deadline": "Date or condition",
      "consequence": "What happens if not fulfilled"
    }
  ],
  "key_terms": {
    "contract_value": "Total value",
    "payment_terms": "Payment schedule",
    "duration": "Contract duration",
    "termination_clause": "How to terminate",
    "governing_law": "Jurisdiction",
    "dispute_resolution": "Arbitration/Court"
  }
}
```"""

# --- end of fixed values ------------------------------------------------------


def schema_prompts(specs: DataFrame) -> DataFrame:
    """One prompt per schema (preset, prompt) from its specs; a schema is a handful of rows."""
    line = F.concat(
        F.lit("- "), F.coalesce("name", F.lit("unknown")), F.lit(" ("), F.coalesce("type", F.lit("string")),
        F.lit("): "), F.coalesce("description", F.lit("")),
    )
    lines = specs.select("preset", "pos", line.alias("_line")).groupBy("preset").agg(
        F.expr("listagg(_line, '\n') within group (order by pos)").alias("_lines"))
    return lines.select("preset", F.concat(F.lit(FIELDS_HEAD), "_lines", F.lit(FIELDS_TAIL)).alias("schema_prompt"))


def entity_prompt(types: Column) -> Column:
    """Prompt for the wanted entity types (an array column; null or empty means all)."""
    known = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f"- {k}: {v}").alias("line")) for k, v in dims.ENTITY_TYPES.items()])
    wanted = F.coalesce(types, F.array().cast("array<string>"))
    kept = F.filter(known, lambda e: (F.size(wanted) == 0) | F.array_contains(wanted, e["k"]))
    lines = F.array_join(F.transform(kept, lambda e: e["line"]), "\n")
    return F.concat(F.lit(ENTITIES_HEAD), lines, F.lit(ENTITIES_TAIL))


def _optional(flag: Column, text: str) -> Column:
    return F.when(F.coalesce(flag, F.lit(True)), F.lit(text)).otherwise(F.lit(""))


def build_prompts(docs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Adds ``user_prompt`` and the ``messages`` array to a document table.

    Columns read: task_type, image, custom_prompt, preset, entity_types (array), document_type,
    and the flags with_checkboxes, with_signatures, with_clauses, with_obligations (null = yes).
    ``prompts`` comes from :func:`schema_prompts`. A custom prompt wins; an unknown preset reads
    as ``invoice``.
    """
    preset = F.when(F.col("preset").isin(*dims.PRESETS), F.col("preset")).otherwise(F.lit("invoice"))
    known = prompts.select(F.col("preset").alias("_preset"), "schema_prompt")
    staged = docs.join(known, preset == F.col("_preset"), "left")
    task = F.col("task_type")
    kind = F.when(F.col("document_type") == "invoice", F.lit("invoice")).otherwise(F.lit("receipt"))
    default = (
        F.when(task == "ocr", F.lit(OCR))
        .when(task == "layout", F.lit(LAYOUT))
        .when(task == "table", F.lit(TABLE))
        .when(task == "field_extraction", F.col("schema_prompt"))
        .when(task == "ner", entity_prompt(F.col("entity_types")))
        .when(task == "form", F.concat(
            F.lit(FORM_HEAD), _optional(F.col("with_checkboxes"), FORM_CHECKBOXES),
            _optional(F.col("with_signatures"), FORM_SIGNATURES), F.lit(FORM_TAIL)))
        .when(task == "invoice", F.concat(F.lit(INVOICE_HEAD), kind, F.lit(INVOICE_TAIL)))
        .when(task == "contract", F.concat(
            F.lit(CONTRACT_HEAD), _optional(F.col("with_clauses"), CONTRACT_CLAUSES),
            _optional(F.col("with_obligations"), CONTRACT_OBLIGATIONS), F.lit(CONTRACT_TAIL)))
    )
    system = F.lit(None).cast("string")
    for name, text in SYSTEM.items():
        system = F.when(task == name, F.lit(text)).otherwise(system)
    part = lambda kind, image, text: F.struct(
        F.lit(kind).alias("type"), image.cast("string").alias("image"), text.cast("string").alias("text"))
    null = F.lit(None)
    asked = staged.withColumn("user_prompt", F.coalesce(F.nullif("custom_prompt", F.lit("")), default))
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.array(part("text", null, system)).alias("content")),
        F.struct(F.lit("user").alias("role"),
                 F.array(part("image", F.col("image"), null), part("text", null, F.col("user_prompt"))).alias("content")),
    )
    return asked.select(*docs.columns, "user_prompt", messages.alias("messages"))

