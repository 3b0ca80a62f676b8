"""Fixed dimension tables: schemas, entity types, quotas, roles, actions, colours.

Everything in this file is a fixed value the results depend on.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- task and event names ---------------------------------------------------

TASKS = ("ocr", "layout", "table", "field_extraction", "ner", "form", "invoice", "contract")
JOB_STATES = ("pending", "processing", "completed", "failed", "cancelled")

# --- extraction schemas: (preset, [(field, type, description)]) --------------

PRESETS = {
    "invoice": [
        ("invoice_number", "string", "Invoice number or ID"),
        ("date", "date", "Invoice date"),
        ("due_date", "date", "Payment due date"),
        ("vendor_name", "string", "Vendor/seller name"),
        ("vendor_address", "string", "Vendor address"),
        ("customer_name", "string", "Customer/buyer name"),
        ("subtotal", "currency", "Subtotal amount"),
        ("tax", "currency", "Tax amount"),
        ("total", "currency", "Total amount"),
    ],
    "receipt": [
        ("store_name", "string", "Store/merchant name"),
        ("date", "date", "Transaction date"),
        ("items", "array", "List of purchased items"),
        ("subtotal", "currency", "Subtotal"),
        ("tax", "currency", "Tax amount"),
        ("total", "currency", "Total amount"),
        ("payment_method", "string", "Payment method used"),
    ],
    "id_card": [
        ("full_name", "string", "Full name"),
        ("date_of_birth", "date", "Date of birth"),
        ("id_number", "string", "ID/document number"),
        ("expiry_date", "date", "Expiration date"),
        ("address", "string", "Address"),
        ("nationality", "string", "Nationality/country"),
    ],
    "business_card": [
        ("name", "string", "Person's name"),
        ("title", "string", "Job title"),
        ("company", "string", "Company name"),
        ("email", "email", "Email address"),
        ("phone", "phone", "Phone number"),
        ("address", "string", "Address"),
        ("website", "url", "Website URL"),
    ],
}

# (template, [(field, type, required, description, validator)])
TEMPLATES = {
    "invoice": [
        ("invoice_number", "text", True, "Invoice ID", None),
        ("date", "date", True, "Invoice date", None),
        ("vendor_name", "text", True, "Vendor/company name", None),
        ("total", "currency", True, "Total amount", None),
        ("tax", "currency", False, "Tax amount", None),
    ],
    "receipt": [
        ("store_name", "text", True, None, None),
        ("date", "date", True, None, None),
        ("total", "currency", True, None, None),
        ("payment_method", "text", False, None, None),
    ],
    "business_card": [
        ("name", "text", True, None, None),
        ("title", "text", False, None, None),
        ("company", "text", False, None, None),
        ("email", "email", False, None, "email"),
        ("phone", "phone", False, None, "phone"),
    ],
}

# field type -> column type; any other type reads as STRING
COLUMN_TYPES = {
    "text": "string", "string": "string", "number": "double", "integer": "bigint",
    "date": "string", "email": "string", "phone": "string", "currency": "string",
    "url": "string", "boolean": "boolean", "list": "array<string>", "array": "array<string>",
}

ENTITY_TYPES = {
    "PERSON": "Names of people",
    "ORGANIZATION": "Companies, institutions, organizations",
    "LOCATION": "Places, addresses, geographic locations",
    "DATE": "Dates and times",
    "MONEY": "Monetary values and currencies",
    "EMAIL": "Email addresses",
    "PHONE": "Phone numbers",
    "URL": "Website URLs",
    "PRODUCT": "Product names",
    "EVENT": "Events",
}

DATE_RULES = (
    ("start_date", "end_date"),
    ("effective_date", "termination_date"),
    ("invoice_date", "due_date"),
    ("order_date", "delivery_date"),
)

# --- tenants ----------------------------------------------------------------

_FULL = ["ocr", "layout", "table", "ner", "form", "invoice", "contract", "field_extraction"]
# tier -> requests per day, documents per batch, storage MB, concurrent jobs, tasks, days kept
TIER_QUOTAS = {
    "free": (100, 5, 100, 1, ["ocr", "layout"], 1),
    "starter": (1000, 20, 1000, 2, ["ocr", "layout", "table", "ner"], 7),
    "professional": (10000, 100, 10000, 5, _FULL, 30),
    "enterprise": (100000, 1000, 100000, 20, _FULL, 365),
}
DEFAULT_QUOTA = (100, 10, 100, 1, ["ocr", "layout"], 7)
QUOTA_COLUMNS = (
    "max_requests_per_day", "max_documents_per_batch", "max_storage_mb",
    "max_concurrent_jobs", "allowed_tasks", "retention_days",
)

# --- access -----------------------------------------------------------------

PERMISSIONS = (
    "document:read", "document:write", "document:delete", "document:export",
    "batch:create", "batch:read", "batch:cancel",
    "user:manage", "tenant:manage", "config:manage", "audit:read",
)
ROLES = {
    "admin": list(PERMISSIONS),
    "manager": [
        "document:read", "document:write", "document:delete", "document:export",
        "batch:create", "batch:read", "batch:cancel", "user:manage", "audit:read",
    ],
    "user": ["document:read", "document:write", "document:export", "batch:create", "batch:read"],
    "readonly": ["document:read", "batch:read"],
}

# --- metrics ----------------------------------------------------------------

DEFAULT_METRICS = (
    ("requests_total", "counter"), ("errors_total", "counter"),
    ("model_loaded", "gauge"), ("active_jobs", "gauge"),
    ("gpu_utilization_percent", "gauge"), ("gpu_memory_used_mb", "gauge"),
)

# --- drawing, chat, uploads ---------------------------------------------------

COLOURS = (
    "#FF0000", "#00FF00", "#0000FF", "#FFFF00", "#FF00FF", "#00FFFF",
    "#FFA500", "#800080", "#008000", "#000080", "#808000", "#800000",
    "#008080", "#FFC0CB", "#FFD700", "#ADFF2F", "#7FFFD4", "#D2691E",
    "#DC143C", "#00CED1", "#9400D3", "#FF1493", "#1E90FF",
)
FIELD_COLOUR, CHECKBOX_COLOUR, SIGNATURE_COLOUR = "#00FF00", "#0000FF", "#FF00FF"

CHAT_MODES = {
    "General Assistant": "You are a helpful assistant that can analyze images and answer questions.",
    "Image Analyzer": "You are an expert image analyst. Provide detailed descriptions and analysis of images.",
    "OCR Reader": "You are an OCR specialist. Extract and transcribe all text from images accurately.",
    "Medical Assistant": "You are a medical AI assistant. Analyze medical images and provide insights (for educational purposes only).",
    "Educational Tutor": "You are an educational tutor. Help explain concepts shown in images and answer related questions.",
}
DEFAULT_MODE = "General Assistant"
DEFAULT_QUESTION = "Describe this image."

IMAGE_PATTERNS = ("*.png", "*.jpg", "*.jpeg", "*.tiff")
BATCH_PATTERNS = ("*.png", "*.jpg", "*.jpeg", "*.pdf", "*.tiff")
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tiff", ".tif")
VIDEO_EXTENSIONS = (".mp4",)
MAX_IMAGE_BYTES = 20 * 1024 * 1024
MAX_VIDEO_BYTES = 100 * 1024 * 1024


# --- as DataFrames (a few dozen rows each; Spark sees their size) ---------------


_ARROW = {
    "string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(),
    "array<string>": pa.list_(pa.string()),
}


def _frame(spark: SparkSession, rows, schema) -> DataFrame:
    """A table of known size: from Arrow, Spark makes a local relation and sees how small it is."""
    rows = list(rows)
    kind = T._parse_datatype_string(schema)
    columns = zip(*rows) if rows else [()] * len(kind)
    arrays = [pa.array(list(c), _ARROW[f.dataType.simpleString()]) for c, f in zip(columns, kind)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=kind.names), kind)


def preset_specs(spark) -> DataFrame:
    rows = [
        (preset, i, name, kind, None, text, None)
        for preset, fields in PRESETS.items()
        for i, (name, kind, text) in enumerate(fields)
    ]
    return _frame(spark, rows, SPEC_SCHEMA)


def template_specs(spark) -> DataFrame:
    rows = [
        (template, i, *field[:3], field[3], field[4])
        for template, fields in TEMPLATES.items()
        for i, field in enumerate(fields)
    ]
    return _frame(spark, rows, SPEC_SCHEMA)


SPEC_SCHEMA = (
    "preset string, pos int, name string, type string, required boolean, "
    "description string, validator string"
)


def entity_types(spark) -> DataFrame:
    return _frame(spark, ENTITY_TYPES.items(), "type string, description string")


def date_rules(spark, rules=DATE_RULES) -> DataFrame:
    rows = [(i, before, after) for i, (before, after) in enumerate(rules)]
    return _frame(spark, rows, "rule_no int, before string, after string")


def tier_quotas(spark) -> DataFrame:
    return _frame(
        spark,
        [(tier, *quota) for tier, quota in TIER_QUOTAS.items()],
        "tier string, max_requests_per_day bigint, max_documents_per_batch bigint, "
        "max_storage_mb bigint, max_concurrent_jobs bigint, allowed_tasks array<string>, "
        "retention_days bigint",
    )


def role_permissions(spark) -> DataFrame:
    return _frame(
        spark,
        [(role, p) for role, granted in ROLES.items() for p in granted],
        "role string, permission string",
    )


def default_metrics(spark) -> DataFrame:
    return _frame(spark, DEFAULT_METRICS, "key string, kind string")


def chat_modes(spark) -> DataFrame:
    return _frame(spark, CHAT_MODES.items(), "usage_mode string, mode_prompt string")
