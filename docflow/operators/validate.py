"""Checks over extracted data: formats, dates, totals, required fields, dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..functions import formats
from ..functions import json_text as J
from ..functions.shared import let, unfold
from ..functions.text import squeeze
from . import shape


# --- one field ----------------------------------------------------------------


def check_format(df: DataFrame, kind: str, value="value", out="is_valid") -> DataFrame:
    """Adds the verdict of one format check (``email``, ``phone``, ``date``, ...)."""
    return df.withColumn(out, formats.CHECKS[kind](value))


def validate_field(df: DataFrame, value="value", kind="type") -> DataFrame:
    """Adds verdict and message by the type named in a column."""
    judged = df.withColumn("is_valid", formats.valid_field(value, kind))
    return judged.withColumn("error", F.when(~F.col("is_valid"), formats.error_text(value, kind)))


def validate_fields(fields: DataFrame, specs: DataFrame, keys=("doc_id",)) -> DataFrame:
    """One row per invalid field: its type and message.

    ``fields`` has (keys, field, value); ``specs`` (name, type), a few rows. Fields without a
    spec and empty values are not checked.
    """
    kinds = specs.select(F.col("name").alias("field"), F.coalesce("type", F.lit("string")).alias("type"))
    return (
        fields.where(F.length("value") > 0)
        .join(kinds, "field")
        .where(~formats.valid_field("value", "type"))
        .select(*keys, "field", "type", "value", formats.error_text("value", "type").alias("error"))
    )


def parse_date(df: DataFrame, value="value", out="parsed") -> DataFrame:
    return df.withColumn(out, formats.parse_date(value))


def to_number(df: DataFrame, value="value", out="number") -> DataFrame:
    return df.withColumn(out, formats.to_number(value, df.schema[value].dataType))


# --- dates across fields --------------------------------------------------------


def date_consistency(dates: DataFrame, rules: DataFrame, keys=("doc_id",)) -> DataFrame:
    """One row per broken rule: the earlier field's date lies after the later field's.

    ``dates`` is long (keys, field, value); ``rules`` is (rule_no, before, after). Each date is
    sent to its side of its rules and one aggregation brings the two sides together, so a
    document is never gathered as a whole.
    """
    keys = list(keys)
    side = lambda name: rules.select("rule_no", F.col(name).alias("field"), F.lit(name).alias("side"))
    wanted = side("before").unionByName(side("after"))
    seen = dates.join(wanted, "field").withColumn("_d", formats.parse_date("value"))
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    pairs = seen.groupBy(*keys, "rule_no").agg(
        pick("before", "_d").alias("before_date"), pick("after", "_d").alias("after_date"),
        pick("before", "field").alias("before_field"), pick("after", "field").alias("after_field"),
        pick("before", "value").alias("before_value"), pick("after", "value").alias("after_value"),
    )
    message = F.concat(
        "before_field", F.lit(" ("), "before_value", F.lit(") should be before "),
        "after_field", F.lit(" ("), "after_value", F.lit(")"),
    )
    return pairs.where(F.col("before_date") > F.col("after_date")).select(
        *keys, "rule_no", "before_field", "after_field", "before_date", "after_date", message.alias("error")
    )


# --- totals -------------------------------------------------------------------


def _money(c) -> Column:
    return F.format_string("%.2f", c.cast("double"))


def _line_values(lines: DataFrame, default_quantity) -> DataFrame:
    """Numbers of the lines; a line without a quantity has the default one, a null quantity is 0."""
    quantity = formats.number_column(lines, "quantity") if "quantity" in lines.columns else F.lit(float(default_quantity))
    if "has_quantity" in lines.columns:
        quantity = F.when(F.coalesce("has_quantity", F.lit(True)), quantity).otherwise(F.lit(default_quantity).cast(lines.select(quantity).schema[0].dataType))
    return lines.withColumn("_amount", formats.number_column(lines, "amount")).withColumn(
        "_qty", quantity).withColumn("_price", formats.number_column(lines, "unit_price"))


def _gap(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def _totals_line(lines: DataFrame, tolerance) -> DataFrame:
    v = _line_values(lines, 1)
    priced = (F.col("_qty") > 0) & (F.col("_price") > 0)
    expected = F.col("_qty") * F.col("_price")
    counted = F.when(F.col("_amount") > 0, F.col("_amount")).when(priced, expected).otherwise(F.lit(0))
    wrong = priced & (F.col("_amount") > 0) & (_gap(expected, F.col("_amount")) > tolerance)
    return v.select(*lines.columns, counted.alias("_counted"), expected.alias("expected"),
                    F.col("_amount").alias("reported"), wrong.alias("_wrong"))


def _reported(summary: DataFrame, keys) -> DataFrame:
    names = ("subtotal", "tax", "discount", "total")
    return summary.select(*keys, *[formats.number_column(summary, n).alias("r_" + n) for n in names])


def _merge(per_doc: DataFrame, summary: DataFrame, keys) -> DataFrame:
    reported = _reported(summary, keys)
    zero = {c: 0 for c in ("n_lines", "n_wrong", "calculated_subtotal", "r_subtotal", "r_tax", "r_discount", "r_total")}
    joined = per_doc.join(reported, list(keys), "full")
    return joined.select(*keys, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in zero.items() if c in joined.columns])


def check_totals(lines: DataFrame, summary: DataFrame, keys=("doc_id",), tolerance=0.01) -> DataFrame:
    """Totals of each document against its lines (currency text is understood).

    Lines are summed before the shuffle; the summary is joined to one row per document.
    """
    keys = list(keys)
    tol = F.lit(tolerance)
    checked = _totals_line(lines, tol)
    per_doc = checked.groupBy(*keys).agg(
        F.count("*").alias("n_lines"), F.sum("_counted").alias("calculated_subtotal"),
        F.sum(F.col("_wrong").cast("int")).alias("n_wrong"),
    )
    m = _merge(per_doc, summary, keys)
    base = F.when(F.col("r_subtotal") > 0, F.col("r_subtotal")).otherwise(F.col("calculated_subtotal"))
    expected = base + F.col("r_tax") - F.col("r_discount")
    subtotal_error = (
        (F.col("calculated_subtotal") > 0) & (F.col("r_subtotal") > 0)
        & (_gap(F.col("calculated_subtotal"), F.col("r_subtotal")) > tol)
    )
    total_error = (F.col("r_total") > 0) & (_gap(expected, F.col("r_total")) > tol)
    return m.select(
        *keys, "n_lines", F.col("n_wrong").alias("n_line_errors"), "calculated_subtotal",
        expected.alias("expected_total"), subtotal_error.alias("subtotal_error"), total_error.alias("total_error"),
        ((F.col("n_wrong") == 0) & ~subtotal_error & ~total_error).alias("is_valid"),
    )


def line_errors(lines: DataFrame, tolerance=0.01) -> DataFrame:
    """The lines of :func:`check_totals` whose quantity and price do not give the amount."""
    bad = _totals_line(lines, F.lit(tolerance)).where("_wrong")
    number = F.col("line_no").cast("string") if "line_no" in lines.columns else F.lit("?")
    return bad.withColumn("error", _line_message(number, F.col("expected"), F.col("reported"))).drop("_wrong", "_counted")


def _line_message(number, expected, amount) -> Column:
    return F.concat(F.lit("Line "), number, F.lit(": quantity * unit_price ("), _money(expected), F.lit(") != amount ("), _money(amount), F.lit(")"))


def audit_invoices(df: DataFrame, text="text", tolerance=0.01) -> DataFrame:
    """:func:`check_totals` of raw responses, each response by itself, with its error texts in order.

    Lines and summary come from one parsed object, and the lines are folded in place: nothing is shuffled.
    """
    tol, keys = F.lit(tolerance), [c for c in df.columns if c != text]
    number = lambda c: formats.to_number(c)
    value = lambda x, i: F.struct(
        (i + 1).cast("string").alias("no"), number(x["line"]["amount"]).alias("amount"), number(x["line"]["unit_price"]).alias("price"),
        F.when(x["has_quantity"], number(x["line"]["quantity"])).otherwise(F.lit(1.0)).alias("qty"))
    priced = lambda v: (v["qty"] > 0) & (v["price"] > 0)
    wrong = lambda v: priced(v) & (v["amount"] > 0) & (_gap(v["qty"] * v["price"], v["amount"]) > tol)
    counted = lambda v: F.when(v["amount"] > 0, v["amount"]).when(priced(v), v["qty"] * v["price"]).otherwise(F.lit(0.0))
    folded = lambda all_: F.struct(
        F.size(all_).cast("bigint").alias("n_lines"), F.aggregate(all_, F.lit(0.0), lambda a, v: a + counted(v)).alias("calculated_subtotal"),
        F.transform(F.filter(all_, wrong), lambda v: _line_message(v["no"], v["qty"] * v["price"], v["amount"])).alias("texts"))
    lines = F.coalesce(F.transform("lines", value), F.array().cast("array<struct<no:string,amount:double,price:double,qty:double>>"))
    said = F.struct(*[formats.to_number(F.col("summary")[n]).alias(n) for n in ("subtotal", "tax", "discount", "total")])
    read = shape.read_invoice(df, text).select(*keys, let(lines, folded).alias("f"), said.alias("s"))
    calc, sub = F.col("f.calculated_subtotal"), F.col("s.subtotal")
    base = F.when(sub > 0, sub).otherwise(calc)
    expected = base + F.col("s.tax") - F.col("s.discount")
    subtotal_error = (calc > 0) & (sub > 0) & (_gap(calc, sub) > tol)
    total_error = (F.col("s.total") > 0) & (_gap(expected, F.col("s.total")) > tol)
    subtotal_text = F.concat(F.lit("Subtotal mismatch: calculated "), _money(calc), F.lit(", reported "), _money(sub))
    total_text = F.concat(F.lit("Total mismatch: subtotal ("), _money(base), F.lit(") + tax ("), _money(F.col("s.tax")), F.lit(") - discount ("),
                          _money(F.col("s.discount")), F.lit(") = "), _money(expected), F.lit(", but total is "), _money(F.col("s.total")))
    errors = F.concat("f.texts", F.array_compact(F.array(F.when(subtotal_error, subtotal_text), F.when(total_error, total_text))))
    return read.select(
        *keys, "f.n_lines", F.size("f.texts").cast("bigint").alias("n_line_errors"), calc.alias("calculated_subtotal"), expected.alias("expected_total"),
        subtotal_error.alias("subtotal_error"), total_error.alias("total_error"), (F.size(errors) == 0).alias("is_valid"), errors.alias("errors"))


def check_invoice(lines: DataFrame, summary: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Invoice audit: subtotal against the lines, total always, line mismatches as warnings."""
    keys = list(keys)
    tol = F.lit(0.01)
    v = _line_values(lines, 0)
    warns = _gap(F.col("_qty") * F.col("_price"), F.col("_amount")) > tol
    per_doc = v.groupBy(*keys).agg(
        F.count("*").alias("n_lines"), F.sum("_amount").alias("calculated_subtotal"),
        F.sum(warns.cast("int")).alias("n_wrong"),
    )
    m = _merge(per_doc, summary, keys)
    expected = F.col("r_subtotal") + F.col("r_tax") - F.col("r_discount")
    subtotal_error = (F.col("n_lines") > 0) & (_gap(F.col("calculated_subtotal"), F.col("r_subtotal")) > tol)
    total_error = _gap(expected, F.col("r_total")) > tol
    return m.select(
        *keys, "n_lines", "calculated_subtotal", F.col("r_subtotal").alias("reported_subtotal"),
        expected.alias("expected_total"), F.col("r_total").alias("reported_total"),
        subtotal_error.alias("subtotal_error"), total_error.alias("total_error"),
        F.col("n_wrong").alias("n_warnings"), (~subtotal_error & ~total_error).alias("is_valid"),
    )


def invoice_messages(checked: DataFrame, keys=("doc_id",)) -> DataFrame:
    """The error texts behind :func:`check_invoice`, one row each."""
    subtotal = F.when(F.col("subtotal_error"), F.concat(
        F.lit("Subtotal mismatch: calculated "), _money(F.col("calculated_subtotal")),
        F.lit(", reported "), _money(F.col("reported_subtotal"))))
    total = F.when(F.col("total_error"), F.concat(
        F.lit("Total mismatch: expected "), _money(F.col("expected_total")),
        F.lit(", reported "), _money(F.col("reported_total"))))
    return unfold(checked, keys, F.array_compact(F.array(subtotal, total)), "_n", "error").drop("_n")


# --- records (nested JSON) ------------------------------------------------------


def _with_variant(df: DataFrame, data: str, name: str) -> DataFrame:
    return df.withColumn(name, J.read_json(data))


def _present(value: Column) -> Column:
    """Neither absent, null, an empty text nor an empty list."""
    return let(value, _is_present)


def _is_present(v: Column) -> Column:
    empty = (J.kind(v) == "STRING") & (J.as_text(v) == "")
    bare = J.kind(v).startswith("ARRAY") & (F.to_json(v) == "[]")
    return ~J.is_missing(v) & ~F.coalesce(empty | bare, F.lit(False))


def required_fields(df: DataFrame, required, data="data", out="missing") -> DataFrame:
    """Adds the list of required (dotted) fields that are missing or empty."""
    read = _with_variant(df, data, "_v")
    marks = [F.when(~_present(J.variant_at(F.col("_v"), f)), F.lit(f)) for f in required]
    return read.withColumn(out, F.array_compact(F.array(*marks))).drop("_v")


def field_dependencies(df: DataFrame, rules, data="data", keys=("doc_id",)) -> DataFrame:
    """One row per broken dependency; ``rules`` is a list of (if_field, [required fields]).

    A trigger counts when it is truthy; a required field fails when null or empty text.
    """
    read = _with_variant(df, data, "_v")

    def broken(trigger, field):
        blank = lambda v: J.is_missing(v) | F.coalesce(
            (J.kind(v) == "STRING") & (J.as_text(v) == ""), F.lit(False))
        empty = let(J.variant_at(F.col("_v"), field), blank)
        fires = J.variant_truthy(J.variant_at(F.col("_v"), trigger))
        return F.when(fires & empty, F.struct(F.lit(trigger).alias("if_field"), F.lit(field).alias("field")))

    found = [broken(t, f) for t, fields in rules for f in fields]
    rows = unfold(read, keys, F.array_compact(F.array(*found)), "_n", "_b")
    message = F.concat("_b.field", F.lit(" is required when "), "_b.if_field", F.lit(" is present"))
    return rows.select(*keys, "_b.if_field", "_b.field", message.alias("error"))


def cross_references(primary: DataFrame, secondary: DataFrame, pairs, key="doc_id", data="data") -> DataFrame:
    """One row per pair of fields that differ between two record tables (case and blanks aside).

    Only the compared fields travel through the join.
    """

    def fields(df, names, prefix):
        read = _with_variant(df, data, "_v")
        cols = []
        for i, name in enumerate(names):
            shown = lambda v: F.when(J.variant_truthy(v), J.show_value(v))
            cols.append(let(J.variant_at(F.col("_v"), name), shown).alias(f"{prefix}{i}"))
        return read.select(key, *cols)

    left = fields(primary, [p for p, _ in pairs], "p")
    right = fields(secondary, [s for _, s in pairs], "s")

    def mismatch(i, names):
        p, s = F.col(f"p{i}"), F.col(f"s{i}")
        return F.when(
            squeeze(p) != squeeze(s),
            F.struct(F.lit(names[0]).alias("primary_field"), F.lit(names[1]).alias("secondary_field"),
                     p.alias("primary_value"), s.alias("secondary_value")),
        )

    found = F.array_compact(F.array(*[mismatch(i, n) for i, n in enumerate(pairs)]))
    return unfold(left.join(right, key), [key], found, "_n", "_m").select(key, "_m.*")


# --- typed records --------------------------------------------------------------


def type_name(name: str) -> str:
    """snake_case to PascalCase."""
    return "".join(part.capitalize() for part in name.split("_"))


def record_schema(spec) -> T.StructType:
    """Spark type of a spec: [(name, type, required), ...]."""
    return T.StructType(
        [T.StructField(n, T.DataType.fromDDL(dims.COLUMN_TYPES.get(k.lower(), "string")), not req) for n, k, req in spec]
    )


# Words read as a truth value.
TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")


def _typed(v: Column, ddl: str) -> Column:
    """Value of the wanted type, null when the JSON value is of another kind."""
    k, text = J.kind(v), J.as_text(v)
    if ddl == "string":
        return F.when(k == "STRING", text)
    if ddl == "double":
        readable = J.is_number_kind(v) | (k == "BOOLEAN")
        return F.when(readable, F.try_variant_get(v, "$", "double")).when(
            k == "STRING", F.trim(text).try_cast("double"))
    if ddl == "bigint":
        whole = F.try_variant_get(v, "$", "double")
        return (
            F.when(k.isin("BIGINT", "BOOLEAN"), F.try_variant_get(v, "$", "bigint"))
            .when(J.is_number_kind(v) & (whole == F.floor(whole)), whole.try_cast("bigint"))
            .when((k == "STRING") & F.trim(text).rlike(r"^[+-]?\d+(\.0+)?$"), F.trim(text).try_cast("double").try_cast("bigint"))
        )
    if ddl == "boolean":
        word = F.when(k == "STRING", F.lower(text)).when(J.is_number_kind(v), F.try_variant_get(v, "$", "double").cast("bigint").cast("string"))
        return (
            F.when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
            .when(word.isin(*TRUE_WORDS), True)
            .when(word.isin(*FALSE_WORDS), False)
        )
    return F.when(k.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(v, "$", "array<string>"))


def apply_schema(df: DataFrame, spec, data="data") -> DataFrame:
    """Typed record columns plus ``violations`` (``name: missing`` or ``name: type``).

    ``spec`` is [(name, type, required), ...]. A required field must be there and fit; an
    optional one may be absent or null.
    """
    read = _with_variant(df, data, "_v")
    rest = [c for c in df.columns if c not in {name for name, _, _ in spec}]
    read = read.select(*rest, *[J.variant_at(F.col("_v"), name).alias("_" + name) for name, _, _ in spec])
    typed_as = lambda kind: lambda v: _typed(v, dims.COLUMN_TYPES.get(kind.lower(), "string"))
    read = read.select("*", *[let(F.col("_" + n), typed_as(kind)).alias(n) for n, kind, _ in spec])
    marks = []
    for name, _, required in spec:
        v, typed = F.col("_" + name), F.col(name)
        absent = F.when(v.isNull(), F.lit(f"{name}: missing")) if required else F.when(F.lit(False), F.lit(""))
        misfit = typed.isNull() & v.isNotNull() & (F.lit(bool(required)) | ~J.is_missing(v))
        marks.append(F.coalesce(absent, F.when(misfit, F.lit(f"{name}: type"))))
    names = [name for name, _, _ in spec]
    return read.select(*rest, *names, F.array_compact(F.array(*marks)).alias("violations"))
