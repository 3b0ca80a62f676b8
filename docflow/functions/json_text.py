"""Finding and checking JSON inside free text, all in native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shared import let
from .text import as_col, strip

# Where a response may carry its JSON, in the order they are tried.
FENCED_JSON = r"(?s)```json(.*?)```"
FENCED_ANY = r"(?s)```(.*?)```"
BRACES = r"(?s)\{.*\}"
BRACKETS = r"(?s)\[.*\]"

FALSY = ("", "null", "false", "0", "0.0", '""')


def _wrap(c: Column) -> Column:
    # A value that ends early or carries extra text breaks this two-key object.
    return F.concat(F.lit('{"x":'), c, F.lit(',"__end":1}'))


def is_json(c) -> Column:
    """True when the whole text is exactly one JSON value."""
    pair = F.from_json(_wrap(as_col(c)), "MAP<STRING,STRING>", {"allowSingleQuotes": "false"})
    return F.coalesce(F.size(pair) == 2, F.lit(False))


def is_loose_json(c) -> Column:
    """Like :func:`is_json` but single quotes are legal."""
    return F.coalesce(F.size(F.json_object_keys(_wrap(as_col(c)))) == 2, F.lit(False))


def read_json(c) -> Column:
    """The value of a text that is exactly one JSON value, else null."""
    return let(as_col(c), lambda t: F.when(is_json(t), F.try_parse_json(t)))


def is_object(c) -> Column:
    return F.coalesce(F.startswith(F.ltrim(as_col(c)), F.lit("{")), F.lit(False))


def is_array(c) -> Column:
    return F.coalesce(F.startswith(F.ltrim(as_col(c)), F.lit("[")), F.lit(False))


def json_truthy(c) -> Column:
    """Truth of a JSON text: null, false, zero and empty values count as false."""
    col = F.btrim(as_col(c), F.lit(" \t\r\n"))
    empty = col.isin(*FALSY) | col.rlike(r"^(\{\s*\}|\[\s*\])$")
    return F.coalesce(~empty, F.lit(False))


def _cut(candidate: Column, greedy: str, opener: str) -> Column:
    def inner(text):
        part = F.regexp_extract(text, greedy, 0)
        return F.when(F.startswith(text, F.lit(opener)), text).otherwise(
            F.coalesce(F.nullif(part, F.lit("")), text))

    return let(strip(candidate), inner)


def _first(text: Column, greedy: str, opener: str, accept) -> Column:
    """First acceptable candidate over the three places, or null."""

    def among(pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return F.get(F.filter(F.transform(found, lambda m: _cut(m, greedy, opener)), accept), F.lit(0))

    fenced = F.contains(text, F.lit("```"))
    whole = let(F.regexp_extract(text, greedy, 0), lambda w: F.when(accept(w), w))
    return F.coalesce(F.when(fenced, F.coalesce(among(FENCED_JSON), among(FENCED_ANY))), whole)


def find_json(text) -> Column:
    """Text of the first JSON value of a response; null when there is none."""
    found = _first(as_col(text), BRACES, "{", is_json)
    return let(found, lambda j: F.when(j != "null", j))


def find_json_array(text) -> Column:
    """Text of the first JSON array of a response; null when there is none."""
    return _first(
        as_col(text), BRACKETS, "[", lambda c: F.startswith(c, F.lit("[")) & is_json(c)
    )


def object_items(json) -> Column:
    """Entries of an object as a map of typed values, the last one of a repeated key; null for
    other JSON."""

    def last_of_each(m):
        keys = F.map_keys(m)
        latest = lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(m)), e["key"])
        unique = F.size(F.array_distinct(keys)) == F.size(m)
        return F.when(unique, m).otherwise(F.map_from_entries(F.filter(F.map_entries(m), latest)))

    read = lambda t: let(F.from_json(t, "MAP<STRING,VARIANT>"), last_of_each)
    return let(as_col(json), lambda t: F.when(is_object(t), read(t)))


def list_items(json) -> Column:
    """Elements of an array as JSON texts; an empty array for other JSON."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(is_array(json), F.from_json(as_col(json), "ARRAY<STRING>")), none)


# --- typed values (VARIANT) ------------------------------------------------


def variant_at(v: Column, path: str) -> Column:
    """Value below a dotted path of object keys, null when a step is missing."""
    steps = "".join("['" + p.replace("'", "\\'") + "']" for p in path.split("."))
    return F.try_variant_get(v, "$" + steps, "variant")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_missing(v: Column) -> Column:
    """Absent, or JSON null."""
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))


def is_number_kind(v: Column) -> Column:
    return kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def show_value(v: Column) -> Column:
    """A value as plain text: ``True``/``False``/``None`` for the JSON words, fractions as
    doubles, objects and arrays as JSON text."""
    k = kind(v)
    return (
        F.when(is_missing(v), F.lit("None"))
        .when(k == "BOOLEAN", F.initcap(as_text(v)))
        .when(k.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double").cast("string"))
        .when(k.rlike("^(ARRAY|OBJECT)"), F.to_json(v))
        .otherwise(as_text(v))
    )


def variant_truthy(v: Column) -> Column:
    k = kind(v)
    return ~is_missing(v) & F.coalesce(
        F.when(k == "STRING", as_text(v) != "")
        .when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(is_number_kind(v), F.try_variant_get(v, "$", "double") != 0)
        .when(k.rlike("^(ARRAY|OBJECT)"), ~F.to_json(v).isin("[]", "{}"))
        .otherwise(F.lit(True)),
        F.lit(False),
    )


def variant_int(v: Column) -> Column:
    """Whole-number reading: fractions are truncated, digit strings are accepted, else null."""
    k = kind(v)
    return (
        F.when(k == "STRING", F.when(
            as_text(v).rlike(r"^\s*[+-]?\d+\s*$"), F.trim(as_text(v)).try_cast("bigint")))
        .when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint"))
        .when(k == "BIGINT", F.try_variant_get(v, "$", "bigint"))
        .when(is_number_kind(v), F.try_variant_get(v, "$", "double").try_cast("bigint"))
    )
