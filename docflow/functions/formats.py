"""Field formats: checks and conversions for one text column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import let
from .text import BLANK_CLASS, BLANKS, NON_WS, WS, as_col, strip

# Patterns and symbols a field has to obey.
EMAIL = r"(?d)^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"(?d)^\+?\p{Nd}{7,15}$"
PHONE_NOISE = rf"[{BLANK_CLASS}\-\.\(\)]"
URL = rf"(?di)^https?://[^{BLANK_CLASS}/$.?#].{NON_WS}*$"
MONEY_NOISE = "$€£¥₹,"

_DIGITS = r"[0-9](?:_?[0-9])*"
FLOAT = (
    rf"(?i)^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    r"|nan|inf|infinity)$"
)
INTEGER = rf"^[+-]?{_DIGITS}$"

_DAY = r"(3[01]|[12][0-9]|0?[1-9]| [1-9])"
_MONTH = r"(1[0-2]|0?[1-9])"
_YEAR = r"([0-9]{4})"
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
)
_LONG = "(" + "|".join(MONTHS) + ")"
_SHORT = "(" + "|".join(m[:3] for m in MONTHS) + ")"
_SP = WS + "+"

# Order matters: the first form that reads the text wins, so day comes before month.
# name -> (pattern, the same date as year, month, day by group, format of that)
DATE_FORMS = {
    "Y-m-d": (rf"^{_YEAR}-{_MONTH}-{_DAY}$", "$1-$2-$3", "y-M-d"),
    "d/m/Y": (rf"^{_DAY}/{_MONTH}/{_YEAR}$", "$3-$2-$1", "y-M-d"),
    "m/d/Y": (rf"^{_MONTH}/{_DAY}/{_YEAR}$", "$3-$1-$2", "y-M-d"),
    "d-m-Y": (rf"^{_DAY}-{_MONTH}-{_YEAR}$", "$3-$2-$1", "y-M-d"),
    "B d, Y": (rf"(?i)^{_LONG}{_SP}{_DAY},{_SP}{_YEAR}$", "$3-$1-$2", "y-MMMM-d"),
    "b d, Y": (rf"(?i)^{_SHORT}{_SP}{_DAY},{_SP}{_YEAR}$", "$3-$1-$2", "y-MMM-d"),
    "d B Y": (rf"(?i)^{_DAY}{_SP}{_LONG}{_SP}{_YEAR}$", "$3-$2-$1", "y-MMMM-d"),
}
EXTRA_DATE_FORM = {"d b Y": (rf"(?i)^{_DAY}{_SP}{_SHORT}{_SP}{_YEAR}$", "$3-$2-$1", "y-MMM-d")}


def _read(text: Column, form) -> Column:
    pattern, order, fmt = form
    plain = F.translate(F.regexp_replace(text, pattern, order), " ", "")
    if fmt == "y-M-d":
        date = plain.try_cast("date")
    else:
        date = F.try_to_timestamp(plain, F.lit(fmt)).cast("date")
    return F.when(text.rlike(pattern) & ~F.endswith(text, F.lit("0000")) & ~F.startswith(text, F.lit("0000")), date)


def parse_date(c, extra=False) -> Column:
    """Date of a text in one of the known forms, null otherwise (also for 30 February)."""
    forms = {**DATE_FORMS, **(EXTRA_DATE_FORM if extra else {})}

    def read(text):
        # The slash, dash and name forms exclude each other on sight of the text.
        first = lambda *names: F.coalesce(*[_read(text, forms[n]) for n in names])
        named = first(*[n for n in forms if "b" in n.lower()])
        return (
            F.when(F.contains(text, F.lit("/")), first("d/m/Y", "m/d/Y"))
            .when(F.contains(text, F.lit("-")), first("Y-m-d", "d-m-Y"))
            .otherwise(named)
        )

    return let(strip(c), read)


def _float(text: Column) -> Column:
    return let(text, lambda t: F.when(t.rlike(FLOAT), F.translate(t, "_", "").try_cast("double")))


def _drop(c, chars) -> Column:
    return F.translate(as_col(c), chars, "")


def valid_email(c) -> Column:
    return as_col(c).rlike(EMAIL)


def valid_phone(c) -> Column:
    return F.regexp_replace(as_col(c), PHONE_NOISE, "").rlike(PHONE)


def valid_date(c) -> Column:
    return parse_date(c, extra=True).isNotNull()


def valid_currency(c) -> Column:
    return _float(_drop(c, MONEY_NOISE + BLANKS)).isNotNull()


def valid_url(c) -> Column:
    return as_col(c).rlike(URL)


def percentage(c) -> Column:
    return _float(strip(F.rtrim(strip(c), F.lit("%"))))


def valid_percentage(c) -> Column:
    return F.coalesce(percentage(c).between(0.0, 100.0), F.lit(False))


def valid_integer(c) -> Column:
    return _drop(c, "," + BLANKS).rlike(INTEGER)


CHECKS = {
    "email": valid_email,
    "phone": valid_phone,
    "date": valid_date,
    "currency": valid_currency,
    "url": valid_url,
    "percentage": valid_percentage,
    "integer": valid_integer,
}


def valid_field(value, field_type) -> Column:
    """Check by the type named in another column; unknown types are always valid."""
    kind = as_col(field_type)
    return reduce(
        lambda case, name: case.when(kind == name, CHECKS[name](value)),
        CHECKS,
        F.when(F.lit(False), F.lit(True)),
    ).otherwise(F.lit(True))


def error_text(value, field_type) -> Column:
    """Message for a value known to be invalid."""
    kind, text = as_col(field_type), as_col(value)
    off_range = (kind == "percentage") & percentage(text).isNotNull()
    name = F.when(kind == "url", F.lit("URL")).otherwise(kind)
    label = F.when(off_range, F.lit("Percentage out of range: ")).otherwise(
        F.concat(F.lit("Invalid "), name, F.lit(" format: ")))
    return F.concat(label, text)


def to_number(c, dtype=None) -> Column:
    """Amount of a value: null and unreadable text are 0, currency marks are ignored.

    Numeric columns keep their type (so decimals stay exact); text becomes DOUBLE.
    """
    col = as_col(c)
    if isinstance(dtype, T.NumericType):
        return F.coalesce(col, F.lit(0).cast(dtype))
    return F.coalesce(_float(_drop(col, MONEY_NOISE + BLANKS)), F.lit(0.0))


def number_column(df, name, missing=0) -> Column:
    """``to_number`` of a column by its type; a missing column or null reads as ``missing``."""
    if name not in df.columns:
        return F.lit(float(missing))
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.NumericType):
        return F.coalesce(F.col(name), F.lit(missing).cast(dtype))
    return F.when(F.col(name).isNull(), F.lit(float(missing))).otherwise(to_number(name, dtype))
