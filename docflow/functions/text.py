"""String helpers: blanks, quoting and truth in the sense of the response format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blank in Unicode text.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 "
    "           "
    "    　"
)
BLANK_CLASS = r"\s\x1C-\x1F\x85\xA0  -     　"
WS = f"[{BLANK_CLASS}]"
NON_WS = f"[^{BLANK_CLASS}]"


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.btrim(as_col(c), F.lit(BLANKS))


def strip_quotes(c) -> Column:
    return F.btrim(strip(c), F.lit('"'))


def squeeze(c) -> Column:
    """Lower case, trimmed, runs of blanks as one space."""
    return F.regexp_replace(strip(F.lower(as_col(c))), WS + "+", " ")


def not_blank(c) -> Column:
    """True when the text holds anything besides blanks; null counts as blank."""
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def word_count(c) -> Column:
    text = strip(c)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(
        F.size(F.split(text, WS + "+"))
    )


def shorten(c, n, mark="...") -> Column:
    """Texts longer than ``n`` keep their first ``n`` characters plus ``mark``."""
    col = as_col(c)
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit(mark))).otherwise(col)
