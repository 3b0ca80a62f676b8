"""XML in text as column expressions: one element with its attributes and its first text.

A text is cut into whole tokens (tags, comments, character data) by one pattern; a fold over the tokens keeps the
open elements. Repetitions are possessive, so that a long text needs no deep stack. Document types and names with a
prefix are not read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shared import let
from .text import as_col, strip

# The grammar of tokens, the named references.
_S = r"[ \t\n]"
_NAME = r"[\p{L}_][\p{L}\p{M}\p{N}_.\-\xB7]*+"
_REF = r"&(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});"
_VALUE = rf"(?:\"(?:[^<&\"]++|{_REF})*+\"|'(?:[^<&']++|{_REF})*+')"
_START = rf"<{_NAME}(?:{_S}++{_NAME}{_S}*+={_S}*+{_VALUE})*+{_S}*+/?>"
_END = rf"</{_NAME}{_S}*+>"
_COMMENT = r"<!--(?:(?!--)[\s\S])*+-->"
_SECTION = r"<!\[CDATA\[[\s\S]*?\]\]>"
_NOTE = rf"<\?(?![xX][mM][lL](?:{_S}|\?)){_NAME}(?:{_S}[\s\S]*?)?\?>"
_CHARACTERS = rf"(?:[^<&]++|{_REF})++"
TOKEN = "|".join((_START, _END, _COMMENT, _SECTION, _NOTE, _CHARACTERS))
ATTRIBUTE = rf"{_S}({_NAME}){_S}*+={_S}*+(\"[^\"]*+\"|'[^']*+')"
DECLARATION = (rf"^<\?xml{_S}+version{_S}*={_S}*(\"1\.[0-9]+\"|'1\.[0-9]+')({_S}+encoding{_S}*={_S}*(\"[A-Za-z][\w.\-]*\"|'[A-Za-z][\w.\-]*'))?"
               rf"({_S}+standalone{_S}*={_S}*(\"(yes|no)\"|'(yes|no)'))?{_S}*\?>")
FORBIDDEN = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"
NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}


def _code(ref: Column) -> Column:
    """The number of a numeric reference."""
    hexadecimal = F.startswith(ref, F.lit("&#x"))
    return F.when(hexadecimal, F.conv(F.regexp_extract(ref, "^&#x([^;]*);", 1), 16, 10)).otherwise(
        F.regexp_extract(ref, "^&#([0-9]*);", 1)).try_cast("int")


def _no_character(ref: Column) -> Column:
    return let(_code(ref), lambda n: ~(n.isin(9, 10, 13) | n.between(0x20, 0xD7FF) | n.between(0xE000, 0xFFFD) | n.between(0x10000, 0x10FFFF)))


def unescape(text: Column) -> Column:
    """References replaced by their characters; the text holds no other ampersand."""

    def shown(part):
        out = F.when(F.startswith(part, F.lit("&#")), F.decode(F.unhex(F.lpad(F.hex(_code(part)), 8, "0")), "UTF-32"))
        for name, character in NAMED.items():
            out = out.when(part == name, F.lit(character))
        return out.otherwise(part)

    parts = F.regexp_extract_all(text, F.lit("&[^;]*;|[^&]+"), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, shown), "")).otherwise(text)


def _kind(token: Column) -> Column:
    starts = lambda mark: F.startswith(token, F.lit(mark))
    return (F.when(starts("</"), "end").when(starts("<!["), "section").when(starts("<!") | starts("<?"), "note")
            .when(starts("<"), F.when(F.endswith(token, F.lit("/>")), "empty").otherwise("start")).otherwise("text"))


def _names(tag: Column) -> Column:
    return F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1))


def _step(acc: Column, token: Column) -> Column:
    """The open elements, the places of the root's tag and of the tag that ends its first text, and whether all fits."""

    def judged(kind):
        depth, name = F.size(acc["open"]), F.regexp_extract(token, rf"^</?({_NAME})", 1)
        tag, opens = kind.isin("start", "empty"), (acc["root"] == 0) & kind.isin("start", "empty")
        numbered = F.when(tag | (kind == "text"), F.regexp_extract_all(token, F.lit("&#[^;]*;"), F.lit(0))).otherwise(F.array().cast("array<string>"))
        wrong = (
            F.when(tag, ((acc["root"] > 0) & (depth == 0)) | let(_names(token), lambda n: F.size(F.array_distinct(n)) < F.size(n)))
            .when(kind == "end", ~F.coalesce(F.get(acc["open"], depth - 1) == name, F.lit(False)))
            .when(kind == "text", ((depth == 0) & ~token.rlike(rf"^{_S}*+$")) | F.contains(token, F.lit("]]>")))
            .when(kind == "section", depth == 0).otherwise(False))
        open_ = (F.when(kind == "start", F.concat(acc["open"], F.array(name)))
                 .when((kind == "end") & (depth > 0), F.slice(acc["open"], F.lit(1), depth - 1)).otherwise(acc["open"]))
        ends = (acc["cut"] == 0) & (F.when(opens, kind == "empty").otherwise((acc["root"] > 0) & (tag | (kind == "end"))))
        return F.struct(
            open_.alias("open"), (acc["at"] + 1).alias("at"), F.when(opens, acc["at"]).otherwise(acc["root"]).alias("root"),
            F.when(ends, acc["at"]).otherwise(acc["cut"]).alias("cut"),
            (acc["fits"] & ~wrong & ~F.exists(numbered, _no_character)).alias("fits"))

    return let(_kind(token), judged)


def read_element(text, build) -> Column:
    """``build(names, values, first)`` of a text that is one well-formed XML element, null for any other text.

    ``names`` and ``values`` are its attributes in order, without ``xmlns``; ``first`` is its character data up to the
    first tag inside it, trimmed, and null where there is none. Comments and notes are passed over.
    """
    source = as_col(text)
    even = F.when(F.contains(source, F.lit("\r")), F.regexp_replace(source, r"\r\n?", "\n")).otherwise(source)
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(1).alias("at"), F.lit(0).alias("root"), F.lit(0).alias("cut"), F.lit(True).alias("fits"))

    def shown(token):
        section = F.regexp_extract(token, r"^<!\[CDATA\[([\s\S]*)\]\]>$", 1)
        return F.when(_kind(token) == "text", unescape(token)).when(_kind(token) == "section", section).otherwise("")

    def read(tokens, state):
        tag = F.get(tokens, state["root"] - 1)
        quoted = F.arrays_zip(_names(tag).alias("n"), F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2)).alias("v"))
        value = lambda a: unescape(F.translate(F.substring(a["v"], F.lit(2), F.length(a["v"]) - 2), "\t\n", "  "))
        kept = F.filter(quoted, lambda a: a["n"] != "xmlns")
        first = F.array_join(F.transform(F.slice(tokens, state["root"] + 1, F.greatest(state["cut"] - state["root"] - 1, F.lit(0))), shown), "")
        return let(kept, lambda a: let(a["n"], lambda names: let(F.transform(a, value), lambda values: let(
            first, lambda f: build(names, values, F.when(f != "", strip(f)))))))

    def judged(whole):
        def folded(tokens):
            covered = F.aggregate(tokens, F.lit(0), lambda n, t: n + F.length(t)) == F.length(whole)
            fits = lambda s: s["fits"] & (s["root"] > 0) & (F.size(s["open"]) == 0)
            return F.when(covered & ~whole.rlike(FORBIDDEN), let(F.aggregate(tokens, start, _step), lambda s: F.when(fits(s), read(tokens, s))))

        return let(F.regexp_extract_all(whole, F.lit(TOKEN), F.lit(0)), folded)

    bare = lambda t: F.when(F.startswith(t, F.lit("<?xml")), F.regexp_replace(t, DECLARATION, "")).otherwise(t)
    return let(even, lambda t: let(bare(t), judged))
