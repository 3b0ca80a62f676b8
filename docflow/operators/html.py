"""Element-level work on page markup, in Arrow batches (one page at a time, nothing shuffled)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.boxes import ordered_box, unscaled
from ..functions.html_tree import Node, read_html
from ..functions.shared import unfold

# Styles, attributes and classes the cleaning acts on.
COLOUR_STYLE = re.compile(r"\bcolor:[^;]+;?")
DROPPED_ATTRIBUTES = ("data-bbox", "data-polygon")
FORMULA_CLASSES = ("formula.machine_printed", "formula.handwritten")
CAPTION_CLASS = "image caption"
EMPTIED_CLASSES = ("music sheet", "chemical formula", "chart")
PAGE = "```html\n<html><body>\n{}</body></html>\n```"


def _clean_node(node: Node):
    style = node.attrs.get("style")
    if style is not None:
        rest = COLOUR_STYLE.sub("", style)
        if rest.strip():
            node.attrs["style"] = rest.rstrip(";")
        else:
            del node.attrs["style"]
    for name in DROPPED_ATTRIBUTES:
        node.attrs.pop(name, None)
    if "class" not in node.attrs:
        return
    tokens = ["formula" if c in FORMULA_CLASSES else c for c in node.attrs["class"].split()]
    tokens = list(dict.fromkeys(tokens))
    joined = " ".join(tokens)
    if node.name == "div" and joined == CAPTION_CLASS:
        node.children.clear()
        tokens = ["image"]
    elif any(c == joined or c in tokens for c in EMPTIED_CLASSES):
        node.children.clear()
        node.attrs.pop("format", None)
    node.attrs["class"] = " ".join(tokens)


def clean_page(html: str | None, joiner: str = "") -> str | None:
    """Cleaned body of one page inside an html fence, null without a body."""
    if html is None:
        return None
    root = read_html(html)
    for node in root.walk():
        _clean_node(node)
    body = next((n for n in root.walk() if n.name == "body"), None)
    if body is None:
        return None
    parts = [p for n in body.children if isinstance(n, Node) for p in (n.markup(), "\n")]
    return PAGE.format(joiner.join(parts))


def clean_document_html(df: DataFrame, html="html", out="cleaned", joiner="") -> DataFrame:
    """Adds the cleaned body of each page."""

    @F.pandas_udf(T.StringType())
    def cleaned(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield batch.map(lambda p: clean_page(p, joiner))

    return df.withColumn(out, cleaned(F.col(html)))


_ELEMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("tag", "text", "raw")])


@F.pandas_udf(T.ArrayType(_ELEMENT))
def _boxed(pages: pd.Series) -> pd.Series:
    def found(page):
        if page is None or "data-bbox" not in page.lower():
            return []
        return [
            {"tag": n.name, "text": n.text(), "raw": n.attrs["data-bbox"]}
            for n in read_html(page).walk()
            if "data-bbox" in n.attrs and n.name != "ol"
        ]

    return pages.map(found)


def html_boxes(df: DataFrame, html="html", resized=("resized_w", "resized_h"), original=("width", "height")) -> DataFrame:
    """One row per element with a ``data-bbox``: tag, text and box in original pixels.

    ``resized`` and ``original`` name the columns with the size the model saw and the real one.
    """
    rest = [c for c in df.columns if c != html]
    read = df.select(*rest, _boxed(F.col(html)).alias("_all"))
    rows = unfold(read, rest, "_all", "element_no", "_e")
    four = F.split(F.trim(F.col("_e.raw")), r"\s+")
    at = [F.get(four, F.lit(i)).try_cast("bigint") for i in range(4)]
    w, h = [(F.col(a), F.col(b)) for a, b in zip(resized, original)]
    x1, x2 = unscaled(at[0], *w), unscaled(at[2], *w)
    y1, y2 = unscaled(at[1], *h), unscaled(at[3], *h)
    return rows.select(
        *rest, "element_no", F.col("_e.tag").alias("tag"), F.col("_e.text").alias("text"),
        ordered_box(x1, y1, x2, y2).alias("bbox"),
    )
