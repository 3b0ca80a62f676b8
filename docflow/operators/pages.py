"""Pages to documents.

A document may have any number of pages, so merged texts come in parts of the page range that the
caller gives: (document, part_no, text). The parts of a document, joined by a blank line in order, are
the merged text. Parts follow from the page number alone, so no task ever holds more than one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_text as J
from ..functions.ranking import bucketed_running_sum

JOIN = "\n\n"


def _part(pages_per_part: int) -> Column:
    return F.floor((F.col("page_no") - 1) / pages_per_part).cast("int").alias("part_no")


def _merge(pages: DataFrame, piece: Column, doc: str, pages_per_part: int, strategy: str) -> DataFrame:
    ordered = F.expr(f"listagg(_piece, '{JOIN}') within group (order by page_no)")
    return (
        pages.select(doc, "page_no", _part(pages_per_part), piece.alias("_piece"))
        .groupBy(doc, "part_no")
        .agg(ordered.alias("text"), F.count("*").alias("pages_in_part"))
        .withColumn("merge_strategy", F.lit(strategy))
    )


def merge_concatenate(pages: DataFrame, pages_per_part: int, doc="doc_id") -> DataFrame:
    """Text of all pages, each below a page marker."""
    marked = F.concat(F.lit("--- Page "), F.col("page_no").cast("string"), F.lit(" ---" + JOIN),
                      F.coalesce("text", F.lit("")))
    return _merge(pages, marked, doc, pages_per_part, "concatenate")


def merge_plain(pages: DataFrame, pages_per_part: int, doc="doc_id", strategy="plain") -> DataFrame:
    """Text of all pages without markers and without data."""
    return _merge(pages, F.coalesce("text", F.lit("")), doc, pages_per_part, strategy)


def page_data(pages: DataFrame, doc="doc_id", data="data") -> DataFrame:
    """The data of the pages that have any: (document, page, data)."""
    return pages.where(F.coalesce(F.size(data) > 0, F.lit(False))).select(doc, F.col("page_no").alias("page"), data)


def merge_structured(pages: DataFrame, doc="doc_id", data="data") -> DataFrame:
    """Combined data per document and key, one row per value.

    ``data`` maps keys to JSON texts. Lists are extended, other values appended; the list of a
    key is its rows ordered by (page_no, pos). Nothing is gathered, so no shuffle either; the
    merged text is :func:`merge_plain`.
    """
    entries = pages.select(doc, "page_no", F.explode(data).alias("key", "_v"))
    values = F.when(J.is_array("_v"), J.list_items("_v")).otherwise(F.array("_v"))
    return entries.select(doc, "key", "page_no", F.posexplode(values).alias("pos", "value"))


def merged_lists(rows: DataFrame, pages_per_part: int, doc="doc_id") -> DataFrame:
    """:func:`merge_structured` as arrays, in parts of bounded page range."""
    item = F.struct("page_no", "pos", "value")
    return rows.groupBy(doc, "key", _part(pages_per_part)).agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["value"]).alias("values")
    )


def page_totals(pages: DataFrame, doc="doc_id", strategy="concatenate") -> DataFrame:
    return pages.groupBy(doc).agg(F.count("*").alias("total_pages")).withColumn("merge_strategy", F.lit(strategy))


def document_groups(pages: DataFrame, stack="doc_id", starts: Column | None = None, pages_per_task=1000) -> DataFrame:
    """Number of the document each page of a stack belongs to, from 1.

    ``starts`` marks first pages; without it every page is a document of its own. ``pages_per_task``
    spreads a long stack over tasks and does not change the result.
    """
    flag = F.lit(1) if starts is None else F.coalesce(starts, F.lit(False)).cast("int")
    bucket = F.floor((F.col("page_no") - 1) / pages_per_task)
    return bucketed_running_sum(pages, [stack], bucket, ["page_no"], flag, "group_no")
