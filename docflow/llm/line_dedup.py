"""Boilerplate lines by their frequency within a site, with DataFrame functions only.

A line's share is the number of the host's pages that hold it, divided by the host's pages. Lines over
the ratio go from every page of that host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged

RATIO, MIN_PAGES = 0.1, 3
#: A list of boilerplate lines up to this size is sent to all tasks; a larger one is joined by salted host.
BROADCAST_BYTES, SALTS = 8 << 20, 64


def _lines(text) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """What makes two lines equal: their text without blanks, tabs and returns at both ends."""
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate(pages: DataFrame, host: str, text: str, ratio=RATIO, min_pages=MIN_PAGES) -> DataFrame:
    """(host, lines): per host the hashes of its boilerplate lines, only hosts that have some.

    A page counts once for each of its lines, so a hot host or line is counted before the shuffle. A host
    has fewer such lines than its pages have lines on average, divided by the ratio.
    """
    named = pages.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.col(text).alias("text"))
    keys = F.array_distinct(F.filter(F.transform(_lines("text"), line_key), lambda x: x != ""))
    lines = named.where("text IS NOT NULL").select("host", F.explode(keys).alias("line"))
    often = lines.groupBy("host", F.xxhash64("line").alias("line")).agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = named.groupBy(F.col("host").alias("_host")).agg(F.count("*").alias("pages"))
    # How often a host's lines occur follows from the lines; the division needs the few frequent ones only.
    found = staged(often, "often").join(staged(totals, "totals"), F.col("host") == F.col("_host")).where(F.col("n") > ratio * F.col("pages"))
    return found.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def drop_boilerplate(pages: DataFrame, host="source", text="text", ratio=RATIO, min_pages=MIN_PAGES) -> DataFrame:
    """Every row with its text free of boilerplate lines, and ``n_lines`` and ``n_dropped``.

    A line goes if it stands on at least ``min_pages`` pages of the host and on more than ``ratio`` of
    them. Lines are equal if their text without blanks, tabs and returns at the ends is; lines without any
    other character are never dropped. A null text stays null with no lines; a row with a null host has
    no site and keeps its lines; a text that loses every line becomes empty. Repeated rows are pages of
    their own. All other columns stay as they are, but for two of the names ``n_lines`` and ``n_dropped``.
    """
    found = staged(boilerplate(pages, host, text, ratio, min_pages), "boilerplate").select(F.col("host").alias("_host"), F.col("lines").alias("bad"))
    size = found.agg(F.sum(F.size("bad") * 8 + F.octet_length(F.col("_host").cast("string")) + 32)).first()[0] or 0
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(host).alias("host"), F.col(text).alias("text"))
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(found), F.col("host") == F.col("_host"), "left")
    else:
        salted = found.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        part = F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("part", part).join(salted, (F.col("host") == F.col("_host")) & (F.col("part") == F.col("_part")), "left")
    lines = _lines("text")
    clean = F.filter(lines, lambda x: (line_key(x) == "") | ~F.array_contains("bad", F.xxhash64(line_key(x))))
    there = F.col("text").isNotNull()
    parts = joined.select("row", "text", F.when(there, F.size(lines)).otherwise(0).cast("long").alias("n_lines"), F.when(there & F.col("bad").isNotNull(), clean).alias("clean"))
    dropped = F.when(F.col("clean").isNotNull(), F.col("n_lines") - F.size("clean")).otherwise(0).cast("long")
    new = F.when(F.col("clean").isNotNull(), F.array_join("clean", "\n")).otherwise(F.col("text"))
    own = [new.alias(c) if c == text else F.col(f"row.`{c}`") for c in pages.columns if c not in ("n_lines", "n_dropped")]
    return parts.select(*own, "n_lines", dropped.alias("n_dropped"))
