"""The named queries of this subpackage and their SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark, sf: str, name: str):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def share_of(id_col="doc_id"):
    """crc32 of the id as text, modulo 5; null for a null id."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5
