"""File listings: folders, keys, blobs, sidecars and uploads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions.ranking import numbered

LISTED = "path string, modificationTime timestamp, length bigint"


def _glob(patterns) -> str:
    return "{" + ",".join(patterns) + "}"


def list_files(spark: SparkSession, path: str, patterns=("*",), recursive=False) -> DataFrame:
    """Path, time and size of files; the content is never read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", _glob(patterns))
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
        .select("path", "modificationTime", "length")
    )


def scan_folder(spark: SparkSession, path: str, patterns=dims.IMAGE_PATTERNS, sort_by="name") -> DataFrame:
    """Files of one folder as pages: file name, path and page number from 1.

    ``sort_by`` is ``name`` or ``modified`` (then by name). Names are numbered in sampled ranges, so a huge
    folder is not sorted by one task, whatever its names look like.
    """
    files = list_files(spark, path, patterns).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return numbered(files, ["modificationTime", "name"] if sort_by == "modified" else ["name"], "page_no")


def batch_files(spark: SparkSession, path: str, patterns=dims.BATCH_PATTERNS) -> DataFrame:
    """Files for a batch job; an empty folder is an error."""
    files = list_files(spark, path, patterns)
    if files.isEmpty():
        raise ValueError(f"No files found matching patterns: {list(patterns)}")
    return files


def _below(base: str):
    # Everything after the base folder, whatever scheme or authority the path carries.
    marker = base.rstrip("/") + "/"
    marker = marker.split("://", 1)[-1]
    at = F.instr("path", F.lit(marker))
    return F.substring("path", at + len(marker), F.length("path"))


def list_keys(spark: SparkSession, base: str, prefix="", as_folder=True) -> DataFrame:
    """Keys (paths below ``base``), sidecars hidden.

    ``as_folder`` treats the prefix as a folder below the base, a missing one giving no keys;
    otherwise it is a plain string prefix of the key.
    """
    folder = base.rstrip("/") + ("/" + prefix.strip("/") if prefix and as_folder else "")
    try:
        keys = list_files(spark, folder, recursive=True).select(_below(base).alias("key"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "key string")
    if prefix and not as_folder:
        keys = keys.where(F.startswith("key", F.lit(prefix)))
    return keys.where(~F.endswith("key", F.lit(".meta")))


def blobs(spark: SparkSession, base: str, patterns=("*",)) -> DataFrame:
    """Keys with their content."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _glob(patterns)).load(base)
        .select(_below(base).alias("key"), "content", "length")
    )


def load_blobs(keys: DataFrame, stored: DataFrame) -> DataFrame:
    """Content per wanted key, null and ``exists`` false when there is none."""
    found = stored.select("key", "content", F.lit(True).alias("_there"))
    return keys.join(found, "key", "left").select(
        *keys.columns, "content", F.coalesce("_there", F.lit(False)).alias("exists"))


def join_sidecar(stored: DataFrame) -> DataFrame:
    """Data files with the metadata of their ``.meta`` neighbour as a map."""
    is_meta = F.endswith("key", F.lit(".meta"))
    meta = stored.where(is_meta).select(
        F.expr("substring(key, 1, length(key) - 5)").alias("key"),
        F.from_json(F.col("content").cast("string"), "MAP<STRING,STRING>").alias("metadata"),
    )
    return stored.where(~is_meta).join(meta, "key", "left")


def filter_uploads(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """Listed paths that exist as files, with their kind and whether the size is allowed.

    Empty and missing paths are dropped; the kind follows the lower-case extension.
    """
    asked = paths.where(F.length("path") > 0)
    files = listing.select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    kind = (
        F.when(ext == ".pdf", "pdf").when(ext.isin(*dims.IMAGE_EXTENSIONS), "image")
        .when(ext.isin(*dims.VIDEO_EXTENSIONS), "video").otherwise("unsupported")
    )
    cap = F.when(F.col("kind") == "video", dims.MAX_VIDEO_BYTES).otherwise(dims.MAX_IMAGE_BYTES)
    return asked.join(files, "path").withColumn("kind", kind).withColumn(
        "accepted", (F.col("kind") != "unsupported") & (F.col("length") <= cap))
