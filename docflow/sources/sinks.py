"""Writers and export texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import metrics

NESTED = (T.ArrayType, T.MapType, T.StructType)
JSON_OPTIONS = {"ignoreNullFields": "false"}


def save_blobs(df: DataFrame, path: str, partition="task_type", fmt="parquet") -> None:
    """Writes (key, content, metadata, partition) rows, replacing what was there."""
    df.write.mode("overwrite").partitionBy(partition).format(fmt).save(path)


def json_lines(df: DataFrame, out="value") -> DataFrame:
    """One JSON text per row, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), JSON_OPTIONS).alias(out))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def csv_columns(df: DataFrame, columns=None) -> DataFrame:
    """The chosen columns in order, nested ones as JSON text, missing ones empty."""
    kinds = {f.name: f.dataType for f in df.schema}

    def cell(name) -> Column:
        if name not in kinds:
            return F.lit("").alias(name)
        if isinstance(kinds[name], NESTED):
            return F.to_json(name, JSON_OPTIONS).alias(name)
        return F.col(name)

    return df.select(*[cell(c) for c in columns or df.columns])


def export_csv(df: DataFrame, path: str, columns=None) -> None:
    csv_columns(df, columns).write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', nullValue="", emptyValue="", lineSep="\n")


def first_list(df: DataFrame) -> DataFrame:
    """Rows of the first list-valued column, or the records themselves without one."""
    for field in df.schema:
        if isinstance(field.dataType, T.ArrayType):
            rows = df.select(F.explode(field.name).alias("value"))
            return rows.select("value.*") if isinstance(field.dataType.elementType, T.StructType) else rows
    return df


def export_first_list(df: DataFrame, path: str, columns=None) -> None:
    export_csv(first_list(df), path, columns)


# Columns of the audit text.
AUDIT_COLUMNS = ("timestamp", "action", "tenant_id", "user_id", "resource_type", "resource_id", "success")


def _iso(ts) -> Column:
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")))


def audit_lines(audit: DataFrame, fmt="json", out="value") -> DataFrame:
    """Audit entries as text rows: all fields as JSON, or seven columns without quoting.

    The header of the column form is :data:`AUDIT_COLUMNS`, written by :func:`export_audit`.
    """
    if fmt == "json":
        return json_lines(audit.withColumn("timestamp", _iso("ts")).drop("ts"), out)
    if fmt != "csv":
        raise ValueError(f"Unknown format: {fmt}")
    cells = [
        _iso("ts"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in AUDIT_COLUMNS[1:-1]],
        F.when(F.col("success"), "True").otherwise("False"),
    ]
    return audit.select(F.concat_ws(",", *cells).alias(out))


def export_audit(audit: DataFrame, path: str, fmt="json") -> None:
    """Writes the lines as text; the column names are the first part, so the parts in name order
    make up the file."""
    lines = audit_lines(audit, fmt)
    if fmt == "csv":
        header = audit.sparkSession.createDataFrame([(",".join(AUDIT_COLUMNS),)], "value string").coalesce(1)
        lines = header.union(lines)
    lines.write.mode("overwrite").text(path)


def prometheus_lines(obs: DataFrame) -> DataFrame:
    """Text lines of every metric: a type line, then its value, or count and sum."""
    name = F.substring_index("key", "{", 1)
    label = F.substring(F.col("key"), F.length(name) + 1, F.length("key"))
    kind = F.col("family")
    plain = F.array(
        F.concat(F.lit("# TYPE "), name, F.lit(" "), kind),
        F.concat("key", F.lit(" "), F.col("value").cast("double").cast("string")),
    )
    spread = F.array(
        F.concat(F.lit("# TYPE "), name, F.lit(" histogram")),
        F.concat(name, F.lit("_count"), label, F.lit(" "), F.col("count").cast("string")),
        F.concat(name, F.lit("_sum"), label, F.lit(" "), F.col("sum").cast("double").cast("string")),
    )
    every = metrics.all_metrics(obs)
    lines = F.when(kind == "histogram", spread).otherwise(plain)
    return every.select("family", "key", F.posexplode(lines).alias("line_no", "value"))


def export_prometheus(obs: DataFrame, path: str) -> None:
    lines = prometheus_lines(obs).repartitionByRange("family", "key").sortWithinPartitions("family", "key", "line_no")
    lines.select("value").write.mode("overwrite").text(path)
