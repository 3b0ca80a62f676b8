"""JSON-lines logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_text as J

# Members of a log record; any other member is an extra field.
RECORD = (
    "timestamp STRING, level STRING, logger STRING, message STRING, module STRING, "
    "function STRING, line INT, exception STRING"
)
MEMBERS = tuple(part.split()[0] for part in RECORD.split(", "))


def parse_log_lines(lines: DataFrame, text="value") -> DataFrame:
    """Log records of a text column, extras as a map, unreadable lines in ``corrupt``."""
    ok = J.is_json(text) & J.is_object(text)
    good = F.when(ok, F.col(text))
    extra = F.map_filter(F.from_json(good, "MAP<STRING,STRING>"), lambda k, _: ~k.isin(*MEMBERS))
    rest = [c for c in lines.columns if c != text]
    read = lines.select(
        *rest, F.from_json(good, RECORD).alias("_r"), extra.alias("extra"),
        F.when(~ok, F.col(text)).alias("corrupt"),
    )
    return read.select(
        *rest, F.col("_r.timestamp").try_cast("timestamp").alias("ts"),
        *[F.col("_r")[m].alias(m) for m in MEMBERS if m != "timestamp"], "extra", "corrupt",
    )


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_log_lines(spark.read.text(path))
