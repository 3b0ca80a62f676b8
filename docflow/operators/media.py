"""Sampling and layout arithmetic for frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sample_evenly(rows: DataFrame, group: str, order, bucket: Column, n=128) -> DataFrame:
    """``n`` rows per group at even steps from the first to the last, repeated when the group is
    smaller; ``sample_no`` runs from 0. ``bucket`` must rise with ``order``.

    The buckets' sizes alone say which places of which buckets are wanted; only those buckets are read
    and ranked, each by itself, so a large group is never in one task.
    """
    order = list(order) if isinstance(order, (list, tuple)) else [order]
    keyed = rows.withColumn("_bucket", bucket)
    sizes = keyed.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_bucket")) - F.col("_n")
    spans = sizes.select(group, "_bucket", "_n", before.alias("_before"), F.sum("_n").over(W.partitionBy(group)).alias("_total"))
    step = (F.col("_total") - 1) / F.lit(float(max(n - 1, 1)))
    last = F.col("_total") - 1 if n > 1 else F.lit(0)
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(
        k.alias("sample_no"), F.when(k == n - 1, last).otherwise(F.floor(k * step)).cast("bigint").alias("frame_index")))
    here = F.filter(places, lambda x: (x["frame_index"] >= F.col("_before")) & (x["frame_index"] < F.col("_before") + F.col("_n")))
    wanted = spans.withColumn("_wanted", here).where(F.size("_wanted") > 0).select(
        F.col(group).alias("_g"), F.col("_bucket").alias("_b"), "_before", "_total", "_wanted")
    found = keyed.join(wanted, F.col(group).eqNullSafe(F.col("_g")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    place = F.col("_before") + F.row_number().over(W.partitionBy(group, "_bucket").orderBy(*order)) - 1
    hits = F.filter("_wanted", lambda x: x["frame_index"] == F.col("_place"))
    return found.withColumn("_place", place).select(*rows.columns, "_total", F.explode(hits).alias("_hit")).select(
        *rows.columns, "_total", F.col("_hit.sample_no").alias("sample_no"), F.col("_hit.frame_index").alias("frame_index"))


def grid_positions(frames: DataFrame, number="sample_no", cols=8, width="width", height="height") -> DataFrame:
    """Row, column and pixel offset of each picture in a contact sheet."""
    row, col = F.floor(F.col(number) / cols).cast("bigint"), F.pmod(F.col(number), F.lit(cols)).cast("bigint")
    return (
        frames.withColumn("grid_row", row).withColumn("grid_col", col)
        .withColumn("offset_x", F.col("grid_col") * F.col(width))
        .withColumn("offset_y", F.col("grid_row") * F.col(height))
    )


def grid_rows(count: Column, cols=8) -> Column:
    return F.ceil(count / cols)


def video_tokens(videos: DataFrame, frames="frames", height="height", width="width", out="tokens") -> DataFrame:
    """Tokens a video costs: frames/2 * height/28 * width/28, cut to a whole number."""
    exact = F.col(frames) / F.lit(2.0) * F.col(height) / F.lit(28.0) * F.col(width) / F.lit(28.0)
    return videos.withColumn(out, exact.cast("bigint"))
