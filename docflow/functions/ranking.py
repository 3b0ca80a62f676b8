"""Ordering inside groups whose size has no bound.

A plain window sends a whole group to one task. These helpers cut a group into buckets (or
salts) first, so a group holding a third of the data is spread over many tasks, and only small
per-bucket summaries are combined per group. All results are exact.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written


def _as_list(x):
    return list(x) if isinstance(x, (list, tuple)) else [x]


def top_per_key(df: DataFrame, keys, order, n: int, salts: int = 256) -> DataFrame:
    """The first ``n`` rows of each key by ``order``; ``keys`` may be empty.

    Stage one keeps ``n`` rows per key and salt (the salt is the input partition, so the limit
    is already applied before the shuffle); stage two ranks at most ``salts * n`` rows per key.
    """
    keys, order = _as_list(keys), _as_list(order)
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    first = W.partitionBy(*keys, "_salt").orderBy(*order)
    pruned = (
        salted.withColumn("_rn", F.row_number().over(first))
        .where(F.col("_rn") <= n)
        .drop("_rn", "_salt")
    )
    if not keys:
        return pruned.orderBy(*order).limit(n)
    last = W.partitionBy(*keys).orderBy(*order)
    return pruned.withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") <= n).drop("_rn")


def newest(df: DataFrame, ts: str, tie: str, n: int) -> DataFrame:
    """Newest ``n`` rows, newest first."""
    order = [F.col(ts).desc(), F.col(tie).desc()]
    return top_per_key(df, [], order, n).orderBy(*order)


def _bucketed(df: DataFrame, keys, bucket: Column, amount: Column):
    """Rows with their bucket, plus per bucket the amount that lies in earlier buckets."""
    keyed = df.withColumn("_bucket", bucket)
    per_bucket = keyed.groupBy(*keys, "_bucket").agg(F.sum(amount).alias("_n"))
    if keys:
        before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    else:
        before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return keyed, offsets


def _attach(keyed: DataFrame, offsets: DataFrame, keys) -> DataFrame:
    on = [*keys, "_bucket"]
    side = offsets.select(*[F.col(k).alias(f"_of_{k}") for k in on], "_before")
    joined = keyed.join(side, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in on]), "left")
    # Without this a join partitioned by the key alone would satisfy the window as well.
    return joined.select(*keyed.columns, "_before").repartition(*on)


def bucketed_rank(df: DataFrame, keys, bucket: Column, order, name="rank") -> DataFrame:
    """``row_number`` of each row in its key. ``bucket`` must rise with ``order``."""
    keys, order = _as_list(keys), _as_list(order)
    keyed, offsets = _bucketed(df, keys, bucket, F.lit(1))
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        _attach(keyed, offsets, keys)
        .withColumn(name, F.col("_before") + F.row_number().over(inside))
        .drop("_bucket", "_before")
    )


def bucketed_running_sum(df: DataFrame, keys, bucket: Column, order, amount: Column, name) -> DataFrame:
    """Running sum of ``amount`` in each key, current row included."""
    keys, order = _as_list(keys), _as_list(order)
    with_amount = df.withColumn("_amount", amount)
    keyed, offsets = _bucketed(with_amount, keys, bucket, F.col("_amount"))
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        _attach(keyed, offsets, keys)
        .withColumn(name, F.col("_before") + F.sum("_amount").over(inside))
        .drop("_bucket", "_before", "_amount")
    )


def bucketed_lead(df: DataFrame, keys, bucket: Column, order: str, values, prefix="next_") -> DataFrame:
    """Values of the following row of the same key, null on the last one."""
    keys, values = _as_list(keys), _as_list(values)
    keyed = df.withColumn("_bucket", bucket)
    row = F.struct(F.lit(True).alias("_there"), *[F.col(v) for v in values])
    firsts = keyed.groupBy(*keys, "_bucket").agg(F.min_by(row, F.col(order)).alias("_first"))
    following = firsts.select(
        *keys, "_bucket",
        F.lead("_first").over(W.partitionBy(*keys).orderBy("_bucket")).alias("_before"),
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(order)
    out = _attach(keyed, following, keys).withColumn(
        "_next", F.coalesce(F.lead(row).over(inside), F.col("_before"))
    )
    for v in values:
        out = out.withColumn(prefix + v, F.col("_next")[v])
    return out.drop("_bucket", "_before", "_next")


def salted_join(left: DataFrame, right: DataFrame, on: str, salts: int, how: str = "inner") -> DataFrame:
    """Equi-join on a column with few, heavy values.

    Each value is split over ``salts`` tasks: left rows go to one of them by a hash of their own
    values, right rows (the smaller side) to all. A right side small enough for Spark to
    broadcast is broadcast all the same.
    """
    plain = [f.name for f in left.schema if isinstance(f.dataType, T.AtomicType)]
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [on, "_salt"], how).drop("_salt")


def in_ranges(df: DataFrame, order, name: str) -> DataFrame:
    """The rows, written in ranges of ``order``, with ``_range`` (rising) and the place ``_at`` in it, from 0.

    Spark samples the rows to find ranges of about equal size, so one key or a bulk of close values is spread
    over as many ranges as it needs. Rows equal in all of ``order`` share a range.
    """
    order = _as_list(order)
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = cut.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    return written(numbered, name)


def numbered(df: DataFrame, order, name="rank") -> DataFrame:
    """All rows with their number in ``order``, from 1: places in ranges, plus the rows of earlier ranges."""
    ranged = in_ranges(df, order, "numbered")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("_range").alias("_of"), before.alias("_before"))
    return ranged.join(offsets, F.col("_range") == F.col("_of")).withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_of", "_before")
