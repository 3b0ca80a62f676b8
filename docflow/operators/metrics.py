"""Counters, gauges and histograms from an observation table.

Columns: name, labels (map), kind (counter, gauge, histogram), ts, value, and ``obs_id`` to
order observations of the same time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import in_ranges, top_per_key

# Reported percentiles.
PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def metric_key(name="name", labels="labels") -> Column:
    """``name{k="v",...}`` with labels by key, or the bare name."""
    pairs = F.transform(
        F.array_sort(F.map_entries(labels)),
        lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')),
    )
    return F.when(F.size(labels) > 0, F.concat(name, F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.col(name))


def add_metric_key(obs: DataFrame, out="key") -> DataFrame:
    return obs.withColumn(out, metric_key())


def _of(obs: DataFrame, kind: str) -> DataFrame:
    return add_metric_key(obs.where(F.col("kind") == kind))


def counters(obs: DataFrame) -> DataFrame:
    return _of(obs, "counter").groupBy("key").agg(F.sum("value").alias("value"))


def gauges(obs: DataFrame) -> DataFrame:
    return _of(obs, "gauge").groupBy("key").agg(F.max_by("value", F.struct("ts", "obs_id")).alias("value"))


def last_1000(obs: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` histogram observations of each key."""
    rows = _of(obs, "histogram").select("key", "name", "ts", "obs_id", "value")
    return top_per_key(rows, ["key"], [F.col("ts").desc(), F.col("obs_id").desc()], n)


def _counted(obs: DataFrame, kinds) -> DataFrame:
    """Observations counted per kind, key and, in a histogram, value; written in ranges of these, so that a
    histogram of very many values lies in many of them."""
    keyed = add_metric_key(obs.where(F.col("kind").isin(*kinds))).select("kind", "key", "value")
    value = F.when(F.col("kind") == "histogram", F.col("value"))
    counted = keyed.groupBy("kind", "key", value.alias("_value")).agg(F.count("value").alias("n"), F.sum("value").alias("_sum"))
    return in_ranges(counted, ["kind", "key", "_value"], "metrics")


def _statistics(counted: DataFrame, kind) -> DataFrame:
    """Totals and percentiles of the histograms in :func:`_counted`.

    Values lie in ranges, so a range's counts tell which ranges hold the wanted places; only these are looked into.
    """
    rows = counted.where(F.col("kind") == "histogram")
    parts = rows.groupBy("key", "_range").agg(
        F.sum("n").alias("n"), F.sum("_sum").alias("s"), F.min("_value").alias("lo"), F.max("_value").alias("hi"))
    of_key = W.partitionBy("key")
    parts = parts.select(
        "key", "_range", "n", F.sum("n").over(of_key).alias("count"), F.sum("s").over(of_key).cast(kind).alias("sum"),
        F.min("lo").over(of_key).alias("min"), F.max("hi").over(of_key).alias("max"),
        F.coalesce(F.sum("n").over(of_key.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = lambda p: F.floor(F.col("count") * F.lit(float(p))) - F.col("before")
    here = lambda p: (place(p) >= 0) & (place(p) < F.col("n"))
    totals = parts.groupBy("key").agg(*[F.max(c).alias(c) for c in ("count", "sum", "min", "max")])
    wanted = parts.select(F.col("key").alias("_key"), F.col("_range").alias("_of"), *[F.when(here(p), place(p)).alias(f"_{n}") for n, p in PERCENTILES.items()])
    wanted = wanted.where(F.coalesce(*[f"_{n}" for n in PERCENTILES]).isNotNull())
    inside = rows.where("n > 0").join(wanted, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_of")))
    upto = F.sum("n").over(W.partitionBy("_range", "key").orderBy("_value").rowsBetween(W.unboundedPreceding, 0))
    found = inside.withColumn("upto", upto)
    at = lambda n: F.when((F.col(f"_{n}") >= F.col("upto") - F.col("n")) & (F.col(f"_{n}") < F.col("upto")), F.col("_value"))
    picked = found.groupBy(F.col("key").alias("_key")).agg(*[F.max(at(n)).alias(n) for n in PERCENTILES])
    return totals.join(picked, F.col("key").eqNullSafe(F.col("_key")), "left").select(
        "key", "count", "sum", (F.col("sum") / F.col("count")).alias("avg"), "min", "max", *PERCENTILES)


def _sum_type(obs: DataFrame):
    return obs.agg(F.sum("value").alias("s")).schema["s"].dataType


def histogram_stats(obs: DataFrame) -> DataFrame:
    """Count, sum, mean, extremes and rank-picked percentiles per key, over all its observations.

    The percentile is the value at position int(n * p) of the sorted values, without interpolation.
    """
    return _statistics(_counted(obs, ("histogram",)), _sum_type(obs))


def all_metrics(obs: DataFrame) -> DataFrame:
    """The three families together; histograms carry their statistics, the others a value.

    Counters and histograms come from one pass over the observations, gauges from another over theirs.
    """
    counted = _counted(obs, ("counter", "histogram"))
    c = counted.where(F.col("kind") == "counter").select("key", F.col("_sum").cast(_sum_type(obs)).alias("value"), F.lit("counter").alias("family"))
    g = gauges(obs).withColumn("family", F.lit("gauge"))
    h = _statistics(counted, _sum_type(obs)).withColumn("family", F.lit("histogram"))
    return c.unionByName(g, allowMissingColumns=True).unionByName(h, allowMissingColumns=True)


def default_metrics(values: DataFrame, defaults: DataFrame) -> DataFrame:
    """Counter and gauge values (key, value) with the default ones present at 0."""
    zero = defaults.select("key", F.lit(0.0).alias("_zero"))
    return values.join(zero, "key", "full").select("key", F.coalesce("value", "_zero").alias("value"))


def request_timer(requests: DataFrame, metric: str) -> DataFrame:
    """Observations of timed requests (obs_id, started, ended, failed, labels): the duration in
    ms and a count labelled by outcome."""
    micros = F.unix_micros("ended") - F.unix_micros("started")
    outcome = F.map_from_arrays(
        F.array(F.lit("status")), F.array(F.when(F.col("failed"), "error").otherwise("success")))
    families = F.array(
        F.struct(F.lit(metric).alias("name"), F.lit("histogram").alias("kind"), F.col("labels"),
                 (micros / 1000).alias("value")),
        F.struct(F.lit(metric + "_total").alias("name"), F.lit("counter").alias("kind"),
                 F.map_concat(F.map_filter("labels", lambda k, _: k != "status"), outcome).alias("labels"),
                 F.lit(1.0).alias("value")),
    )
    rows = requests.select("obs_id", F.col("ended").alias("ts"), F.explode(families).alias("_o"))
    return rows.select("obs_id", "ts", "_o.*")
