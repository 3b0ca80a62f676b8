"""Connected components of a graph given as a table of links.

Alternating large-star and small-star steps: each replaces links by links to smaller nodes without
joining or parting components, until every node points at the smallest of its component. The table of
each node's smallest and largest neighbours, found by map-side minimums and maximums, tells whether that
holds, so no further step is needed to see that nothing changes. Links are never more than before, so
repeated ones need no shuffle of their own. Both sides of each join are written tables, so adaptive
execution can split a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged


def components(links: DataFrame, a="a", b="b") -> DataFrame:
    """(node, component) for every node with a link; ``component`` is the smallest node reachable.

    Links with a null end or with both ends equal, and repeated links, change nothing. Without links
    the result is empty.
    """
    now = staged(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(
        F.greatest(a, b).alias("a"), F.least(a, b).alias("b")), "links")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"), F.max("b").alias("high")), "near")
        # Done if each node has either larger neighbours only or a single smaller one.
        if near.where("low < node AND high != low").isEmpty():
            return near.select("node", F.least("node", "low").alias("component"))
        # Large-star: a link's larger end moves to the smallest neighbour of the other end.
        large = staged(now.join(near, F.col("b") == F.col("node")).select("a", F.least("b", "low").alias("b")), "large")
        # Small-star: a node and its smaller neighbours move to the smallest of them.
        small = staged(large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")), "small")
        moved = large.join(small, F.col("a") == F.col("node")).where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = staged(moved.unionByName(small.select(F.col("node").alias("a"), F.col("low").alias("b"))), "links")
