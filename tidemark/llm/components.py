"""Connected components of a distributed graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Nodes of so many neighbours and more are told their least one by broadcast, in so many rows at most.
_HUB, _HUBS = 256, 50_000


def _with_least(edges: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """Add ``m`` to edges (u, v); ``least`` is written: u, m and the number k of rows that u has among ``rows``.

    The neighbours of a hub would meet in one task of a shuffled join.  A hub has at least ``rows / _HUBS`` of
    the rows, so there are ``_HUBS`` of them at most, however large the graph, and they are broadcast.
    """
    hub = F.col("k") >= max(_HUB, -(-rows // _HUBS))
    hubs, others = least.where(hub).select(F.col("u").alias("_u"), F.col("m").alias("_m")), least.where(~hub).select("u", "m")
    told = edges.join(F.broadcast(hubs), F.col("u") == F.col("_u"), "left").drop("_u")
    return told.where(F.col("_m").isNotNull()).select("u", "v", F.col("_m").alias("m")).union(told.where(F.col("_m").isNull()).join(others, "u").select("u", "v", "m"))


def _fingerprint(edges: DataFrame) -> tuple:
    # Whole numbers below 2^40, so that the sum of any number of rows fits.
    part = F.shiftright(F.xxhash64("u", "v"), 24)
    return tuple(edges.agg(F.count("*"), F.sum(part.cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of an edge; root is the least node reached.

    ``edges`` has columns a and b of one orderable type.  Each round links the
    neighbours of a node to the least of them (first the larger ones, then the
    smaller ones), which needs a number of rounds that grows with the logarithm
    of the graph.  Every round is an aggregation and a join on the node, in which hubs
    are broadcast, so no neighbourhood is ever collected or brought to one task, and
    what it makes is written, so that lost executors cost one round at most.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    seen = _fingerprint(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("k")), label)
        large = materialize(_with_least(both.where("v > u"), least, 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .where("u <> v").distinct(), label)
        # Now every u is the larger end; its least neighbour becomes that of the others.
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")), label)
        # Every round has as many rows as there are edges at most.
        joined = _with_least(large, low, seen[0])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), label)
        then, seen = seen, _fingerprint(now)
        if then == seen:
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return materialize(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), label)
