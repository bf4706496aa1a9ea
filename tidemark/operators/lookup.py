"""Lookups.  The key filter or join stands before the resolution, so it reaches the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resolve import latest, snapshot


def get(mutations: DataFrame, key) -> DataFrame:
    """The live (key, value, seq) of one key: one row or none."""
    return snapshot(mutations.where(F.col("key") == F.lit(key)))


def state(mutations: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value, state) of each wanted key: live, deleted or missing."""
    wanted = keys.select("key").distinct()
    held = latest(mutations.join(wanted, "key", "left_semi"))
    named = F.when(F.col("deleted"), "deleted").when(F.col("deleted").isNotNull(), "live").otherwise("missing")
    return wanted.join(held, "key", "left").select("key", "value", named.alias("state"))


def multi_get(mutations: DataFrame, keys: DataFrame) -> DataFrame:
    """Live rows of many keys: the log is cut down by a semi join, then resolved."""
    return snapshot(mutations.join(keys.select("key").distinct(), "key", "left_semi"))


def range_scan(mutations: DataFrame, low=None, high=None) -> DataFrame:
    """Live rows with low <= key < high, either open if None."""
    if low is not None:
        mutations = mutations.where(F.col("key") >= F.lit(low))
    if high is not None:
        mutations = mutations.where(F.col("key") < F.lit(high))
    return snapshot(mutations)


def prefix_scan(mutations: DataFrame, prefix) -> DataFrame:
    """Live rows whose key starts with a prefix."""
    return snapshot(mutations.where(F.startswith("key", F.lit(prefix))))


def ordered(entries: DataFrame) -> DataFrame:
    """All entries in key order: a range-partitioned sort."""
    return entries.orderBy("key")
