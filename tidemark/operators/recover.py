"""Recovery: log batches that no segment holds are replayed over the segments."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .resolve import latest


def recover(log: DataFrame, segments: DataFrame) -> DataFrame:
    """Newest mutation of every key over log and segments; replaying more than needed changes nothing."""
    columns = ("key", "value", "deleted", "seq")
    return latest(log.select(*columns).unionByName(segments.select(*columns)))
