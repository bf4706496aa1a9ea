"""Leveled compaction: what is due, and the merge of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resolve import latest


def level_sizes(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("level").agg(F.count("*").alias("n_segments"), F.sum("size_bytes").alias("size_bytes"), F.sum("n_entries").alias("n_entries"))


def candidates(manifest: DataFrame, level: int, threshold: int) -> DataFrame:
    """All segments of a level whose total payload reaches the threshold (equality counts), else none."""
    own = manifest.where(F.col("level") == level)
    total = own.groupBy().agg(F.sum("size_bytes").alias("_total")).where(F.col("_total") >= threshold)
    return own.join(F.broadcast(total), F.lit(True)).drop("_total")  # one row at most


def merge(entries: DataFrame) -> DataFrame:
    """One run: the newest entry of every key.  Deletes stay, for older levels may hold the key."""
    return latest(entries)


def drop_tombstones(bottom: DataFrame) -> DataFrame:
    """A full merge into the bottom level without deletes.

    Safe only if every older entry takes part and no older mutation can arrive.
    """
    return merge(bottom).where(~F.col("deleted"))
