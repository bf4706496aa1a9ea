"""Last writer wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(mutations: DataFrame, plan: str = "aggregate") -> DataFrame:
    """The newest mutation of every key, deletes included.

    ``aggregate`` combines on the map side, so a hot key costs each task one row;
    ``window`` ranks the rows of a key.  Both take the row of the greatest seq,
    and are the same for any split, order or repetition of the log.
    """
    if plan == "window":
        newest = Window.partitionBy("key").orderBy(F.col("seq").desc())
        return mutations.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("key", "value", "deleted", "seq")
    won = mutations.groupBy("key").agg(F.max_by(F.struct("value", "deleted", "seq"), "seq").alias("_w"))
    return won.select("key", "_w.value", "_w.deleted", "_w.seq")


def snapshot(mutations: DataFrame, plan: str = "aggregate") -> DataFrame:
    """(key, value, seq) of the live keys.  Deletes are dropped after the newest is known."""
    return latest(mutations, plan).where(~F.col("deleted")).select("key", "value", "seq")


def overlay(tiers: list[DataFrame]) -> DataFrame:
    """Newest mutation of every key over tiers given newest first.

    Each older tier is read only for keys that newer ones do not have (a left anti
    join).  Right if the tiers hold disjoint, falling seq ranges; ``latest`` over
    the union is right always.
    """
    out = latest(tiers[0])
    for older in tiers[1:]:
        out = out.unionByName(latest(older.join(out.select("key"), "key", "left_anti")))
    return out


def key_versions(mutations: DataFrame) -> DataFrame:
    """Puts, deletes and the seq range of every key."""
    return mutations.groupBy("key").agg(
        F.count("*").alias("n_versions"), F.sum((~F.col("deleted")).cast("long")).alias("n_puts"),
        F.sum(F.col("deleted").cast("long")).alias("n_deletes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
