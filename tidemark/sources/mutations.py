"""Mutation logs: puts and deletes with a unique, ever growing ``seq``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import MUTATION
from . import files


def as_mutations(df: DataFrame, *, key: Column, value: Column, seq: Column, deleted: Column | None = None) -> DataFrame:
    """(key, value, deleted, seq).  A delete has no value; an empty value is a live one.

    ``seq`` must be unique and come from the source: it alone says what is newer.
    A null value without a delete mark is a delete.
    """
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    gone = gone | value.isNull()
    return df.select(key.alias("key"), F.when(~gone, value).alias("value"), gone.alias("deleted"), seq.cast("long").alias("seq"))


def append(mutations: DataFrame, root: str, batch_id: int) -> None:
    """Append a batch to the log; batch ids grow.  Writing a batch again replaces it, so a retried batch counts once."""
    mutations.write.mode("overwrite").parquet(f"{root.rstrip('/')}/log/batch_id={batch_id}")


def batches(spark: SparkSession, root: str) -> list[int]:
    """The ids of the whole batches of the log."""
    log = f"{root.rstrip('/')}/log"
    found = [x for x in files.names(spark, log) if x.startswith("batch_id=") and files.exists(spark, f"{log}/{x}/_SUCCESS")]
    return sorted(int(x.partition("=")[2]) for x in found)


def replay(spark: SparkSession, root: str, after: int = -1) -> DataFrame:
    """The mutations of the batches after one; the others are not opened."""
    paths = [f"{root.rstrip('/')}/log/batch_id={b}" for b in batches(spark, root) if b > after]
    return spark.read.schema(MUTATION).parquet(*paths) if paths else spark.createDataFrame([], MUTATION)


def retire(spark: SparkSession, root: str, until: int) -> None:
    """Delete the batches up to one, which segments hold."""
    for b in batches(spark, root):
        if b <= until:
            files.delete(spark, f"{root.rstrip('/')}/log/batch_id={b}")
