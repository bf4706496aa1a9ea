"""Folders of a store, through Hadoop's file systems, so that any of them serves."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it is not there."""
    fs, where = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def move_new(spark: SparkSession, source: str, target: str) -> bool:
    """Give a written folder its name, in one step; false if the name is taken."""
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    context = hadoop.FileContext.getFileContext(hadoop.Path(target).toUri(), spark._jsc.hadoopConfiguration())
    if exists(spark, target):
        return False
    try:
        context.rename(hadoop.Path(source), hadoop.Path(target), gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Exception:
        # Another writer may have come first; anything else is an error.
        if exists(spark, source) and exists(spark, target):
            return False
        raise
    return True


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that all executors see: under ``spark.checkpoint.dir``, or a temporary one on a single machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix=f'tidemark-{label}-')}"
