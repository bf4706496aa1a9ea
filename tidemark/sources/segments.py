"""Immutable key-sorted segments in Parquet, and the manifest that lists them.

A segment counts from the moment a manifest version names it, so half-written
segments are never read.  Manifest versions are small tables, one row a segment.  A
version is written beside the others and gets its number in one step, so a writer
that dies leaves nothing that counts or blocks, and of two writers that start from the
same version the second gets a ``PublishConflict``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import MANIFEST, MUTATION
from . import files


class PublishConflict(RuntimeError):
    """Another writer has published since the manifest was read."""


def write_segment(entries: DataFrame, root: str, level: int, max_batch: int = -1, expected_keys: int | None = None) -> DataFrame:
    """Write (key, value, deleted, seq) with one row a key; return its manifest row.

    Rows are range-partitioned and sorted by key, so that row groups have narrow
    key ranges, and carry a Bloom filter on the key for lookups in between.
    ``max_batch``: log batches up to this one are in this segment or in others.
    """
    spark, name = entries.sparkSession, uuid.uuid4().hex
    path = f"{root.rstrip('/')}/segments/{name}"
    writer = (entries.select("key", "value", "deleted", "seq").repartitionByRange("key").sortWithinPartitions("key").write
              .option("parquet.bloom.filter.enabled#key", "true"))
    if expected_keys:
        writer = writer.option("parquet.bloom.filter.expected.ndv#key", str(expected_keys))
    writer.parquet(path)
    payload = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    k = F.col("key").cast("binary")
    return spark.read.parquet(path).agg(
        F.lit(name).alias("segment_id"), F.lit(level).alias("level"), F.lit(path).alias("path"), F.min(k).alias("min_key"),
        F.max(k).alias("max_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count("*").alias("n_entries"),
        F.coalesce(F.sum(F.col("deleted").cast("long")), F.lit(0)).cast("long").alias("n_deletes"),
        F.coalesce(F.sum(payload), F.lit(0)).cast("long").alias("size_bytes"), F.lit(max_batch).cast("long").alias("max_batch"))


def _versions(spark: SparkSession, root: str) -> tuple[int, int]:
    """The newest whole version, and the greatest number that is taken; 0 if none."""
    where = f"{root.rstrip('/')}/manifest"
    taken = sorted((int(x.partition("=")[2]) for x in files.names(spark, where) if x.startswith("v=")), reverse=True)
    whole = next((v for v in taken if files.exists(spark, f"{where}/v={v}/_SUCCESS")), 0)
    return whole, max(taken, default=0)


def _version(spark: SparkSession, root: str, v: int) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{root.rstrip('/')}/manifest/v={v}") if v else spark.createDataFrame([], MANIFEST)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The newest whole manifest; no rows before the first segment."""
    return _version(spark, root, _versions(spark, root)[0])


def publish(spark: SparkSession, root: str, added: list[DataFrame], retired: list[str] = (), base: int | None = None) -> int:
    """A new manifest version with the rows ``added`` and without the segments ``retired``; returns its number.

    ``base``: the version the caller has read (``current_version``), if not the newest.
    """
    whole, taken = _versions(spark, root)
    if base is not None and base != whole:
        raise PublishConflict(f"version {whole} is newer than version {base}")
    rows = _version(spark, root, whole).where(~F.col("segment_id").isin(list(retired)))
    for x in added:
        rows = rows.unionByName(x)
    where = f"{root.rstrip('/')}/manifest"
    draft = f"{where}/_draft-{uuid.uuid4().hex}"
    rows.coalesce(1).write.parquet(draft)
    # A number that a dead writer has taken is passed over; one that a live writer takes now is not.
    if not files.move_new(spark, draft, f"{where}/v={taken + 1}"):
        files.delete(spark, draft)
        raise PublishConflict(f"another writer has published version {taken + 1}")
    return taken + 1


def current_version(spark: SparkSession, root: str) -> int:
    return _versions(spark, root)[0]


def flushed_to(rows: DataFrame) -> int:
    """The last log batch that the segments hold; -1 if none."""
    found = rows.agg(F.max("max_batch")).first()[0]
    return -1 if found is None else found


def read_segments(spark: SparkSession, rows: DataFrame, key_range: tuple[bytes, bytes] | None = None) -> DataFrame:
    """The entries of the segments in ``rows``; those beyond ``key_range`` are not opened."""
    if key_range:
        low, high = (F.lit(bytearray(x)) for x in key_range)
        rows = rows.where((F.col("max_key") >= low) & (F.col("min_key") <= high))
    paths = [r["path"] for r in rows.select("path").collect()]  # one row a segment
    return spark.read.schema(MUTATION).parquet(*paths) if paths else spark.createDataFrame([], MUTATION)


def collect_garbage(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete all but the ``keep`` newest manifest versions, and segments that none of these lists; returns the segments.

    No writer may be at work: its segment is not listed yet.
    """
    where = root.rstrip("/")
    taken = sorted((int(x.partition("=")[2]) for x in files.names(spark, f"{where}/manifest") if x.startswith("v=")), reverse=True)
    whole = [v for v in taken if files.exists(spark, f"{where}/manifest/v={v}/_SUCCESS")][: max(keep, 1)]
    listed = {r["segment_id"] for v in whole for r in _version(spark, root, v).select("segment_id").collect()}
    gone = [x for x in files.names(spark, f"{where}/segments") if x not in listed]
    for x in gone:
        files.delete(spark, f"{where}/segments/{x}")
    for x in files.names(spark, f"{where}/manifest"):
        if x not in {f"v={v}" for v in whole}:
            files.delete(spark, f"{where}/manifest/{x}")
    return gone
