"""A store of segments: continuous ingest, flush, compaction and keyed reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import Config
from ..operators import lookup
from ..operators.compact import drop_tombstones, merge
from ..operators.recover import recover
from ..sources import mutations as log
from ..sources import segments


def ingest(stream: DataFrame, root: str, checkpoint: str, flush_every: int = 1) -> StreamingQuery:
    """Log every micro-batch; after each ``flush_every`` of them write what is not flushed as a segment.

    A batch that is retried replaces itself in the log, and a segment counts only
    once the manifest lists it with its last batch, so failures lose and double nothing.
    Late rows need no watermark: the newest seq wins in whatever order they come.
    """
    def take(batch: DataFrame, batch_id: int) -> None:
        log.append(batch.select("key", "value", "deleted", "seq"), root, batch_id)
        if (batch_id + 1) % flush_every == 0:
            flush(batch.sparkSession, root)

    return (stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def flush(spark: SparkSession, root: str) -> None:
    """Write the log batches that no segment holds as one level-0 segment; only these are read, and then deleted.

    If a flush dies after the manifest is published, the next one deletes its batches.
    """
    base = segments.current_version(spark, root)
    done = segments.flushed_to(segments.manifest(spark, root))
    new = [b for b in log.batches(spark, root) if b > done]
    if new:
        segments.publish(spark, root, [segments.write_segment(merge(log.replay(spark, root, done)), root, 0, new[-1])], base=base)
    log.retire(spark, root, new[-1] if new else done)


def compact_level(spark: SparkSession, root: str, level: int, threshold: int = 0, bottom: int | None = None, drop_deletes: bool = False) -> bool:
    """Merge a level's segments into the next; false if there are none or they are fewer bytes than the threshold.

    Level ``bottom`` takes the result in with all it has, so that it stays one segment;
    ``drop_deletes`` leaves deletes out there, which is safe only if no mutation older than
    those stored can arrive any more, and no level between holds older ones.
    """
    base, target = segments.current_version(spark, root), level + 1
    listed = segments.manifest(spark, root)
    rows = listed.where(F.col("level") == level).select("segment_id", "size_bytes").collect()  # one row a segment
    if not rows or sum(r["size_bytes"] for r in rows) < threshold:
        return False
    own = listed.where(F.col("level").isin(level, target) if target == bottom else F.col("level") == level)
    entries = segments.read_segments(spark, own)
    whole = drop_deletes and target == bottom
    merged = segments.write_segment(drop_tombstones(entries) if whole else merge(entries), root, target, segments.flushed_to(listed))
    segments.publish(spark, root, [merged], [r["segment_id"] for r in own.select("segment_id").collect()], base)
    return True


def compact(spark: SparkSession, root: str, config: Config, force: bool = False, drop_deletes: bool = False) -> list[int]:
    """Cascade over the stored levels from 0 up, each merged into the next if it is due; returns those that were.

    Sizes come from the manifest, so a level that is not due is not read.
    """
    last = config.levels - 1
    return [level for level in range(last) if compact_level(spark, root, level, 0 if force else config.compaction_bytes, last, drop_deletes)]


def _entries(spark: SparkSession, root: str, key_range: tuple[bytes, bytes] | None = None) -> tuple[DataFrame, DataFrame]:
    listed = segments.manifest(spark, root)
    return log.replay(spark, root, segments.flushed_to(listed)), segments.read_segments(spark, listed, key_range)


def current(spark: SparkSession, root: str) -> DataFrame:
    """Live rows over all segments and the log batches not flushed yet."""
    found = recover(*_entries(spark, root))
    return found.where(~F.col("deleted")).select("key", "value", "seq")


def get(spark: SparkSession, root: str, key: bytes) -> DataFrame:
    """The live row of one key: segments of another key range are not opened, and Parquet's ranges and Bloom filters skip row groups of the others."""
    fresh, stored = _entries(spark, root, (key, key))
    return lookup.get(fresh.unionByName(stored), bytearray(key))


def multi_get(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """Live rows of the binary ``key`` column of a table: only segments that their range meets are opened."""
    ends = keys.agg(F.min("key").alias("low"), F.max("key").alias("high")).first()
    if ends["low"] is None:
        return current(spark, root).limit(0)
    fresh, stored = _entries(spark, root, (bytes(ends["low"]), bytes(ends["high"])))
    low, high = F.lit(bytearray(ends["low"])), F.lit(bytearray(ends["high"]))
    return lookup.multi_get(fresh.unionByName(stored).where(F.col("key").between(low, high)), keys)
