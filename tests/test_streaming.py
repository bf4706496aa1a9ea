"""Ingest, flush, compaction and recovery over files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.model import Config
from tidemark.operators import compact as plans
from tidemark.sources import files, segments
from tidemark.sources import mutations as log
from tidemark.streaming.ingest import compact, compact_level, current, flush, get, ingest, multi_get

from .test_resolve import as_dict, frame, history, model


def test_stream_equals_batch(spark, tmp_path):
    rows = history(5, 200)
    late = rows[:]
    random.Random(0).shuffle(late)
    for i in range(4):
        frame(spark, late[i::4]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    root = str(tmp_path / "store")
    ingest(stream, root, str(tmp_path / "cp"), flush_every=2).awaitTermination()
    assert as_dict(current(spark, root)) == model(rows)
    assert compact_level(spark, root, 0) and not compact_level(spark, root, 0)
    assert segments.manifest(spark, root).select("level").distinct().collect()[0][0] == 1
    assert as_dict(current(spark, root)) == model(rows)


def test_recovery_by_batch(spark, tmp_path):
    rows, root = history(6, 90), str(tmp_path / "store")
    log.append(frame(spark, rows[60:]), root, 0)
    flush(spark, root)
    # A later batch with older mutations, and one that is written twice.
    log.append(frame(spark, rows[:30]), root, 1)
    for _ in range(2):
        log.append(frame(spark, rows[30:60]), root, 2)
    assert as_dict(current(spark, root)) == model(rows)
    flush(spark, root)
    flush(spark, root)
    assert segments.manifest(spark, root).count() == 2 and not log.batches(spark, root)
    assert as_dict(current(spark, root)) == model(rows)
    assert not compact_level(spark, root, 0, threshold=10**9)


def test_segments_are_pruned_and_retired(spark, tmp_path):
    root = str(tmp_path)
    first = segments.write_segment(frame(spark, [(b"abc", b"abc", False, 1)]), root, 0, expected_keys=1)
    segments.publish(spark, root, [first])
    segments.publish(spark, root, [segments.write_segment(frame(spark, [(b"x", b"y", False, 2)]), root, 0)])
    rows = segments.manifest(spark, root)
    assert rows.count() == 2
    assert segments.read_segments(spark, rows, (b"a", b"b")).count() == 1
    name = rows.where(F.col("min_seq") == 1).first().segment_id
    segments.publish(spark, root, [], [name])
    left = segments.read_segments(spark, segments.manifest(spark, root))
    assert [bytes(r.key) for r in left.collect()] == [b"x"]
    assert segments.read_segments(spark, segments.manifest(spark, str(tmp_path / "none"))).count() == 0


def store(spark, root, rows, batches):
    for k in range(batches):
        log.append(frame(spark, rows[k * len(rows) // batches : (k + 1) * len(rows) // batches]), root, k)
        flush(spark, root)


def test_publish_after_a_crash_and_between_two_writers(spark, tmp_path):
    rows, root = history(7, 60), str(tmp_path / "store")
    store(spark, root, rows[:40], 2)
    # One writer died while it wrote a version in place, another before it gave its draft a name.
    os.makedirs(f"{root}/manifest/v=3")
    os.makedirs(f"{root}/manifest/_draft-x")
    assert segments.manifest(spark, root).count() == 2
    log.append(frame(spark, rows[40:]), root, 2)
    flush(spark, root)
    assert segments.current_version(spark, root) == 4 and as_dict(current(spark, root)) == model(rows)
    seg = segments.write_segment(frame(spark, rows[:1]), root, 0)
    with pytest.raises(segments.PublishConflict):
        segments.publish(spark, root, [seg], base=2)
    os.makedirs(f"{root}/a")
    os.makedirs(f"{root}/b")
    assert not files.move_new(spark, f"{root}/a", f"{root}/b") and os.path.isdir(f"{root}/a")


def test_log_is_read_and_kept_only_until_flushed(spark, tmp_path):
    rows, root = history(8, 60), str(tmp_path / "store")
    store(spark, root, rows[:40], 2)
    assert not log.batches(spark, root) and segments.flushed_to(segments.manifest(spark, root)) == 1
    # A batch that was flushed already, but not deleted, is neither read nor flushed again.
    log.append(frame(spark, rows[:20]), root, 0)
    log.append(frame(spark, rows[40:]), root, 2)
    assert log.replay(spark, root, 1).count() == 20 and as_dict(current(spark, root)) == model(rows)
    flush(spark, root)
    assert not log.batches(spark, root) and segments.manifest(spark, root).count() == 3


@pytest.mark.parametrize("drop", [False, True])
def test_cascade_over_stored_levels(spark, tmp_path, drop):
    rows, root, config = history(9, 90), str(tmp_path / "store"), Config(compaction_bytes=1, levels=3)
    store(spark, root, rows[:60], 2)
    assert compact(spark, root, config, drop_deletes=drop) == [0, 1] and compact(spark, root, config) == []
    log.append(frame(spark, rows[60:]), root, 2)
    flush(spark, root)
    assert plans.level_sizes(segments.manifest(spark, root)).count() == 2
    assert as_dict(current(spark, root)) == model(rows)
    assert compact(spark, root, Config(compaction_bytes=10**6, levels=3)) == []
    assert compact(spark, root, config, force=True, drop_deletes=drop) == [0, 1]
    left = segments.manifest(spark, root)
    assert [(r.level, r.n_deletes > 0) for r in left.collect()] == [(2, not drop)] and as_dict(current(spark, root)) == model(rows)
    gone = segments.collect_garbage(spark, root)
    assert gone and files.names(spark, f"{root}/segments") == [left.first().segment_id] and as_dict(current(spark, root)) == model(rows)


def test_keyed_reads_open_few_segments(spark, tmp_path):
    root = str(tmp_path / "store")
    put = lambda k, v, n: (k, v, v is None, n)
    for i, part in enumerate([[put(b"a", b"1", 1), put(b"c", b"2", 2)], [put(b"b", b"3", 3), put(b"c", None, 4)], [put(b"x", b"5", 5), put(b"z", b"6", 6)]]):
        log.append(frame(spark, part), root, i)
        flush(spark, root)
    log.append(frame(spark, [put(b"b", b"7", 7)]), root, 3)
    opened = lambda df: {f.rsplit("/", 2)[-2] for f in df.inputFiles() if "/segments/" in f}
    assert as_dict(get(spark, root, b"b")) == {b"b": b"7"} and len(opened(get(spark, root, b"b"))) == 2
    assert get(spark, root, b"c").count() == 0 and as_dict(get(spark, root, b"x")) == {b"x": b"5"} and len(opened(get(spark, root, b"x"))) == 1
    assert "EqualTo(key" in get(spark, root, b"x")._jdf.queryExecution().toString()
    keys = spark.createDataFrame([(bytearray(k),) for k in (b"a", b"b", b"c")], "key binary")
    assert as_dict(multi_get(spark, root, keys)) == {b"a": b"1", b"b": b"7"} and len(opened(multi_get(spark, root, keys))) == 2
    assert multi_get(spark, root, keys.limit(0)).count() == 0


def test_candidates(spark, tmp_path):
    store(spark, str(tmp_path), [(b"abc", b"abc", False, 1), (b"abc", b"ab", False, 2)], 2)
    rows = segments.manifest(spark, str(tmp_path))
    assert [plans.candidates(rows, level, n).count() for level, n in ((0, 1), (0, 11), (0, 12), (1, 0))] == [2, 2, 0, 0]
