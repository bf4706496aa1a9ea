"""The registered queries: each operator over a driver table read as a mutation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..model import Config
from ..operators import compact, lookup, resolve
from ..operators.recover import recover
from ..sources import mutations as log
from ..sources import segments
from ..sources.files import shared_folder
from ..sources.mutations import as_mutations
from ..streaming import ingest as store
from ..streaming.ingest import current, ingest

#: Log batches of the stores that queries write; each is flushed as a segment.
BATCHES = 4
CONFIG = Config(compaction_bytes=4096, levels=3)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events log: users' properties, deleted by an error."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "props")
    return as_mutations(e, key=F.col("user_id").cast("string"), value=F.col("props"), seq=F.col("event_id"),
                        deleted=F.col("event_type") == "error")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders log: customers' last priority, deleted by a pending order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return as_mutations(o, key=F.col("o_custkey").cast("string"), value=F.col("o_orderpriority"), seq=F.col("o_orderkey"),
                        deleted=F.col("o_orderstatus") == "P")


_stores: dict = {}


def _store(spark: SparkSession, sf_dir: str, label: str = "read") -> str:
    """A store of the events log in ``BATCHES`` level-0 segments of neighbouring seq; written once a session for each label."""
    name = (spark.sparkContext.applicationId, sf_dir, label)
    if name not in _stores:
        root, rows = shared_folder(spark, "store"), events(spark, sf_dir)
        rows = rows.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "deleted", "seq")
        top = (rows.agg(F.max("seq")).first()[0] or 0) + 1
        for k in range(BATCHES):
            log.append(rows.where((F.col("seq") >= top * k // BATCHES) & (F.col("seq") < top * (k + 1) // BATCHES)), root, k)
            store.flush(spark, root)
        _stores[name] = root
    return _stores[name]


def _text(entries: DataFrame) -> DataFrame:
    return entries.withColumns({"key": codec.utf8(F.col("key")), "value": codec.utf8(F.col("value"))})


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments.manifest(spark, _store(spark, sf_dir))
    return rows.select("level", "n_entries", "n_deletes", "size_bytes", codec.utf8(F.col("min_key")).alias("min_key"),
                       codec.utf8(F.col("max_key")).alias("max_key"), "min_seq", "max_seq")


def _level(spark: SparkSession, root: str, level: int) -> DataFrame:
    rows = segments.manifest(spark, root).where(F.col("level") == level)
    return _text(segments.read_segments(spark, rows)).withColumn("level", F.lit(level))


def _compacted(how):
    """A query over a store of its own after a compaction."""
    def run(spark, sf_dir):
        return how(spark, _store(spark, sf_dir, how.__name__))

    return run


@_compacted
def _level0(spark, root):
    store.compact_level(spark, root, 0)
    return _level(spark, root, 1)


@_compacted
def _cascade(spark, root):
    store.compact(spark, root, CONFIG, force=True)
    return _level(spark, root, CONFIG.levels - 1)


@_compacted
def _collected(spark, root):
    store.compact(spark, root, CONFIG, force=True, drop_deletes=True)
    segments.collect_garbage(spark, root)
    return _level(spark, root, CONFIG.levels - 1).select("key", "value", "seq")


def _store_multi_get(spark, sf_dir):
    keys = wanted(spark, sf_dir).select(F.col("key").cast("binary").alias("key"))
    return _text(store.multi_get(spark, _store(spark, sf_dir), keys))


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys to look up: customers of one market segment."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_mktsegment = 'BUILDING'")
    return c.select(F.col("c_custkey").cast("string").alias("key"))


def _point(key: str):
    def run(spark, sf_dir):
        log = events(spark, sf_dir)
        return lookup.state(log.where(F.col("key") == key), spark.createDataFrame([(key,)], "key string"))

    return run


def _overlay(spark, sf_dir):
    log = orders(spark, sf_dir)
    # Newest tier first; the slices of seq do not overlap.
    top = log.agg(F.max("seq")).first()[0] or 0
    cuts = [top * 2 // 3, top // 3]
    tiers = [log.where(F.col("seq") > cuts[0]), log.where((F.col("seq") <= cuts[0]) & (F.col("seq") > cuts[1])), log.where(F.col("seq") <= cuts[1])]
    return resolve.overlay(tiers).where(~F.col("deleted")).select("key", "value", "seq")


def _replayed(spark, sf_dir):
    log = orders(spark, sf_dir)
    late = log.where(F.col("seq") % 3 == 0)
    return recover(log.where(F.col("seq") % 2 == 0).unionByName(late).unionByName(late), log.where(F.col("seq") % 2 == 1)).where(
        ~F.col("deleted")).select("key", "value", "seq")


def _stream(spark, sf_dir):
    root = shared_folder(spark, "stream")
    names = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(names).parquet(f"{sf_dir}/events.parquet*")
    rows = as_mutations(stream, key=F.col("user_id").cast("string").cast("binary"), value=F.col("props").cast("binary"),
                        seq=F.col("event_id"), deleted=F.col("event_type") == "error")
    ingest(rows, root, f"{root}/stream-checkpoint").awaitTermination()
    store.compact_level(spark, root, 0)
    return _text(current(spark, root))


QUERIES = {
    "mutation_log": events,
    "lww_snapshot": lambda s, d: resolve.snapshot(events(s, d)),
    "lww_snapshot_orders": lambda s, d: resolve.snapshot(orders(s, d)),
    "lww_snapshot_window": lambda s, d: resolve.snapshot(orders(s, d), "window"),
    "lww_with_tombstones": lambda s, d: resolve.latest(events(s, d)),
    "point_get": _point("1"),
    "point_get_deleted": _point("5"),
    "point_get_missing": _point("no such key"),
    "multi_get": lambda s, d: lookup.multi_get(orders(s, d), wanted(s, d)),
    "multi_get_states": lambda s, d: lookup.state(orders(s, d), wanted(s, d)),
    "range_scan": lambda s, d: lookup.range_scan(orders(s, d), "1", "2"),
    "prefix_scan": lambda s, d: lookup.prefix_scan(orders(s, d), "12"),
    "ordered_scan": lambda s, d: lookup.ordered(resolve.latest(events(s, d))),
    "live_key_count": lambda s, d: resolve.latest(orders(s, d)).agg(
        F.count("*").alias("n_keys"), F.coalesce(F.sum((~F.col("deleted")).cast("long")), F.lit(0)).alias("n_live")),
    "key_version_stats": lambda s, d: resolve.key_versions(orders(s, d)),
    "run_merge": lambda s, d: _text(segments.read_segments(s, segments.manifest(s, _store(s, d)))),
    "segment_stats": _manifest,
    "level_sizes": lambda s, d: compact.level_sizes(_manifest(s, d)),
    "compaction_candidates": lambda s, d: compact.candidates(_manifest(s, d), 0, CONFIG.compaction_bytes),
    "compact_level0": _level0,
    "compact_cascade": _cascade,
    "compact_gc_bottom": _collected,
    "store_get": lambda s, d: _text(store.get(s, _store(s, d), b"1")),
    "store_multi_get": _store_multi_get,
    "recover_replay": _replayed,
    "tier_overlay": _overlay,
    "stream_snapshot": _stream,
}

_EVENTS = ("e AS (SELECT user_id::VARCHAR AS key, CASE WHEN event_type <> 'error' THEN props END AS value, "
           "event_type = 'error' OR props IS NULL AS deleted, event_id AS seq FROM events)")
_ORDERS = ("o AS (SELECT o_custkey::VARCHAR AS key, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS value, "
           "o_orderstatus = 'P' OR o_orderpriority IS NULL AS deleted, o_orderkey AS seq FROM orders)")
_WANTED = "k AS (SELECT c_custkey::VARCHAR AS key FROM customer WHERE c_mktsegment = 'BUILDING')"


def _latest(log: str, where: str = "true", by: str = "key") -> str:
    return f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY seq DESC) AS n FROM {log} WHERE {where}) WHERE n = 1"


def _live(log: str, where: str = "true") -> str:
    return f"SELECT key, value, seq FROM ({_latest(log, where)}) WHERE NOT deleted"


def _state(log: str, keys: str) -> str:
    return (f"SELECT k.key, l.value, CASE WHEN l.deleted THEN 'deleted' WHEN l.key IS NOT NULL THEN 'live' ELSE 'missing' END AS state "
            f"FROM (SELECT DISTINCT key FROM {keys}) k LEFT JOIN ({_latest(log)}) l ON l.key = k.key")


_SEGMENTS = (f"{_EVENTS}, c AS (SELECT *, (SELECT max(event_id) + 1 FROM events) AS top FROM e), "
             f"p AS (SELECT key, value, deleted, seq, (SELECT max(k) FROM range({BATCHES}) t(k) WHERE seq >= top * k // {BATCHES}) AS batch FROM c), "
             f"s AS (SELECT 0 AS level, * FROM ({_latest('p', by='batch, key')}))")
_SIZE = "octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0)"
_STATS = (f"SELECT level, count(*) AS n_entries, sum(deleted::INT)::BIGINT AS n_deletes, sum({_SIZE})::BIGINT AS size_bytes, "
          "min(key) AS min_key, max(key) AS max_key, min(seq) AS min_seq, max(seq) AS max_seq FROM s GROUP BY level, batch")

SQL = {
    "mutation_log": f"WITH {_EVENTS} SELECT * FROM e",
    "lww_snapshot": f"WITH {_EVENTS} {_live('e')}",
    "lww_snapshot_orders": f"WITH {_ORDERS} {_live('o')}",
    "lww_snapshot_window": f"WITH {_ORDERS} {_live('o')}",
    "lww_with_tombstones": f"WITH {_EVENTS} {_latest('e')}",
    "point_get": f"WITH {_EVENTS} {_state('e', "(SELECT '1' AS key)")}",
    "point_get_deleted": f"WITH {_EVENTS} {_state('e', "(SELECT '5' AS key)")}",
    "point_get_missing": f"WITH {_EVENTS} {_state('e', "(SELECT 'no such key' AS key)")}",
    "multi_get": f"WITH {_ORDERS}, {_WANTED} {_live('o', 'key IN (SELECT key FROM k)')}",
    "multi_get_states": f"WITH {_ORDERS}, {_WANTED} {_state('o', 'k')}",
    "range_scan": f"WITH {_ORDERS} {_live('o', "key >= '1' AND key < '2'")}",
    "prefix_scan": f"WITH {_ORDERS} {_live('o', "starts_with(key, '12')")}",
    "ordered_scan": f"WITH {_EVENTS} {_latest('e')} ORDER BY encode(key)",
    "live_key_count": f"WITH {_ORDERS} SELECT count(*) AS n_keys, coalesce(sum((NOT deleted)::INT), 0)::BIGINT AS n_live FROM ({_latest('o')})",
    "key_version_stats": f"WITH {_ORDERS} SELECT key, count(*) AS n_versions, sum((NOT deleted)::INT)::BIGINT AS n_puts, "
                         "sum(deleted::INT)::BIGINT AS n_deletes, min(seq) AS first_seq, max(seq) AS last_seq FROM o GROUP BY key",
    "run_merge": f"WITH {_SEGMENTS} SELECT key, value, deleted, seq FROM s",
    "segment_stats": f"WITH {_SEGMENTS} {_STATS}",
    "level_sizes": f"WITH {_SEGMENTS}, t AS ({_STATS}) SELECT level, count(*) AS n_segments, sum(size_bytes)::BIGINT AS size_bytes, "
                   "sum(n_entries)::BIGINT AS n_entries FROM t GROUP BY level",
    "compaction_candidates": f"WITH {_SEGMENTS}, t AS ({_STATS}) SELECT * FROM t WHERE (SELECT sum(size_bytes) FROM t) >= {CONFIG.compaction_bytes}",
    "compact_level0": f"WITH {_EVENTS} SELECT *, 1 AS level FROM ({_latest('e')})",
    "compact_cascade": f"WITH {_EVENTS} SELECT *, {CONFIG.levels - 1} AS level FROM ({_latest('e')})",
    "compact_gc_bottom": f"WITH {_EVENTS} {_live('e')}",
    "store_get": f"WITH {_EVENTS} {_live('e', "key = '1'")}",
    "store_multi_get": f"WITH {_EVENTS}, {_WANTED} {_live('e', 'key IN (SELECT key FROM k)')}",
    "recover_replay": f"WITH {_ORDERS} {_live('o')}",
    "tier_overlay": f"WITH {_ORDERS} {_live('o')}",
    "stream_snapshot": f"WITH {_EVENTS} {_live('e')}",
}
