"""Last writer wins against a dictionary, for any split, order and repetition of the log."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.model import MUTATION, Config
from tidemark.operators import compact, lookup, recover, resolve
from tidemark.sources.mutations import as_mutations

KEYS = [b"", b"a", b"ab", b"\x7f", b"\xff", "é".encode(), b"\x00", b"zz"]


def history(seed, n=120):
    r = random.Random(seed)
    return [(k := r.choice(KEYS), None if (gone := r.random() < 0.3) else r.choice([b"", b"x", b"\xff\x00"]), gone, i) for i in range(n)]


def model(rows):
    live = {}
    for key, value, gone, _ in sorted(rows, key=lambda x: x[3]):
        live[key] = None if gone else value
    return {k: v for k, v in live.items() if v is not None}


def frame(spark, rows):
    return spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v), d, s) for k, v, d, s in rows], MUTATION)


def as_dict(df):
    return {bytes(r["key"]): bytes(r["value"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("plan", ["aggregate", "window"])
def test_snapshot(spark, seed, plan):
    rows = history(seed)
    shuffled = rows + rows[::3]
    random.Random(seed).shuffle(shuffled)
    assert as_dict(resolve.snapshot(frame(spark, shuffled), plan)) == model(rows)


def test_tiers_levels_and_replay(spark):
    rows = history(3)
    tiers = [frame(spark, rows[80:]), frame(spark, rows[40:80]), frame(spark, rows[:40])]
    assert as_dict(resolve.overlay(tiers).where("not deleted")) == model(rows)
    assert as_dict(recover.recover(tiers[0].union(tiers[0]), tiers[2].union(tiers[1])).where("not deleted")) == model(rows)


def test_tombstones_hide_and_stay(spark):
    rows = [(b"k", b"old", False, 1), (b"k", None, True, 2), (b"e", b"", False, 3)]
    df = frame(spark, rows)
    assert as_dict(resolve.snapshot(df)) == {b"e": b""}
    assert resolve.latest(df).where("deleted").count() == 1
    assert compact.drop_tombstones(df).count() == 1
    assert lookup.get(df, bytearray(b"k")).count() == 0
    assert lookup.get(df, bytearray(b"e")).first()["value"] == b""


def test_states_and_scans(spark):
    df = frame(spark, [(b"a", b"1", False, 1), (b"b", None, True, 2), (b"\xff", b"3", False, 3)])
    keys = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"b"),), (bytearray(b"c"),), (bytearray(b"a"),)], "key binary")
    got = {bytes(r["key"]): r["state"] for r in lookup.state(df, keys).collect()}
    assert got == {b"a": "live", b"b": "deleted", b"c": "missing"}
    assert as_dict(lookup.multi_get(df, keys)) == {b"a": b"1"}
    assert as_dict(lookup.range_scan(df, bytearray(b"a"), bytearray(b"b"))) == {b"a": b"1"}
    assert as_dict(lookup.range_scan(df, bytearray(b"b"))) == {b"\xff": b"3"}
    assert as_dict(lookup.prefix_scan(df, bytearray(b"\xff"))) == {b"\xff": b"3"}
    assert [bytes(r["key"]) for r in lookup.ordered(df).collect()] == [b"a", b"b", b"\xff"]


def test_point_filter_reaches_the_scan(spark, tmp_path):
    frame(spark, history(4)).write.parquet(str(tmp_path / "log"))
    plan = lookup.get(spark.read.parquet(str(tmp_path / "log")), bytearray(b"a"))._jdf.queryExecution().toString()
    assert "EqualTo(key" in plan


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", None, 1, None), ("b", "x", 2, True), ("c", "x", 3, None)], "k string, v string, s long, d boolean")
    got = as_mutations(df, key=F.col("k"), value=F.col("v"), seq=F.col("s"), deleted=F.col("d"))
    assert {r["key"]: r["deleted"] for r in got.collect()} == {"a": True, "b": True, "c": False}
    empty = spark.createDataFrame([], MUTATION)
    assert resolve.snapshot(empty).count() == 0 and resolve.latest(empty, "window").count() == 0


def test_config(tmp_path):
    assert Config().levels == 4 and Config.from_dict({"levels": 2}).levels == 2
    (tmp_path / "c").write_text("# levels\nlevels: 3  # three\n\ncompaction_bytes: 1000\n")
    assert Config.from_file(str(tmp_path / "c")) == Config(1000, 3)
    for bad in ({"no_such": 1}, {"levels": -1}, {"levels": 1}):
        with pytest.raises(ValueError):
            Config.from_dict(bad)


def test_utf8(spark):
    assert spark.range(1).select(codec.utf8(F.unhex(F.lit("FF"))).alias("x")).first().x is None
