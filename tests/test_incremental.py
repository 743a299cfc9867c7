import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import incremental as I

STATE = "state_id long, path string, status string, hash string, topic string, size long, mtime_ns long, retry_count int, error string, timestamp string, logged_at timestamp"
LISTING = "listing_id long, path string, topic string, hash string, size long, mtime_ns long, seen_at timestamp"


def state(spark, *rows):
    return spark.createDataFrame([(i, p, s, h, "T", 1, 1, 0, None, t, dt.datetime(2025, 1, 1)) for i, (p, s, h, t) in enumerate(rows)], STATE)


def listing(spark, *rows):
    return spark.createDataFrame([(i, p, "T", h, 1, 1, dt.datetime(2025, 1, d)) for i, (p, h, d) in enumerate(rows)], LISTING)


def due(spark, s, f):
    return sorted(r.path for r in I.new_or_changed(s, f).select("path").collect())


def test_what_is_due(spark):
    s = state(
        spark,
        ("same", "success", " ABC", "2025-01-01T00:00:00Z"), ("changed", "success", "a", "2025-01-01 00:00:00"), ("failed", "failed", "a", "2025-01-01T00:00:00"),
        ("broken", "success", "a", "2025-01-01T00:00:00"), ("broken", "processing", "b", "2025-01-02T00:00:00"), ("broken", "failed", None, "2025-01-03T00:00:00"),
        ("offset", "success", "new", "2025-01-02T00:00:00+09:00"), ("offset", "success", "old", "2025-01-01T10:00:00"), ("unreadable", "success", "a", "2025-01-01T00:00:00"),
        ("guía", "success", "x", "2025-01-01T00:00:00"), (None, "success", "x", "2025-01-01T00:00:00"),
    )
    f = listing(
        spark, ("same", "abc ", 1), ("changed", "b", 1), ("failed", "a", 1), ("broken", "a", 1), ("offset", "new", 1), ("unreadable", None, 2), ("unreadable", "z", 1),
        ("guía", "x", 1), ("never", "q", 1), ("never", "q", 1), (None, "q", 1),
    )
    # 01-02 00:00+09:00 is 01-01 15:00 UTC, after 10:00.
    assert due(spark, s, f) == ["changed", "failed", "never"]


def test_empty_tables(spark):
    assert due(spark, state(spark).limit(0), listing(spark, ("a", "h", 1))) == ["a"]
    assert due(spark, state(spark, ("a", "success", "h", "2025-01-01T00:00:00")), listing(spark).limit(0)) == []


def test_ties_and_clashing_columns(spark):
    rows = spark.createDataFrame([("k", 1, "a", "x"), ("k", 1, "b", "y"), ("k", None, "c", "z")], "key string, at int, v string, _v string")
    assert I.latest_by(rows, ["key"], [F.col("at")], ["v", "_v"]).collect() == [("k", "b", "y")]


SCHEMA = "path string, version string, made string"


def test_runs_skip_and_repeat_nothing(spark, tmp_path):
    root = str(tmp_path / "target")
    src = lambda *r: spark.createDataFrame(list(r), "path string, version string")
    make = lambda d: d.withColumn("made", F.concat("path", F.lit("@"), "version"))
    got = lambda d: sorted(tuple(r) for r in d.collect())
    assert got(I.advance(src(("a", "1"), ("b", "1")), root, SCHEMA, "path", "version", make)) == [("a", "1", "a@1"), ("b", "1", "b@1")]
    before = I.current_version(spark, root)

    def breaks(d):
        return make(d).withColumn("made", F.raise_error(F.lit("lost executor")).cast("string"))

    with pytest.raises(Exception):
        I.advance(src(("a", "2"), ("b", "1"), ("c", "1")), root, SCHEMA, "path", "version", breaks)
    assert I.current_version(spark, root) == before  # nothing published
    worked = []
    done = I.advance(src(("a", "2"), ("b", "1"), ("c", "1")), root, SCHEMA, "path", "version", lambda d: worked.extend(sorted(r.path for r in d.collect())) or make(d))
    assert worked == ["a", "c"]  # b is not done again
    assert got(done) == [("a", "2", "a@2"), ("b", "1", "b@1"), ("c", "1", "c@1")]
    I.advance(src(("a", "2"), ("b", "1"), ("c", "1")), root, SCHEMA, "path", "version", lambda d: worked.append(d.count()) or make(d))
    assert worked[-1] == 0


def test_records_without_rows_null_keys_and_concurrent_runs(spark, tmp_path):
    root = str(tmp_path / "target")
    src = spark.createDataFrame([("a", "1"), ("none", "1"), (None, "1"), ("two", "1"), ("blank", None)], "path string, version string")
    worked = []

    def process(d):
        worked.append(sorted(r.path for r in d.collect()))
        d = d.where("path <> 'none'").withColumn("made", F.lit("x"))
        return d.unionByName(d.where("path = 'two'"))

    for _ in range(3):
        out = I.advance(src, root, SCHEMA, "path", "version", process)
    assert worked == [["a", "blank", "none", "two"], [], []]
    assert sorted(r.path for r in out.collect()) == ["a", "blank", "two", "two"]
    assert I.current_version(spark, root) == 1
    more = src.unionByName(spark.createDataFrame([("b", "1")], "path string, version string"))

    def raced(d):
        I.advance(more, root, SCHEMA, "path", "version", process)
        return process(d)

    with pytest.raises(I.ConcurrentRun):
        I.advance(more, root, SCHEMA, "path", "version", raced)
    assert sorted(r.path for r in I.read_target(spark, root, SCHEMA).collect()) == ["a", "b", "blank", "two", "two"]


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = str(tmp_path / "target")
    make = lambda d: d.withColumn("made", F.col("version"))
    rows = [(f"k{i}", "1") for i in range(200)]
    I.advance(spark.createDataFrame(rows, "path string, version string"), root, SCHEMA, "path", "version", make)
    one = I._read_manifest(spark, root, 1)["data"]
    out = I.advance(spark.createDataFrame([*rows[1:], ("k0", "2")], "path string, version string"), root, SCHEMA, "path", "version", make)
    two = I._read_manifest(spark, root, 2)["data"]
    assert sum(one[b] != two[b] for b in one) == 1 and out.count() == 200 and out.where("version = '2'").count() == 1
