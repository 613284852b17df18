"""Keyed tables that batches are merged into, and streams that write to them."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.streaming import windows
from millrace.streaming.merge import KeyedTable

ROWS = "k string, `o.o` int, v string, op string"


def state(table):
    return {r.k: (r["o.o"], r.v) for r in table.read().collect()}


def test_the_last_row_of_each_key_stays(spark, tmp_path):
    r = random.Random(4)
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], ["o.o"], buckets=5, removed="op = 'D'")
    assert table.read() is None
    want = {}
    for n in range(4):
        batch = [(r.choice([None, *"abcdefgh"]), r.randrange(6), f"v{n}-{i}", r.choice("UUD")) for i in range(30)]
        table.merge(spark.createDataFrame(batch, ROWS), n, "s")
        for k in {b[0] for b in batch}:
            best = max((b for b in batch if b[0] == k), key=lambda b: (b[1], b[2], b[3]))
            if k not in want or best[1] >= want[k][1]:
                want[k] = best
        assert state(table) == {k: b[1:3] for k, b in want.items() if b[3] != "D"}
    before = state(table)
    table.merge(spark.createDataFrame([("a", 99, "again", "U")], ROWS), 2, "s")  # a batch that was merged already
    assert state(table) == before
    table.merge(spark.createDataFrame([("a", 99, "other", "U")], ROWS), 0, "another stream")
    assert state(table)["a"] == (99, "other")
    assert table.vacuum() >= 1 and table.vacuum() == 0 and state(table)["a"] == (99, "other")


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], ["o.o"], buckets=16)
    table.merge(spark.createDataFrame([(f"k{i}", 1, "v", "U") for i in range(200)], ROWS), 0)
    first = table.manifest()["folders"]
    table.merge(spark.createDataFrame([("k7", 2, "w", "U")], ROWS), 1)
    second = table.manifest()["folders"]
    assert sum(first[b] != second[b] for b in first) == 1 and len(first) == len(second)
    assert table.read().count() == 200


def test_a_failure_loses_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], ["o.o"], buckets=2)
    table.merge(spark.createDataFrame([("a", 1, "v", "U"), ("b", 1, "v", "U")], ROWS), 0)
    before = state(table)
    broken = spark.createDataFrame([("a", 2, "w", "U")], ROWS).withColumn("v", F.expr("raise_error('lost')").cast("string"))
    with pytest.raises(Exception, match="lost"):
        table.merge(broken, 1)
    assert state(table) == before and table.manifest()["version"] == 1
    lost = tmp_path / "t" / next(iter(table.manifest()["folders"].values())).split("/_bucket")[0]
    lost.rename(tmp_path / "elsewhere")
    with pytest.raises(Exception):  # rows that can't be read are an error, not an empty table
        table.merge(spark.createDataFrame([("a", 3, "x", "U"), ("b", 3, "x", "U")], ROWS), 1)
    (tmp_path / "elsewhere").rename(lost)
    assert state(table) == before
    table.merge(spark.createDataFrame([("a", 2, "w", "U")], ROWS), 1)
    assert state(table) == before | {"a": (2, "w")}


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    source, place = tmp_path / "in", tmp_path / "t"
    table = KeyedTable(spark, str(place), ["k"], ["o.o"], buckets=4)

    def run():
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(source))
        return windows.merged_batches(stream, table, str(tmp_path / "checkpoint"))

    for n in range(3):
        spark.createDataFrame([("a", n, f"v{n}", "U"), (f"only{n}", 0, "x", "U")], ROWS).coalesce(1).write.mode("append").parquet(str(source))
        assert {r.k: r.v for r in run().collect()} == {"a": f"v{n}", **{f"only{i}": "x" for i in range(n + 1)}}
    version = table.manifest()["version"]
    run()
    assert table.manifest()["version"] == version


def test_late_rows_are_dropped_and_state_goes(spark, tmp_path):
    source = tmp_path / "in"
    schema = "event_id int, ts timestamp, event_type string, value double"

    def add(*rows):
        spark.createDataFrame([(i, F_ts(t), "x", 1.0) for i, t in rows], "event_id int, t string, event_type string, value double").select(
            "event_id", F.col("t").cast("timestamp").alias("ts"), "event_type", "value"
        ).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(source)).withWatermark("ts", "1 hour")
        w = stream.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
        out = windows.updated(w.select(F.col("w.start").alias("start"), "n"), ["start"], str(tmp_path / "state"))
        return {r.start.hour: r.n for r in out.collect()}

    F_ts = lambda t: f"2024-01-01 {t}"
    add((1, "01:10:00"), (2, "01:20:00"), (3, "05:00:00"))
    assert run() == {1: 2, 5: 1}
    add((4, "05:30:00"), (5, "01:30:00"))  # the second comes after the watermark, 04:00
    assert run() == {1: 2, 5: 2}
