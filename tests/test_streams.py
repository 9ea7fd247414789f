"""Stateful streams against their batch forms: any order of arrival, several files, and no state left."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import events as ev
from lodestar.streaming import feed, replay

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def rows(spark, n, seed):
    rng = random.Random(seed)
    data = [(i, 1_700_000_000_000_000 + rng.randrange(6 * 3600 * 10**6) // 7_000_000 * 7_000_000, None if i % 50 == 0 else 0 if i % 3 == 0 else rng.randrange(6), rng.choice("ab")) for i in range(n)]
    return spark.createDataFrame(data, "event_id long, t long, user_id long, event_type string").select("event_id", F.timestamp_micros("t").alias("ts"), "user_id", "event_type")


def run(spark, folder, table, rule):
    """The rows in four files in no order, each read by itself, then a mark that lies behind all windows."""
    replay.durable(spark)
    shuffled = table.withColumn("f", F.pmod(F.xxhash64("event_id", F.lit(7)), F.lit(4)))
    for k in range(4):
        shuffled.where(F.col("f") == k).drop("f").orderBy(F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    end = table.agg((F.max("ts") + F.expr("INTERVAL 5 days")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("event_type"))
    source = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withWatermark("ts", "7 hours").where("event_id >= 0 OR ts IS NULL")
    last = None
    for close in (False, True):
        if close:
            end.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        query = rule(source()).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        last = [p for p in query.recentProgress if p["stateOperators"]][-1]
    return spark.read.parquet(f"{folder}/out"), [s["numRowsTotal"] for s in last["stateOperators"]]


def compare(a, b):
    assert sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.collect())))


@pytest.mark.parametrize("case", ["anchored", "limited", "throttled", "chained"])
def test_streams_equal_their_batch_forms(spark, tmp_path, case):
    table = rows(spark, 500, 5)
    if case == "anchored":
        got, left = run(spark, tmp_path, table, lambda s: feed.anchored_dedupe_stream(s, 1200))
        compare(got.select("user_id", "event_type", "event_id"), ev.anchored_dedupe(table, ["user_id", "event_type"], "ts", "event_id", 1200))
    elif case == "limited":
        got, left = run(spark, tmp_path, table, lambda s: feed.rate_limited_stream(s, "user_id", 2, 60))
        compare(got.select("event_id", "allowed"), ev.rate_limited(table, "user_id", "ts", ["event_id"], 2, 60).select("event_id", "allowed"))
        assert got.where("NOT allowed").count() > 50
    elif case == "throttled":
        got, left = run(spark, tmp_path, table, lambda s: feed.throttled_stream(s, "user_id", 900, 6))
        compare(got.select("event_id", "recent", "throttled"), ev.throttled(table, "user_id", "ts", 900, 6).select("event_id", "recent", "throttled"))
    else:
        both = lambda s: replay.replayed(feed.rate_limited_stream(s, "user_id", 1, 40).where("allowed"), ["user_id"], "ts", "event_id", replay.Anchored(600))
        got, left = run(spark, tmp_path, table, both)
        kept = ev.rate_limited(table, "user_id", "ts", ["event_id"], 1, 40).where("allowed")
        compare(got.select("user_id", "event_id"), ev.anchored_dedupe(kept, ["user_id"], "ts", "event_id", 600).select("user_id", "event_id"))
    assert set(left) == {0}, left


def test_rules_by_hand():
    second = replay.MICROS
    rule = replay.Anchored(10)
    assert rule([(0, 1), (5 * second, 2), (10 * second, 3), (19 * second, 4)], []) == ([(1, 0), (3, 10 * second)], [10 * second], 20 * second)
    out, carry, _ = replay.Throttled(10, 1)([(0, 1), (0, 2), (10 * second, 3), (11 * second, 4)], [])
    assert [(i, n, many) for i, _, n, many in out] == [(1, 2, True), (2, 2, True), (3, 3, True), (4, 2, True)] and carry == [10 * second, 11 * second]
