"""Publishing whole versions, moving a stored queue, and sinks that a replayed batch does not change."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestar.sources import published, queue
from lodestar.streaming import sinks


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def fails_late(n):
    """Rows of which the last cannot be worked out, so that a write dies after files of others are there."""
    return lambda spark: spark.range(n, numPartitions=4).select(F.when(F.col("id") < n - 1, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")).alias("id"))


def test_a_write_that_dies_leaves_the_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(published.NotPublished):
        published.read(spark, path)
    assert published.publish(spark.range(5), path) == (0, [])
    before = rows(published.read(spark, path))
    with pytest.raises(Exception, match="lost"):
        published.publish(fails_late(1000)(spark), path)
    assert rows(published.read(spark, path)) == before and os.listdir(path) == ["v-000000000000"]


def test_a_job_killed_before_the_rename_leaves_the_table(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    published.publish(spark.range(5), path)
    monkeypatch.setattr(published, "_rename", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        published.publish(spark.range(9), path)
    monkeypatch.undo()
    assert published.read(spark, path).count() == 5
    assert published.publish(spark.range(9), path)[0] == 1 and published.read(spark, path).count() == 9


def test_a_taken_number_is_refused_and_old_versions_go(spark, tmp_path):
    path = f"{tmp_path}/t"
    for n in range(4):
        published.publish(spark.range(n + 1), path)
    assert published.versions(spark, path) == [2, 3]
    with pytest.raises(Exception, match="(?i)exists"):
        published.publish(spark.range(50), path, version=3)
    assert published.read(spark, path).count() == 4


def test_gates(spark, tmp_path):
    path = f"{tmp_path}/t"
    floor = lambda c: c.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("gate"), (F.col("n") >= 5).alias("ok"), F.col("n").cast("double").alias("detail"))
    assert published.publish(spark.range(7), path, floor)[0] == 0
    version, judged = published.publish(spark.range(3), path, floor)
    assert version is None and [tuple(r) for r in judged] == [("rows", False, 3.0)]
    version, judged = published.publish(spark.range(8), path, floor, most_bytes=10)
    assert version is None and [(r.gate, r.ok) for r in judged] == [("rows", True), ("bytes", False)]
    assert published.publish(spark.range(8), path, lambda c: floor(c).limit(0))[0] is None
    assert published.read(spark, path).count() == 7
    # a candidate made of the table itself
    assert published.publish(published.read(spark, path).union(spark.range(1)), path, floor)[0] == 1 and published.read(spark, path).count() == 8


def test_queue_moves(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/q"
    one = spark.createDataFrame([(i, f"o{i}") for i in range(10)], "id long, owner string")
    queue.append(one, path)
    queue.append(one.unionByName(spark.createDataFrame([(10, None)], one.schema)), path)
    decisions = spark.createDataFrame([(1, 1, "accepted"), (2, 1, "accepted"), (2, 2, "rejected"), (3, 1, "maybe"), (99, 1, "accepted"), (None, 1, "accepted")], "id long, at long, verdict string")
    state = lambda: (rows(queue.waiting(spark, path).select("id", "owner")), rows(queue.decided(spark, path).select("id", "owner", "status", "batch")))
    publish = published.publish
    monkeypatch.setattr(published, "publish", lambda *_, **__: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        queue.move(decisions, path, 1)
    monkeypatch.setattr(published, "publish", publish)
    torn = state()
    queue.move(decisions, path, 1)
    assert state() == torn
    queue.move(decisions, path, 1)
    queue.append(one, path)
    assert state() == torn == (sorted(repr((i, f"o{i}" if i < 10 else None)) for i in (0, 3, 4, 5, 6, 7, 8, 9, 10)), sorted([repr((1, "o1", "accepted", 1)), repr((2, "o2", "rejected", 1))]))
    queue.move(decisions.selectExpr("id + 3 AS id", "at", "verdict"), path, 2)
    assert queue.waiting(spark, path).count() == 7 and queue.decided(spark, path).count() == 4


def batches(spark, n):
    rng = random.Random(3)
    data = [(i, rng.randrange(300), None if i % 40 == 0 else rng.randrange(4), rng.choice("abcdef")) for i in range(n)]
    table = spark.createDataFrame(data, "event_id long, at long, user_id long, code string")
    return table, [table.where(F.col("event_id") % 6 == k) for k in range(6)]


@pytest.mark.parametrize("kind", ["newest", "history"])
def test_sinks_equal_their_batch_forms(spark, tmp_path, kind):
    table, parts = batches(spark, 400)
    sink = sinks.newest(f"{tmp_path}/s", "at", "event_id", 50, every=2) if kind == "newest" else sinks.history(f"{tmp_path}/s", "user_id", "code", "at", every=2)
    for k, part in enumerate(parts):
        sink(part, k)
        sink(part, k)
        if k:
            sink(parts[k - 1], k - 1)
    shown = sink.read(spark)
    if kind == "newest":
        assert rows(shown) == rows(table.orderBy(F.desc("at"), F.desc("event_id")).limit(50))
    else:
        want = {}
        for r in table.collect():
            n, a, b = want.get((r.user_id, r.code), (0, r.at, r.at))
            want[r.user_id, r.code] = n + 1, min(a, r.at), max(b, r.at)
        assert rows(shown) == sorted(repr((*k, *v)) for k, v in want.items())
        top = {r for u in {k[0] for k in want} for r in sorted(((k, v) for k, v in want.items() if k[0] == u), key=lambda kv: (-kv[1][2], kv[0][1]))[:2]}
        assert rows(sinks.capped(shown, "user_id", "code", 2)) == sorted(repr((*k, *v)) for k, v in top)
    assert len(published.versions(spark, f"{tmp_path}/s/parts")) <= 4


def test_a_batch_meets_the_pool_of_its_time(spark, tmp_path):
    pool, out, source = f"{tmp_path}/pool", f"{tmp_path}/out", f"{tmp_path}/in"
    schema = "code string, name string, brand string, image string, quantity string"
    published.publish(spark.createDataFrame([("1", "Milk", "A", "m.png", None), ("1", "Milk", "B", None, "1 l")], schema), pool)
    items = lambda *r: spark.createDataFrame(r, "event_id long, code string, name string, brand string").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("event_id long, code string, name string, brand string").parquet(source)
        stream.writeStream.foreachBatch(sinks.enriching(out, pool)).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    items((1, "1", None, "Own"), (2, "2", "", None), (3, None, "Said", None))
    run()
    published.publish(published.read(spark, pool).unionByName(spark.createDataFrame([("2", "Bread", "C", None, "500 g")], schema)), pool)
    items((4, "2", "", None))
    run()
    shown = published.read(spark, out, published.versions(spark, out)).select("event_id", "code", "name", "brand", "image", "quantity")
    assert [tuple(r) for r in shown.orderBy("event_id").collect()] == [(1, "1", "Milk", "Own", "m.png", None), (2, "2", "", None, None, None), (3, None, "Said", None, None, None), (4, "2", "Bread", "C", None, "500 g")]
    again = spark.read.parquet(source).where("event_id = 4")
    sinks.enriching(out, pool)(again, published.versions(spark, out)[-1])
    assert published.read(spark, out, published.versions(spark, out)).count() == 4
