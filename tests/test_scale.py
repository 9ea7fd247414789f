"""Operators that must not gather a group, against brute force."""

import math
import random

from pyspark.sql import functions as F

from lodestar.operators import brands, events, gates, places, rank, store_upsert


def test_quantiles_of_many_values_in_one_group(spark):
    n = 1_000_000
    rows = spark.range(n).selectExpr("IF(id < 999000, 'big', IF(id < 999990, 'small', null)) AS g", "cast((id * 7919) % 1000003 AS double) + 0.25 AS v")
    got = {r.g: (r.n, r.q_1, r.q_50, r.q_99) for r in gates.floor_quantiles(rows, ["g"], "v", [0.01, 0.5, 0.99]).collect()}
    values = {}
    for i in range(n):
        values.setdefault("big" if i < 999000 else "small" if i < 999990 else None, []).append((i * 7919) % 1000003 + 0.25)
    for g, v in values.items():
        v.sort()
        assert got[g] == (len(v), *(v[math.floor(len(v) * f)] for f in (0.01, 0.5, 0.99)))


def test_quantiles_with_heavy_values(spark):
    rows = spark.range(9000).selectExpr("1 AS g", "IF(id % 3 = 0, 5.0D, cast(id % 100 AS double)) AS v")
    v = sorted(5.0 if i % 3 == 0 else float(i % 100) for i in range(9000))
    r = gates.floor_quantiles(rows, ["g"], "v", [0.0, 0.1, 0.9, 1.0]).first()
    assert (r.n, r.q_0, r.q_10, r.q_90, r.q_100) == (9000, v[0], v[900], v[8100], v[-1])
    assert gates.floor_quantiles(rows.limit(0), ["g"], "v", [0.5]).count() == 0


def test_numbers_rows_of_hot_groups(spark):
    rows = spark.range(5000).selectExpr("IF(id % 3 = 0, null, id % 2) AS g", "(id * 7919) % 5003 DIV 4 AS v", "id")
    got = {r.id: r.place for r in rank.numbered(rows, ["g"], F.col("v"), ["v", "id"], "place").collect()}
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.g, []).append((r.v, r.id))
    assert got == {i: k for g in groups.values() for k, (_, i) in enumerate(sorted(g), 1)}


def test_numbers_ties_in_ranges_of_their_own(spark):
    data = [(i, 5.0 if i % 10 else [4.0, 9.0, None][i % 3], None if i % 97 == 0 else i * 7919 % 4001) for i in range(4000)]
    rows = spark.createDataFrame(data, "id long, v double, w long")
    order = [F.asc_nulls_last("v"), F.asc_nulls_last("w"), "id"]
    got = {r.id: r.place for r in rank.numbered(rows, [], F.col("v"), order, "place", F.col("w")).collect()}
    last = lambda x: (x is None, x or 0)
    assert got == {i: k for k, (i, *_) in enumerate(sorted(data, key=lambda r: (last(r[1]), last(r[2]), r[0])), 1)}
    # nine rows of ten are equal, and no task sorts a tenth of them
    sizes = rank.in_ranges(rows, [], F.col("v"), F.col("w")).groupBy("range_").count().agg(F.max("count")).first()[0]
    assert sizes < 400


def test_first_two_of_a_hot_group(spark):
    rows = spark.range(3000).selectExpr("IF(id % 3 = 0, 'hot', concat('g', id % 5)) AS g", "IF(id % 7 = 0, null, concat('b', id % 400)) AS b").unionByName(spark.createDataFrame([(None, "x"), ("one", "y")], "g string, b string"))
    want = {}
    for r in rows.collect():
        if r.g is not None and r.b is not None:
            want.setdefault(r.g, set()).add(r.b)
    assert {r.g: (r.firsts, r.n) for r in rank.first_two(rows, "g", "b").collect()} == {g: (sorted(v)[:2], len(v)) for g, v in want.items()}


def test_one_long_phrase_adds_one_length(spark):
    rows = spark.createDataFrame([("brand one", "A", 1), (" ".join(f"w{i}" for i in range(40)), "B", 2)], "alias string, brand string, ord int")
    titles = spark.createDataFrame([(1, "x brand one " + "y " * 50), (2, "z " + " ".join(f"W{i}" for i in range(40)))], "k long, t string")
    assert brands.lengths_of(rows.withColumnRenamed("alias", "phrase")) == [2, 40]
    assert {r.k: r.brand for r in brands.phrase_match(titles, "k", "t", rows).collect()} == {1: "A", 2: "B"}
    assert brands.phrase_match(titles, "k", "t", rows.limit(0)).count() == 0


def test_first_cells_hold_about_what_is_asked(spark):
    stores = spark.range(20000).selectExpr("id % 2 AS city", "IF(id % 2 = 0, 40.0D, 10.0D) + (id * 7919 % 10007) / 10007.0D * IF(id % 2 = 0, 1, 0.2D) AS lat", "20.0D + (id * 104729 % 10009) / 10009.0D * IF(id % 2 = 0, 1, 0.2D) AS lng")
    sizes = {r.city: r.size_ for r in places.first_cells(stores, ["city"], 3).collect()}
    # a block 25 times as dense starts with cells a fifth as wide, and the nine cells hold less than eight times the three stores
    assert 4.9 < sizes[0] / sizes[1] < 5.1
    assert 9 * sizes[0] ** 2 * 10000 < 8 * 3


def test_pages_and_samples(spark):
    rows = spark.range(100)
    assert [r.id for r in rank.page(rows, ["id"], 2, 40, 90).collect()] == list(range(80, 90))
    assert rank.page(rows, ["id"], 5, 40, 90).count() == 0
    first = {r.id for r in rank.top_sample(rows, "id", 30, 1).collect()}
    assert len(first) == 30 and first == {r.id for r in rank.top_sample(rows, "id", 30, 1).collect()} != {r.id for r in rank.top_sample(rows, "id", 30, 2).collect()}


def km(a, b):
    y, x = math.radians(b[0] - a[0]), math.radians(b[1] - a[1])
    h = math.sin(y / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(x / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(h, 1.0)))


def test_nearest_against_brute_force(spark):
    rng = random.Random(3)
    stores = [(i, i % 3, None if i % 11 == 0 else rng.uniform(-60, 60), None if i % 11 == 0 else rng.choice([rng.uniform(10, 11), rng.uniform(-170, 170)])) for i in range(120)] + [(900, 7, None, None), (901, 7, 1.0, 1.0), (902, 7, None, None), (903, 7, None, None)]
    points = [(i, rng.choice([0, 1, 2, 7, 8]), None if i % 13 == 0 else rng.uniform(-60, 60), None if i % 13 == 0 else rng.uniform(9, 12)) for i in range(80)]
    got = {}
    frame = places.nearest(spark.createDataFrame(points, "point int, city int, lat0 double, lng0 double"), spark.createDataFrame(stores, "sid int, city int, lat double, lng double"), ["city"], 3)
    for r in frame.collect():
        got.setdefault(r.point, []).append((r.place, r.sid))
    want = {}
    for p, city, y, x in points:
        near = sorted((math.inf if y is None or sy is None else round(km((y, x), (sy, sx)), 6), s) for s, c, sy, sx in stores if c == city)[:3]
        if near:
            want[p] = [(k, s) for k, (_, s) in enumerate(near, 1)]
    assert {p: sorted(v) for p, v in got.items()} == want


def test_greedy_merge_against_brute_force(spark):
    rng = random.Random(5)
    stores = [(i, "c", None if i % 17 == 0 else 42 + rng.random() / 2, None if i % 17 == 0 else 21 + rng.random() / 2) for i in range(150)]
    kept, want = [], {}
    for s, _, y, x in stores:
        near = [k for k, ky, kx in kept if y is not None and ky is not None and km((ky, kx), (y, x)) <= 5]
        want[s] = near[0] if near else s
        if not near:
            kept.append((s, y, x))
    frame = spark.createDataFrame(stores, "sid long, chain string, lat double, lng double")
    assert {r.sid: r.merged_into for r in store_upsert.greedy_merge(frame, ["chain"], 5.0).collect()} == want


def test_greedy_merge_of_a_long_line_and_of_blocks(spark):
    line = spark.range(4000).selectExpr("id AS sid", "'a-b' AS chain", "42.0D + id * 0.0009D AS lat", "21.0D AS lng").unionByName(spark.createDataFrame([(9000, "a b", 42.0, 21.0), (9001, None, 42.0, 21.0), (9002, None, 42.0, 21.0)], "sid long, chain string, lat double, lng double"))
    got = {r.sid: r.merged_into for r in store_upsert.greedy_merge(line, ["chain"], 0.12).collect()}
    # neighbours lie 100 m apart: every other store is kept
    assert got == {**{i: i - i % 2 for i in range(4000)}, 9000: 9000, 9001: 9001, 9002: 9002}


def test_throttle_spreads_a_busy_client(spark):
    rng = random.Random(8)
    data = [(i, None if i % 90 == 0 else 0 if i % 3 else rng.randrange(3), None if i % 70 == 0 else rng.randrange(-400, 400)) for i in range(600)]
    rows = spark.createDataFrame(data, "id long, client long, s long").withColumn("at", F.timestamp_seconds("s"))
    got = {r.id: (r.recent, r.throttled) for r in events.throttled(rows, "client", "at", 20, 5).collect()}
    near = lambda c, t: sum(1 for _, d, u in data if c == d and (t is None and u is None or t is not None and u is not None and t - 20 <= u <= t))
    assert got == {i: (near(c, t), near(c, t) > 5) for i, c, t in data}
    plan = events.throttled(rows, "client", "at", 20, 5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(client" in plan and "span_" in [p for p in plan.splitlines() if "hashpartitioning" in p][0]


def counting(monkeypatch, name):
    """The most rows that a function of ``places`` was given, or gave, in a call."""
    seen, real = [], getattr(places, name)

    def count(rows, *args):
        out = real(rows, *args)
        seen.append(max(rows.count(), out.count()))
        return out

    monkeypatch.setattr(places, name, count)
    return seen


def test_nearest_of_crowded_places(spark, monkeypatch):
    """three hundred points and as many stores at one place do not meet in pairs."""
    seen = counting(monkeypatch, "first_rows")
    stores = spark.range(300).selectExpr("id AS sid", "1 AS city", "42D AS lat", "21D AS lng")
    points = spark.range(300).selectExpr("id AS point", "1 AS city", "42.001D AS lat0", "21D AS lng0")
    rows = places.nearest(points, stores, ["city"], 3).collect()
    assert sorted((r.point, r.place, r.sid) for r in rows) == [(p, k + 1, k) for p in range(300) for k in range(3)]
    assert max(seen) <= 300


def test_resolution_of_crowded_places(spark, monkeypatch):
    """F16: reports and stores at few places do not meet in pairs; who has one store near finds it."""
    seen = counting(monkeypatch, "within")
    reports = spark.range(300).selectExpr("id AS rid", "CAST(NULL AS string) AS phone", "'c' AS chain", "1 AS city", "IF(id < 200, 42D, 43D) AS lat", "21D AS lng")
    stores = spark.range(300).selectExpr("id AS sid", "CAST(NULL AS string) AS phone", "'c' AS chain", "1 AS city", "IF(id = 7, 43.01D, 42D) AS lat", "21D AS lng")
    rows = places.resolve_stores(reports, stores, 15.0).collect()
    assert sorted((r.rid, r.sid, r.level) for r in rows if r.sid is not None) == [(i, 7, 2) for i in range(200, 300)]
    assert len(rows) == 300 and max(seen) <= 300


def test_pairs_of_a_crowded_cell_in_many_tasks(spark):
    """all stores lie in one cell."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows = spark.range(2500).selectExpr("id AS sid", "'c' AS chain", "42D + id / 1000000 AS lat", "21D AS lng")
        tasks = places.near_pairs(rows, 30.0, ["chain"]).groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in tasks) == 2500 * 2499 // 2 and len(tasks) > 1


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(8)
    stores = [(i, i % 2, 42 + rng.random() * 2, 20 + rng.random() * 2) for i in range(200)]
    got = sorted((r.a, r.b) for r in places.near_pairs(spark.createDataFrame(stores, "sid int, chain int, lat double, lng double"), 30.0, ["chain"]).collect())
    assert got == sorted((a[0], b[0]) for a in stores for b in stores if a[0] < b[0] and a[1] == b[1] and km(a[2:], b[2:]) <= 30)
