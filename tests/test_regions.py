"""Points in polygons with holes that overlap, against a plain ray for every pair."""

import math
import random

from lodestar.operators import regions

POINTS, SEGMENTS = "sid long, lat double, lng double", "region string, ord long, y1 double, x1 double, y2 double, x2 double"


def ring(y, x, ry, rx, n, rng, turn=1):
    bend = [rng.uniform(0.6, 1.0) for _ in range(n)]
    at = [(y + ry * bend[k] * math.sin(2 * math.pi * k * turn / n), x + rx * bend[k] * math.cos(2 * math.pi * k * turn / n)) for k in range(n)]
    return list(zip(at, at[1:] + at[:1], strict=True))


def polygons():
    rng = random.Random(11)
    out = {}
    for k in range(24):
        y, x, size = rng.uniform(-2, 2), rng.uniform(-2, 2), 10 ** rng.uniform(-3, 0.3)
        lines = ring(y, x, size, size * rng.uniform(0.2, 2), rng.choice([3, 7, 40]), rng)
        if k % 2:
            lines += ring(y, x, size / 3, size / 3, 5, rng, -1)
        out[f"r{k}"] = (k // 2, lines)
    out["large"] = (99, ring(0, 0, 60, 120, 900, rng))
    out["square"] = (50, [((0.0, 0.0), (0.0, 0.5)), ((0.0, 0.5), (0.5, 0.5)), ((0.5, 0.5), (0.5, 0.0)), ((0.5, 0.0), (0.0, 0.0))])
    out["line"] = (0, [((0.1, 0.1), (0.1, 0.4)), ((0.1, 0.4), (0.1, 0.1))])
    return out


def inside(lat, lng, lines):
    n = 0
    for (y1, x1), (y2, x2) in lines:
        if (y1 > lat) != (y2 > lat) and lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            n += 1
    return n % 2 == 1


def test_against_a_ray_for_every_pair(spark):
    shapes, rng = polygons(), random.Random(2)
    at = [(rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(1500)] + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(200)]
    # next to the small ones, on corners, and on the edges of cells
    at += [(y + rng.uniform(-0.01, 0.01), x + rng.uniform(-0.01, 0.01)) for _, lines in shapes.values() for (y, x), _ in lines[:30]]
    at += [c for _, lines in shapes.values() for c, _ in lines[:10]] + [(i / 16, j / 16) for i in range(-4, 12) for j in range(-4, 12)]
    want = {}
    for i, (lat, lng) in enumerate(at):
        hits = sorted((o, r) for r, (o, lines) in shapes.items() if inside(lat, lng, lines))
        if hits:
            want[i] = hits[0][1]
    points = [(i, *p) for i, p in enumerate(at)] + [(90_001, None, 0.1), (90_002, 0.1, float("nan")), (90_003, float("inf"), 0.1)]
    lines = [(r, o, *a, *b) for r, (o, ls) in shapes.items() for a, b in ls] + [("r1", 0, None, 0.0, 1.0, 1.0), ("r2", 1, float("nan"), 0.0, 1.0, 1.0)]
    got = regions.in_polygon(spark.createDataFrame(points, POINTS), spark.createDataFrame(lines, SEGMENTS))
    assert {r.sid: r.region for r in got.collect()} == want
    assert len(set(want.values())) > 15


def test_cells_decide_most_points_and_are_bounded(spark):
    lines = [("far", 0, *a, *b) for a, b in ring(0, 0, 50, 100, 400, random.Random(1))] + [("near", 1, *a, *b) for a, b in ring(0, 0, 0.01, 0.01, 4, random.Random(1))]
    table = spark.createDataFrame(lines, SEGMENTS)
    cells = regions.cover(regions.strips(table, regions.boxes(table)))
    by = {(r.region, r.inside): r["count"] for r in cells.groupBy("region", "inside").count().collect()}
    assert by["far", True] + by["far", False] < 2000 and by["near", True] + by["near", False] < 600 and by["far", False] < 3 * by["far", True] + 400
    plan = regions.in_polygon(spark.range(10).selectExpr("id AS sid", "cast(id AS double) AS lat", "cast(id AS double) AS lng"), table)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and any("Join Inner" in line and "cy#" in line and "cx#" in line for line in plan.splitlines())


def test_empty(spark):
    none = spark.createDataFrame([], SEGMENTS)
    some = spark.createDataFrame([(1, 0.0, 0.0)], POINTS)
    assert regions.in_polygon(some, none).count() == 0
    assert regions.in_polygon(some.limit(0), spark.createDataFrame([("a", 0, 0.0, 0.0, 1.0, 1.0)], SEGMENTS)).count() == 0
