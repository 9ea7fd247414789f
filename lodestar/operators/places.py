"""Stores: nearest, near pairs, label votes, and entity resolution in blocks."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, haversine_km
from ..sources.shared import stage
from .joins import grown, match
from .rank import first_rows

#: Kilometres that a degree has at least, in either direction, below 63 degrees of latitude.
KM_A_DEGREE = 50.0
#: Kilometres that a degree of latitude has at least.
KM_A_LATITUDE = 111.0
#: Stores of a cell that meet its neighbours in one part.
PART = 500


def near_pairs(stores: DataFrame, km: float, same: list[str]) -> DataFrame:
    """(a, b, km) of stores within ``km`` that agree in ``same``: cells of a grid joined to their neighbours by equality.

    Of two neighbours one meets the other, and a cell of many stores is dealt out in parts of about ``PART``, so a task
    holds a bounded share of a cell however many stores lie in one; the pairs themselves grow with its square.
    """
    high, wide = km / KM_A_LATITUDE, km / KM_A_DEGREE
    cell = F.floor(F.col("lat") / high).alias("cy"), F.floor(F.col("lng") / wide).alias("cx")
    placed = stores.where("lat IS NOT NULL AND lng IS NOT NULL").select(*same, "sid", "lat", "lng", *cell)
    parts = placed.groupBy(*same, "cy", "cx").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    steps = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    spread = placed.withColumn("d", F.explode(steps)).select(*same, F.col("sid").alias("a"), F.col("lat").alias("la"), F.col("lng").alias("na"), ((F.col("d.y") == 0) & (F.col("d.x") == 0)).alias("own"), (F.col("cy") + F.col("d.y")).alias("cy"), (F.col("cx") + F.col("d.x")).alias("cx"))
    spread = spread.join(parts, [*same, "cy", "cx"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = placed.withColumnRenamed("sid", "b").join(parts, [*same, "cy", "cx"]).withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    # few bytes make many pairs, so the number of tasks goes by the parts and not by the bytes
    tasks, keys = min(max(parts.agg(F.sum("parts")).first()[0] or 1, 16), 2000), [*same, "cy", "cx", "part"]
    pairs = spread.repartition(tasks, *keys).join(grown(dealt.repartition(tasks, *keys)), keys).where("IF(own, a < b, a <> b)")
    near = pairs.where(F.abs(F.col("la") - F.col("lat")) <= high).withColumn("km", haversine_km(F.col("la"), F.col("na"), F.col("lat"), F.col("lng"))).where(F.col("km") <= km)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "km")


def label_vote(rows: DataFrame, group: str, label: str) -> DataFrame:
    """The commonest label of a group; ties by capitals, then by alphabet."""
    counted = rows.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    capitals = F.length(F.regexp_replace(label, "[^A-Z]", ""))
    return counted.groupBy(group).agg(F.min_by(F.struct(label, "n"), F.struct(-F.col("n"), -capitals, label)).alias("b")).select(group, f"b.{label}", "b.n")


def within(rows: DataFrame, known: DataFrame, same: list[str], km: float) -> DataFrame:
    """(rid, sid, km) of rows (rid, lat, lng) and known places (sid, la, na) that agree in ``same`` and lie within ``km``, by grid cells."""
    size = km / KM_A_DEGREE
    steps = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1)))
    around = rows.where("lat IS NOT NULL AND lng IS NOT NULL").withColumn("d", F.explode(steps))
    around = around.select(*same, "rid", "lat", "lng", (F.floor(F.col("lat") / size) + F.col("d.y")).alias("cy"), (F.floor(F.col("lng") / size) + F.col("d.x")).alias("cx"))
    placed = known.where("la IS NOT NULL AND na IS NOT NULL").select(*same, "sid", "la", "na", F.floor(F.col("la") / size).alias("cy"), F.floor(F.col("na") / size).alias("cx"))
    distance = haversine_km(F.col("lat"), F.col("lng"), F.col("la"), F.col("na"))
    return around.join(grown(placed), [*same, "cy", "cx"]).select(*same, "rid", "sid", distance.alias("km")).where(F.col("km") <= km)


def _only(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, sid) of the groups that have exactly one ``sid``; told from the least and the greatest, not from a set."""
    return rows.groupBy(*group).agg(F.min("sid").alias("sid"), F.max("sid").alias("most_")).where("sid = most_").drop("most_")


def alone_within(rows: DataFrame, known: DataFrame, same: list[str], km: float) -> DataFrame:
    """(rid, sid) of rows (rid, lat, lng) with exactly one ``sid`` of ``known`` (sid, lat, lng) within ``km`` that agrees in ``same``.

    Places meet, not rows: equal places of rows are one, and those of known stores are one with its least and greatest
    ``sid``.  Two stores in a cell whose diagonal is shorter than ``km`` are more than one for all that lies in it.
    """
    tight = km / 160.0
    keys, cell = [*same, "lat", "lng"], [F.floor(F.col("lat") / tight).alias("ty"), F.floor(F.col("lng") / tight).alias("tx")]
    seats = known.where("lat IS NOT NULL AND lng IS NOT NULL AND sid IS NOT NULL").groupBy(*keys).agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"))
    crowded = seats.select(*same, *cell, "lo", "hi").groupBy(*same, "ty", "tx").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").drop("lo", "hi")
    spots = rows.where("lat IS NOT NULL AND lng IS NOT NULL").select(*keys).distinct()
    spots = spots.select("*", *cell).join(grown(crowded), [*same, "ty", "tx"], "left_anti").drop("ty", "tx").withColumn("rid", F.struct("lat", "lng"))
    near = within(spots, seats.select(*same, F.struct("lo", "hi").alias("sid"), F.col("lat").alias("la"), F.col("lng").alias("na")), same, km)
    one = near.groupBy(*same, "rid").agg(F.min("sid.lo").alias("sid"), F.max("sid.hi").alias("most_")).where("sid = most_")
    return rows.select("rid", *keys).join(grown(one.select(*same, "rid.lat", "rid.lng", "sid")), keys).select("rid", "sid")


def resolve_stores(rows: DataFrame, known: DataFrame, km: float) -> DataFrame:
    """Rows (rid, phone, chain, city, lat, lng) against known stores by the first level that has exactly one hit.

    Distances meet in grid cells, by places; for the last level only chains with one store in a city are joined.
    """
    phones = _only(known.where("phone IS NOT NULL"), ["phone"])
    alone = _only(known, ["chain", "city"])
    near = alone_within(rows, known, ["chain", "city"], km).groupBy("rid").agg(F.min("sid").alias("sid"), F.max("sid").alias("most_")).where("sid = most_")
    levels = [
        rows.join(grown(phones), "phone").select("rid", "sid", F.lit(1).alias("level")),
        near.select("rid", "sid", F.lit(2).alias("level")),
        rows.join(grown(alone), ["chain", "city"]).select("rid", "sid", F.lit(3).alias("level")),
    ]
    first = functools.reduce(DataFrame.unionByName, levels).groupBy("rid").agg(F.min_by(F.struct("sid", "level"), "level").alias("b"))
    return rows.select("rid").join(grown(first), "rid", "left").select("rid", "b.sid", "b.level")


def _cells(lat: str, lng: str) -> list:
    return [F.floor(F.col(lat) / F.col("size_")).alias("cy"), F.floor(F.col(lng) / F.col("size_")).alias("cx")]


def first_cells(stores: DataFrame, same: list[str], most: int) -> DataFrame:
    """(same, size_): degrees of the cells that a block starts with, from its stores by area, so that a cell holds about ``most``."""
    span = lambda c: F.greatest(F.max(c) - F.min(c), F.lit(0.001))
    blocks = stores.groupBy(*same).agg((span("lat") * span("lng") / F.count(F.lit(1))).alias("area_"))
    return blocks.select(*same, F.least(F.greatest(F.sqrt(0.8 * most * F.col("area_")), F.lit(0.001)), F.lit(360.0)).alias("size_"))


def nearest(points: DataFrame, stores: DataFrame, same: list[str], most: int) -> DataFrame:
    """The ``most`` nearest stores of each point among those that agree in ``same``; stores off the map last.

    Points meet the stores of their own and the neighbouring cells of their block's grid, by equality.  What lies beyond
    those is at least a cell away, along the latitude or to the meridian: a point that has enough stores within that is
    done; the others go on with cells eight times as wide.  Points of one place ask once, and of stores at one place only the
    first ``most`` can be an answer, so crowded places cost no more than others.
    """
    keys, told = [*same, "lat0", "lng0"], [c for c in stores.columns if c not in points.columns]
    by_km = [F.col("km").asc_nulls_last(), "sid"]
    placed = first_rows(stores.where("lat IS NOT NULL AND lng IS NOT NULL"), [*same, "lat", "lng"], ["sid"], most, "r_").drop("r_")
    spots = stage(points.select(*keys).distinct(), "near-spots")
    steps = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1)))
    sizes = stage(first_cells(placed, same, most), "near-cells")
    left, placed, found = spots.where("lat0 IS NOT NULL AND lng0 IS NOT NULL").join(sizes, same), stage(placed.join(sizes, same), "near-stores"), []
    while True:
        around = left.select("*", *_cells("lat0", "lng0")).withColumn("d", F.explode(steps))
        around = around.withColumns({"cy": F.col("cy") + F.col("d.y"), "cx": F.col("cx") + F.col("d.x")}).drop("d")
        hits = around.join(grown(placed.select("*", *_cells("lat", "lng")).drop("size_")), [*same, "cy", "cx"])
        km = F.round(haversine_km(F.col("lat0"), F.col("lng0"), F.col("lat"), F.col("lng")), 6)
        top = stage(first_rows(hits.select(*keys, *told, "size_", km.alias("km")), keys, by_km, most, "place"), "near")
        last = F.col("size_") >= 360
        reach = EARTH_KM * F.asin(F.sin(F.radians(F.least("size_", F.lit(90.0)))) * F.cos(F.radians("lat0"))) - 1e-5
        sure = top.groupBy(*keys).agg(F.count_if(last | (F.col("km") <= reach)).alias("n"), F.bool_or(last).alias("last_")).where(F.col("last_") | (F.col("n") >= most)).select(*keys)
        found.append(top.join(sure, keys, "left_semi").drop("size_"))
        left = stage(left.join(sure, keys, "left_anti").where(~last), "left")
        if left.isEmpty():
            break
        wider = F.least(8 * F.col("size_"), F.lit(360.0))
        left, placed = left.withColumn("size_", wider), placed.withColumn("size_", wider)
    near = functools.reduce(DataFrame.unionByName, found)
    # whoever has too few gets the first stores of the block that no distance is known to
    full = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most).select(*keys)
    short = spots.join(full, keys, "left_anti")
    unplaced = first_rows(stores.where("lat IS NULL OR lng IS NULL"), same, ["sid"], most, "r_").drop("r_")
    blind = first_rows(stores, same, ["sid"], most, "r_").drop("r_")
    nowhere = "lat0 IS NULL OR lng0 IS NULL"
    rest = short.where(f"NOT ({nowhere})").join(unplaced, same).unionByName(short.where(nowhere).join(blind, same))
    every = near.drop("place").unionByName(rest.select(*keys, *told, F.lit(None).cast("double").alias("km")))
    return match(points, grown(first_rows(every, keys, by_km, most, "place")), keys).select(*points.columns, *told, "km", "place")
