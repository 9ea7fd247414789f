"""The upsert of stores against the loop that it stands for."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import store_upsert as su

SCHEMA = "ord long, chain string, name string, city string, address string, lat double, lng double, hours string, phone string, source string"
MAP = lambda: F.col("source").contains("map")


def key(value):
    return " ".join("".join(c if c.isalnum() else " " for c in (value or "").lower()).split())


def loop(on_file, fresh):
    """One record after the other; places as pairs."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kept, into = [], {}
    for first, rows in ((True, on_file), (False, fresh)):
        for row in sorted(rows):
            s = dict(zip(names, row, strict=True))
            s["t"] = s["ord"] - (1 << 60) if first else s["ord"]
            chain, place = key(s["chain"]), lambda x: None if x["lat"] is None or x["lng"] is None else (x["lat"], x["lng"])
            s["ak"] = (chain, key(s["city"]), key(s["address"])) if key(s["address"]) else None
            s["nk"] = (chain, key(s["name"])) if key(s["name"]) else None
            s["ck"], s["n"] = chain, 0
            hit = None
            if not first:
                hit = next((o for o in kept if s["ak"] and o["ak"] == s["ak"]), None)
                if hit is None and place(s):
                    hit = next((o for o in kept if o["ck"] == chain and place(o) and su.metres(place(o), place(s)) <= su.RADIUS), None)
                if hit is None and s["nk"]:
                    named = next((o for o in kept if o["nk"] == s["nk"]), None)
                    hit = named if named and not (place(named) and place(s)) else None
                into[s["t"]] = hit and hit["t"]
            if hit is None:
                kept.append(s)
                continue
            hit["n"] += 1
            promote = "map" in (hit["source"] or "") and "map" not in (s["source"] or "")
            for f in ("chain", "name", "city", "address", "hours", "phone", "source"):
                if promote:
                    hit[f] = s[f] if f == "source" or s[f] is not None else hit[f]
                elif hit[f] is None and f in ("city", "address", "hours", "phone"):
                    hit[f] = s[f]
            if place(s) and (promote or not place(hit)):
                hit["lat"], hit["lng"] = place(s)
    return into, {o["t"]: (*(o[f] for f in su.FIELDS), o["n"]) for o in kept}


def check(spark, on_file, fresh, tile=su.TILE):
    stores, decided, rounds = su.upsert(spark.createDataFrame(on_file, SCHEMA), spark.createDataFrame(fresh, SCHEMA), MAP(), tile)
    into, kept = loop(on_file, fresh)
    assert {r.t: r["into"] for r in decided.collect()} == into
    assert {r.t: (*(r[f] for f in su.FIELDS), r.n_merged) for r in stores.collect()} == kept
    return rounds


@pytest.mark.parametrize("seed, tile", [(1, su.TILE), (3, 6)])
def test_upsert_against_the_loop(spark, seed, tile):
    rng = random.Random(seed)

    def record(i):
        spot = rng.randrange(12)
        lat = None if rng.random() < 0.3 else 42 + spot * 0.004 + rng.random() * 0.003
        return (
            i, rng.choice(["Alpha", "alpha ", "Beta", None]), rng.choice(["Market", f"Shop {spot}", "", None]), rng.choice(["Town", "Hill", None]),
            rng.choice([None, None, "", f"Road {rng.randrange(25)}"]), lat, None if lat is None else 21 + rng.random() * 0.004, rng.choice([None, f"{i}h"]), rng.choice([None, str(i)]), rng.choice(["map/1", "own", None]),
        )

    check(spark, [record(i) for i in range(60)], [record(i) for i in range(440 if seed == 1 else 60)], tile)


def test_a_long_line_takes_few_rounds(spark):
    line = [(i, "c", None, None, None, 42.0, 20.0 + i * 50 / 82_600, None, None, "own") for i in range(10_000)]
    stores, decided, rounds = su.upsert(spark.createDataFrame([], SCHEMA), spark.createDataFrame(line, SCHEMA), MAP())
    assert rounds < 30 and decided.where("into IS NULL").count() == 3334 and stores.agg(F.sum("n_merged")).first()[0] == 6666
    _, _, more = su.upsert(spark.createDataFrame([], SCHEMA), spark.createDataFrame(line, SCHEMA), MAP(), 2000)
    assert more < 30


def test_many_at_one_place_and_empty_tables(spark):
    same = [(i, "c", "Market", "x", None, 42.0, 21.0, None, None, "own") for i in range(600)]
    assert check(spark, [], same, 300) < 10
    none = spark.createDataFrame([], SCHEMA)
    stores, decided, rounds = su.upsert(none, none, MAP())
    assert (stores.count(), decided.count(), rounds) == (0, 0, 0)


def test_records_of_the_public_map_cost_no_round_each(spark):
    # a line of small clusters of one name, each led by a record of the map that the next one takes over and moves
    line = [(i, "c", "Market", None, None, 42.0, 20.0 + (i // 4) * 0.003 + (i % 4) * 0.0004, None, None, "map" if i % 4 == 0 else "own") for i in range(240)]
    line.append((240, "c", "Market", None, None, None, None, None, None, "own"))
    assert check(spark, [], line) < 8


def test_rounds_broadcast_nothing(spark):
    rows = spark.createDataFrame([(i, "c", "n", "x", f"r{i % 3}", 42.0 + i, 21.0, None, None, "own") for i in range(9)], SCHEMA)
    stores, _, _ = su.upsert(rows.limit(0), rows, MAP())
    assert "Broadcast" not in stores._jdf.queryExecution().executedPlan().toString()
