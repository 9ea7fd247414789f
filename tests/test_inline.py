"""Rows of one address as one branch, inline alternatives and live answers, on small tables against plain loops."""

import random

from lodestar.operators import branches, inline
from lodestar.operators.store_upsert import metres

STORE = "ord long, chain string, name string, city string, address string, lat double, lng double, hours string, phone string"


def by_loop(stores):
    out, seen = [], {}
    for s in sorted(stores, key=lambda r: r[0]):
        o, chain, name, city, address, lat, lng, hours, phone = s
        low = lambda v: (v or "").lower().strip()
        key = None if not low(chain) else ("a", low(chain), low(city), low(address)) if low(address) else ("n", low(chain), low(city), low(name)) if low(name) else None
        row = {"ord": o, "chain": chain, "name": name, "city": city, "address": address, "hours": hours, "phone": phone, "at": (lat, lng) if lat is not None and lng is not None else None, "n": 0}
        held = seen.get(key) if key else None
        if held is None or held["at"] and row["at"] and metres(held["at"], row["at"]) > 120:
            out.append(row)
            if key and held is None:
                seen[key] = row
            continue
        for c in ("city", "address", "hours", "phone", "at"):
            held[c] = row[c] if held[c] is None else held[c]
        held["n"] += 1
    return sorted(repr((r["ord"], r["chain"], r["name"], r["city"], r["address"], r["hours"], r["phone"], *(r["at"] or (None, None)), r["n"])) for r in out)


def test_one_address_is_one_branch_unless_apart(spark):
    rng = random.Random(4)
    some = lambda *v: rng.choice([None, *v])
    stores = [(i, rng.choice([None, "", "A", "a", "B"]), some("", "Shop", "shop", "Kiosk"), some("X", "x"), some("", "Road 1", "road 1", "Road 2"), *rng.choice([(None, None), (42.0, None), (42.0 + rng.randrange(4) * 0.0005, 21.0 + rng.randrange(3) * 0.0006)]), some("8-20", "9-17"), some("1", "2")) for i in range(400)]
    got = branches.by_address(spark.createDataFrame(stores, STORE))
    assert sorted(repr(tuple(r)) for r in got.collect()) == by_loop(stores)
    assert branches.by_address(spark.createDataFrame([], STORE)).count() == 0


def test_inline_lanes(spark):
    entries = spark.createDataFrame([(1, 1, "Alfa", "snacks", ["en:crisps"], ["snack"]), (2, 2, "Beta", "milk", ["en:milks"], ["dairy"]), (3, 3, "Gama", "milk", ["en:milks"], ["dairy"])], "entry long, ord long, brand string, category string, tags array<string>, families array<string>")
    kinds = spark.createDataFrame([("crisp", "crisps", "1"), ("cream", "cream", "2"), ("milk", "milk", "3")], "word string, family string, ord string")
    tags = spark.createDataFrame([("crisps", "en:crisps"), ("milk", "en:milks"), ("cream", "en:creams")], "kind string, tag string")
    wide = spark.createDataFrame([("yog", "dairy", "1"), ("soap", "bath", "2")], "word string, family string, ord string")
    rows = spark.createDataFrame([
        (1, "Alfa", "snacks", None, "x", None),  # its own entry's brand
        (2, None, "Crisps", None, "with milk", None),  # the shelf before the flavour in the name
        (3, None, "goods", "crisps-snacks", "cream", None),  # what the brand sells before the name
        (4, None, None, None, "sour cream", None),  # a known kind that nothing answers
        (5, None, "goods", None, "yoghurt", None),  # no kind: the family
        (6, None, "goods", None, "soap", None), (7, None, None, None, None, None), (8, "", "", "", "", None),
    ], "k long, brands string, category string, brand_category string, name string, hint_family string")
    got = {r.k: (r.entry, r.via) for r in inline.inline_alternative(rows, "k", entries, kinds, tags, wide).collect()}
    assert got == {1: (1, "brand"), 2: (1, "kind:crisps"), 3: (1, "kind:crisps"), 5: (2, "family")}


def test_live_after_curated(spark):
    static = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "probe long, code string, place long")
    live = spark.createDataFrame([(1, "a", "X", "O", True, 1.0), (1, "c", "X", "O", True, 3.0), (1, "c", "Y", "O", True, 2.0), (1, "d", "O", "O", True, 0.0), (1, "e", None, "O", True, 2.5), (1, "f", "X", "O", None, 0.0), (1, None, "X", "O", True, 0.0), (1, "", "X", "O", True, 0.0), (2, "z", "X", None, True, None)], "probe long, code string, brand string, own string, eligible boolean, price double")
    got = sorted(tuple(r) for r in inline.merge_live(static, live, ["price"], 4).collect())
    assert got == [(1, "a", False, 2), (1, "b", False, 1), (1, "c", True, 3), (1, "e", True, 4), (2, "z", True, 1)]
    assert inline.merge_live(static, live.limit(0), ["price"], 1).collect()[0].code == "b"
