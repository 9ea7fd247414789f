"""Readers on fresh JSON."""

import json

import pytest

from lodestar.sources import readers


def test_offers_in_many_spellings(spark, tmp_path):
    rows = [{"code": " 17 ", "product_name": "Tea", "price": "1.5", "isLocalBrand": True, "junk": 1}, {"id": "b", "price": "free", "isLocalBrand": "maybe"}, {"name": "no key"}, {"url": "u", "price": 0}]
    path = tmp_path / "offers.json"
    path.write_text(json.dumps({"products": rows}))
    got = readers.normalise(readers.rows_of(spark, str(path), "products"), readers.OFFER, "id").collect()
    assert [(r.id, r.name, r.price, r.local) for r in got] == [("17", "Tea", 1.5, True), ("b", None, None, None), ("u", None, 0.0, None)]


def test_ranges(spark, tmp_path):
    path = tmp_path / "ranges.json"
    path.write_text("\n".join(map(json.dumps, [{"range": "20-10", "country": "A", "iso": "aa"}, {"from": 5, "kind": "coupon", "iso": "x"}, {"prefix": "977"}, {"range": [1, 3]}, {"note": "none"}])))
    got = {(r.lo, r.hi, r.issuer, r.kind, r.iso) for r in readers.ranges(readers.rows_of(spark, str(path))).collect()}
    assert got == {(10, 20, "A", "country", "aa"), (5, 5, "x", "coupon", None), (977, 977, "Unknown", "country", None), (1, 3, "Unknown", "country", None)}


def test_shapes(spark, tmp_path):
    for k, body in enumerate(('[{"code": "1"}]', '{"items": [{"code": "1"}]}', '{"meta": {}, "products": [{"code": "1"}]}', '{"data": 3}', "plain")):
        (tmp_path / f"{k}.json").write_text(body)
        read = lambda: [r.code for r in readers.normalise(readers.rows_of(spark, str(tmp_path / f"{k}.json"), "items", "products"), readers.PRODUCT, "code").collect()]  # noqa: B023, E731
        if k < 3:
            assert read() == ["1"]
        else:
            with pytest.raises(readers.Unreadable):
                read()
    with pytest.raises(readers.Unreadable):
        readers.rows_of(spark, str(tmp_path / "missing.json"))
    none = readers.rows_or_none(spark, str(tmp_path / "missing.json"), readers.ORIGIN, "brand", "brands")
    assert none.count() == 0 and "made_in" in none.columns


def test_curated_tables(spark, tmp_path):
    tables = {
        "pairings": {"entries": [{"flaggedBrand": "F", "tags": ["en:a"], "alternatives": [{"brand": "A", "country": "X"}, {"brand": "B"}]}, {"company": "no brand"}]},
        "origins": {"brands": [{"brand": "F", "productionCountry": "X", "verified": True, "ownership": "O"}]},
        "listed": [{"name": "F", "aliases": ["eff", "F-Brand"]}],
        "notes": {"stores": [{"store": "S", "text": "closed on Sundays"}]},
    }
    for name, body in tables.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    read = lambda name, spec, key: readers.normalise(readers.rows_of(spark, str(tmp_path / f"{name}.json"), "entries", "brands", "stores"), spec, key).collect()
    pair = read("pairings", readers.PAIRING, "brand")
    assert [(r.brand, r.tags, [a.brand for a in r.alternatives]) for r in pair] == [("F", ["en:a"], ["A", "B"])]
    assert [(r.made_in, r.verified, r.owner) for r in read("origins", readers.ORIGIN, "brand")] == [("X", True, "O")]
    assert [r.aliases for r in read("listed", readers.LISTED, "brand")] == [["eff", "F-Brand"]]
    assert [(r.name, r.note) for r in read("notes", readers.NOTE, "name")] == [("S", "closed on Sundays")]
    (tmp_path / "index.json").write_text(json.dumps({"tags": {"en:a": {"count": 5, "codes": ["1", "2"]}, "en:b": {"codes": ["3"]}}}))
    assert sorted(tuple(r) for r in readers.tag_index(readers.keyed_rows(spark, str(tmp_path / "index.json"), "tags")).collect()) == [("en:a", 5, "1"), ("en:a", 5, "2"), ("en:b", 1, "3")]
    (tmp_path / "iso.json").write_text(json.dumps({"al": {"name": "Albania", "recognises": True, "sources": ["s"]}}))
    listed = spark.createDataFrame([('{"iso": "AL", "name": "Other"}',), ('{"isoCode": "xk", "recognises": "maybe"}',)], "raw string")
    got = {r.iso: (r.name, r.recognises, r.sources) for r in readers.attributes(readers.keyed_rows(spark, str(tmp_path / "iso.json")), listed).collect()}
    assert got == {"AL": ("Albania", True, ["s"]), "XK": (None, None, None)}


def test_refusal(spark, tmp_path):
    rows = spark.range(10)
    assert readers.write_if_kept(rows, str(tmp_path / "a"), 12, 0.8) == 10
    with pytest.raises(ValueError, match="refusing"):
        readers.write_if_kept(rows, str(tmp_path / "a"), 100, 0.8)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 10
    assert readers.unblocked(spark.sql("SELECT 'Big Shop' AS s UNION ALL SELECT 'corner' AS s"), ["big ?shop"], ["s"]).count() == 1
