"""Named predicates, homonyms by a table of rules, and category trees of any depth."""

import json

from pyspark.sql import functions as F

from lodestar.operators import predicates
from lodestar.sources import pages

SCHEMA = "pid int, name string, quantity string, category string, tags array<string>, brand string"
ROWS = [
    (1, "Jaffa Multivitamin 0.25L", None, None, None, "Jaffa"), (2, "Jaffa Cakes 150 g", None, "PIJE", None, "Jaffa"), (3, "Jaffa", "330 ml", None, None, "Jaffa"), (4, "Jaffa", "2 kg", "Pije", None, "Jaffa"),
    (5, "Jaffa", None, None, ["en:fruit-juices"], "Jaffa"), (6, None, None, "Pije", None, "Jaffa"), (7, "Jaffa Çokollatë 0,5 l", None, None, None, "Jaffa"), (8, "Jaffa", None, "Lëngje", None, "Jaffa"), (9, "", "", None, None, None),
]


def test_drinks_need_positive_evidence(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    assert {r.pid for r in rows.where(predicates.holds(F.lit("drink"))).collect()} == {1, 3, 5, 8}
    assert rows.where(predicates.holds(F.lit("no such predicate"))).count() == 0


def test_homonyms_by_table(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    hits = spark.createDataFrame([(1, "brand", "JAFFA", "Jaffa Crvenka"), (1, "barcode", "jaffa", "Jaffa Crvenka"), (2, "brand", "Jaffa", "Jaffa Crvenka"), (3, "title", "jaffa", "Jaffa Other"), (5, "title", "Jaffa!", "Jaffa Crvenka"), (9, "brand", None, "Jaffa Crvenka")], "pid int, reason string, token string, brand string")
    rules = spark.createDataFrame([("Jaffa", "Jaffa Crvenka", "drink"), ("jaffa", "Jaffa Crvenka", "drink")], "alias string, brand string, predicate string")
    told = {(r.pid, r.reason): r.stands for r in predicates.standing(hits, rows, rules, "pid").collect()}
    assert told == {(1, "brand"): False, (1, "barcode"): True, (2, "brand"): True, (3, "title"): True, (5, "title"): False, (9, "brand"): True}
    assert predicates.standing(hits, rows, rules.where("false"), "pid").where("stands").count() == 6


def test_a_further_predicate_is_a_function_and_a_row(spark):
    predicates.predicate("short")(lambda: F.length("name") < 6)
    try:
        rows = spark.createDataFrame(ROWS, SCHEMA)
        rules = spark.createDataFrame([("jaffa", "J", "short")], "alias string, brand string, predicate string")
        hits = rows.where("name IS NOT NULL AND name <> ''").select("pid", F.lit("brand").alias("reason"), F.lit("Jaffa").alias("token"), F.lit("J").alias("brand"))
        assert {r.pid for r in predicates.standing(hits, rows, rules, "pid").where("NOT stands").collect()} == {3, 4, 5, 8}
    finally:
        del predicates.PREDICATES["short"]


def test_trees_of_any_depth(spark):
    deep = {"name": "end"}
    for i in range(50):
        deep = {"name": f" n{i} ", "sub": [deep, {"name": f"leaf\t{i}"}]}
    wide = {"name": "root", "sub": [{"name": f"w{i}", "sub": []} for i in range(100_000)]}
    rows = spark.createDataFrame([(1, json.dumps({"c": [deep]})), (2, json.dumps({"c": [wide]})), (3, json.dumps({"c": []})), (4, None), (5, "no json")], "id int, json string")
    got = {}
    for r in pages.leaves(rows, "id", "json", "c", "sub").collect():
        got.setdefault(r.id, set()).add(r.path)
    root = [f"n{i}" for i in range(49, -1, -1)]
    assert got[1] == {"/".join([*root, "end"])} | {"/".join([*root[: 50 - i], f"leaf {i}"]) for i in range(50)}
    assert got[2] == {f"root/w{i}" for i in range(100_000)} and set(got) == {1, 2}
