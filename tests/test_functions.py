"""Rules on literals: codes, texts, sizes, events."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import codes, sizes, text
from lodestar.operators import dedupe, events, gates, issuer, merge
from lodestar.streaming import feed as stream


def one(spark, column, *values):
    row = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))]).select(column(*(F.col(f"c{i}") for i in range(len(values)))).alias("r")).first()
    return row["r"]


@pytest.mark.parametrize(
    ("code", "valid", "prefix"),
    [("4006381333931", True, "400"), ("4006381333930", False, "400"), ("036000291452", True, "003"), ("96385074", True, "963"), ("14006381333938", True, "400"), ("12345", False, None), ("", False, None)],
)
def test_codes(spark, code, valid, prefix):
    assert one(spark, codes.is_valid, code) is valid
    assert one(spark, codes.prefix, code) == prefix


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("Water 6X1.5L", (1.5, "l", 6, "volume", 9000.0)),
        ("Flour 1 KG", (1.0, "kg", 1, "mass", 1000.0)),
        ("Oil 0,75 lt", (0.75, "l", 1, "volume", 750.0)),
        ("Gr 100 x 4 tuna", (100.0, "g", 4, "mass", 400.0)),
        ("Coffee 250g bag 1kg", None),
        ("500g twice 500 g", (500.0, "g", 1, "mass", 500.0)),
        ("Peaches kg/PLU.12", None),
        ("300x2kg", None),
        ("Cola 0.33Lx6", (0.33, "l", 6, "volume", 1980.0)),
        ("Juice 4 × 20 cl", (20.0, "cl", 4, "volume", 800.0)),
        ("Tea 20 bags", None),
        ("Sugar kg. 5", (5.0, "kg", 1, "mass", 5000.0)),
        ("Spread gr 30% less", None),
        ("Yoghurt 2*125gr + 250 g", (125.0, "g", 2, "mass", 250.0)),
        ("Crème 200 ML", (200.0, "ml", 1, "volume", 200.0)),
        ("Gel 500grams", None),
        ("Rice 60 kg", None),
        ("", None),
    ],
)
def test_sizes(spark, title, want):
    got = one(spark, sizes.parse_size, title)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("title", "by_weight", "pieces"), [("Ham per kg", True, None), ("Apples kg /", True, None), ("PLU: 4011 bananas", True, None), ("Kgb 2 kg", False, None), ("Eggs 10/1", False, 10), ("Caps 24 kom", False, 24), ("Pads 6000 pcs", False, None), ("1/1", False, 1), ("", False, None)])
def test_pieces_and_weight(spark, title, by_weight, pieces):
    assert one(spark, sizes.is_sold_by_weight, title) is by_weight
    assert one(spark, sizes.piece_count, title) == pieces


def test_match_names_agree(spark):
    for a, b in (("Milk 0,5 L", "milk 0.5l"), ("Flour 500 gr", "FLOUR 500g"), ("Eggs 10/1 fresh", "eggs fresh"), ("Ham PLU.12", "ham"), ("Ham plu 4 kg/", "ham kg")):
        assert one(spark, sizes.match_name, a) == one(spark, sizes.match_name, b)
    assert one(spark, sizes.match_name, "Milk 1l") != one(spark, sizes.match_name, "Milk 2l")
    assert one(spark, sizes.match_name, "") == ""


def test_folds_every_accent(spark):
    assert one(spark, text.key, "Dvořák Łódź Ő") == "dvorak lodz o"
    assert one(spark, text.key, "Cafe\u0301 N\u0303u ệ ǭ ǿ") == "cafe nu e o o"
    assert len(text.accents()[0]) == len(text.accents()[1]) > 400
    assert one(spark, text.decode_entities, "caf&#233; &#x1F600; &#39;&#0;&#xD800; &amp;#39;") == "café \U0001f600 '&#0;&#xD800; &#39;"


def test_thirteen_digits(spark):
    assert [one(spark, codes.thirteen, c) for c in ("96385074", "036000291452", "14006381333938")] == ["0000096385074", "0036000291452", "4006381333938"]


def test_streams(spark, tmp_path):
    rows = spark.range(600).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + id * 3) AS ts", "IF(id % 2 = 0, 'a', 'b') AS event_type", "IF(id % 3 = 0, '40063813', 'x') AS code", "'user1' AS owner", "'fine' AS note")
    rows.write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df in (("minutes", stream.minute_counts_stream(source())), ("valid", stream.valid_stream(source()))):
        df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    want = {tuple(r) for r in stream.minute_counts_stream(rows).collect()}
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "minutes")).collect()}
    assert got and got <= want  # the last minutes wait for late events
    assert spark.read.parquet(str(tmp_path / "valid")).count() == 200


def test_text(spark):
    assert one(spark, text.key, "Crème-Brûlée  2L!") == "creme brulee 2l"
    assert one(spark, text.slug, "Ça va, Žan?") == "ca-va-zan"
    assert one(spark, text.contains_words, "coca cola zero", "cola zero") is True
    assert one(spark, text.contains_words, "coca colazero", "cola zero") is False
    assert one(spark, text.same_brand, "Acme", "acme foods") is True
    assert one(spark, text.same_brand, "", "acme") is False
    assert one(spark, text.decode_entities, "a &lt;b&gt; &amp;lt;") == "a <b> &lt;"
    assert one(spark, text.humanise_tag, "en:sour-milks") == "Sour milks"


def test_issuer_gap(spark):
    ranges = spark.createDataFrame([(0, 499, "A", "country", "LOCAL"), (499, 998, "B", "country", "OTHER")], "lo int, hi int, issuer string, kind string, stance string")
    assert {(r.number, r.n) for r in issuer.coverage(ranges).collect()} == {(499, 2), (999, 0)}
    marked = issuer.classify(spark.createDataFrame([("4990000000009",), ("20000004",), ("9990000000000",), (None,)], "code string"), ranges)
    assert {r.code: r.verdict for r in marked.collect()} == {"4990000000009": "LOCAL", "20000004": "NOT_A_COUNTRY", "9990000000000": "UNKNOWN", None: "UNKNOWN"}


def test_quantile_is_by_floor_index(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", None)], "g string, v double")
    got = gates.floor_quantiles(rows, ["g"], "v", [0.5, 0.99]).collect()
    assert [(r.g, r.n, r.q_50, r.q_99) for r in got] == [("a", 4, 3.0, 4.0)]


def test_cheapest_ties_and_missing_prices(spark):
    rows = spark.createDataFrame([(1, "x", None, 1), (1, "y", 2.0, 2), (1, "z", 2.0, 3), (2, "x", None, 4)], "pid int, source string, price double, ord int")
    got = {r.pid: (r.source, r.price, r.also_at) for r in dedupe.cheapest(rows, ["pid"], "ord").collect()}
    assert got == {1: ("y", 2.0, ["x", "z"]), 2: ("x", None, [])}


def test_merge_of_identical_input_changes_nothing(spark):
    base = spark.createDataFrame([("a", "k", 1.0, "EUR", "n"), ("b", None, None, "EUR", "m")], "id string, match_key string, price double, currency string, name string")
    merged = merge.upsert(base, base)
    assert {r.outcome for r in merged.collect()} == {"unchanged"}
    assert merge.change_log(merged).count() == 0
    assert merge.difference(base, base).count() == 0


def test_anchored_window(spark):
    rows = spark.sql("SELECT 1 AS u, id AS e, timestamp_seconds(id * 400) AS ts FROM range(5)")
    assert sorted(r.e for r in events.anchored_dedupe(rows, ["u"], "ts", "e", 600).collect()) == [0, 2, 4]
