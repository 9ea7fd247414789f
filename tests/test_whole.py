"""Queries that read everything, against brute force on small tables."""

from pyspark.sql import functions as F

from lodestar import registry
from lodestar.operators import brands, events, merge, resolve
from lodestar.plans import evidence, matching, shelves

DATA = "/root/testdata/sf0.001"


def test_trusted_local_counts_every_source(spark):
    marked = spark.createDataFrame(
        [(1, "c1", "red ring", "Own", "OTHER"), (2, "c2", "ring", "Own", "OTHER"), (3, "c3", "ring by far away good tea", None, "OTHER"), (4, "c4", "ring", "Far-Away Good Tea!", "OTHER"), (5, "c5", "far awaygood tea", None, "LOCAL")],
        "pid long, code string, name string, brand string, verdict string",
    )
    said = spark.createDataFrame([(p, True) for p in (1, 2, 3, 4, 5)] + [(1, None), (2, False)], "pid long, local boolean")
    listed, codes = spark.createDataFrame([("Bad",)], "brand string"), spark.createDataFrame([("c9",)], "code string")
    phrases = spark.createDataFrame([("far away good tea",)], "phrase string")
    assert sorted(r.pid for r in evidence.trusted(marked, said, listed, codes, phrases).collect()) == [1, 5]
    denied = {r.l_partkey for r in spark.read.parquet(f"{DATA}/lineitem.parquet").where("(l_partkey + l_suppkey) % 3 <> 0 AND l_partkey % 4 <> 0 AND (l_partkey + l_suppkey) % 5 = 0").select("l_partkey").distinct().collect()}
    found = {r.pid for r in registry.QUERIES["trusted_local"](spark, DATA).collect()}
    assert found and not denied & found


def test_whole_texts_are_keyed(spark):
    rows = spark.createDataFrame([(1, "Čaj one\nSecond, longer line\nlonger"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: tuple(r) for r in shelves.whole_keys(rows).collect()}
    assert got == {1: (1, "caj one second longer line longer", "caj-one-second-longer-line-longer", 3, "second longer line"), 2: (2, "", "", 0, "")}


def test_every_tag_gives_candidates(spark):
    parts = spark.read.parquet(f"{DATA}/part.parquet").collect()
    best = {}
    for p in parts:
        for tier, tag in enumerate(reversed(p.p_name.split(" "))):
            k, v = (p.p_type, tier, tag, p.p_brand), (round(p.p_retailprice, 2), p.p_partkey)
            best[k] = min(best.get(k, v), v)
    want = {}
    for (probe, tier, _, _), v in best.items():
        want.setdefault((probe, tier), []).append(v)
    rows = set()
    for probe in {p for p, _ in want}:
        n = 0
        for tier in sorted(t for p, t in want if p == probe):
            if n < 8:
                found = want[probe, tier]
                rows.add((probe, tier, len(found), min(found)[0], max(i for _, i in found)))
                n += len(found)
    assert {tuple(r) for r in matching.tiered_candidates(spark, DATA).collect()} == rows


def test_long_phrases_match(spark):
    rows = spark.createDataFrame([(1, "soap by Procter and Gamble company ltd"), (2, "procter and gamble")], "pid long, title string")
    aliases = spark.createDataFrame([("Procter and Gamble Company", "P", 1), ("soap", "S", 2)], "alias string, brand string, ord int")
    assert sorted((r.pid, r.brand) for r in brands.phrase_match(rows, "pid", "title", aliases).collect()) == [(1, "P")]


def test_blank_brands_all_stay(spark):
    rows = spark.createDataFrame([(1, "a", 2), (1, "a", 1), (1, None, 3), (1, None, 4), (1, " ", 5)], "g int, brand string, o int")
    assert sorted(r.o for r in resolve.diversify(rows, ["g"], ["o"], "brand").collect()) == [1, 3, 4, 5]


def test_overlap_against_brute_force(spark):
    rows = [(i, f"n{i % 4}", f"b{i * i % 7}" if i % 5 else None) for i in range(40)]
    brands_of = {n: {b for _, x, b in rows if x == n and b} for _, n, _ in rows}
    want = {(i, min(brands_of[n] - {b}), len(brands_of[n] - {b})) for i, n, b in rows if b and brands_of[n] - {b}}
    got = {tuple(r) for r in matching.overlap(spark.createDataFrame(rows, "pid long, name string, brand string")).where("pid % 5 <> 0").collect()}
    assert got == want


def test_dedupe_collects_no_group(spark):
    rows = spark.range(30000).selectExpr("id % 2 AS u", "timestamp_micros(id DIV 2 * 7000000) AS ts", "id AS e")
    found = events.anchored_dedupe(rows, ["u"], "ts", "e", 600)
    assert "collect_list" not in found._jdf.queryExecution().toString()
    # 7 second steps: the first row 600 s or more later is the 86th
    assert sorted(r.e for r in found.collect()) == sorted(2 * i + u for u in (0, 1) for i in range(0, 15000, 86))


def test_upsert_moves_its_rows_once(spark):
    """rows of the base and of the re-read are dealt out by id, and what the full join gives is not moved again."""
    fields = [*merge.VOLATILE, *merge.FROZEN]
    made = lambda n, shift: spark.range(n).selectExpr(f"CAST(id + {shift} AS string) AS id", *(f"IF(id % 3 = 0, CAST(id AS string), NULL) AS {f}" if f == "match_key" else "'EUR' AS currency" if f == "currency" else f"CAST(id AS string) AS {f}" for f in fields), f"CAST(id + {shift} AS string) AS ord")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        merged = merge.full_upsert(made(60, 0), made(60, 30), "ord")
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "FullOuter" in plan and "Exchange" not in plan.split("FullOuter")[0]
        assert {r.counter: r.n for r in merge.upsert_counters(merged).collect()}["row:kept"] == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_probes_that_say_the_same_ask_once(spark, monkeypatch):
    """two hundred probes with one text meet fifty entries once."""
    seen, real = [], resolve.top

    def count(rows, *args):
        seen.append(rows.count())
        return real(rows, *args)

    monkeypatch.setattr(resolve, "top", count)
    probes = spark.range(200).selectExpr("id AS probe", "'red bolt' AS name")
    keys = spark.range(50).selectExpr("lpad(id, 2, '0') AS entry", "'bolt' AS token", "3 AS weight")
    rows = resolve.hits_of(probes, "probe", ["name"], F.split("name", " "), keys, 0.7, 3).collect()
    assert sorted((r.probe, r["rank"], r.entry, r.score) for r in rows) == [(p, k + 1, f"0{k}", 3) for p in range(200) for k in range(3)]
    assert seen == [50]


def test_every_basket_asks(spark):
    """each order with a known part is a query, whatever its number, and gets the hits of a loop over the catalogue."""
    parts = {p.p_partkey: p for p in spark.read.parquet(f"{DATA}/part.parquet").collect()}
    names, baskets = {}, {}
    for p in parts.values():
        k = (p.p_brand, p.p_type)
        names[k] = max(names.get(k, ""), p.p_name)
    known = {r.o_orderkey for r in spark.read.parquet(f"{DATA}/orders.parquet").collect()}
    for r in spark.read.parquet(f"{DATA}/lineitem.parquet").collect():
        if r.l_orderkey in known and r.l_partkey in parts:
            baskets.setdefault(r.l_orderkey, []).append(parts[r.l_partkey])
    weights = {"/".join(k): [*((w, 3) for w in n.split(" ")), (k[1].lower(), 1)] for k, n in names.items()}
    want = set()
    for order, held in baskets.items():
        said = {*max(p.p_name for p in held).split(" "), min(p.p_type for p in held).lower()}
        scores = {e: s for e, words in weights.items() if (s := sum(n for w, n in words if w in said))}
        near = sorted((-s, e) for e, s in scores.items() if s >= 0.7 * max(scores.values()))
        want |= {(order, i + 1, e, -s) for i, (s, e) in enumerate(near[:3])}
    got = {(r.o_orderkey, r["rank"], r.entry, r.score) for r in registry.QUERIES["retrieval_topk"](spark, DATA).collect()}
    assert got == want and {o for o, *_ in got} == set(baskets)
