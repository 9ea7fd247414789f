"""Term search, tiers and identity rules against plain Python."""

import random
import re

from pyspark.sql import functions as F

from lodestar import registry
from lodestar.operators import search

DATA = "/root/testdata/sf0.001"
TERMS = [("milk", "milk", "01"), ("milk", "qumesht", "02"), ("chocolate", "choc", "03"), ("tea", "tea", "04"), ("cold-tea", "ice tea", "05"), ("pasta", "torte", "06"), ("cake", "tort", "07"), ("bags", "bin bag", "08")]
TRAPS = [("milk", "milka"), ("tea", "team"), ("torte", "tortell")]


def plain(title):
    return re.sub(r"[^a-z0-9]+", " ", title.lower()).strip()


def hits(title):
    t, out = " " + plain(title), []
    for family, term, ord_ in TERMS:
        for at in range(len(t)):
            if t[at] == " " and t.startswith(term, at + 1):
                word = re.match("[a-z0-9]*", t[at + 1 :]).group()
                if not any(term == x and word.startswith(rest) for x, rest in TRAPS):
                    out.append((at + 1, term, family, ord_))
    return out


def tables(spark):
    return spark.createDataFrame(TERMS, "family string, term string, ord string"), spark.createDataFrame(TRAPS, "term string, rest string")


def test_terms_and_traps(spark):
    rng = random.Random(1)
    parts = ["Milk", "milka", "MILKSHAKE", "choco", "tea", "team", "Ice", "tea,", "ice tea", "tortellini", "torte", "tortilla", "bin", "bags", "bin-bags", "x", "Qumësht", ""]
    titles = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 5))) for _ in range(400)] + [None, "", "milk " * 300, "Milka Milk"]
    rows = spark.createDataFrame(list(enumerate(titles)), "pid int, title string")
    terms, traps = tables(spark)
    found = search.term_hits(rows, "pid", F.col("title"), terms, traps)
    fold = lambda t: (t or "").replace("ë", "e")
    assert sorted(map(tuple, found.collect())) == sorted((i, at, term) for i, t in enumerate(titles) for at, term, *_ in hits(fold(t)))
    got = {r.pid: r for r in search.heads(found, "pid", terms).collect()}
    for i, t in enumerate(titles):
        told = sorted((at, -len(term), o, family) for at, term, family, o in hits(fold(t)))
        assert (i in got) == bool(told)
        if told:
            lead = [x for x in told if x[0] == 1]
            assert (got[i].head, got[i].lead, got[i].families) == (told[0][3], lead[0][3] if lead else None, sorted({x[3] for x in told}))
    assert got[len(titles) - 1].head == "milk"  # the word after the trapped one counts
    assert search.term_hits(rows.limit(0), "pid", F.col("title"), terms, traps).count() == 0
    assert search.term_hits(rows, "pid", F.col("title"), terms.limit(0), traps).count() == 0


def test_short_lists_answer_every_brand(spark):
    rng = random.Random(2)
    for case in range(4):
        rows = [(i, rng.choice("aaaaabbc") if case else f"b{i % 3}", f"s{rng.randrange(12)}", rng.randrange(5)) for i in range(120)] + [(200 + i, None, f"s{i}", 9) for i in range(9)]
        frame = spark.createDataFrame([("g", *r) for r in rows], "g string, cand int, brand string, same string, price int")
        lists = search.short_list(frame, ["g"], ["price", "cand"], "brand", "same", 3)
        assert lists.count() <= 9
        probes = spark.createDataFrame([(o, "g") for o in ["a", "b", "c", "b0", "b1", None, "zz"]], "own string, g string").withColumn("probe", F.coalesce("own", F.lit("none")))
        got = {}
        for r in search.answers(probes.join(lists, "g"), ["price", "cand"], 3).collect():
            got.setdefault(r.probe, []).append((r["rank"], r.cand))
        for own in ["a", "b", "c", "b0", "b1", None, "zz"]:
            want, seen = [], set()
            for i, b, s, _ in sorted(rows, key=lambda r: (r[3], r[0])):
                if s not in seen and (own is None or b is None or b != own):
                    seen.add(s)
                    want.append(i)
            assert sorted(got[own or "none"]) == list(enumerate(want[:3], 1)), (case, own)


def meets(rule, words):
    has = lambda w: any(x.startswith(w[:-1]) for x in words) if w.endswith("*") else w in words
    _, _, _, all_of, any_of, none_of = rule
    return (all_of or any_of) and all(map(has, all_of)) and (not any_of or any(map(has, any_of))) and not any(map(has, none_of))


def test_identity_of_named_products(spark):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("smok", "chip", "trik", "vip", "jaf") for b in range(30)]
    word = lambda: rng.choice(vocabulary) if rng.random() < 0.9 else rng.choice(vocabulary)[:4] + "*"
    rules = []
    for i in range(10_000):
        all_of = [word() for _ in range(rng.randint(0, 3))]
        rules.append((f"r{i:05}", f"f{rng.randrange(4)}", f"{i % 7}{i:05}", all_of, [word() for _ in range(rng.randint(0 if all_of else 1, 3))], [word() for _ in range(rng.randint(0, 2))]))
    titles = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 7))).upper() for _ in range(150)] + [None, "", "!!!"]
    table = spark.createDataFrame(rules, "rule string, family string, ord string, all_of array<string>, any_of array<string>, none_of array<string>")
    rows = spark.createDataFrame(list(enumerate(titles)), "pid int, title string")
    got = {r.pid: (r.family, r.entry, r.n_rules) for r in search.identities(rows, "pid", F.col("title"), table).collect()}
    want = {}
    for i, t in enumerate(titles):
        met = [r for r in rules if meets(r, set((t or "").lower().split()))]
        if met:
            families = {r[1] for r in met}
            want[i] = (families.pop() if len(families) == 1 else None, min(met, key=lambda r: (r[2], r[0]))[0], len(met))
    assert got == want and len(want) > 100
    assert search.identities(rows, "pid", F.col("title"), table.where("false")).count() == 0


def named_by_hand(parts):
    """{pid: (family, entry, n_rules)} of the parts by a rule for each name and brand, and for each adjective and shelf."""
    rules = set()
    for p in parts:
        (a, n), b, t = p.p_name.split(" "), int(p.p_brand[6:]), p.p_type.lower()
        rules.add((f"b {a} {n} {b}", "f" + n[0], "", (a, n), (f"b{b}", f"c{b}"), (f"t{b % 7}", "promo")))
        rules.add((f"a {a} {t}", "f" + a[0], "", (), (a[:2] + t, a + "*"), ("box", t[:3] + "*")))
    out = {}
    for p in parts:
        words = {*p.p_name.split(" "), "b" + p.p_brand[6:], p.p_type.lower(), f"t{p.p_partkey % 7}", *(["box"] if p.p_partkey % 10 == 0 else [])}
        if met := [r for r in rules if meets(r, words)]:
            families = {r[1] for r in met}
            out[p.p_partkey] = (families.pop() if len(families) == 1 else None, min(r[0] for r in met), len(met))
    return out


def test_families_by_every_rule(spark):
    """a rule counts however long the names of its adjective and shelf are."""
    parts = spark.read.parquet(f"{DATA}/part.parquet").collect()
    named, want = named_by_hand(parts), {}
    for p in parts:
        lead = "f" + p.p_name[0] if p.p_partkey % 2 == 0 else None
        agreed = lead if p.p_partkey % 3 != 1 else None if lead else "f" + p.p_type[0]
        by_rule = named.get(p.p_partkey, (None,))[0]
        want[p.p_partkey] = (agreed or by_rule, "witness" if agreed else "identity" if by_rule else None)
    assert {r.pid: (r.family, r.by) for r in registry.QUERIES["exact_family"](spark, DATA).collect()} == want


def test_products_meet_every_rule(spark):
    """family, first rule and number of rules of every part, by all rules of names and brands, adjectives and shelves."""
    want = named_by_hand(spark.read.parquet(f"{DATA}/part.parquet").collect())
    assert {r.pid: (r.family, r.entry, r.n_rules) for r in registry.QUERIES["product_identity"](spark, DATA).collect()} == want
    assert max(n for *_, n in want.values()) > 4


def test_plans_meet_words_by_equality(spark):
    terms, traps = tables(spark)
    rows = spark.range(10).selectExpr("id AS pid", "'milk' AS title")
    plan = search.term_hits(rows, "pid", F.col("title"), terms, traps)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_candidates_that_are_alike_meet_an_ask_once(spark, monkeypatch):
    """of four hundred candidates with the same hits a short list meets the ask, with the same answers."""
    seen, real = [], search.short_list

    def count(rows, group, *args):
        if group == ["ask"]:
            seen.append(rows.count())
        return real(rows, group, *args)

    monkeypatch.setattr(search, "short_list", count)
    terms, traps = tables(spark)
    none = spark.createDataFrame([], "tag string, term string, ord string")
    shelves, sides = spark.createDataFrame([], "family string, shelf string"), spark.createDataFrame([("milk", "food")], "family string, side string")
    pool = spark.range(400).selectExpr("id AS cand", "IF(id = 399, 'Fresh milk', 'Milk') AS name", "concat('b', id % 3) AS brand", "'dairy' AS shelf", "CAST(NULL AS string) AS label", "'food' AS side", "true AS local", "CAST(400 - id AS double) AS price", "CAST(id AS string) AS same")
    probes = spark.range(50).selectExpr("id AS probe", "array('en:x') AS tags", "CAST(NULL AS string) AS family", "'Milk' AS name", "IF(id = 0, NULL, concat('b', id % 3)) AS own")
    got = {}
    for r in search.shelf_search(probes, pool, terms, none, traps, shelves, sides)[0].collect():
        got.setdefault(r.probe, {})[r.rank] = r.cand
    for p in range(50):
        want = [c for c in range(399, -1, -1) if p == 0 or c % 3 != p % 3][:6]
        assert [got[p][k + 1] for k in range(6)] == want
    assert seen and max(seen) < 100
