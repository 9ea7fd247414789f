"""Filter audit, centroid clustering and source mixing against brute force, and on odd input."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import centroids, filter_audit, mixing

ODD = [
    (1, None, "a", 1), (2, "", None, 1), (3, " \n\t\x0b ", "", 1), (4, "w" * 10 + " $", "a", 1), (5, "same text", "b", 1), (5, "same text", "b", 1), (6, "same text", "a", 1),
    (None, "same text", "a", 1), (None, "same text", "c", 1), (7, "a b " * 30000, "a", 1), (8, "İ \U0001f600 中文 x", "c", 1), (9, "AB cd " * 120, "b", 1), (10, None, None, 1),
    (11, " ".join(f"w{i}" for i in range(300)), "b", 1), (12, " ".join(f"w{i}" for i in range(300)), "b", 1), (-1, "same text", "é", 1),
]
SCHEMA = "doc_id bigint, text string, source string, size int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"part": F.lit("x"), "mask": F.lit(1), "row": F.lit(0), "text_": F.lit("y"), "key": F.lit(2)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_audit(rows, labels):
    seen, good, toxic = {}, set(), set()
    for i, t, *_ in rows:
        if i is not None:
            seen[t or ""] = min(i, seen.get(t or "", i))
    for i, q, x in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if x == 1 else set()
    cells = collections.defaultdict(lambda: [0] * 6)
    removed_by = collections.Counter()
    for i, t, s, *_ in rows:
        t, w, part = t or "", words(t), s or ""
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and i > seen[t],
        }
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for k, x in enumerate(order, 1):
                removed, again = fails[x] and not gone, fails[x] and gone
                gone = gone or fails[x]
                add = (not gone, removed, again, fails[x] and sum(fails.values()) == 1, removed and i in good, removed and i in toxic)
                cells[part, order, k] = [a + int(b) for a, b in zip(cells[part, order, k], add, strict=True)]
                removed_by[part, x] += removed
    return sorted((*key, *c, removed_by[key[0], key[1][key[2] - 1]]) for key, c in cells.items())


def test_audit_of_odd_rows(spark, odd):
    labels = [(5, 1, 0), (5, None, 1), (6, 0, 1), (9, 1, None), (None, 1, 1), (77, 1, 1), (12, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = filter_audit.audit(filter_audit.counted(filter_audit.masks(odd), table))
    names = ["part", "filter_order", "step", *filter_audit.FIELDS, "shapley"]
    assert sorted(tuple(r[c] for c in names) for r in found.collect()) == brute_audit(ODD, [x for x in labels if x[0] is not None])
    assert filter_audit.audit(filter_audit.counted(filter_audit.masks(odd.limit(0)), table)).count() == 0
    assert filter_audit.masks(odd).join(table.limit(0), "doc_id", "left").count() == len(ODD)


def test_fields_do_not_run_over(spark):
    most = (1 << 61) + 3
    rows = [("p", 0, False, False, most), ("p", 31, True, True, most), ("p", 1, True, False, most), ("q", 16, False, True, 7)]
    found = filter_audit.audit(spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean, n bigint")).collect()
    assert len(found) == 1200
    cell = {(r.part, r.filter_order, r.step): r for r in found}
    first, last = cell["p", "ABCDE", 1], cell["p", "BACDE", 2]
    assert (first.kept, first.removed, first.redundant, first.unique_fails, first.good_lost, first.toxic_lost) == (most, 2 * most, 0, most, 2 * most, most)
    assert (last.kept, last.removed, last.redundant) == (most, most, most)
    assert cell["q", "EABCD", 1].removed == 7 and cell["q", "EABCD", 1].shapley == 7 * 120
    assert all(r.kept == 0 for r in found if r.part == "q" and r.step == 5)


def test_copies_of_a_hot_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    found = filter_audit.masks(docs).groupBy((F.col("mask") >= 16).alias("copy")).count().collect()
    assert {r["copy"]: r["count"] for r in found} == {False: 2001, True: 999}


def brute_clusters(rows, k, dim, rounds):
    kept = [(i, [math.floor(1024 * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    cents = [x for _, x in sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)[:k]]
    square = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    nearest = lambda x: min((square(x, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for j in range(len(cents)):
            mine = [x for (_, x), c in zip(kept, own, strict=True) if c == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    total = collections.Counter()
    for _, c, d in found:
        total[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(repr((i, c, d, total[c], sum(total.values()), names[c])) for i, c, d in found)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("dim, spread", [(2, 0.004), (5, 1.0), (64, 0.2)])
def test_clusters_against_brute_force(spark, dim, spread):
    rng = random.Random(dim)
    rows = [(i, [rng.gauss(0, 1) * spread + (i % 11 if dim > 2 else 0) for _ in range(dim)]) for i in range(300)]
    rows += [(i % 3, list(rows[i % 7][1])) for i in range(60)] + [(None, [0.5] * dim), (None, [0.5] * dim)]
    bad = [(900, None), (901, []), (902, [1.0] * (dim + 1)), (903, [None] + [1.0] * (dim - 1)), (904, [math.nan] * dim), (905, [math.inf] * dim)]
    table = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>").withColumns({"cluster": F.lit("x"), "x": F.lit(1), "part": F.lit(0)})
    found = centroids.clusters(table, k=8, dim=dim)
    assert sorted(repr(tuple(r[c] for c in COLUMNS)) for r in found.collect()) == brute_clusters(rows, 8, dim, 10)


def test_few_vectors_and_empty_tables(spark):
    rows = [(5, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [-3.0, 0.1])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(repr(tuple(r[c] for c in COLUMNS)) for r in centroids.clusters(table, dim=2).collect()) == brute_clusters(rows, 8, 2, 10)
    assert centroids.clusters(table.limit(0), dim=2).collect() == [] and centroids.clusters(table, dim=3).columns == COLUMNS
    with pytest.raises(Exception, match="too large"):
        centroids.clusters(spark.createDataFrame([(1, [2.0**17, 0.0])], "vec_id bigint, embedding array<double>"), dim=2)


def test_loosening_holds_in_the_sphere():
    rng = np.random.default_rng(5)
    tighter = 0
    for _ in range(200):
        dim = int(rng.integers(2, 9))
        old, new = rng.normal(0, 1000, (5, dim)).astype(np.int64), rng.normal(0, 1000, (5, dim)).astype(np.int64)
        new = old + (new - old) // 4
        radius = rng.uniform(0, 1500, 5)
        fall = centroids.loosening(old, new, radius)
        for a in range(5):
            out = rng.normal(0, 1, (2000, dim))
            x = old[a] + out / np.linalg.norm(out, axis=1, keepdims=True) * radius[a] * rng.uniform(0, 1, (2000, 1)) ** (1 / dim)
            others = [j for j in range(5) if j != a]
            worst = max((np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)).max() for j in others)
            full = max(np.linalg.norm(new[j] - old[j]) for j in others)
            assert worst <= fall[a] + 1e-6 and fall[a] <= full + 1e-6
            tighter += fall[a] < full - 1e-6
    assert tighter > 200


def test_bounds_spare_scans(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (2000, 8)) + rng.integers(0, 12, (2000, 1)) * 9
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    vectors = centroids.integers(table, 8)
    _, _, scans = centroids.cluster_vectors(vectors, centroids.first_centroids(vectors), 10)
    assert scans[0] == 2000 and sum(scans[1:]) < 10 * 2000 * 0.35


def brute_mix(rows, weights, share, most):
    sized = [(i, s, len(words(t)), t) for i, t, s, *_ in rows]
    total = collections.Counter()
    for _, s, n, _ in sized:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full = set()
    while True:
        free = [s for s in names if s not in full]
        level = (share * sum(total.values()) - sum(most * total[s] for s in full)) / max(sum(weight[s] for s in free), 1)
        above = {s for s in free if level * weight[s] > most * total[s]}
        if not above:
            break
        full |= above
    target = {s: min(float(most * total[s]), level * weight[s]) for s in names}
    key = lambda r: hashlib.md5(f"13:{r[0] if r[0] is not None else '' if r[3] is None else 't' + r[3]}".encode()).hexdigest()[:16]
    line = []
    for s in names:
        sent = 0
        for r in sorted((r for r in sized if r[1] == s), key=key):
            sent += r[2]
            line += [((t * total[s] + sent) / target[s], names.index(s), key(r), r) for t in range(most) if r[2] and target[s]]
    taken, spent = collections.Counter(), 0
    for *_, r in sorted(line, key=lambda x: x[:3]):
        spent += r[2]
        if spent > share * sum(total.values()):
            break
        taken[r] += r[2]
    shown = collections.Counter(r for r in sized)
    return sorted((str(r[0]), str(r[1]), r[2], total[r[1]], round(target[r[1]], 6), taken[r] if shown[r] == 1 else None) for r in sized), taken


def shown(rows, repeated=()):
    return sorted((str(r.doc_id), str(r.source), r.size, r.source_size, round(r.target, 6), None if (r.doc_id, r.source, r.size) in repeated else r.taken) for r in rows)


def test_mix_of_odd_rows(spark, odd):
    want, taken = brute_mix(ODD, mixing.WEIGHTS, mixing.SHARE, mixing.MOST)
    rows = mixing.mix(odd.drop("size").withColumn("size", F.lit("x"))).collect()
    assert shown(rows, {(5, "b", 2)}) == want
    assert sum(r.taken for r in rows) == sum(taken.values())
    assert mixing.mix(odd.limit(0)).collect() == []
    nothing = mixing.mix(odd.withColumn("text", F.lit(" "))).collect()
    assert len(nothing) == len(ODD) and all(r.target == 0 and r.taken == 0 for r in nothing)


@pytest.fixture
def many_ranges(spark):
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "23"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_mix_comes_near_its_targets(spark, many_ranges):
    rng = random.Random(11)
    rows = [(i, "w " * rng.choice([0, 1, 3, 30, 200]), "hot" if i % 3 == 0 else f"s{rng.randrange(7)}", 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix(docs).collect()
    assert shown(found) == brute_mix(rows, mixing.WEIGHTS, mixing.SHARE, mixing.MOST)[0]
    assert shown(found) == shown(mixing.mix(docs.repartition(7)).collect())
    by, target = collections.Counter(), {}
    for r in found:
        by[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    for s, t in target.items():
        assert abs(by[s] - t) <= 200, (s, by[s], t)
    total = sum(r.size for r in found)
    assert 1.5 * total - 200 <= sum(by.values()) <= 1.5 * total


def test_excess_is_shared_again(spark):
    given = spark.createDataFrame([("a", 1), ("b", 1000), ("c", 10), ("d", 50), (None, 2000), ("", 0)], "source string, source_size bigint")
    found, budget = mixing.targets(given)
    target = {r.source: r.target for r in found.collect()}
    assert budget == pytest.approx(sum(target.values())) and budget == 1.5 * 3061
    # weights by code point: '' 5, a 2, b 1, c 5, d 2, null 1
    assert target == pytest.approx({"": 0, "a": 2, "c": 20, "d": 100, "b": 2000, None: 1.5 * 3061 - 2122})
    with pytest.raises(ValueError):
        mixing.targets(given, share=3.0)
