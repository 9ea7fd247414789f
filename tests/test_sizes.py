"""Tables that grow are never broadcast, whatever their guessed size; results do not change with that."""

import random
import types

import pandas as pd
import pytest
from pyspark.sql import functions as F

import lodestar.registry as registry
from lodestar.operators import branches
from lodestar.streaming import replay

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def broadcasts(df):
    """The first nodes under each broadcast exchange, in the plan that is made before anything runs."""
    lines = plan_of(df).splitlines()
    found = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = line.index("BroadcastExchange")
            under = []
            for below in lines[i + 1 :]:
                if len(below) - len(below.lstrip(" :+-*()0123456789")) <= depth:
                    break
                under.append(below)
            found.append("\n".join(under[:3]))
    return found


@pytest.mark.parametrize("name", ["rule_families", "tag_families", "shelf_labels"])
def test_rule_joins_broadcast_no_titles(spark, name):
    assert not [b for b in broadcasts(registry.QUERIES[name](spark, DATA)) if "pid#" in b]


@pytest.mark.parametrize("name", ["live_merged", "product_identity", "exact_family"])
def test_products_are_not_broadcast(spark, name):
    found = broadcasts(registry.QUERIES[name](spark, DATA))
    assert not [b for b in found if "pid#" in b]


def test_stocked_counts_what_stocking_pairs(spark):
    rng = random.Random(4)
    names = ["Chain A", "chain-b", "C", "", None]
    products = spark.createDataFrame([(i, rng.choice([None, *range(8)]), rng.choice([*names, "chain D"])) for i in range(200)], "pid long, source long, venue string")
    records = spark.createDataFrame([(i, rng.choice(names), rng.choice([*names, "chain d"])) for i in range(60)], "sid long, chain string, name string")
    chains = spark.createDataFrame([(rng.randrange(5), rng.choice([*names[:3], "none"])) for _ in range(9)], "source long, chain string")
    want = branches.stocking(products, records, chains).groupBy("pid", "claim").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("first"))
    got = branches.stocked(products, records, chains)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stocking_query_makes_no_pairs(spark):
    """Products meet counts: nothing is grouped once products have come in."""
    plan = plan_of(registry.QUERIES["stocking_stores"](spark, DATA))
    assert not [line for line in plan.splitlines() if "HashAggregate" in line and "pid#" in line]


class Kept:
    """A stand-in for list and value state, and for the handle that gives it; calls are counted."""

    def __init__(self):
        self.values, self.timers, self.calls = [], [], 0

    def exists(self):
        return bool(self.values)

    def get(self):
        return self.values[0] if self.single else iter(list(self.values))

    def appendValue(self, v):
        self.calls += 1
        self.values.append(v)

    def appendList(self, vs):
        self.calls += 1
        self.values.extend(vs)

    def put(self, vs):
        self.values = list(vs)

    def update(self, v):
        self.values = [v]

    def clear(self):
        self.values = []


def test_a_key_waits_with_one_timer():
    states, timers = {}, set()

    def state(name, single):
        states[name] = Kept()
        states[name].single = single
        return states[name]

    handle = types.SimpleNamespace(getListState=lambda n, s: state(n, False), getValueState=lambda n, s: state(n, True), registerTimer=timers.add)
    judge = replay.Replay(replay.Throttled(600, 3), ["id_", "t_", "recent", "throttled"])
    judge.init(handle)
    minute = 60 * replay.MICROS
    times = [i * minute for i in range(100)]
    random.Random(2).shuffle(times)
    list(judge.handleInputRows(("k",), iter([pd.DataFrame({"t_": times, "id_": times})]), None))
    assert timers == {60_000} and states["waiting"].calls == 1
    out, mark = [], 0
    while timers:
        # watermarks in steps of half an hour; all timers that have passed fire, as the engine does
        mark += 30 * 60_000
        for t in sorted(x for x in timers if x <= mark):
            timers.discard(t)
            out += [x for f in judge.handleExpiredTimer(("k",), types.SimpleNamespace(getCurrentWatermarkInMs=lambda m=mark: m), t) for x in f["id_"].tolist()]
    assert out == sorted(times) and not any(s.values for s in states.values())
