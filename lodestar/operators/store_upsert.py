"""Upsert of stores in which what is inserted becomes a candidate for what follows.

Records come in an order: those on file, then the fresh ones.  A fresh record goes into the first kept record of its
address (chain, city, address); else into the first kept one of its chain within ``RADIUS`` metres (or those asked for); else into the
first kept one of its chain and name, unless both are placed.  Otherwise it is kept itself.  What is merged fills the
gaps of the kept record, so that one without a place may gain it; and a kept record of the public map takes over what
the first record of another source says, its place included.  Later records see the place as it is by then.

Which record a later one meets depends on what became of the earlier ones.  They are decided in rounds: a record is
decided once nothing undecided that comes before it can change the answer, which is told from the least
undecided number of its address, of its name, and of the map cells around it, and of the record that it would go into.
Within a tile of the map a task decides one record after the other, so a row of neighbours costs no round each; only
what lies at a tile's edge waits for the next tile.  A kept record of the public map that nothing undecided elsewhere can
change moves within the walk, too.  No table that grows is broadcast.  Tiles are as large as ``TILE`` records allow, and a
task takes no more than that many undecided records of a tile in a round, the earliest ones.

Defined results: null or empty addresses and names match nothing; null chains are one chain; records without a place are
matched by address and name alone; ties of numbers are not allowed (``ord`` is unique among the records on file and among
the fresh ones); no distance is taken across the 180th meridian.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import discard, stage
from .joins import grown
from .rank import first_rows

#: Metres within which two stores of a chain are one (fixed value).
RADIUS = 120.0
#: Undecided records of a tile that a task holds at once.
TILE = 20_000
#: Sizes of tiles in cells, as powers of two, from large to small.
LEVELS = (12, 9, 6, 3)
FIELDS = ("chain", "name", "city", "address", "lat", "lng", "hours", "phone", "source")
_DEGREE = math.pi / 180 * 6_371_000
_FILE = 1 << 60


def _side(radius: float) -> float:
    """Side of a cell in degrees: twice the radius."""
    return 2 * radius / _DEGREE


def metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    y, x = math.radians(b[0] - a[0]), math.radians(b[1] - a[1])
    h = math.sin(y / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(x / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(min(h, 1.0)))


def numbered(on_file: DataFrame, fresh: DataFrame, public: Column) -> DataFrame:
    """The records of both tables with number ``t``, chain, address and name keys, and whether they are of the public map."""
    rows = on_file.withColumn("t", F.col("ord") - _FILE).unionByName(fresh.withColumn("t", F.col("ord").cast("bigint")))
    rows = rows.withColumns({c: F.col(c).cast("double") for c in ("lat", "lng")})
    word = lambda c: text.key(F.col(c))
    chain = F.coalesce(word("chain"), F.lit(""))
    filled = lambda key, *parts: F.when(key != "", F.concat_ws("|", *parts, key))
    return rows.select(
        "t", *FIELDS, chain.alias("ck"), filled(word("address"), chain, word("city")).alias("ak"), filled(word("name"), chain).alias("nk"), F.coalesce(public, F.lit(False)).alias("map"),
        (F.col("lat").isNotNull() & F.col("lng").isNotNull()).alias("placed"),
    )


def _cells(rows: DataFrame, reach: float, size: float) -> DataFrame:
    """``rows`` once for each cell (cy, cx) of ``size`` degrees within ``reach`` cells of their place."""
    wide = F.cos(F.radians("lat"))
    away = F.least(F.lit(reach * size) / F.greatest(wide, F.lit(0.01)), F.lit(180.0))
    span = lambda c, d: F.sequence(F.floor((F.col(c) - d) / size), F.floor((F.col(c) + d) / size))
    return rows.withColumn("cy", F.explode(span("lat", F.lit(reach * size)))).withColumn("cx", F.explode(span("lng", away)))


def _tiles(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (ck, cy, cx, ...) with ``tile``: the largest around them that holds at most ``most`` of them."""
    for level in LEVELS[:-1]:
        name = F.concat_ws(":", F.lit(level), F.shiftright("cy", level), F.shiftright("cx", level))
        sizes = rows.withColumn("k_", name).groupBy("ck", "k_").agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") <= most).withColumnRenamed("k_", f"k{level}").drop("n_").withColumn(f"is{level}", F.lit(True))
        rows = rows.withColumn(f"k{level}", name).join(grown(sizes), ["ck", f"k{level}"], "left")
    last = LEVELS[-1]
    chosen = F.coalesce(*(F.when(F.col(f"is{v}"), F.col(f"k{v}")) for v in LEVELS[:-1]), F.concat_ws(":", F.lit(last), F.shiftright("cy", last), F.shiftright("cx", last)))
    return rows.withColumn("tile", chosen).drop(*(f"{p}{v}" for v in LEVELS[:-1] for p in ("k", "is")))


def _around(store: dict, place: tuple[float, float], reach: float, size: float) -> Iterator:
    """What the cells within ``reach`` metres of a place hold."""
    high = reach / _DEGREE * 1.001
    wide = min(high / max(math.cos(math.radians(place[0])), 0.01), 180.0)
    for cy in range(math.floor((place[0] - high) / size), math.floor((place[0] + high) / size) + 1):
        for cx in range(math.floor((place[1] - wide) / size), math.floor((place[1] + wide) / size) + 1):
            yield from store.get((cy, cx), ())


def _walker(radius: float):
    """What a task does for a tile."""
    size = _side(radius)

    def walk(table: pa.Table) -> pa.Table:
        """Decides the undecided records of a tile one after the other; leaves those that something undecided may change."""
        cell = lambda place: (math.floor(place[0] / size), math.floor(place[1] / size))
        rows, sites, waiting, out = table.to_pylist(), defaultdict(list), defaultdict(list), []
        for r in rows:
            if r["owner"] is not None:
                place = (r["lat"], r["lng"])
                sites[cell(place)].append([r["owner"], r["since"], r["until"], place, r["settled"], r["pending"]])
        for r in sorted((r for r in rows if r["owner"] is None), key=lambda r: r["t"]):
            t, place, into, settled = r["t"], (r["lat"], r["lng"]), None, True
            late = r["a"] == "wait" or (r["outside"] is not None and r["outside"] < t) or any(metres(p, place) <= 2 * radius for p in _around(waiting, place, 2 * radius, size))
            if not late and r["a"] == "hit":
                into, settled = r["a_into"], r["a_settled"]
            elif not late:
                near = [x for x in _around(sites, place, radius, size) if x[1] < t and (x[2] is None or t <= x[2]) and metres(x[3], place) <= radius]
                if near:
                    site = min(near, key=lambda x: x[0])
                    into, _, _, _, settled, pending = site
                    late = not settled and pending is not None and pending < t
                    if not late and not settled and not r["map"]:
                        # nothing before it can change the kept record of the public map, which goes to its place now
                        site[2], settled = t, True
                        sites[cell(place)].append([into, t, None, place, True, None])
                elif r["c"] == "hit":
                    into, settled = r["c_into"], r["c_settled"]
                else:
                    late = r["c"] == "wait"
            if not late:
                out.append((t, into))
            if late or not settled:
                # where a record changes the place of another, the next round tells where that is
                waiting[cell(place)].append(place)
            elif into is None:
                sites[cell(place)].append([t, t, None, place, not r["map"], min((x for x in (r["mate"], r["outside"]) if x is not None), default=None)])
        return pa.table({"t": pa.array([o[0] for o in out], pa.int64()), "into": pa.array([o[1] for o in out], pa.int64())})

    return walk


def _first(name: str, by: Column | None = None) -> Column:
    """The first value of a column, by number, that is not null."""
    return F.min_by(name, F.when(F.col(name).isNotNull() if by is None else by, F.col("t")))


def owners(records: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is known of kept records: (owner, ck, ak, nk, settled, placed_at), and their places over time (owner, ck, lat, lng, since, until, settled)."""
    known = records.join(grown(decided), "t").withColumn("owner", F.coalesce("into", "t"))
    own = known.where("into IS NULL").select("owner", "ck", "ak", "nk", F.col("map").alias("o_map"), F.col("placed").alias("o_placed"), F.col("lat").alias("o_lat"), F.col("lng").alias("o_lng"))
    place = F.struct("t", "lat", "lng", "placed")
    merged = known.where("into IS NOT NULL").groupBy("owner").agg(F.min(F.when(F.col("placed"), place)).alias("gain"), F.min(F.when(~F.col("map"), place)).alias("other"))
    rows = own.join(grown(merged), "owner", "left")
    promoted = F.col("o_map") & F.col("other").isNotNull()
    site = lambda ok, since, lat, lng: F.when(ok, F.struct(since.alias("since"), lat.alias("lat"), lng.alias("lng")))
    moved = promoted & F.col("other.placed")
    gained = ~F.col("o_placed") & F.col("gain").isNotNull() & ~(moved & F.coalesce(F.col("gain.t") == F.col("other.t"), F.lit(False)))
    places = F.array(
        site(F.col("o_placed"), F.col("owner"), F.col("o_lat"), F.col("o_lng")), site(gained, F.col("gain.t"), F.col("gain.lat"), F.col("gain.lng")),
        site(moved, F.col("other.t"), F.col("other.lat"), F.col("other.lng")),
    )
    rows = rows.withColumn("places", F.array_sort(F.filter(places, lambda x: x.isNotNull())))
    rows = rows.withColumn("settled", (F.size("places") > 0) & (~F.col("o_map") | promoted)).withColumn("placed_at", F.get("places", F.lit(0))["since"])
    told = rows.select("owner", "ck", "ak", "nk", "settled", "placed_at")
    spans = F.transform("places", lambda x, i: F.struct(x["since"].alias("since"), F.get("places", i + 1)["since"].alias("until"), x["lat"].alias("lat"), x["lng"].alias("lng")))
    return told, rows.select("owner", "ck", "settled", F.explode(spans).alias("s")).select("owner", "ck", "settled", "s.*")


def _round(records: DataFrame, undecided: DataFrame, decided: DataFrame, tile: int, radius: float) -> DataFrame:
    """(t, into) of the records that this round decides."""
    told, sites = owners(records, decided)
    size = _side(radius)
    told = stage(told, "upsert-owners")
    word = lambda rows, t, name: rows.select(F.explode(F.array(F.struct(F.lit("a").alias("kind"), F.col("ak").alias("k")), F.struct(F.lit("n").alias("kind"), F.col("nk").alias("k")))).alias("x"), F.col(t).alias(name), *(F.col(c) for c in rows.columns if c == "placed")).where("x.k IS NOT NULL")
    unplaced = F.min(F.when(~F.col("placed"), F.col("u"))).alias("l")
    states = word(undecided, "t", "u").unionByName(word(told, "owner", "o"), allowMissingColumns=True).groupBy("x").agg(F.min("u").alias("u"), unplaced, F.count("u").alias("n"), F.min("o").alias("o"))
    states = stage(states.select("x.kind", "x.k", "u", "l", "n", "o"), "upsert-states")
    # the least undecided number of the cells around an unsettled record's places, of its address and of its name
    cells = undecided.where("placed").groupBy("ck", "cy", "cx", "tile").agg(F.min("t").alias("u"))
    cells = stage(cells, "upsert-cells")
    open_ = told.where("NOT settled")
    of = lambda kind, key, rows: rows.join(grown(states.where(F.col("kind") == kind).select(F.col("k").alias(key), *(F.col(c).alias(f"{c}_{kind}") for c in "ulno"))), key, "left")
    near = _cells(sites.where("NOT settled"), 0.5, size).join(grown(cells), ["ck", "cy", "cx"]).groupBy("owner").agg(F.min("u").alias("u_near"))
    # a placed record never goes into a placed one by its name
    named = F.when(F.col("placed_at").isNotNull(), F.col("l_n")).otherwise(F.col("u_n"))
    pending = of("n", "nk", of("a", "ak", open_)).join(grown(near), "owner", "left").select("owner", F.least("u_a", named, "u_near").alias("pending"))
    told = stage(told.join(grown(pending), "owner", "left").select("owner", "settled", "placed_at", "pending"), "upsert-pending")
    asked = of("n", "nk", of("a", "ak", undecided))
    for kind in "an":
        asked = asked.join(grown(told.select(F.col("owner").alias(f"o_{kind}"), *(F.col(c).alias(f"{c}_{kind}") for c in ("settled", "placed_at", "pending")))), f"o_{kind}", "left")
    first = lambda k: F.coalesce((F.col(f"o_{k}") < F.col("t")) & (F.col(f"u_{k}").isNull() | (F.col(f"u_{k}") > F.col(f"o_{k}"))), F.lit(False))
    before = lambda k: F.coalesce(F.col(f"u_{k}") < F.col("t"), F.lit(False))
    unsure = lambda k: ~F.col(f"settled_{k}") & F.coalesce(F.col(f"pending_{k}") < F.col("t"), F.lit(False))
    asked = asked.withColumns({
        "a": F.when(first("a"), F.when(unsure("a"), "wait").otherwise("hit")).when(before("a"), "wait").otherwise("none"),
        "c": F.when(first("n"), F.when(F.col("placed") & F.coalesce(F.col("placed_at_n") < F.col("t"), F.lit(False)), "new").when(unsure("n"), "wait").otherwise("hit")).when(before("n"), "wait").otherwise("new"),
    })
    # the least undecided number that may change the record by address or name, were it kept; its own where that is not known
    mate = F.least(F.when(F.col("n_a") > 1, F.col("t")), F.greatest("t", "l_n"))
    mate = F.when(F.col("l_n").isNull(), F.when(F.col("n_a") > 1, F.col("t"))).otherwise(mate).alias("mate")
    asked = asked.select(mate, "t", "ck", "cy", "cx", "tile", "lat", "lng", "map", "placed", "a", F.col("o_a").alias("a_into"), F.col("settled_a").alias("a_settled"), "c", F.col("o_n").alias("c_into"), F.col("settled_n").alias("c_settled"))
    loose = asked.where("NOT placed AND (a = 'hit' OR (a = 'none' AND c <> 'wait'))")
    loose = loose.select("t", F.when(F.col("a") == "hit", F.col("a_into")).when(F.col("c") == "hit", F.col("c_into")).alias("into"))
    here = first_rows(asked.where("placed"), ["ck", "tile"], ["t"], tile, "n_").drop("n_")
    edge = _cells(here.select("t", "ck", "lat", "lng", F.col("tile").alias("own")), 1, size).join(grown(cells), ["ck", "cy", "cx"]).where("tile <> own").groupBy("t").agg(F.min("u").alias("outside"))
    seen = _cells(sites.join(grown(told.select("owner", "pending")), "owner"), 0.5, size).join(grown(cells.select("ck", "cy", "cx", "tile")), ["ck", "cy", "cx"])
    seen = seen.select("ck", "tile", "owner", "lat", "lng", "settled", "since", "until", "pending").distinct()
    both = here.join(grown(edge), "t", "left").drop("cy", "cx", "placed").unionByName(seen, allowMissingColumns=True)
    return both.groupBy("ck", "tile").applyInArrow(_walker(radius), "t bigint, into bigint").unionByName(loose)


def upsert(on_file: DataFrame, fresh: DataFrame, public: Column, tile: int = TILE, radius: float = RADIUS) -> tuple[DataFrame, DataFrame, int]:
    """The kept stores (t, fields, n_merged), (t, into) of every fresh record (null: inserted), and the number of rounds.

    Both tables hold ``ord`` and FIELDS; ``public`` tells records of the public map.  On file ``t`` is ord - 2**60.
    """
    records = numbered(on_file, fresh, public)
    size = F.lit(_side(radius))
    celled = records.withColumns({"cy": F.floor(F.col("lat") / size), "cx": F.floor(F.col("lng") / size)})
    placed = _tiles(celled.where("placed").select("t", "ck", "cy", "cx"), tile).select("t", "tile")
    records = stage(celled.join(grown(placed), "t", "left"), "upsert-records")
    none = F.lit(None).cast("bigint").alias("into")
    decided = stage(records.where("t < 0").select("t", none), "upsert-decided")
    undecided, rounds = records.where("t >= 0"), 0
    while not undecided.isEmpty():
        rounds += 1
        after = stage(decided.unionByName(_round(records, undecided, decided, tile, radius)), "upsert-decided")
        discard(decided)
        decided = after
        undecided = stage(records.where("t >= 0").join(grown(decided), "t", "left_anti"), "upsert-open")
    known = records.join(grown(decided), "t").withColumn("owner", F.coalesce("into", "t"))
    other = known.where("into IS NOT NULL").groupBy("owner").agg(
        F.count(F.lit(1)).alias("n_merged"), F.min_by(F.struct(*FIELDS), F.when(~F.col("map"), F.col("t"))).alias("new"), *(_first(c).alias(f"gap_{c}") for c in ("city", "address", "hours", "phone")),
        F.min_by(F.struct("lat", "lng"), F.when(F.col("placed"), F.col("t"))).alias("gap"),
    )
    rows = known.where("into IS NULL").join(grown(other), "owner", "left").withColumn("new", F.when(F.col("map"), F.col("new")))
    own_place, new_place = F.when(F.col("placed"), F.struct("lat", "lng")), F.when(F.col("new.lat").isNotNull() & F.col("new.lng").isNotNull(), F.struct("new.lat", "new.lng"))
    place = F.coalesce(new_place, own_place, F.col("gap"), F.struct("lat", "lng"))
    source = F.when(F.col("new").isNotNull(), F.col("new.source")).otherwise(F.col("source")).alias("source")
    filled = [*(F.coalesce(f"new.{c}", c).alias(c) for c in ("chain", "name")), *(F.coalesce(f"new.{c}", c, f"gap_{c}").alias(c) for c in ("city", "address", "hours", "phone")), source]
    stores = rows.select("t", *filled, place["lat"].alias("lat"), place["lng"].alias("lng"), F.coalesce("n_merged", F.lit(0)).alias("n_merged"))
    return stores, decided.where("t >= 0"), rounds


def greedy_merge(stores: DataFrame, block: list[str], km: float, tile: int = TILE) -> DataFrame:
    """(sid, merged_into): a store joins the first kept store of its block within ``km``, in order of ``sid``.

    The upsert of places alone: no address or name, nothing on file.  ``sid`` is a unique whole number from 0 to
    2 ** 60.  Stores off the map or without a block are kept themselves.
    """
    known = F.lit(True)
    for b in block:
        known = known & F.col(b).isNotNull()
    name = F.sha2(F.to_json(F.struct(*block)), 256)
    here = {c: F.when(known, F.col(c)) for c in ("lat", "lng")}
    empty = [F.lit(None).cast("string").alias(c) for c in FIELDS if c not in ("chain", "lat", "lng")]
    fresh = stores.select(F.col("sid").cast("bigint").alias("ord"), name.alias("chain"), *(here[c].alias(c) for c in here), *empty)
    _, decided, _ = upsert(fresh.limit(0), fresh, F.lit(False), tile, 1000 * km)
    return decided.select(F.col("t").alias("sid"), F.coalesce("into", "t").alias("merged_into"))
