"""Stores: distance, regions, votes and resolution, bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import branches, places, regions
from ..operators.store_upsert import greedy_merge
from ..sources.catalogue import sql, stores, table

_HALF = "(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2))"
# null without a coordinate: least() would pass over the null and put such stores at the other end of the earth
_KM = f"2 * 6371.0::DOUBLE * asin(sqrt(CASE WHEN {_HALF} > 1 THEN 1.0 ELSE {_HALF} END))"


def store_nearest(spark, sf_dir):
    """The three nearest stores in a customer's city."""
    points = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("point"), F.col("c_nationkey").alias("city"), F.expr("42.0D + (c_custkey * 29 % 1000) / 1000.0D").alias("lat0"), F.expr("20.5D + (c_custkey * 31 % 1000) / 1000.0D").alias("lng0")
    )
    found = places.nearest(points, stores(spark, sf_dir).drop("name", "chain"), ["city"], 3)
    return found.select("point", "place", "sid", F.floor(F.col("km") * 100).alias("decametres"))


_NEAREST = sql("store", f"""+c AS (SELECT c_custkey AS point, c_nationkey AS city, 42.0::DOUBLE + (c_custkey * 29 % 1000) / 1000.0::DOUBLE AS lat, 20.5::DOUBLE + (c_custkey * 31 % 1000) / 1000.0::DOUBLE AS lng FROM customer),
    p AS (SELECT point, sid, round({_KM.format(a='c', b='s')}, 6) AS km FROM c JOIN store s USING (city))
    SELECT * FROM (SELECT point, row_number() OVER (PARTITION BY point ORDER BY km NULLS LAST, sid) AS place, sid, floor(km * 100)::BIGINT AS decametres FROM p) WHERE place <= 3""")


def store_radius_pairs(spark, sf_dir):
    """Stores of one chain within thirty kilometres of each other."""
    return places.near_pairs(stores(spark, sf_dir), 30.0, ["chain"]).select("a", "b", F.round("km", 4).alias("km"))


_PAIRS = sql("store", f"SELECT a.sid AS a, b.sid AS b, round({_KM.format(a='a', b='b')}, 4) AS km FROM store a JOIN store b ON a.chain = b.chain AND a.sid < b.sid WHERE {_KM.format(a='a', b='b')} <= 30.0")


def _segments(spark, sf_dir):
    """Every nation's region is a rhombus around a point of its own, in the order of the nations; every third has a hole.  Neighbours overlap."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("region"), F.col("n_nationkey").cast("bigint").alias("ord"), F.expr("42.1D + (n_nationkey % 5) * 0.2D").alias("y"), F.expr("20.6D + (n_nationkey DIV 5) * 0.2D").alias("x"))
    sides = [(0.0, 0.137, 0.091, 0.0), (0.091, 0.0, 0.0, -0.137), (0.0, -0.137, -0.091, 0.0), (-0.091, 0.0, 0.0, 0.137)]
    side = F.explode(F.array(*(F.struct(*(F.lit(v * k).alias(c) for c, v in zip(("y1", "x1", "y2", "x2"), s, strict=True)), F.lit(k < 1).alias("hole")) for k in (1.0, 0.5) for s in sides)))
    drawn = n.withColumn("s", side).where("NOT s.hole OR ord % 3 = 0")
    return drawn.select("region", "ord", *((F.col(k[0]) + F.col(f"s.{k}")).alias(k) for k in ("y1", "x1", "y2", "x2")))


def point_in_polygon(spark, sf_dir):
    """The first region that each store lies in."""
    return regions.in_polygon(stores(spark, sf_dir).select("sid", "lat", "lng"), _segments(spark, sf_dir))


_POLYGON = sql("store", """+n AS (SELECT n_name AS region, n_nationkey AS o, 42.1::DOUBLE + (n_nationkey % 5) * 0.2::DOUBLE AS y, 20.6::DOUBLE + (n_nationkey // 5) * 0.2::DOUBLE AS x FROM nation),
    g AS (SELECT region, o, y + h * [0.0, 0.091, 0.0, -0.091][k]::DOUBLE AS y1, x + h * [0.137, 0.0, -0.137, 0.0][k]::DOUBLE AS x1, y + h * [0.091, 0.0, -0.091, 0.0][k]::DOUBLE AS y2, x + h * [0.0, -0.137, 0.0, 0.137][k]::DOUBLE AS x2
        FROM n, range(1, 5) t(k), (VALUES (1.0::DOUBLE), (0.5::DOUBLE)) q(h) WHERE h = 1 OR o % 3 = 0),
    w AS (SELECT sid, region, o FROM store, g WHERE (y1 > lat) <> (y2 > lat) AND lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)
    SELECT sid, arg_min(region, o) AS region FROM w GROUP BY 1""")


def store_label_vote(spark, sf_dir):
    """The label of each chain by vote of its stores' spellings."""
    label = F.when(F.col("sid") % 3 == 0, F.initcap("chain")).when(F.col("sid") % 3 == 1, F.upper("chain")).otherwise(F.col("chain"))
    return places.label_vote(stores(spark, sf_dir).withColumn("label", label), "chain", "label")


_VOTE = sql("store", """+l AS (SELECT chain, CASE sid % 3 WHEN 0 THEN 'C' || substr(chain, 2) WHEN 1 THEN upper(chain) ELSE chain END AS label FROM store),
    c AS (SELECT chain, label, count(*) AS n FROM l GROUP BY 1, 2)
    SELECT chain, label, n FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY n DESC, length(regexp_replace(label, '[^A-Z]', '', 'g')) DESC, label) AS r FROM c) WHERE r = 1""")


def store_groups(spark, sf_dir):
    """Stores by chain and city, with how many are on the map."""
    return stores(spark, sf_dir).groupBy("chain", "city").agg(F.count(F.lit(1)).alias("n"), F.count("lat").alias("n_placed"), F.array_join(F.sort_array(F.collect_list("sid")), ",").alias("sids"))


_STORE_GROUPS = sql("store", "SELECT chain, city, count(*) AS n, count(lat) AS n_placed, array_to_string(list_sort(list(sid)), ',') AS sids FROM store GROUP BY 1, 2")


def _reports(spark, sf_dir):
    """Store reports made of customers: a phone that a store may have, a chain and a city."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("rid"), F.expr("IF(c_custkey % 4 = 0, concat('p', c_custkey % 3000), null)").alias("phone"), F.expr("concat('chain ', c_custkey % 12)").alias("chain"),
        F.col("c_nationkey").alias("city"), F.expr("42.0D + (c_custkey * 29 % 1000) / 1000.0D").alias("lat"), F.expr("20.5D + (c_custkey * 31 % 1000) / 1000.0D").alias("lng"),
    )


def store_resolution(spark, sf_dir):
    """Reports matched to stores by phone, by distance in a chain and city, or as the only one there."""
    known = stores(spark, sf_dir).withColumn("phone", F.expr("concat('p', sid)"))
    return places.resolve_stores(_reports(spark, sf_dir), known, 15.0)


_RESOLUTION = sql("store", f"""+r AS (SELECT c_custkey AS rid, CASE WHEN c_custkey % 4 = 0 THEN 'p' || (c_custkey % 3000) END AS phone, 'chain ' || (c_custkey % 12) AS chain, c_nationkey AS city,
        42.0::DOUBLE + (c_custkey * 29 % 1000) / 1000.0::DOUBLE AS lat, 20.5::DOUBLE + (c_custkey * 31 % 1000) / 1000.0::DOUBLE AS lng FROM customer),
    h AS (SELECT rid, sid, 1 AS level FROM r JOIN store s ON r.phone = 'p' || s.sid
        UNION ALL SELECT rid, sid, 2 FROM r JOIN store s ON r.chain = s.chain AND r.city = s.city WHERE {_KM.format(a='r', b='s')} <= 15.0
        UNION ALL SELECT rid, sid, 3 FROM r JOIN store s ON r.chain = s.chain AND r.city = s.city),
    g AS (SELECT rid, level, min(sid) AS sid FROM h GROUP BY 1, 2 HAVING count(DISTINCT sid) = 1)
    SELECT rid, b.sid, b.level FROM r LEFT JOIN (SELECT rid, arg_min(sid, level) AS sid, min(level) AS level FROM g GROUP BY 1) b USING (rid)""")


def store_greedy_merge(spark, sf_dir):
    """Stores of one chain that merge into an earlier one within thirty kilometres, in input order."""
    return greedy_merge(stores(spark, sf_dir).select("sid", "chain", "lat", "lng"), ["chain"], 30.0)


# store after store: those kept so far, and whether one of them is near
_GREEDY = sql("store", f"""+o AS (SELECT *, row_number() OVER (ORDER BY sid) AS i FROM store),
    e AS (SELECT a.sid AS a, b.sid AS b FROM store a JOIN store b ON a.chain = b.chain AND a.sid < b.sid WHERE {_KM.format(a='a', b='b')} <= 30.0),
    n AS (SELECT o.i, o.sid, coalesce((SELECT list(e.a) FROM e WHERE e.b = o.sid), []) AS near FROM o),
    r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept
        UNION ALL SELECT n.i, CASE WHEN len(list_intersect(kept, near)) > 0 THEN kept ELSE list_append(kept, sid) END FROM r JOIN n ON n.i = r.i + 1),
    k AS (SELECT kept FROM r ORDER BY i DESC LIMIT 1)
    SELECT sid, CASE WHEN list_contains(kept, sid) THEN sid ELSE list_min(list_intersect(kept, near)) END AS merged_into FROM n, k""").replace("WITH ", "WITH RECURSIVE ", 1)


def _records(spark, sf_dir):
    """Store records with brand-led chains, phones that some share, addresses, and cities that some lack."""
    return stores(spark, sf_dir).selectExpr(
        "sid", "concat(element_at(array('Alfa', 'Beta', 'Gama', 'Delta', 'Zeta'), cast(sid % 5 AS int) + 1), IF(sid % 2 = 0, ' Market', '')) AS chain",
        "concat(element_at(array('Alfa', 'Beta', 'Gama', 'Delta', 'Zeta'), cast(sid % 5 AS int) + 1), ' Shop', IF(sid % 3 = 0, concat(' corner', sid % 7), '')) AS name",
        "IF(sid % 4 = 0, concat('+1 ', sid DIV 10), null) AS phone", "IF(sid % 6 = 5, null, concat('Street word', sid % 9, ' lane', sid % 4, ' ', sid % 13)) AS address",
        "IF(sid % 7 = 6, null, concat('Town ', city)) AS city", "lat", "lng",
    )


def _branch_reports(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS rid", "concat(element_at(array('Alfa', 'Beta', 'Gama', 'Delta', 'Zeta', 'Eta'), cast(c_custkey % 6 AS int) + 1), ' Market', IF(c_custkey % 4 = 1, concat(' corner', c_custkey % 7), '')) AS name",
        "IF(c_custkey % 5 = 0, concat('1-', c_custkey % 40), null) AS phone", "IF(c_custkey % 3 = 0, concat('word', c_custkey % 9, ' lane', c_custkey % 4, ' Rd ', c_custkey % 13), null) AS address",
        "IF(c_custkey % 2 = 0, concat('Town ', c_nationkey), null) AS city", "IF(c_custkey % 8 = 7, 42.0D + (c_custkey * 37 % 1000) / 1000.0D, null) AS lat", "IF(c_custkey % 8 = 7, 20.5D + (c_custkey * 53 % 1000) / 1000.0D, null) AS lng",
        "c_custkey % 17 = 0 AS mall",
    )


def store_cascade(spark, sf_dir):
    """The store record that each report means, by phone, place, address, name, or as the only one; with method and confidence."""
    return branches.resolve(_branch_reports(spark, sf_dir), _records(spark, sf_dir), F.coalesce((F.col("sid") % 3) == 0, F.lit(False)))


_K = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"
_RECORDS = f"""record AS (SELECT sid, ['alfa', 'beta', 'gama', 'delta', 'zeta'][(sid % 5)::INT + 1] AS brand, ['alfa', 'beta', 'gama', 'delta', 'zeta'][(sid % 5)::INT + 1] || CASE WHEN sid % 2 = 0 THEN ' market' ELSE '' END AS chain,
        ['alfa', 'beta', 'gama', 'delta', 'zeta'][(sid % 5)::INT + 1] || ' shop' || CASE WHEN sid % 3 = 0 THEN ' corner' || (sid % 7) ELSE '' END AS called, CASE WHEN sid % 4 = 0 THEN '1' || (sid // 10) END AS phone,
        CASE WHEN sid % 6 = 5 THEN '' ELSE 'street word' || (sid % 9) || ' lane' || (sid % 4) || ' ' || (sid % 13) || ' ' END AS address, CASE WHEN sid % 7 = 6 THEN '' ELSE 'town ' || city END AS city, lat, lng, sid % 3 = 0 AS regional FROM store),
    s AS (SELECT *, address || called AS held FROM record),
    r AS (SELECT c_custkey AS rid, ['alfa', 'beta', 'gama', 'delta', 'zeta', 'eta'][(c_custkey % 6)::INT + 1] AS brand, CASE WHEN c_custkey % 4 = 1 THEN ['corner' || (c_custkey % 7)] ELSE [] END AS extra,
        CASE WHEN c_custkey % 5 = 0 THEN '1' || (c_custkey % 40) END AS phone, CASE WHEN c_custkey % 3 = 0 THEN ['word' || (c_custkey % 9), 'lane' || (c_custkey % 4), (c_custkey % 13)::VARCHAR] ELSE [] END AS words,
        CASE WHEN c_custkey % 2 = 0 THEN 'town ' || c_nationkey ELSE '' END AS city, CASE WHEN c_custkey % 8 = 7 THEN 42.0::DOUBLE + (c_custkey * 37 % 1000) / 1000.0::DOUBLE END AS lat, CASE WHEN c_custkey % 8 = 7 THEN 20.5::DOUBLE + (c_custkey * 53 % 1000) / 1000.0::DOUBLE END AS lng, c_custkey % 17 = 0 AS mall FROM customer),
    p AS (SELECT r.*, s.sid, s.chain, s.called, s.held, s.regional, r.phone = s.phone AS rung, len(list_intersect(r.words, string_split(s.held, ' '))) AS hit, s.city AS at_city,
        r.city <> '' AND s.city <> '' AND r.city <> s.city AND NOT contains(' ' || s.held || ' ', ' ' || r.city || ' ') AS clash, {_KM.format(a='r', b='s')} AS km FROM r JOIN s ON r.brand = s.brand),
    a AS (SELECT *, hit > 0 AND (hit = len(words) OR hit >= 2 AND hit >= 0.6 * len(words)) AS agrees, list_filter(list_concat(['market'], extra), lambda w: NOT list_contains(['market', brand], w)) AS telling FROM p),
    ph AS (SELECT rid, count(*) AS n, min(sid) AS sid, count(*) FILTER (WHERE agrees) AS m, min(sid) FILTER (WHERE agrees) AS asid FROM a WHERE rung GROUP BY 1),
    lv AS (SELECT rid, 1 AS level, CASE WHEN n = 1 THEN sid WHEN m = 1 THEN asid END AS sid, CASE WHEN n = 1 THEN 'phone' WHEN m = 1 THEN 'phone+address' ELSE 'ambiguous' END AS method, CASE WHEN n = 1 OR m = 1 THEN 'high' END AS confidence FROM ph
        UNION ALL SELECT rid, 3, arg_min(sid, (km, sid)), 'near', 'high' FROM a WHERE km <= 0.15 GROUP BY 1
        UNION ALL SELECT rid, 4, CASE WHEN count(*) = 1 THEN min(sid) END, CASE WHEN count(*) = 1 THEN 'chain+address' ELSE 'ambiguous' END, CASE WHEN count(*) = 1 THEN 'high' END FROM a WHERE NOT mall AND agrees AND NOT clash GROUP BY 1
        UNION ALL SELECT rid, 5, min(sid), 'name', 'medium' FROM a WHERE NOT mall AND len(telling) > 0 AND len(list_filter(telling, lambda w: NOT list_contains(string_split(called, ' '), w))) = 0 AND NOT clash GROUP BY 1 HAVING count(*) = 1
        UNION ALL SELECT rid, 6, min(sid), 'sole in region', 'low' FROM (SELECT *, count(*) OVER (PARTITION BY rid) AS n FROM a WHERE NOT mall AND regional) WHERE {{sole}} GROUP BY 1 HAVING count(*) = 1
        UNION ALL SELECT rid, 7, min(sid), 'sole in city', 'low' FROM a WHERE NOT mall AND city <> '' AND city = at_city GROUP BY 1 HAVING count(*) = 1),
    b AS (SELECT rid, arg_min({{{{'s': sid, 'm': method, 'c': confidence}}}}, level) AS b FROM lv GROUP BY 1), n AS (SELECT brand, count(*) AS n_all FROM s GROUP BY 1)"""
_CASCADE = sql("store", f"+{_RECORDS.format(sole='NOT clash')} SELECT r.rid, b.b.s AS sid, coalesce(b.b.m, CASE WHEN mall OR lat IS NOT NULL OR coalesce(n_all < 2, true) THEN 'new' ELSE 'unresolved' END) AS method, b.b.c AS confidence FROM r LEFT JOIN b USING (rid) LEFT JOIN n USING (brand)")


def chain_renames(spark, sf_dir):
    """Chains written in several ways under one name, with how many stores were renamed."""
    shown = F.expr("concat(IF(sid % 3 = 0, upper(chain), chain), IF(sid % 5 = 0, '.', ''))")
    rows = stores(spark, sf_dir).withColumn("chain", shown)
    return branches.renames(branches.canonical_chains(rows, stores(spark, sf_dir).select(F.col("chain").alias("alias"), F.initcap("chain").alias("canonical")).distinct()))


_RENAMES = sql("store", """SELECT chain, canonical, count(*) AS n FROM (SELECT CASE WHEN sid % 3 = 0 THEN upper(chain) ELSE chain END || CASE WHEN sid % 5 = 0 THEN '.' ELSE '' END AS chain, 'C' || substr(chain, 2) AS canonical FROM store) WHERE chain <> canonical GROUP BY 1, 2""")


def merged_records(spark, sf_dir):
    """Records of one chain and city as one, every field from the first that has it."""
    rows = _records(spark, sf_dir).join(stores(spark, sf_dir).select("sid", F.concat_ws("/", "chain", F.col("city").cast("string")).alias("into")), "sid")
    return branches.merge_fields(rows, "into", "sid", ["sid", "phone", "address", "city", "lat"])


_MERGED = sql("store", f"""+w AS (SELECT x.sid, x.chain || '/' || x.city AS into_, CASE WHEN x.sid % 4 = 0 THEN '+1 ' || (x.sid // 10) END AS phone, CASE WHEN x.sid % 6 <> 5 THEN 'Street word' || (x.sid % 9) || ' lane' || (x.sid % 4) || ' ' || (x.sid % 13) END AS address, CASE WHEN x.sid % 7 <> 6 THEN 'Town ' || x.city END AS city, x.lat FROM store x)
    SELECT into_ AS into, min(sid) AS sid, arg_min(phone, sid) FILTER (WHERE phone IS NOT NULL) AS phone, arg_min(address, sid) FILTER (WHERE address IS NOT NULL) AS address, arg_min(city, sid) FILTER (WHERE city IS NOT NULL) AS city, arg_min(lat, sid) FILTER (WHERE lat IS NOT NULL) AS lat, count(*) AS n_merged FROM w GROUP BY 1""")


def official_lists(spark, sf_dir):
    """Records of a weaker source less those of listed chains, and listed stores that got their place from them."""
    rows = stores(spark, sf_dir)
    weak, listed = rows.where("sid % 2 = 0"), rows.where("sid % 2 = 1 AND chain IN ('chain 1', 'chain 2', 'chain 3', 'chain 4')").withColumns({"lat": F.when(F.col("sid") % 3 != 0, F.col("lat")), "lng": F.when(F.col("sid") % 3 != 0, F.col("lng"))})
    both = weak.unionByName(rows.where("chain = 'chain 5' AND sid % 4 = 1")).unionByName(rows.where("chain = 'chain 1'").withColumn("sid", F.col("sid") + 1000000))
    kept, placed = branches.without_listed(both, listed, ["chain", "city"])
    return kept.select("sid", F.lit("kept").alias("status"), "lat").unionByName(placed.select("sid", F.when(F.col("moved"), "placed").otherwise("listed").alias("status"), "lat"))


_LISTED = sql("store", """+l AS (SELECT sid, chain, city, CASE WHEN sid % 3 <> 0 THEN lat END AS lat FROM store WHERE sid % 2 = 1 AND chain IN ('chain 1', 'chain 2', 'chain 3', 'chain 4')),
    w AS (SELECT sid, chain, city, lat FROM store WHERE sid % 2 = 0 UNION ALL SELECT sid, chain, city, lat FROM store WHERE chain = 'chain 5' AND sid % 4 = 1 UNION ALL SELECT sid + 1000000, chain, city, lat FROM store WHERE chain = 'chain 1'),
    o AS (SELECT chain, city, min(lat) AS lat FROM w WHERE chain IN (SELECT chain FROM l) AND lat IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT sid, 'kept' AS status, lat FROM w WHERE chain NOT IN (SELECT chain FROM l)
    UNION ALL SELECT sid, CASE WHEN l.lat IS NULL AND o.lat IS NOT NULL THEN 'placed' ELSE 'listed' END, coalesce(l.lat, o.lat) FROM l LEFT JOIN o USING (chain, city)""")


def owner_fields(spark, sf_dir):
    """What owners gave for stores: fields that were missing, and fields where they say otherwise."""
    given = stores(spark, sf_dir).where("sid % 3 <> 1").selectExpr("sid", "concat('+1 ', sid DIV 10) AS phone", "IF(sid % 2 = 0, 'elsewhere', '') AS address", "concat('Town ', city) AS city")
    out = branches.supplied(_records(spark, sf_dir), given, ["phone", "address", "city"])
    return out.select("sid", "phone", "address", F.array_join("given", ",").alias("given"), F.array_join("disputed", ",").alias("disputed"))


_OWNED = sql("store", """+w AS (SELECT sid, sid % 3 <> 1 AS g, CASE WHEN sid % 4 = 0 THEN '+1 ' || (sid // 10) END AS phone, CASE WHEN sid % 6 <> 5 THEN 'Street word' || (sid % 9) || ' lane' || (sid % 4) || ' ' || (sid % 13) END AS address, CASE WHEN sid % 7 <> 6 THEN 'Town ' || city END AS city FROM store)
    SELECT sid, coalesce(phone, CASE WHEN g THEN '+1 ' || (sid // 10) END) AS phone, coalesce(address, CASE WHEN g THEN CASE WHEN sid % 2 = 0 THEN 'elsewhere' ELSE '' END END) AS address,
    concat_ws(',', CASE WHEN g AND phone IS NULL THEN 'phone' END, CASE WHEN g AND address IS NULL AND sid % 2 = 0 THEN 'address' END, CASE WHEN g AND city IS NULL THEN 'city' END) AS given,
    concat_ws(',', CASE WHEN g AND address IS NOT NULL AND sid % 2 = 0 THEN 'address' END) AS disputed FROM w""")


def stocking_stores(spark, sf_dir):
    """How many stores stock a product, by the chains of its source or else by the venue it names."""
    chains = stores(spark, sf_dir).where("sid % 2 = 0").select(F.col("sid").alias("source"), "chain")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), (F.col("p_partkey") % 10).alias("source"), F.expr("IF(p_partkey % 3 = 0, upper(concat('Chain-', p_partkey % 12)), null)").alias("venue"))
    return branches.stocked(rows, stores(spark, sf_dir), chains)


_STOCKING = sql("store", """+p AS (SELECT p_partkey AS pid, p_partkey % 10 AS source, CASE WHEN p_partkey % 3 = 0 THEN 'chain ' || (p_partkey % 12) END AS venue FROM part),
    c AS (SELECT DISTINCT p.pid, t.sid FROM p JOIN store s ON s.sid = p.source AND s.sid % 2 = 0 JOIN store t ON t.chain = s.chain),
    v AS (SELECT pid, sid FROM p JOIN store ON chain = venue WHERE pid NOT IN (SELECT pid FROM c))
    SELECT pid, 'chain' AS claim, count(*) AS n, min(sid) AS "first" FROM c GROUP BY 1 UNION ALL SELECT pid, 'venue', count(*), min(sid) FROM v GROUP BY 1""")

QUERIES = {f.__name__: f for f in (store_nearest, store_radius_pairs, point_in_polygon, store_label_vote, store_groups, store_resolution, store_greedy_merge, store_cascade, chain_renames, merged_records, official_lists, owner_fields, stocking_stores)}
ORACLES = dict(zip(QUERIES, (_NEAREST, _PAIRS, _POLYGON, _VOTE, _STORE_GROUPS, _RESOLUTION, _GREEDY, _CASCADE, _RENAMES, _MERGED, _LISTED, _OWNED, _STOCKING), strict=True))
