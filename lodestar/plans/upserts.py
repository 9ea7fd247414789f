"""The upsert of stores and what makes one of rows with one address, bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import branches
from ..operators import store_upsert as su
from ..operators.joins import grown
from ..sources.catalogue import sql, stores

#: Every third store is on file; the others come in.  Stores lie in a few places, some with an address, a third of them from the public map.
_RECORDS = """sid AS ord, concat('Chain ', sid % 3) AS chain, CASE sid % 5 WHEN 0 THEN 'Market' WHEN 1 THEN NULL ELSE name END AS name, concat('c', sid % 4) AS city,
    CASE WHEN sid % 4 < 2 THEN concat('Road ', (sid * 7) % 30) END AS address, CASE WHEN sid % 6 <> 0 THEN CAST(42.0 AS DOUBLE) + (sid * 37 % 11) * CAST(0.0015 AS DOUBLE) + sid * CAST(0.0000002 AS DOUBLE) END AS lat,
    CASE WHEN sid % 6 <> 0 THEN CAST(20.5 AS DOUBLE) + (sid * 53 % 13) * CAST(0.0015 AS DOUBLE) + sid * CAST(0.0000002 AS DOUBLE) END AS lng, CASE WHEN sid % 2 = 0 THEN concat(sid, ' h') END AS hours,
    CASE WHEN sid % 3 = 1 THEN concat('+383 ', sid) END AS phone, CASE WHEN (sid DIV 3) % 8 = 0 THEN 'map' ELSE 'own' END AS source"""


def store_upsert(spark, sf_dir):
    """What becomes of every store that comes in: the one it goes into, or itself, and what that one is in the end."""
    rows = stores(spark, sf_dir)
    shown = rows.selectExpr(*_split(_RECORDS))
    on_file, fresh = shown.where("ord % 3 = 0"), shown.where("ord % 3 <> 0")
    kept, decided, _ = su.upsert(on_file, fresh, F.col("source") == "map")
    number = lambda c: F.when(F.col(c) < 0, F.col(c) + F.lit(1 << 60)).otherwise(F.col(c))
    told = decided.select(F.col("t").alias("sid"), F.coalesce("into", "t").alias("t"))
    return told.join(grown(kept), "t").select("sid", number("t").alias("kept_as"), "chain", "name", "city", "address", "hours", "phone", "source", F.round("lat", 7).alias("lat"), F.round("lng", 7).alias("lng"), "n_merged")


def _split(columns: str) -> list[str]:
    """The select list above, at the commas that follow a name."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(columns[at:i])
            at = i + 1
    return [*out, columns[at:]]


_METRES = "2 * 6371000 * asin(sqrt(least(power(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * power(sin(radians({b}.lng - {a}.lng) / 2), 2), 1.0)))"
_KEEP = "{{'t': {t}, 'ck': {s}.ck, 'ak': {s}.ak, 'nk': {s}.nk, 'chain': {s}.chain, 'name': {s}.name, 'city': {s}.city, 'address': {s}.address, 'hours': {s}.hours, 'phone': {s}.phone, 'source': {s}.source, 'lat': {s}.lat, 'lng': {s}.lng, 'n': 0}}"
_TAKES = "(k.source = 'map' AND s.source <> 'map')"
_BOTH = lambda f: f"CASE WHEN {_TAKES} THEN coalesce(s.{f}, k.{f}) ELSE coalesce(k.{f}, s.{f}) END"
_OWN = lambda f: f"CASE WHEN {_TAKES} THEN coalesce(s.{f}, k.{f}) ELSE k.{f} END"
#: One record after the other: the list of kept ones is the state of the recursion.
_UPSERT = sql("store", f"""+RECURSIVE_r AS (SELECT {_RECORDS.replace(" DIV ", " // ")} FROM store),
    keyed AS (SELECT *, lower(chain) AS ck, lower(chain) || '|' || city || '|' || lower(address) AS ak, lower(chain) || '|' || regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g') AS nk FROM RECURSIVE_r),
    fresh AS (SELECT row_number() OVER (ORDER BY ord) AS i, * FROM keyed WHERE ord % 3 <> 0),
    steps AS (
        SELECT 0::BIGINT AS i, (SELECT list({_KEEP.format(t="ord", s="f")} ORDER BY ord) FROM keyed f WHERE ord % 3 = 0) AS kept, NULL::BIGINT AS sid, NULL::BIGINT AS kept_as
        UNION ALL
        SELECT i, CASE WHEN hit IS NULL THEN list_append(kept, {_KEEP.format(t="s.ord", s="s")}) ELSE list_transform(kept, lambda k: CASE WHEN k.t <> hit THEN k ELSE
            {{'t': k.t, 'ck': k.ck, 'ak': k.ak, 'nk': k.nk, 'chain': {_OWN("chain")}, 'name': {_OWN("name")}, 'city': {_BOTH("city")}, 'address': {_BOTH("address")}, 'hours': {_BOTH("hours")}, 'phone': {_BOTH("phone")},
              'source': CASE WHEN {_TAKES} THEN s.source ELSE k.source END, 'lat': {_BOTH("lat")}, 'lng': {_BOTH("lng")}, 'n': k.n + 1}} END) END, s.ord, coalesce(hit, s.ord)
        FROM (SELECT f.i, p.kept, f AS s, coalesce(
                list_filter(p.kept, lambda k: k.ak = f.ak)[1].t,
                list_filter(p.kept, lambda k: k.ck = f.ck AND coalesce({_METRES.format(a="k", b="f")} <= {su.RADIUS}, false))[1].t,
                CASE WHEN f.lat IS NULL OR list_filter(p.kept, lambda k: k.nk = f.nk)[1].lat IS NULL THEN list_filter(p.kept, lambda k: k.nk = f.nk)[1].t END) AS hit
            FROM steps p JOIN fresh f ON f.i = p.i + 1)),
    final AS (SELECT unnest(kept) AS k FROM steps ORDER BY i DESC LIMIT (SELECT len(kept) FROM steps ORDER BY i DESC LIMIT 1))
    SELECT sid, kept_as, k.chain AS chain, k.name AS name, k.city AS city, k.address AS address, k.hours AS hours, k.phone AS phone, k.source AS source, round(k.lat, 7) AS lat, round(k.lng, 7) AS lng, k.n::BIGINT AS n_merged
    FROM steps JOIN final ON k.t = kept_as WHERE sid IS NOT NULL""").replace("WITH store AS", "WITH RECURSIVE store AS", 1).replace("RECURSIVE_r", "shown")


def stores_by_address(spark, sf_dir):
    """Stores of one chain, city and address, or name, as one, unless they lie apart."""
    kept = branches.by_address(stores(spark, sf_dir).selectExpr(*_split(_RECORDS)))
    return kept.select("ord", "chain", "name", "city", "address", "hours", "phone", F.round("lat", 7).alias("lat"), F.round("lng", 7).alias("lng"), "n_merged")


_BY_ADDRESS = sql("store", f"""+x AS (SELECT {_RECORDS.replace(" DIV ", " // ")} FROM store),
    k AS (SELECT *, coalesce('a|' || lower(chain) || '|' || city || '|' || lower(address), 'n|' || lower(chain) || '|' || city || '|' || regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), ord::VARCHAR) AS key FROM x),
    p AS (SELECT key, arg_min(lat, ord) AS lat, arg_min(lng, ord) AS lng FROM k WHERE lat IS NOT NULL GROUP BY 1),
    m AS (SELECT k.*, CASE WHEN k.lat IS NOT NULL AND {_METRES.format(a="p", b="k")} > 120 THEN ord END AS alone FROM k LEFT JOIN p USING (key))
    SELECT min(ord) AS ord, arg_min(chain, ord) AS chain, arg_min({{'v': name}}, ord).v AS name, arg_min(city, ord) AS city, arg_min(address, ord) FILTER (WHERE address IS NOT NULL) AS address, arg_min(hours, ord) FILTER (WHERE hours IS NOT NULL) AS hours,
        arg_min(phone, ord) FILTER (WHERE phone IS NOT NULL) AS phone, round(arg_min(lat, ord) FILTER (WHERE lat IS NOT NULL), 7) AS lat, round(arg_min(lng, ord) FILTER (WHERE lng IS NOT NULL), 7) AS lng, count(*) - 1 AS n_merged FROM m GROUP BY key, alone""")

QUERIES = {f.__name__: f for f in (store_upsert, stores_by_address)}
ORACLES = dict(zip(QUERIES, (_UPSERT, _BY_ADDRESS), strict=True))
