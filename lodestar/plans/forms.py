"""Names, phones, hours, sizes, location codes and pages in the forms of their sources, bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import forms, location
from ..operators.joins import grown, match
from ..sources import pages
from ..sources.catalogue import products, sql, stores, table


def name_forms(spark, sf_dir):
    """Firms' names without legal forms, as chain keys, compared with two letters folded, and whether they sell food."""
    shown = F.expr("concat(initcap(n_name), ' Mart', CASE s_suppkey % 4 WHEN 0 THEN ' Sh.p.k.' WHEN 1 THEN ' GmbH & Co' WHEN 2 THEN ' Çaj Ëmbël' ELSE '' END)")
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", shown.alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("  ")).when(F.col("s_suppkey") % 3 == 1, F.col("s_name")).alias("own"))
    name = F.regexp_replace("name", "Sh.p.k.", "Shpk")
    return rows.select("s_suppkey", forms.firm_name(name).alias("firm"), forms.chain_key(F.col("name")).alias("chain_key"), forms.two_letter_fold(F.col("name")).alias("folded"), forms.display_name(F.col("own"), F.col("name")).alias("shown"), forms.mark(F.col("name"), ["mart"], ["caj"]).alias("groceries"))


_NAMES = """WITH r AS (SELECT s_suppkey, s_name, upper(left(n_name, 1)) || lower(substr(n_name, 2)) || ' Mart' AS base, s_suppkey % 4 AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    i AS (SELECT s_suppkey, s_name, k, array_to_string(list_transform(string_split(base, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS base FROM r)
    SELECT s_suppkey, replace(lower(base), '_', ' ') || CASE WHEN k = 2 THEN ' caj embel' ELSE '' END AS firm, replace(replace(lower(base), '_', ''), ' ', '') || ['shpk', 'gmbhco', 'cajembel', ''][k + 1] AS chain_key,
    lower(base) || [' sh.p.k.', ' gmbh & co', ' caj embel', ''][k + 1] AS folded, CASE WHEN s_suppkey % 3 = 1 THEN s_name ELSE base || [' Sh.p.k.', ' GmbH & Co', ' Çaj Ëmbël', ''][k + 1] END AS shown, k <> 2 AS groceries FROM i"""


def phone_forms(spark, sf_dir):
    """Phones by country code and length, and opening hours on the 24-hour clock."""
    raw = F.expr("CASE c_custkey % 5 WHEN 0 THEN concat('+383 ', 44000000 + c_custkey) WHEN 1 THEN concat('00381-', c_custkey) WHEN 2 THEN concat('+383 (', c_custkey, ')') WHEN 3 THEN concat('+381 ', 10000000 + c_custkey) END")
    hour = F.expr("concat(c_custkey % 14, IF(c_custkey % 2 = 0, ':30', ''), IF(c_custkey % 3 = 0, ' am', ' PM'))")
    rows = table(spark, sf_dir, "customer").select("c_custkey", forms.phone_class(raw, "383", 8, ["381"]).alias("p"), forms.clock(hour).alias("clock"))
    return rows.select("c_custkey", "p.phone", "p.fault", "clock")


_PHONES = """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '+383' || (44000000 + c_custkey) END AS phone,
    CASE c_custkey % 5 WHEN 1 THEN 'no code' WHEN 2 THEN CASE WHEN length(c_custkey::VARCHAR) <> 8 THEN length(c_custkey::VARCHAR) || ' digits' END WHEN 3 THEN 'code 381' WHEN 4 THEN 'none' END AS fault,
    CASE WHEN c_custkey % 14 BETWEEN 1 AND 12 THEN lpad(((c_custkey % 14) % 12 + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 12 END)::VARCHAR, 2, '0') || CASE WHEN c_custkey % 2 = 0 THEN ':30' ELSE ':00' END END AS clock FROM customer"""


def pasted_lines(spark, sf_dir):
    """Lines pasted from a map as typed rows."""
    line = F.expr(
        """concat('Store ', c_custkey, IF(c_custkey % 11 = 0, ' - ', ' — '), CASE c_custkey % 3 WHEN 0 THEN 'No reviews' WHEN 1 THEN concat('4.', c_custkey % 10, ' (', c_custkey, ')') ELSE '3.5 (2.6K)' END,
        ' · Market · Street ', c_custkey % 9, IF(c_custkey % 2 = 0, ' · +383 44 111 222', ''), CASE c_custkey % 4 WHEN 0 THEN ' · Open 24 hours' WHEN 1 THEN ' · Opens 7 AM' WHEN 2 THEN ' · Closes 10:30 PM · Delivery' ELSE ' · Closed · Takeout · In-store' END)"""
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", forms.pasted_line(line).alias("r")).where("r IS NOT NULL")
    return rows.select("c_custkey", "r.name", "r.rating", "r.reviews", "r.kind", "r.address", "r.phone", "r.hours", "r.opens", "r.closes", F.array_join("r.services", ",").alias("services"))


_PASTED = """SELECT c_custkey, 'Store ' || c_custkey AS name, CASE c_custkey % 3 WHEN 1 THEN ('4.' || c_custkey % 10)::DOUBLE WHEN 2 THEN 3.5 END AS rating, CASE c_custkey % 3 WHEN 1 THEN c_custkey WHEN 2 THEN 2600 END AS reviews,
    'Market' AS kind, 'Street ' || (c_custkey % 9) AS address, CASE WHEN c_custkey % 2 = 0 THEN '+383 44 111 222' END AS phone, CASE WHEN c_custkey % 4 = 0 THEN '24/7' END AS hours, CASE WHEN c_custkey % 4 = 1 THEN '07:00' END AS opens,
    CASE WHEN c_custkey % 4 = 2 THEN '22:30' END AS closes, CASE c_custkey % 4 WHEN 2 THEN 'Delivery' WHEN 3 THEN 'Takeout,In-store' ELSE '' END AS services FROM customer WHERE c_custkey % 11 <> 0"""


def dedupe_keys(spark, sf_dir):
    """Keys of listings by code, else by name without pack counts, else by row; tallied by kind and size of group."""
    code = F.when(F.col("pid") % 4 == 0, F.concat(F.lit("EAN "), "code")).when(F.col("pid") % 4 == 1, F.lit("123"))
    key = forms.dedupe_key(code, F.when(F.col("pid") % 5 != 0, F.concat("name", F.expr("IF(pid % 2 = 0, ' 10/1', '')"))), F.col("pid"))
    return products(spark, sf_dir).select(key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


_DEDUPE = sql("product", "SELECT CASE WHEN pid % 4 = 0 THEN 'code:' || code WHEN pid % 5 <> 0 THEN 'name:' || name ELSE 'row:' || pid END AS key, count(*) AS n FROM product GROUP BY 1")


def size_sources(spark, sf_dir):
    """The size to show and where it comes from: quantity field, weight, title, pieces."""
    field = F.expr("CASE pid % 6 WHEN 0 THEN '2 x 75 cl' WHEN 1 THEN 'one bag' END")
    title = F.concat("title", F.expr("IF(pid % 8 = 5, ' 24 pcs', '')"))
    rows = products(spark, sf_dir).select("pid", field.alias("field"), title.alias("said"))
    # reading sizes costs far more than a join, so each field and title is read once
    read = rows.select("field", "said").distinct().withColumn("s", forms.best_size(F.col("field"), F.col("said")))
    return match(rows, grown(read), ["field", "said"], "left").select("pid", "s.shown", "s.source")


_SIZES = sql("product", """SELECT pid, CASE WHEN pid % 6 = 0 THEN '2 x 75 cl' ELSE ['6 x 1.5 l', '500 g', '1 kg', '0.33 l', '4 x 100 g', '24 pcs', '2 x 250 ml', '1 kg'][(pid % 8)::INT + 1] END AS shown,
    CASE WHEN pid % 6 = 0 THEN 'field' WHEN pid % 8 = 7 THEN 'weight' WHEN pid % 8 = 5 THEN 'pieces' ELSE 'title' END AS source FROM product""")


def location_codes(spark, sf_dir):
    """Stores' places from their short codes, near a point of reference; far and malformed ones are refused."""
    rows = stores(spark, sf_dir).where("lat IS NOT NULL").select("sid", location.encode(F.col("lat") + 0.00003, F.col("lng") + 0.00003).alias("code"))
    short = F.when(F.col("sid") % 10 == 9, F.lit("AAAA+BB")).otherwise(F.concat(F.substr("code", F.lit(5), F.lit(4)), F.lit("+"), F.right("code", F.lit(2))))
    return rows.select("sid", location.decode_short(short, F.lit(42.66), F.lit(21.16), (42.2, 42.95, 20.55, 21.45), 45.0).alias("p")).select("sid", "p.lat", "p.lng", "p.fault")


# of a short code the place nearest to the reference is meant, so what lies over half a degree off comes out a degree away
_CENTRE = "round((floor(({0} + 0.00003) * 8000) + 0.5) / 8000.0::DOUBLE + CASE WHEN {0} < {1} - 0.5 THEN 1 WHEN {0} > {1} + 0.5 THEN -1 ELSE 0 END, 7)"
_LOCATIONS = sql("store", f"""+c AS (SELECT sid, {_CENTRE.format("lat", 42.66)} AS lat, {_CENTRE.format("lng", 21.16)} AS lng FROM store WHERE lat IS NOT NULL),
    d AS (SELECT *, 2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(lat - 42.66) / 2), 2) + cos(radians(42.66)) * cos(radians(lat)) * pow(sin(radians(lng - 21.16) / 2), 2))) AS km FROM c),
    f AS (SELECT *, CASE WHEN sid % 10 = 9 THEN 'malformed' WHEN NOT (lat BETWEEN 42.2 AND 42.95 AND lng BETWEEN 20.55 AND 21.45) THEN 'outside' WHEN km > 45 THEN 'far' END AS fault FROM d)
    SELECT sid, CASE WHEN fault IS NULL THEN lat END AS lat, CASE WHEN fault IS NULL THEN lng END AS lng, fault FROM f""")


def reply_guard(spark, sf_dir):
    """Conversation turns with words that no reply may have, or colours that the turn before did not name."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    asked = ["system", "model", "data"]
    known = F.filter(F.array(*map(F.lit, asked)), lambda w: F.coalesce(F.lower("before").contains(w), F.lit(False)))
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    both = rows.join(before, ["conv_id", "turn"], "left")
    faults = forms.reply_faults(F.col("text"), known, asked, ["always", "the best"])
    return both.select("conv_id", "turn", F.array_join(faults, ",").alias("faults"))


_SAID = "' ' || trim(regexp_replace(translate(strip_accents(lower(t.text)), 'đłøħıŧßæœðþ', 'dlohitsaodt'), '[^a-z0-9]+', ' ', 'g')) || ' '"
_GUARD = f"""WITH x AS (SELECT t.conv_id, t.turn, coalesce({_SAID}, ' ') AS said, lower(coalesce(b.text, '')) AS before FROM conversations t LEFT JOIN conversations b ON b.conv_id = t.conv_id AND b.turn + 1 = t.turn)
    SELECT conv_id, turn, array_to_string(list_filter([{", ".join(f"CASE WHEN contains(said, ' {w} ') AND NOT contains(before, '{w}') THEN 'brand {w}' END" for w in ("system", "model", "data"))},
        {", ".join(f"CASE WHEN contains(said, ' {w} ') THEN 'claim {w}' END" for w in ("always", "the best"))}], lambda f: f IS NOT NULL), ',') AS faults FROM x"""


def robots_groups(spark, sf_dir):
    """Whether pages may be fetched by rules in groups of agents: a named group outweighs the wildcard, the longest rule decides."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    lines = F.expr("concat('User-agent: *\\nDisallow: /\\nAllow: /en\\n', IF(length(host) % 2 = 0, 'User-Agent: lodestar # us\\nuser-agent: other\\nDisallow: /en/1\\nDisallow:\\n', ''), 'Sitemap: x')")
    return pages.allowed(rows, rows.select("host").distinct().withColumn("robots", lines), "lodestar").select("page_id", "allowed", "rule")


_ROBOTS = r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, CASE WHEN length(host) % 2 = 0 THEN NOT starts_with(path, '/en/1') WHEN starts_with(path, '/en') THEN true ELSE NOT starts_with(path, '/') END AS allowed,
    CASE WHEN length(host) % 2 = 0 THEN CASE WHEN starts_with(path, '/en/1') THEN '/en/1' END WHEN starts_with(path, '/en') THEN '/en' WHEN starts_with(path, '/') THEN '/' END AS rule FROM p"""


def page_objects(spark, sf_dir):
    """JSON that pages carry, cut at its closing bracket, and the leaves of the category tree in it."""
    tree = F.expr("""concat('x = {"a": "}", "c": [{"name": "Top', page_id % 3, '", "sub": [{"name": "Mid", "sub": [{"name": "Leaf', page_id, '"}]}, {"name": "Side"}, ', repeat('{"name": "Deep", "sub": [', cast(page_id % 9 AS int)), '{"name": " End\\\\n", "sub": []}', repeat(']}', cast(page_id % 9 AS int)), ']}]}; {')""")
    rows = table(spark, sf_dir, "pages").select("page_id", pages.balanced(tree, "{").alias("json"))
    return pages.leaves(rows, "page_id", "json", "c", "sub").select("page_id", "path")


_OBJECTS = "SELECT page_id, 'Top' || (page_id % 3) || '/Mid/Leaf' || page_id AS path FROM pages UNION ALL SELECT page_id, 'Top' || (page_id % 3) || '/Side' FROM pages UNION ALL SELECT page_id, 'Top' || (page_id % 3) || '/' || repeat('Deep/', (page_id % 9)::INT) || 'End' FROM pages"


def price_tiles(spark, sf_dir):
    """Products and prices on tiles of a page."""
    tile = """concat('<div class="tile"><a title="Item &amp; ', page_id, '"></a><span class="price">', page_id % 50, ',', 10 + page_id % 90, ' €</span></div><div class="tile"><a title="None"></a></div>')"""
    return pages.tiles(table(spark, sf_dir, "pages").select("page_id", F.expr(tile).alias("html")), "page_id", "html").select("page_id", "title", "price")


_TILES = "SELECT page_id, 'Item & ' || page_id AS title, ((page_id % 50) || '.' || (10 + page_id % 90))::DOUBLE AS price FROM pages UNION ALL SELECT page_id, 'None', NULL FROM pages"

QUERIES = {f.__name__: f for f in (name_forms, phone_forms, pasted_lines, dedupe_keys, size_sources, location_codes, reply_guard, robots_groups, page_objects, price_tiles)}
ORACLES = dict(zip(QUERIES, (_NAMES, _PHONES, _PASTED, _DEDUPE, _SIZES, _LOCATIONS, _GUARD, _ROBOTS, _OBJECTS, _TILES), strict=True))
