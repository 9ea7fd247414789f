"""The cascades of alternatives with all their lanes, bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cascade
from ..sources.catalogue import products, sql, table
from ..sources.shared import stage
from .pairings import _CTES, _KINDS, _NOUNS, GENERIC, entries, scans
from .search import _ANY_TIERS, _SHELF_TIERS, STOP

_NOUN = "element_at(split(name, ' '), -1)"
_KIND = f"element_at(array({', '.join(map(repr, _KINDS))}), cast(nullif(array_position(array({', '.join(map(repr, _NOUNS))}), {{0}}), 0) AS int))"


def _offered(spark, sf_dir):
    """Brands that an entry offers: those of the three next numbers."""
    return entries(spark, sf_dir).selectExpr("entry", "explode(sequence(1, 3)) AS place").selectExpr("entry", "place", "concat('Brand ', entry + place) AS alt")


def _rules(spark, sf_dir):
    """Terms from the nouns' first letters by kind, tags with whole names, traps, shelves and sides."""
    named = table(spark, sf_dir, "part").selectExpr("p_name", "element_at(split(p_name, ' '), -1) AS n").distinct()
    terms = named.selectExpr(f"{_KIND.format('n')} AS family", "left(n, 4) AS term", "n AS ord").where("family IS NOT NULL").distinct()
    tags = named.selectExpr("concat('en:', n, 's') AS tag", "p_name AS term", "p_name AS ord").where("length(p_name) % 2 = 0")
    traps = named.selectExpr("left(n, 4) AS term", "concat(left(n, 4), 'box') AS rest").distinct()
    sides = terms.select("family").distinct().selectExpr("family", "IF(family < 'k', 'food', 'other') AS side")
    labels = table(spark, sf_dir, "part").selectExpr("p_type AS shelf").distinct()
    return terms, tags, traps, sides.select("family").join(labels, F.length("family") + F.length("shelf") != 10), sides


def _search_pool(spark, sf_dir):
    return products(spark, sf_dir).where("pid % 4 <> 1").selectExpr(
        "pid AS cand", "concat(name, IF(pid % 6 = 0, ' with gearbox', '')) AS name", "brand", "lower(category) AS shelf", "IF(pid % 9 <> 0, category, null) AS label",
        "IF(pid % 2 = 0, 'food', 'other') AS side", "CASE pid % 5 WHEN 0 THEN true WHEN 1 THEN false END AS local", "IF(pid % 13 <> 0, price, null) AS price", "concat(name, '/', pid % 40) AS same",
    )


def _static(spark, sf_dir):
    """Many brands for nouns of four letters, two for those of five, none for others."""
    rows = products(spark, sf_dir).selectExpr("pid", "brand", "IF(pid % 11 <> 0, price, null) AS price", f"{_NOUN} AS n", "cast(substr(brand, 7) AS int) AS b")
    return rows.where("(length(n) = 4 AND pid % 3 = 0) OR (length(n) = 5 AND b % 13 = 1)").selectExpr("concat('en:', n, 's') AS tag", "cast(pid AS string) AS cand", "brand", "price")


def _live(spark, sf_dir):
    """Rows for nouns with an odd number of letters."""
    return products(spark, sf_dir).where(f"length({_NOUN}) % 2 = 1 AND pid % 5 < 2").selectExpr(f"concat('en:', {_NOUN}, 's') AS tag", "cast(pid AS string) AS cand", "brand", "price")


def _scan_probes(spark, sf_dir):
    """Scans with what a search needs; of every twelfth the family is one that no entry has."""
    shown = products(spark, sf_dir).selectExpr("pid", "IF(pid % 5 = 0, 'sundries', name) AS name", "IF(pid % 4 = 0, 'nothing', category) AS shelf", "brand AS own")
    asked = scans(spark, sf_dir).withColumns({"family": F.when(F.col("pid") % 12 == 6, "misc").otherwise(F.col("family")), "tags": F.reverse("tags")})
    return asked.join(shown, "pid").withColumnRenamed("pid", "probe")


def _lanes(spark, sf_dir):
    """What a scan's cascade takes after the entries and their answers."""
    return _static(spark, sf_dir), _live(spark, sf_dir), stage(_search_pool(spark, sf_dir), "search-pool"), _rules(spark, sf_dir), STOP, GENERIC


def scan_cascade(spark, sf_dir):
    """Answers of every product as a scan: entry by brand, by tags, static pool, live rows, then the shelf search and its tiers."""
    return cascade.for_scan(_scan_probes(spark, sf_dir), entries(spark, sf_dir), _offered(spark, sf_dir), *_lanes(spark, sf_dir))


_ENTRY, _, _REST = _CTES.partition(",\n    scan AS")
_PAIR = "pair AS" + _REST.partition("pair AS")[2].replace("tagged AS", "by_tag AS")
_SCANNED = "scan AS" + _REST.partition(",\n    pair AS")[0]
_WORD = "string_split(name, ' ')[-1]"
_SEARCH_TABLES = f"""x AS (SELECT DISTINCT p_name, string_split(p_name, ' ')[-1] AS n FROM part),
    term AS (SELECT * FROM (SELECT DISTINCT {_KINDS!r}[list_position({_NOUNS!r}, n)] AS family, left(n, 4) AS term, n AS ord FROM x) WHERE family IS NOT NULL),
    tag_term AS (SELECT 'en:' || n || 's' AS tag, p_name AS term, p_name AS ord FROM x WHERE length(p_name) % 2 = 0),
    trap AS (SELECT DISTINCT left(n, 4) AS term, left(n, 4) || 'box' AS rest FROM x),
    side AS (SELECT DISTINCT family, CASE WHEN family < 'k' THEN 'food' ELSE 'other' END AS side FROM term),
    shelf AS (SELECT family, shelf FROM side, (SELECT DISTINCT p_type AS shelf FROM part) WHERE length(family) + length(shelf) <> 10),
    pool AS (SELECT pid AS cand, name || CASE WHEN pid % 6 = 0 THEN ' with gearbox' ELSE '' END AS name, brand, lower(category) AS shelf, CASE WHEN pid % 9 <> 0 THEN category END AS label, CASE WHEN pid % 2 = 0 THEN 'food' ELSE 'other' END AS side,
        CASE pid % 5 WHEN 0 THEN true WHEN 1 THEN false END AS local, CASE WHEN pid % 13 <> 0 THEN price END AS price, name || '/' || (pid % 40) AS same FROM product WHERE pid % 4 <> 1),
    stat AS (SELECT 'en:' || n || 's' AS tag, pid::VARCHAR AS cand, brand, price FROM (SELECT pid, brand, CASE WHEN pid % 11 <> 0 THEN price END AS price, {_WORD} AS n, substr(brand, 7)::INT AS b FROM product) WHERE (length(n) = 4 AND pid % 3 = 0) OR (length(n) = 5 AND b % 13 = 1)),
    live AS (SELECT 'en:' || {_WORD} || 's' AS tag, pid::VARCHAR AS cand, brand, price FROM product WHERE length({_WORD}) % 2 = 1 AND pid % 5 < 2)"""
#: After ``scan`` (pid, brands, tags from general to specific, family, hint, hint_family, name, shelf, own).
_SCAN_LANES = f"""{_PAIR}, {_SEARCH_TABLES},
    lane AS (SELECT pid, 'brand-match' AS via, place::INT AS place, 'Brand ' || (b.e + place) AS alt FROM picked, range(1, 4) t(place)
        UNION ALL SELECT pid, 'brand-category-match', place::INT, 'Brand ' || (b.e + place) FROM by_tag, range(1, 4) t(place) WHERE pid NOT IN (SELECT pid FROM picked)),
    r1 AS (SELECT * FROM scan WHERE pid NOT IN (SELECT pid FROM lane)),
    t0 AS (SELECT r.pid, st.*, row_number() OVER (PARTITION BY r.pid, st.brand ORDER BY st.price NULLS LAST, cand) AS k FROM r1 r JOIN stat st ON r.tags[-1] = st.tag AND r.own <> st.brand),
    t1 AS (SELECT * FROM (SELECT pid, cand, row_number() OVER (PARTITION BY pid ORDER BY price NULLS LAST, cand) AS place FROM t0 WHERE k = 1) WHERE place <= 6),
    full_ AS (SELECT pid FROM t1 GROUP BY 1 HAVING count(*) >= 3),
    m0 AS (SELECT pid, cand, 0 AS l, place, NULL AS price FROM t1 WHERE pid NOT IN (SELECT pid FROM full_)),
    m1 AS (SELECT * FROM m0 UNION ALL SELECT r.pid, v.cand, 1, 0, v.price FROM r1 r JOIN live v ON r.tags[-1] = v.tag AND r.own <> v.brand WHERE r.pid NOT IN (SELECT pid FROM full_) AND (r.pid, v.cand) NOT IN (SELECT (pid, cand) FROM m0)),
    m2 AS (SELECT * FROM (SELECT pid, cand, row_number() OVER (PARTITION BY pid ORDER BY l, place, price NULLS LAST, cand) AS place FROM m1) WHERE place <= 6),
    probe AS (SELECT pid AS probe, tags, family, name, shelf, own FROM r1 WHERE pid NOT IN (SELECT pid FROM full_) AND pid NOT IN (SELECT pid FROM m2))"""
_SCAN_ROWS = """SELECT pid AS probe, via, place, alt FROM lane UNION ALL SELECT pid, 'static-pool', place::INT, cand FROM t1 WHERE pid IN (SELECT pid FROM full_)
    UNION ALL SELECT pid, 'live', place::INT, cand FROM m2 UNION ALL SELECT probe, tier, rank::INT, cand::VARCHAR FROM any_"""
_SCAN_SHOWN = "SELECT s.pid, brands, list_reverse(tags) AS tags, {family} AS family, hint, hint_family, CASE WHEN s.pid % 5 = 0 THEN 'sundries' ELSE name END AS name, CASE WHEN s.pid % 4 = 0 THEN 'nothing' ELSE category END AS shelf, brand AS own FROM scanned s JOIN product USING (pid)"
_SCAN = sql("product", f"""+{_ENTRY}, {_SCANNED.replace("scan AS", "scanned AS", 1)}, scan AS ({_SCAN_SHOWN.format(family="CASE WHEN s.pid % 12 = 6 THEN 'misc' ELSE family END")}),
    {_SCAN_LANES}{_SHELF_TIERS}{_ANY_TIERS} {_SCAN_ROWS}""")


def _candidates(spark, sf_dir, family):
    return products(spark, sf_dir).selectExpr("pid AS cand", "brand", f"{family} AS family", "category AS shelf", "IF(pid % 11 <> 0, price, null) AS price", "concat(name, '/', pid % 40) AS same", "pid AS ord", "pid % 4 = 0 AS no_photo")


def _trusted(spark, sf_dir):
    """Rows that may answer a shelf row: every second product."""
    return _candidates(spark, sf_dir, f"IF(pid % 10 < 8, {_KIND.format(_NOUN)}, null)").where("cand % 2 = 0 AND cand % 7 < 4")


def _row_probes(spark, sf_dir):
    """Shelf rows with the scans' brands and hints as categories; a third is placed in a family."""
    shown = products(spark, sf_dir).selectExpr("pid", "pid AS cand", "brand AS own", f"IF(pid % 3 = 1, {_KIND.format(_NOUN)}, null) AS family", "IF(pid % 5 = 0, null, category) AS shelf", "concat(name, '/', pid % 40) AS same")
    return scans(spark, sf_dir).select("pid", "brands", "hint", "hint_family").join(shown, "pid").withColumnRenamed("pid", "probe")


def row_cascade(spark, sf_dir):
    """Answers of every product as a shelf row: entry by brand, entries by category, rows of the family, rows of the shelf."""
    return cascade.for_row(_row_probes(spark, sf_dir), entries(spark, sf_dir), _offered(spark, sf_dir), stage(_trusted(spark, sf_dir), "cascade-pool"))


_KIND_OF = f"{_KINDS!r}[list_position({_NOUNS!r}, {{0}})]"
_CANDIDATES = "trusted AS (SELECT pid AS cand, brand, {family} AS family, category AS shelf, CASE WHEN pid % 11 <> 0 THEN price END AS price, name || '/' || (pid % 40) AS same, pid % 4 = 0 AS no_photo FROM product{where})"
_ASKED = f"""q AS (SELECT s.pid, replace(hint, '-', ' ') AS hint, p.brand AS own, CASE WHEN s.pid % 3 = 1 THEN {_KINDS!r}[list_position({_NOUNS!r}, {_WORD})] END AS family, CASE WHEN s.pid % 5 <> 0 THEN category END AS shelf, name || '/' || (s.pid % 40) AS same FROM scan s JOIN product p USING (pid)),
    cat AS (SELECT hint, entry, ord FROM (SELECT DISTINCT hint FROM q WHERE hint IS NOT NULL) JOIN entry ON category = hint OR len(list_filter(tags, lambda t: contains(' ' || regexp_replace(t, '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || hint || ' '))) > 0)"""
_TRUSTED = f"{_CANDIDATES.format(family=f'CASE WHEN pid % 10 < 8 THEN {_KIND_OF.format(_WORD)} END', where=' WHERE pid % 2 = 0 AND pid % 7 < 4')},\n    {_ASKED}"
_CATEGORY_ANSWERS = """SELECT {key}, alt, row_number() OVER (PARTITION BY {key} ORDER BY o, alt) AS place FROM (SELECT {key}, 'Brand ' || (entry + place) AS alt, min((ord, place)) AS o FROM cat, range(1, 4) t(place) GROUP BY 1, 2)"""
_UNPLACED = _SCANNED.replace("CASE WHEN pid % 3 <> 0 THEN k END AS family", "NULL::VARCHAR AS family")
_ROW = sql("product", f"""+{_ENTRY}, {_UNPLACED}, {_PAIR}, {_TRUSTED}, ca AS ({_CATEGORY_ANSWERS.format(key="hint")}),
    l2 AS (SELECT pid, place, alt FROM q JOIN ca USING (hint) WHERE place <= 6 AND pid NOT IN (SELECT pid FROM picked)),
    r2 AS (SELECT * FROM q WHERE pid NOT IN (SELECT pid FROM picked) AND pid NOT IN (SELECT pid FROM l2)),
    f0 AS (SELECT r.pid, t.cand, t.price, row_number() OVER (PARTITION BY r.pid, t.same ORDER BY t.price NULLS LAST, t.cand) AS k FROM r2 r JOIN trusted t ON r.family = t.family AND r.own <> t.brand AND r.same <> t.same),
    l3 AS (SELECT * FROM (SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY price NULLS LAST, cand) AS place, cand FROM f0 WHERE k = 1) WHERE place <= 6),
    l4 AS (SELECT * FROM (SELECT r.pid, row_number() OVER (PARTITION BY r.pid ORDER BY t.cand) AS place, t.cand FROM r2 r JOIN trusted t ON r.shelf = t.shelf AND r.own <> t.brand AND r.pid <> t.cand WHERE r.pid NOT IN (SELECT pid FROM l3)) WHERE place <= 6)
    SELECT pid AS probe, 'brand-match' AS via, place::INT AS place, 'Brand ' || (b.e + place) AS alt FROM picked, range(1, 4) t(place) UNION ALL SELECT pid, 'brand-category-match', place::INT, alt FROM l2
    UNION ALL SELECT pid, 'catalog-family-fallback', place::INT, cand::VARCHAR FROM l3 UNION ALL SELECT pid, 'catalog-category-fallback', place::INT, cand::VARCHAR FROM l4
    UNION ALL SELECT pid, 'none', NULL, NULL FROM r2 WHERE pid NOT IN (SELECT pid FROM l3) AND pid NOT IN (SELECT pid FROM l4)""")


def _asked(spark, sf_dir):
    """Names of products as picked categories, with the tag of their noun; names of an even length are placed in a family."""
    names = products(spark, sf_dir).select("name").distinct()
    return names.selectExpr(
        "name AS probe", "name AS category", "CAST(null AS string) AS brands", f"array('en:food', concat('en:', {_NOUN}, 's')) AS tags", f"IF(length(name) % 2 = 0, {_KIND.format(_NOUN)}, null) AS family",
        "CAST(null AS string) AS hint", "CAST(null AS string) AS hint_family", "CAST(null AS string) AS name", "CAST(null AS string) AS shelf", "CAST(null AS string) AS own",
    )


def category_cascade(spark, sf_dir):
    """Answers of picked categories: entries of the category, else what a scan of its tag gets."""
    return cascade.for_category(_asked(spark, sf_dir), entries(spark, sf_dir), _offered(spark, sf_dir), *_lanes(spark, sf_dir))


_CATEGORY_SCAN = f"""ask_ AS (SELECT DISTINCT name AS pid FROM product),
    cat AS (SELECT pid, entry, ord FROM ask_ JOIN entry ON category = pid OR len(list_filter(tags, lambda t: contains(' ' || regexp_replace(t, '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || pid || ' '))) > 0), ca AS ({_CATEGORY_ANSWERS.format(key="pid")}),
    scan AS (SELECT pid, NULL::VARCHAR AS brands, ['en:food', 'en:' || string_split(pid, ' ')[-1] || 's'] AS tags, CASE WHEN length(pid) % 2 = 0 THEN {_KINDS!r}[list_position({_NOUNS!r}, string_split(pid, ' ')[-1])] END AS family,
        NULL::VARCHAR AS hint, NULL::VARCHAR AS hint_family, NULL::VARCHAR AS name, NULL::VARCHAR AS shelf, NULL::VARCHAR AS own FROM ask_ WHERE pid NOT IN (SELECT pid FROM cat))"""
_CATEGORY = sql("product", f"""+{_ENTRY}, {_CATEGORY_SCAN}, {_SCAN_LANES.replace("r.own <> st.brand", "true").replace("r.own <> v.brand", "true")}{_SHELF_TIERS}{_ANY_TIERS}
    SELECT pid AS probe, 'brand-category-match' AS via, place::INT AS place, alt FROM ca WHERE place <= 6 UNION ALL {_SCAN_ROWS}""")


def _exact(spark, sf_dir, family, pool):
    asked = _row_probes(spark, sf_dir).drop("family").join(products(spark, sf_dir).selectExpr("pid AS probe", f"{family} AS family"), "probe")
    return cascade.exact(asked, entries(spark, sf_dir), _offered(spark, sf_dir), stage(pool, "cascade-pool"))


def exact_answers(spark, sf_dir):
    """Answers of every product's own family alone: the brand's entry, the category's entry, all products of it with a photo first.

    An answer is the first six in a total order, the number that the answer shows (fixed value); all others of the family compete.
    """
    family = _KIND.format(_NOUN)
    return _exact(spark, sf_dir, family, _candidates(spark, sf_dir, family))[0]


def exact_refusals(spark, sf_dir):
    """Entries of products' brands that were refused, by reason."""
    refused = _exact(spark, sf_dir, f"IF(pid % 5 < 4, {_KIND.format(_NOUN)}, null)", _trusted(spark, sf_dir))[1]
    return refused.groupBy("reason").agg(F.count(F.lit(1)).alias("n_probes"), F.sum("n").alias("n"))


_PLACED = _KIND_OF.format("string_split(split_part(same, '/', 1), ' ')[-1]")


def _exact_sql(pool, family):
    return f"""{_ENTRY}, {_SCANNED}, {_PAIR}, {pool},
    e1 AS (SELECT q.* EXCLUDE (family), {family} AS family FROM q),
    of_ AS (SELECT entry, ord, CASE WHEN len(families) = 1 THEN families[1] END AS f FROM entry),
    hit AS (SELECT e1.pid, family, o.* FROM e1 JOIN pair p USING (pid) JOIN of_ o ON o.entry = p.entry WHERE family IS NOT NULL),
    a1 AS (SELECT pid, arg_min(entry, ord) AS entry, min(ord) AS first_ FROM hit WHERE f = family GROUP BY 1),
    a2 AS (SELECT e1.pid, arg_min(o.entry, o.ord) AS entry FROM e1 JOIN cat USING (hint) JOIN of_ o ON o.entry = cat.entry AND o.f = e1.family WHERE e1.pid NOT IN (SELECT pid FROM a1) GROUP BY 1),
    r2 AS (SELECT * FROM e1 WHERE family IS NOT NULL AND pid NOT IN (SELECT pid FROM a1) AND pid NOT IN (SELECT pid FROM a2)),
    f0 AS (SELECT r.pid, t.cand, t.price, no_photo, row_number() OVER (PARTITION BY r.pid, t.same ORDER BY no_photo, t.price NULLS LAST, t.cand) AS k FROM r2 r JOIN trusted t ON r.family = t.family AND r.own <> t.brand AND r.same <> t.same)"""


_EXACT = _exact_sql(_TRUSTED, f"CASE WHEN pid % 5 < 4 THEN {_PLACED} END")
_EXACT_WHOLE = _exact_sql(f"{_CANDIDATES.format(family=_KIND_OF.format(_WORD), where='')},\n    {_ASKED}", _PLACED)
_EXACT_ANSWERS = sql("product", f"""+{_EXACT_WHOLE} SELECT pid AS probe, 'brand-match' AS via, place::INT AS place, 'Brand ' || (entry + place) AS alt FROM a1, range(1, 4) t(place)
    UNION ALL SELECT pid, 'brand-category-match', place::INT, 'Brand ' || (entry + place) FROM a2, range(1, 4) t(place)
    UNION ALL SELECT * FROM (SELECT pid, 'catalog-family-fallback', row_number() OVER (PARTITION BY pid ORDER BY no_photo, price NULLS LAST, cand)::INT AS place, cand::VARCHAR FROM f0 WHERE k = 1) WHERE place <= 6""")
_EXACT_REFUSALS = sql("product", f"""+{_EXACT} SELECT reason, count(DISTINCT pid) AS n_probes, count(*) AS n FROM (SELECT hit.pid, CASE WHEN f IS NULL THEN 'entry spans families' ELSE 'different family' END AS reason FROM hit LEFT JOIN a1 USING (pid)
    WHERE (first_ IS NULL OR ord < first_) AND f IS DISTINCT FROM family UNION ALL SELECT pid, 'undetermined' FROM e1 WHERE family IS NULL) GROUP BY 1""")

QUERIES = {f.__name__: f for f in (scan_cascade, row_cascade, category_cascade, exact_answers, exact_refusals)}
ORACLES = dict(zip(QUERIES, (_SCAN, _ROW, _CATEGORY, _EXACT_ANSWERS, _EXACT_REFUSALS), strict=True))
