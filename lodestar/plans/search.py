"""Shelf search, its tiers and named products, bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search, taxonomy
from ..operators.joins import grown
from ..sources.catalogue import products, sql, table
from ..sources.shared import stage

STOP = ["with"]


def _rules(spark, sf_dir):
    """Rules made of the names: first letters of nouns and whole names as terms, by nouns' families; traps; shelves; sides."""
    named = table(spark, sf_dir, "part").select("p_name", F.split("p_name", " ")[0].alias("a"), F.element_at(F.split("p_name", " "), -1).alias("n")).distinct()
    family = "concat('f', length(n), right(n, 1))"
    stems = named.selectExpr(f"{family} AS family", "left(n, 4) AS term", "concat('2', n) AS ord").distinct()
    phrases = named.where("length(a) = 3").selectExpr("concat('g', right(n, 1)) AS family", "p_name AS term", "concat('1', p_name) AS ord")
    tags = named.where("length(a) = 4").selectExpr("concat('en:', a, '-', n, 's') AS tag", "explode(array(p_name, left(n, 4))) AS term", "p_name AS ord").where("term <> 'ring'")
    traps = named.selectExpr("left(n, 4) AS term", "explode(array(concat(left(n, 4), 'box'), concat(left(n, 4), 'xy'))) AS rest").distinct()
    terms = stems.unionByName(phrases)
    sides = terms.select("family").distinct().selectExpr("family", "IF(right(family, 1) < 'm', 'food', 'other') AS side")
    labels = table(spark, sf_dir, "part").select(F.col("p_type").alias("shelf")).distinct()
    shelves = sides.select("family").join(labels, F.length("family") + F.length("shelf") != 10)
    return terms, tags, traps, shelves, sides


_RULES = """x AS (SELECT DISTINCT p_name, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[-1] AS n FROM part),
    term AS (SELECT DISTINCT 'f' || length(n) || right(n, 1) AS family, left(n, 4) AS term, '2' || n AS ord FROM x UNION ALL SELECT 'g' || right(n, 1), p_name, '1' || p_name FROM x WHERE length(a) = 3),
    tag_term AS (SELECT * FROM (SELECT 'en:' || a || '-' || n || 's' AS tag, unnest([p_name, left(n, 4)]) AS term, p_name AS ord FROM x WHERE length(a) = 4) WHERE term <> 'ring'),
    trap AS (SELECT DISTINCT left(n, 4) AS term, unnest([left(n, 4) || 'box', left(n, 4) || 'xy']) AS rest FROM x),
    side AS (SELECT DISTINCT family, CASE WHEN right(family, 1) < 'm' THEN 'food' ELSE 'other' END AS side FROM term),
    shelf AS (SELECT family, shelf FROM side, (SELECT DISTINCT p_type AS shelf FROM part) WHERE length(family) + length(shelf) <> 10),
    pool AS (SELECT pid AS cand, name || CASE pid % 6 WHEN 0 THEN ' with gearbox' WHEN 1 THEN ' boltxy' WHEN 2 THEN 's' ELSE '' END AS name, CASE WHEN pid % 11 <> 0 THEN brand END AS brand,
        lower(category) || CASE WHEN pid % 9 = 0 THEN ' rods' ELSE '' END AS shelf, CASE WHEN pid % 9 <> 0 THEN category END AS label, CASE WHEN pid % 2 = 0 THEN 'food' ELSE 'other' END AS side,
        CASE pid % 5 WHEN 0 THEN true WHEN 1 THEN false END AS local, CASE WHEN pid % 13 <> 0 THEN price END AS price, name || '/' || (pid % 40) AS same FROM product),
    probe AS (SELECT pid AS probe, ['en:food', 'en:' || replace(name, ' ', '-') || 's', 'en:unknown'] AS tags, CASE WHEN pid % 3 = 0 THEN 'f' || length(string_split(name, ' ')[-1]) || right(name, 1) END AS family,
        CASE WHEN pid % 7 = 0 THEN 'sundries' WHEN pid % 7 = 1 THEN 'set of ' || string_split(name, ' ')[1] ELSE replace(name, 'large ', '') END AS name, CASE WHEN pid % 4 = 0 THEN 'nothing' ELSE category END AS shelf, brand AS own FROM product)"""

#: Every place of a title, term by term.
_HITS = """SELECT {key}, p AS at_, term FROM (SELECT {key}, ' ' || t AS t, unnest(range(1, length(t) + 1)) AS p FROM {rows}), (SELECT DISTINCT term FROM {terms}) z
    WHERE t[p] = ' ' AND starts_with(substr(t, p + 1), term) AND NOT EXISTS (SELECT 1 FROM trap WHERE trap.term = z.term AND starts_with(regexp_extract(substr(t, p + 1), '^[a-z0-9]+'), rest))"""
_KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def _pool(spark, sf_dir):
    return products(spark, sf_dir).selectExpr(
        "pid AS cand", "concat(name, CASE pid % 6 WHEN 0 THEN ' with gearbox' WHEN 1 THEN ' boltxy' WHEN 2 THEN 's' ELSE '' END) AS name", "IF(pid % 11 <> 0, brand, null) AS brand",
        "concat(lower(category), IF(pid % 9 = 0, ' rods', '')) AS shelf", "IF(pid % 9 <> 0, category, null) AS label", "IF(pid % 2 = 0, 'food', 'other') AS side",
        "CASE pid % 5 WHEN 0 THEN true WHEN 1 THEN false END AS local", "IF(pid % 13 <> 0, price, null) AS price", "concat(name, '/', pid % 40) AS same",
    )


def _probes(spark, sf_dir):
    return products(spark, sf_dir).selectExpr(
        "pid AS probe", "array('en:food', concat('en:', replace(name, ' ', '-'), 's'), 'en:unknown') AS tags", "IF(pid % 3 = 0, concat('f', length(element_at(split(name, ' '), -1)), right(name, 1)), null) AS family",
        "CASE WHEN pid % 7 = 0 THEN 'sundries' WHEN pid % 7 = 1 THEN concat('set of ', split(name, ' ')[0]) ELSE replace(name, 'large ', '') END AS name", "IF(pid % 4 = 0, 'nothing', category) AS shelf", "brand AS own",
    )


def title_heads(spark, sf_dir):
    """Families of titles by the earliest term, by a term that leads, and all, with traps on how words go on."""
    terms, _, traps, *_ = _rules(spark, sf_dir)
    rows = _pool(spark, sf_dir)
    found = search.heads(search.term_hits(rows, "cand", F.concat_ws(" ", "name", "shelf"), terms, traps), "cand", terms)
    return found.select("cand", "head", "lead", F.array_join("families", ",").alias("families"))


_HEADS = sql("product", f"""+{_RULES}, t AS (SELECT cand, {_KEY.format("name || ' ' || shelf")} AS t FROM pool), h AS ({_HITS.format(key="cand", rows="t", terms="term")})
    SELECT cand, arg_min(family, (at_, -length(h.term), ord)) AS head, arg_min(family, (-length(h.term), ord)) FILTER (WHERE at_ = 1) AS lead, string_agg(DISTINCT family, ',' ORDER BY family) AS families FROM h JOIN term USING (term) GROUP BY 1""")


def shelf_term_search(spark, sf_dir):
    """For every product the first six others that a search by its tag's and family's terms finds."""
    terms, tags, traps, shelves, sides = _rules(spark, sf_dir)
    best, _ = search.shelf_search(_probes(spark, sf_dir), stage(_pool(spark, sf_dir), "search-pool"), terms, tags, traps, shelves, sides)
    return best.select("probe", "rank", "cand")


_SHELF_TIERS = f""",
    pt AS (SELECT probe, {_KEY.format("name")} AS t FROM probe WHERE family IS NULL), ph AS ({_HITS.format(key="probe", rows="pt", terms="term")}),
    lead AS (SELECT probe, arg_min(family, (-length(ph.term), ord)) AS lead FROM ph JOIN term USING (term) WHERE at_ = 1 GROUP BY 1),
    placed AS (SELECT p.* EXCLUDE (family), coalesce(p.family, lead) AS family FROM probe p LEFT JOIN lead USING (probe)),
    tagged AS (SELECT probe, arg_max(tag, d) AS tag FROM (SELECT probe, unnest(tags) AS tag, generate_subscripts(tags, 1) AS d FROM probe) WHERE tag IN (SELECT tag FROM tag_term) GROUP BY 1),
    asked AS (SELECT p.*, tag, coalesce(tag, '') || '|' || coalesce(family, '') AS ask FROM placed p LEFT JOIN tagged USING (probe)),
    ask AS (SELECT DISTINCT ask, tag, family FROM asked),
    at_ AS (SELECT ask, family, term, min(r) AS r FROM (SELECT ask, a.family, t.term, (0, t.ord) AS r FROM ask a JOIN tag_term t USING (tag) UNION ALL SELECT ask, a.family, t.term, (1, t.ord) FROM ask a JOIN term t USING (family)) GROUP BY ALL),
    known AS (SELECT term FROM term UNION SELECT term FROM tag_term),
    ct AS (SELECT cand, {_KEY.format("concat_ws(' ', name, brand, shelf)")} AS t FROM pool), ch AS ({_HITS.format(key="cand", rows="ct", terms="known")}),
    sized AS (SELECT ch.*, at_ + length(term) - 1 AS e, length({_KEY.format("concat_ws(' ', name, brand)")}) AS n_name, length({_KEY.format("name")}) AS n_title FROM ch JOIN pool USING (cand)),
    own AS (SELECT cand, arg_min(family, (at_, -length(s.term), ord)) AS head FROM sized s JOIN term USING (term) WHERE e <= n_title GROUP BY 1),
    found AS (SELECT ask, family, cand, min(r) AS r, NOT bool_or(e <= n_name) AS miss FROM sized JOIN at_ USING (term) GROUP BY 1, 2, 3),
    good AS (SELECT f.*, p.brand, p.price, p.same, NOT coalesce(p.local, false) AS strange FROM found f JOIN pool p USING (cand) LEFT JOIN own USING (cand) LEFT JOIN side ON side.family = f.family
        WHERE coalesce(side.side, 'other') = p.side AND (head IS NULL OR coalesce(head = f.family, false))
          AND (p.label IS NULL OR f.family IS NULL OR NOT EXISTS (SELECT 1 FROM shelf s WHERE s.family = f.family) OR EXISTS (SELECT 1 FROM shelf s WHERE s.family = f.family AND s.shelf = p.label))),
    one AS (SELECT a.probe, g.cand, g.miss, g.strange, g.r, g.price, row_number() OVER (PARTITION BY a.probe, g.same ORDER BY miss, strange, g.r, price NULLS LAST, g.cand) AS k
        FROM asked a JOIN good g ON g.ask = a.ask WHERE a.own IS NULL OR g.brand IS NULL OR a.own <> g.brand),
    best AS (SELECT * FROM (SELECT probe, row_number() OVER (PARTITION BY probe ORDER BY miss, strange, r, price NULLS LAST, cand) AS rank, cand FROM one WHERE k = 1) WHERE rank <= 6)"""
_SHELF = _RULES + _SHELF_TIERS
_SEARCH = sql("product", f"+{_SHELF} SELECT probe, rank, cand FROM best")


def any_alternative(spark, sf_dir):
    """The first tier that answers each product: family, a word of the name, the shelf; or why none does."""
    rules = _rules(spark, sf_dir)
    return search.tier_search(stage(_probes(spark, sf_dir), "search-probes"), stage(_pool(spark, sf_dir), "search-pool"), *rules, STOP)


_ANY_TIERS = f""",
    lost AS (SELECT * FROM placed WHERE family IS NULL AND probe NOT IN (SELECT probe FROM best)),
    cw AS (SELECT DISTINCT cand, unnest(string_split({_KEY.format("concat_ws(' ', name, shelf)")}, ' ')) AS w FROM pool),
    pw AS (SELECT DISTINCT probe, own, unnest(string_split({_KEY.format("name")}, ' ')) AS w FROM lost),
    n1 AS (SELECT DISTINCT probe, cand FROM pw JOIN cw USING (w) JOIN pool USING (cand) WHERE length(w) >= 4 AND w <> 'with' AND (own IS NULL OR brand IS NULL OR own <> brand)),
    n2 AS (SELECT *, row_number() OVER (PARTITION BY probe, same ORDER BY NOT coalesce(local, false), price NULLS LAST, cand) AS k FROM n1 JOIN pool USING (cand)),
    n3 AS (SELECT * FROM (SELECT probe, row_number() OVER (PARTITION BY probe ORDER BY NOT coalesce(local, false), price NULLS LAST, cand) AS rank, cand FROM n2 WHERE k = 1) WHERE rank <= 6),
    s1 AS (SELECT l.probe, l.own, p.*, row_number() OVER (PARTITION BY l.probe, p.same ORDER BY NOT coalesce(p.local, false), p.price NULLS LAST, p.cand) AS k FROM lost l JOIN pool p ON lower(l.shelf) = p.shelf
        WHERE l.probe NOT IN (SELECT probe FROM n3) AND (own IS NULL OR p.brand IS NULL OR own <> p.brand)),
    s3 AS (SELECT * FROM (SELECT probe, row_number() OVER (PARTITION BY probe ORDER BY NOT coalesce(local, false), price NULLS LAST, cand) AS rank, cand FROM s1 WHERE k = 1) WHERE rank <= 6),
    every AS (SELECT probe, 'family' AS tier, rank, cand FROM best UNION ALL SELECT probe, 'name', rank, cand FROM n3 UNION ALL SELECT probe, 'category', rank, cand FROM s3),
    any_ AS (SELECT * FROM every UNION ALL SELECT probe, CASE WHEN family IS NULL THEN 'no-family' ELSE 'none-in-family' END, NULL, NULL FROM placed WHERE probe NOT IN (SELECT probe FROM every))"""
_ANY = sql("product", f"+{_SHELF}{_ANY_TIERS} SELECT * FROM any_")


def _identity_rules(spark, sf_dir):
    """A rule for each name and brand, and one for each adjective and shelf."""
    parts = table(spark, sf_dir, "part").selectExpr("split(p_name, ' ') AS w", "cast(substr(p_brand, 7) AS int) AS b", "lower(p_type) AS t")
    by_brand = parts.select("w", "b").distinct().selectExpr("concat_ws(' ', 'b', w[0], w[1], b) AS rule", "concat('f', left(w[1], 1)) AS family", "w AS all_of", "array(concat('b', b), concat('c', b)) AS any_of", "array(concat('t', b % 7), 'promo') AS none_of")
    by_shelf = parts.select(F.expr("w[0] AS a"), "t").distinct().selectExpr("concat_ws(' ', 'a', a, t) AS rule", "concat('f', left(a, 1)) AS family", "array() AS all_of", "array(concat(left(a, 2), t), concat(a, '*')) AS any_of", "array('box', concat(left(t, 3), '*')) AS none_of")
    return by_brand.unionByName(by_shelf).withColumn("ord", F.col("rule"))


def product_identity(spark, sf_dir):
    """Products by rules of several conditions on their titles: the one family that all rules met agree on, and the first rule."""
    title = F.expr("concat_ws(' ', name, concat('B', substr(brand, 7)), category, concat('T', pid % 7), IF(pid % 10 = 0, 'box', null))")
    return search.identities(products(spark, sf_dir), "pid", title, _identity_rules(spark, sf_dir))


_IDENTITY = f"""x AS (SELECT string_split(p_name, ' ') AS w, substr(p_brand, 7)::INT AS b, lower(p_type) AS t FROM part),
    rule AS (SELECT DISTINCT 'b ' || w[1] || ' ' || w[2] || ' ' || b AS rule, 'f' || left(w[2], 1) AS family, w AS all_of, ['b' || b, 'c' || b] AS any_of, ['t' || (b % 7), 'promo'] AS none_of FROM x
        UNION ALL SELECT DISTINCT 'a ' || w[1] || ' ' || t AS rule, 'f' || left(w[1], 1), []::VARCHAR[], [left(w[1], 2) || t, w[1] || '*'], ['box', left(t, 3) || '*'] FROM x),
    title AS (SELECT pid, list_concat(ws, list_transform(list_filter(ws, lambda y: length(y) >= 3), lambda y: left(y, 3) || '*'), list_transform(ws, lambda y: y || '*'), list_transform(list_filter(ws, lambda y: length(y) >= 4), lambda y: left(y, 4) || '*'), list_transform(list_filter(ws, lambda y: length(y) >= 5), lambda y: left(y, 5) || '*')) AS said
        FROM (SELECT pid, string_split(lower(concat_ws(' ', name, 'b' || substr(brand, 7), category, 't' || (pid % 7), CASE WHEN pid % 10 = 0 THEN 'box' END)), ' ') AS ws FROM product)),
    met AS (SELECT pid, r.* FROM title JOIN rule r ON list_has_all(said, all_of) AND list_has_any(said, any_of) AND NOT list_has_any(said, none_of))"""
_IDENTITIES = sql("product", f"+{_IDENTITY} SELECT pid, CASE WHEN min(family) = max(family) THEN min(family) END AS family, min(rule) AS entry, count(*) AS n_rules FROM met GROUP BY 1")


def exact_family(spark, sf_dir):
    """Families that shelf and title agree on, else that of the named product."""
    rows = products(spark, sf_dir).selectExpr("pid", "concat('f', left(category, 1)) AS shelf", "concat('f', left(name, 1)) AS lead", "name")
    shelf = F.when(F.col("pid") % 3 == 0, F.array("shelf", "lead")).when(F.col("pid") % 3 == 1, F.array("shelf")).otherwise(F.array().cast("array<string>"))
    lead = F.when(F.col("pid") % 2 == 0, F.col("lead"))
    known = rows.select("pid", taxonomy.witness(shelf, F.filter(F.array(lead), lambda x: x.isNotNull()), lead).alias("agreed"))
    named = product_identity(spark, sf_dir).select("pid", F.col("family").alias("named"))
    return known.join(grown(named), "pid", "left").select("pid", F.coalesce("agreed", "named").alias("family"), F.when(F.col("agreed").isNotNull(), "witness").when(F.col("named").isNotNull(), "identity").alias("by"))


_EXACT = sql("product", f"""+{_IDENTITY}, named AS (SELECT pid, CASE WHEN min(family) = max(family) THEN min(family) END AS named FROM met GROUP BY 1),
    w AS (SELECT pid, CASE WHEN pid % 2 = 0 THEN 'f' || left(name, 1) END AS lead, 'f' || left(category, 1) AS shelf FROM product),
    k AS (SELECT pid, CASE pid % 3 WHEN 0 THEN lead WHEN 1 THEN CASE WHEN lead IS NULL THEN shelf END ELSE lead END AS agreed FROM w)
    SELECT pid, coalesce(agreed, named) AS family, CASE WHEN agreed IS NOT NULL THEN 'witness' WHEN named IS NOT NULL THEN 'identity' END AS by FROM k LEFT JOIN named USING (pid)""")

QUERIES = {f.__name__: f for f in (title_heads, shelf_term_search, any_alternative, product_identity, exact_family)}
ORACLES = dict(zip(QUERIES, (_HEADS, _SEARCH, _ANY, _IDENTITIES, _EXACT), strict=True))
