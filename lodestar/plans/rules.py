"""Families and shelves by tables of rules, bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import taxonomy
from ..sources.catalogue import products, sql, table

#: What looks like something else in a title, and what to read instead.
TRAPS = [("hot ring", "loop"), ("with bolt", "fixed")]
GENERIC = ["en:food", "en:small"]


def _rules(spark, sf_dir):
    """A rule for each noun of the names: its first four letters, a family by its length and last letter, its side."""
    noun = F.element_at(F.split("p_name", " "), -1)
    named = table(spark, sf_dir, "part").select(noun.alias("ord")).distinct()
    return named.selectExpr("left(ord, 4) AS word", "concat('f', length(ord), right(ord, 1)) AS family", "ord", "IF(length(ord) = 4, 'essential', 'household') AS side")


def _titles(spark, sf_dir):
    return products(spark, sf_dir).selectExpr("pid", "concat_ws(' ', name, CASE pid % 4 WHEN 0 THEN 'with bolt' WHEN 1 THEN 'gearbox' WHEN 2 THEN 'Rings' END) AS title", "category", "name")


_RULES = """rule AS (SELECT left(n, 4) AS word, 'f' || length(n) || right(n, 1) AS family, n AS ord, CASE WHEN length(n) = 4 THEN 'essential' ELSE 'household' END AS side FROM (SELECT DISTINCT string_split(p_name, ' ')[-1] AS n FROM part)),
    t AS (SELECT pid, category, name, replace(replace(' ' || name || CASE pid % 4 WHEN 0 THEN ' with bolt' WHEN 1 THEN ' gearbox' WHEN 2 THEN ' rings' ELSE '' END || ' ', ' hot ring ', ' loop '), ' with bolt ', ' fixed ') AS title FROM product),
    w AS (SELECT pid, unnest(ws) AS w, generate_subscripts(ws, 1) AS at_ FROM (SELECT pid, list_filter(string_split(title, ' '), lambda x: x <> '') AS ws FROM t)),
    h AS (SELECT pid, at_, word, family, ord FROM w JOIN rule ON starts_with(w, word))"""


def rule_families(spark, sf_dir):
    """Families of titles: by the first rule, by the head word, and all of them without parents."""
    parents = _rules(spark, sf_dir).where("length(ord) = 4").select("family").distinct().withColumn("parent", F.lit("f6t"))
    found = taxonomy.by_rules(_titles(spark, sf_dir), "pid", "title", _rules(spark, sf_dir), TRAPS, parents)
    return found.select("pid", "family", "head", F.array_join("families", ",").alias("families"))


_FAMILIES = sql("product", f"""+{_RULES}, e AS (SELECT DISTINCT pid, family FROM h), p AS (SELECT DISTINCT family FROM rule WHERE length(ord) = 4),
    k AS (SELECT pid, family FROM e WHERE NOT (family = 'f6t' AND pid IN (SELECT pid FROM e JOIN p USING (family))))
    SELECT h.pid, arg_min(family, (ord, word)) AS family, arg_min(family, (at_, -length(word), ord)) AS head, any_value(f.families) AS families FROM h JOIN (SELECT pid, string_agg(family, ',' ORDER BY family) AS families FROM k GROUP BY 1) f ON f.pid = h.pid GROUP BY 1""")


def tag_families(spark, sf_dir):
    """Families by the most specific tag that a rule places."""
    tags = F.expr("array('en:food', 'en:gears-and-such', concat('en:', replace(name, ' ', '-')), 'en:small')")
    rows = products(spark, sf_dir).where("pid % 3 <> 0").select("pid", tags.alias("tags")).unionByName(products(spark, sf_dir).where("pid % 3 = 0").select("pid", F.array(F.lit("en:food"), F.lit("en:unknown")).alias("tags")))
    return taxonomy.tag_families(rows, "pid", "tags", _rules(spark, sf_dir), GENERIC)


_TAGS = sql("product", f"""+{_RULES}, g AS (SELECT pid, unnest([2, 3]) AS depth, unnest(['en:gears-and-such', 'en:' || replace(name, ' ', '-')]) AS tag FROM product WHERE pid % 3 <> 0),
    x AS (SELECT pid, depth, tag, unnest(string_split(substr(tag, 4), '-')) AS w FROM g), y AS (SELECT * FROM x JOIN rule ON starts_with(w, word))
    SELECT pid, arg_min(family, (-depth, ord, word)) AS family, arg_min(tag, (-depth, ord, word)) AS tag FROM y GROUP BY 1""")


def shelf_labels(spark, sf_dir):
    """Labels and sides of shelves named in many ways; small ones are folded."""
    shown = products(spark, sf_dir).selectExpr("pid", "concat(IF(pid % 5 = 0, 'All ', ''), IF(pid % 7 = 0, lower(category), element_at(split(name, ' '), -1)), 's & more') AS shelf")
    return taxonomy.shelves(shown, "pid", "shelf", _rules(spark, sf_dir), 20)


_LABELS = sql("product", f"""+{_RULES}, s AS (SELECT pid, CASE WHEN pid % 7 = 0 THEN lower(category) ELSE string_split(name, ' ')[-1] END || 's' AS shelf FROM product),
    l AS (SELECT s.pid, arg_min({{'l': family, 's': side}}, (ord, word)) AS b FROM s LEFT JOIN rule ON starts_with(shelf, word) GROUP BY 1),
    z AS (SELECT b.l AS label FROM l GROUP BY 1 HAVING count(*) >= 20)
    SELECT pid, CASE WHEN b.l IN (SELECT label FROM z WHERE label IS NOT NULL) THEN b.l ELSE 'other' END AS label, CASE WHEN b.l IN (SELECT label FROM z WHERE label IS NOT NULL) THEN b.s END AS side FROM l""")

QUERIES = {f.__name__: f for f in (rule_families, tag_families, shelf_labels)}
ORACLES = dict(zip(QUERIES, (_FAMILIES, _TAGS, _LABELS), strict=True))
