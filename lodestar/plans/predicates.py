"""Predicates by name and the homonyms that they tell apart, bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import predicates
from ..sources.catalogue import flagged_brands, products, sql


def _shown(spark, sf_dir):
    """Products with what a label says: sizes in the name or beside it, shelves, tags."""
    return products(spark, sf_dir).selectExpr(
        "pid", "brand", "CASE pid % 5 WHEN 0 THEN title WHEN 1 THEN concat(name, ' Cake 0,5 L') WHEN 2 THEN name WHEN 3 THEN concat('Sok ', name) ELSE '' END AS name",
        "CASE pid % 3 WHEN 0 THEN '330 ml' WHEN 1 THEN '2 kg' END AS quantity", "category", "CASE WHEN pid % 4 = 0 THEN array('en:beverages', 'en:fruit-juices') WHEN pid % 4 = 1 THEN array('en:lemonades') ELSE array() END AS tags",
    )


_LABELS = """l AS (SELECT pid, brand, CASE pid % 5 WHEN 0 THEN title WHEN 1 THEN name || ' Cake 0,5 L' WHEN 2 THEN name WHEN 3 THEN 'Sok ' || name ELSE '' END AS name,
        CASE pid % 3 WHEN 0 THEN '330 ml' WHEN 1 THEN '2 kg' ELSE '' END AS quantity, category,
        CASE pid % 4 WHEN 0 THEN ' en:beverages en:fruit-juices' WHEN 1 THEN ' en:lemonades' ELSE '' END AS tags FROM product),
    x AS (SELECT pid, brand, category, lower(name) AS n, quantity AS q, lower(category) || tags AS s FROM l)"""
_DRINK = f"""((trim(n) <> '' OR q <> '') AND NOT regexp_matches(n, '{predicates.NO_DRINK}') AND NOT regexp_matches(n, '{predicates.WEIGHED}')
    AND NOT (NOT regexp_matches(q, '{predicates.LIQUID}') AND regexp_matches(q, '{predicates.WEIGHED}'))
    AND (regexp_matches(n, '{predicates.LIQUID}') OR regexp_matches(q, '{predicates.LIQUID}') OR regexp_matches(s, '{predicates.DRINK_SHELF}')))"""


def drinks(spark, sf_dir):
    """Which products are drinks by what their labels say."""
    return _shown(spark, sf_dir).select("pid", predicates.holds(F.lit("drink")).alias("drink"))


def brand_homonyms(spark, sf_dir):
    """Hits of flagged brands that stand, and those that another firm's product of the same name explains."""
    shown, flags = _shown(spark, sf_dir), flagged_brands(spark, sf_dir)
    rules = flags.where("alias LIKE 'brand#%'").selectExpr("alias", "brand", "CASE ord % 15 WHEN 0 THEN 'drink' WHEN 5 THEN 'promoted' ELSE 'weighed' END AS predicate")
    hits = shown.join(flags.where("alias LIKE 'brand %'").select("brand", "alias"), "brand")
    hits = hits.select("pid", F.expr("IF(pid % 7 = 0, 'barcode', IF(pid % 7 = 1, 'title', 'brand'))").alias("reason"), F.when(F.col("pid") % 6 == 0, F.concat(F.upper("alias"), F.lit(" x"))).otherwise(F.upper("alias")).alias("token"), "brand")
    return predicates.standing(hits, shown, rules, "pid").select("pid", "reason", "homonym", "stands")


_HOMONYMS = f"""+{_LABELS}, f AS (SELECT DISTINCT brand, ord FROM flag),
    h AS (SELECT pid, brand, CASE pid % 7 WHEN 0 THEN 'barcode' WHEN 1 THEN 'title' ELSE 'brand' END AS reason, CASE ord % 15 WHEN 0 THEN 'drink' WHEN 5 THEN 'promoted' ELSE 'weighed' END AS predicate FROM l JOIN f USING (brand)),
    m AS (SELECT h.pid, reason, CASE WHEN reason <> 'barcode' AND h.pid % 6 <> 0 AND CASE predicate WHEN 'drink' THEN {_DRINK} WHEN 'promoted' THEN category = 'PROMO' ELSE regexp_matches(n, '{predicates.WEIGHED}') END THEN predicate END AS homonym FROM h JOIN x USING (pid))
    SELECT pid, reason, homonym, homonym IS NULL AS stands FROM m"""

QUERIES = {f.__name__: f for f in (drinks, brand_homonyms)}
ORACLES = dict(zip(QUERIES, (sql("product", f"+{_LABELS} SELECT pid, {_DRINK} AS drink FROM x"), sql("product flag", _HOMONYMS)), strict=True))
