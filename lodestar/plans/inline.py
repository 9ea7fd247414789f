"""Inline alternatives and live answers, bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inline, issuer
from ..operators.joins import grown
from ..sources.catalogue import issuers, products, sql, table
from .catalogue import _DENSE, _VERDICT
from .matching import FAMILIES
from .pairings import _CTES, _KINDS, _NOUNS, entries, scans

_OTHER = "element_at(split(name, ' '), -1)"


def _shelf_rows(spark, sf_dir):
    """Rows whose shelf says something for a quarter, whose brand is listed for something for a fifth, and of whose brands a third are known."""
    shown = products(spark, sf_dir).selectExpr("pid", f"CASE pid % 4 WHEN 0 THEN concat({_OTHER}, ' Tools') WHEN 1 THEN 'GOODS' END AS category", "IF(pid % 5 = 0, 'gears-and-such', NULL) AS brand_category", "name")
    known = scans(spark, sf_dir).select("pid", F.when(F.col("pid") % 3 == 0, F.col("brands")).alias("brands"), F.when(F.col("pid") % 4 == 0, F.col("hint_family")).alias("hint_family"))
    return shown.join(grown(known), "pid")


def inline_alternatives(spark, sf_dir):
    """The entry shown beside each row: by brand, by the kind of thing, or, where that is unknown, by family."""
    noun = table(spark, sf_dir, "part").select(F.element_at(F.split("p_name", " "), -1).alias("ord")).distinct()
    family = F.create_map(*(F.lit(x) for w, k in FAMILIES for x in (w, k)))[F.col("ord")]
    kinds = noun.where("length(ord) % 2 = 0")
    rules, tags = kinds.selectExpr("left(ord, 4) AS word", "concat('k ', ord) AS family", "ord"), kinds.selectExpr("concat('k ', ord) AS kind", "concat('en:', ord, 's') AS tag")
    wide = noun.select(F.left("ord", F.lit(4)).alias("word"), family.alias("family"), "ord").where("family IS NOT NULL")
    return inline.inline_alternative(_shelf_rows(spark, sf_dir), "pid", entries(spark, sf_dir), rules, tags, wide)


_INLINE = sql("product", f"""+{_CTES}, noun AS (SELECT DISTINCT string_split(p_name, ' ')[-1] AS n FROM part),
    row_ AS (SELECT pid, CASE pid % 4 WHEN 0 THEN lower(string_split(name, ' ')[-1] || ' tools') WHEN 1 THEN 'goods' END AS shelf, CASE WHEN pid % 5 = 0 THEN 'gears and such' END AS listed, name, CASE WHEN pid % 4 = 0 THEN hint_family END AS hf FROM product JOIN scan USING (pid)),
    lane1 AS (SELECT pid, arg_min(entry, (via, o)) AS entry FROM (SELECT p.pid, p.entry, p.ord AS o, CASE WHEN shelf IS NULL THEN CASE WHEN count(*) OVER (PARTITION BY p.pid) = 1 THEN '1 only' END WHEN replace(category, ' ', '-') = replace(shelf, ' ', '-') THEN '1 hint'
        WHEN list_contains(families, hf) THEN '2 hint family' WHEN len(list_filter(string_split(shelf, ' '), lambda w: length(w) > 3 AND contains(replace(category, ' ', '-'), w))) > 0 THEN '3 hint word' END AS via
        FROM pair p JOIN entry USING (entry) JOIN row_ USING (pid) WHERE p.pid % 3 = 0) WHERE via IS NOT NULL GROUP BY 1),
    said AS (SELECT pid, 0 AS place, unnest(string_split(shelf, ' ')) AS w FROM row_ UNION ALL SELECT pid, 1, unnest(string_split(listed, ' ')) FROM row_ UNION ALL SELECT pid, 2, unnest(string_split(name, ' ')) FROM row_),
    kind AS (SELECT pid, arg_min(n, (place, n)) AS kind FROM said JOIN noun ON length(n) % 2 = 0 AND starts_with(w, left(n, 4)) GROUP BY 1),
    lane2 AS (SELECT pid, kind, min(entry) AS entry FROM kind JOIN entry ON list_contains(tags, 'en:' || kind || 's') GROUP BY 1, 2),
    fam AS (SELECT pid, arg_min({_KINDS!r}[list_position({_NOUNS!r}, n)], n) AS family FROM said JOIN noun ON starts_with(w, left(n, 4)) AND list_contains({_NOUNS!r}, n) WHERE place <> 1 AND pid NOT IN (SELECT pid FROM kind) GROUP BY 1),
    lane3 AS (SELECT pid, min(entry) AS entry FROM fam f JOIN entry ON list_contains(families, f.family) GROUP BY 1)
    SELECT pid, entry, 'brand' AS via FROM lane1 UNION ALL SELECT pid, entry, 'kind:k ' || kind FROM lane2 WHERE pid NOT IN (SELECT pid FROM lane1)
    UNION ALL SELECT pid, entry, 'family' FROM lane3 WHERE pid NOT IN (SELECT pid FROM lane1)""")


def live_merged(spark, sf_dir):
    """Two curated answers of every product, then live ones that are not flagged, not its own brand's and not there already; six in all."""
    marked = issuer.classify(products(spark, sf_dir), issuers(spark, sf_dir)).select("pid", "code", "brand", "price", (F.col("verdict") != "FLAGGED").alias("eligible"))
    probes = products(spark, sf_dir).select(F.col("pid").alias("probe"), F.col("brand").alias("own"))
    near = lambda low, high: probes.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("step")).withColumn("pid", F.col("probe") + F.col("step")).join(grown(marked), "pid")
    static = near(1, 2).where("probe % 4 <> 0").selectExpr("probe", "code", "step AS place")
    live = near(2, 9).unionByName(near(5, 5)).withColumn("code", F.when(F.col("step") != 7, F.col("code")))
    return inline.merge_live(static, live, ["price", "pid"])


_LIVE = sql("product issuer", f"""+{_DENSE}, m AS (SELECT p.pid, p.code, p.brand, p.price, {_VERDICT} <> 'FLAGGED' AS eligible FROM product p LEFT JOIN dense ON number = substr(code, 1, 3)::INT),
    s AS (SELECT p.pid AS probe, m.code, step AS place FROM product p, range(1, 3) t(step), m WHERE m.pid = p.pid + step AND p.pid % 4 <> 0),
    l AS (SELECT p.pid AS probe, m.code, min((m.price, m.pid)) AS o FROM product p, range(2, 10) t(step), m WHERE m.pid = p.pid + step AND step <> 7 AND m.brand <> p.brand AND m.eligible GROUP BY 1, 2),
    u AS (SELECT probe, code, false AS live, place, NULL AS o FROM s UNION ALL SELECT probe, code, true, 9, o FROM l WHERE (probe, code) NOT IN (SELECT (probe, code) FROM s))
    SELECT * FROM (SELECT probe, code, live, row_number() OVER (PARTITION BY probe ORDER BY live, place, o) AS place FROM u) WHERE place <= 6""")

QUERIES = {f.__name__: f for f in (inline_alternatives, live_merged)}
ORACLES = dict(zip(QUERIES, (_INLINE, _LIVE), strict=True))
