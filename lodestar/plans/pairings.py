"""Curated pairings and the alternatives that follow from them, bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairings, resolve
from ..sources.catalogue import products, sql, table
from .matching import FAMILIES

_NOUNS = [w for w, _ in FAMILIES]
_KINDS = [f for _, f in FAMILIES]
GENERIC = ["en:food"]


def _pick(values: list[str], at: str) -> str:
    return f"element_at(array({', '.join(map(repr, values))}), cast({at} AS int) + 1)"


def entries(spark, sf_dir):
    """An entry for each brand: a category, tags, and no, one or two families, by the brand's number."""
    named = table(spark, sf_dir, "part").select(F.col("p_brand").alias("b")).distinct().select(F.expr("cast(substr(b, 7) AS int)").alias("n"))
    noun, kind, other = _pick(_NOUNS, "n % 8"), _pick(_KINDS, "n % 8"), _pick(_KINDS, "(n + 3) % 8")
    return named.selectExpr(
        "n AS entry", "n AS ord", "concat('Brand ', n) AS brand", f"concat({noun}, IF(n % 2 = 0, ' tools', '')) AS category", f"array(concat('en:', {noun}, 's'), concat('en:small-', {noun}), 'en:food') AS tags",
        f"IF(n % 4 = 0, array(), IF(n % 3 = 0, array({kind}, {other}), array({kind}))) AS families",
    )


def scans(spark, sf_dir):
    """pid, brands, tags, family, hint, hint_family of products: every third has no family, every other a hint."""
    word = F.element_at(F.split("name", " "), -1)
    kinds = F.create_map(*(F.lit(x) for w, k in FAMILIES for x in (w, k)))
    brands = F.expr("CASE pid % 4 WHEN 0 THEN brand WHEN 1 THEN concat(brand, ' Foods, stranger') WHEN 2 THEN 'stranger' ELSE concat('brand ', pid % 25, ', ', brand) END")
    return products(spark, sf_dir).select(
        "pid", F.regexp_replace(brands, "#", " ").alias("brands"), F.array(F.concat(F.lit("en:"), word, F.lit("s")), F.lit("en:food")).alias("tags"),
        F.when(F.col("pid") % 3 != 0, kinds[word]).alias("family"), F.when(F.col("pid") % 2 == 0, F.when(F.col("pid") % 5 == 0, F.concat(word, F.lit(" Tools"))).otherwise(word)).alias("hint"),
        F.when(F.col("pid") % 2 == 0, kinds[word]).alias("hint_family"),
    )


_CTES = f"""entry AS (SELECT n AS entry, n AS ord, 'brand ' || n AS brand, {_NOUNS!r}[n % 8 + 1] || CASE WHEN n % 2 = 0 THEN ' tools' ELSE '' END AS category,
        ['en:' || {_NOUNS!r}[n % 8 + 1] || 's', 'en:small-' || {_NOUNS!r}[n % 8 + 1], 'en:food'] AS tags,
        CASE WHEN n % 4 = 0 THEN []::VARCHAR[] WHEN n % 3 = 0 THEN [{_KINDS!r}[n % 8 + 1], {_KINDS!r}[(n + 3) % 8 + 1]] ELSE [{_KINDS!r}[n % 8 + 1]] END AS families
        FROM (SELECT DISTINCT substr(p_brand, 7)::INT AS n FROM part)),
    scan AS (SELECT pid, lower(replace(CASE pid % 4 WHEN 0 THEN brand WHEN 1 THEN brand || ' Foods, stranger' WHEN 2 THEN 'stranger' ELSE 'brand ' || (pid % 25) || ', ' || brand END, '#', ' ')) AS brands,
        ['en:' || w || 's', 'en:food'] AS tags, CASE WHEN pid % 3 <> 0 THEN k END AS family, CASE WHEN pid % 2 = 0 THEN CASE WHEN pid % 5 = 0 THEN w || '-tools' ELSE w END END AS hint, CASE WHEN pid % 2 = 0 THEN k END AS hint_family
        FROM (SELECT *, {_KINDS!r}[list_position({_NOUNS!r}, w)] AS k FROM (SELECT *, string_split(name, ' ')[-1] AS w FROM product))),
    pair AS (SELECT DISTINCT pid, entry, ord FROM (SELECT pid, trim(unnest(string_split(brands, ','))) AS part FROM scan) JOIN entry ON contains(' ' || part || ' ', ' ' || brand || ' ') OR contains(' ' || brand || ' ', ' ' || part || ' ')),
    picked AS (SELECT pid, arg_min({{'e': entry, 'v': via}}, (via, ord)) AS b FROM (SELECT p.*, CASE WHEN family IS NOT NULL THEN CASE WHEN list_contains(families, family) THEN '1 family' WHEN len(families) = 0 THEN '2 open' END
        WHEN hint IS NULL THEN CASE WHEN count(*) OVER (PARTITION BY p.pid) = 1 THEN '1 only' END WHEN replace(category, ' ', '-') = hint THEN '1 hint' WHEN list_contains(families, hint_family) THEN '2 hint family'
        WHEN len(list_filter(string_split(hint, '-'), lambda w: length(w) > 3 AND contains(category, w))) > 0 THEN '3 hint word' END AS via FROM pair p JOIN entry USING (entry) JOIN scan USING (pid)) WHERE via IS NOT NULL GROUP BY 1),
    tagged AS (SELECT pid, arg_min({{'e': entry, 'v': via}}, (via, ord)) AS b FROM (
        SELECT pid, entry, ord, '1 tag' AS via FROM scan JOIN entry ON families[1] = family AND list_has_any(list_filter(scan.tags, lambda t: t <> 'en:food'), entry.tags)
        UNION ALL SELECT pid, entry, ord, '2 family' FROM scan JOIN entry ON len(families) = 1 AND families[1] = family) GROUP BY 1)"""


def pairing_by_brand(spark, sf_dir):
    """Every entry that a product's brand list meets."""
    return pairings.by_brand(scans(spark, sf_dir), "pid", "brands", entries(spark, sf_dir)).select("pid", "entry")


_BY_BRAND = sql("product", f"+{_CTES} SELECT pid, entry FROM pair")


def pairing_pick(spark, sf_dir):
    """The entry of a scan, and by which rule."""
    return pairings.pick(scans(spark, sf_dir), "pid", entries(spark, sf_dir))


_PICK = sql("product", f"+{_CTES} SELECT pid, b.e AS entry, b.v AS via FROM picked")


def pairing_by_tags(spark, sf_dir):
    """The entry of a product's tags in its family, else of its family alone."""
    return pairings.by_tags(scans(spark, sf_dir), "pid", entries(spark, sf_dir), GENERIC)


_BY_TAGS = sql("product", f"+{_CTES} SELECT pid, b.e AS entry, b.v AS via FROM tagged")


def pairing_by_category(spark, sf_dir):
    """Entries of the categories that products' names end in."""
    asked = products(spark, sf_dir).select(F.element_at(F.split("name", " "), -1).alias("category")).distinct()
    return pairings.by_category(asked, entries(spark, sf_dir)).select("category", "entry")


_BY_CATEGORY = sql("product", f"+{_CTES} SELECT DISTINCT w AS category, entry FROM (SELECT DISTINCT string_split(name, ' ')[-1] AS w FROM product) JOIN entry ON category = w OR len(list_filter(tags, lambda t: contains(' ' || regexp_replace(t, '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || w || ' '))) > 0")


def _answers(spark, sf_dir):
    """Brands that an entry offers: those of the three next numbers."""
    return entries(spark, sf_dir).select("entry", F.explode(F.expr("sequence(1, 3)")).alias("place")).withColumn("alt", F.concat(F.lit("Brand "), (F.col("entry") + F.col("place")).cast("string")))


def alternatives_for_scan(spark, sf_dir):
    """Answers of the first tier that has any: entry by brand, entry by tags, cheapest products of the family by other brands."""
    rows, known = scans(spark, sf_dir), entries(spark, sf_dir)
    brand = pairings.pick(rows, "pid", known).select("pid", "entry", F.lit(1).alias("tier"))
    tags = pairings.by_tags(rows, "pid", known, GENERIC).select("pid", "entry", F.lit(2).alias("tier"))
    curated = resolve.first_tier(brand.unionByName(tags), "pid").join(_answers(spark, sf_dir), "entry").select("pid", "tier", "place", "alt")
    kinds = F.create_map(*(F.lit(x) for w, k in FAMILIES for x in (w, k)))
    pool = products(spark, sf_dir).select("pid", "brand", "price", kinds[F.element_at(F.split("name", " "), -1)].alias("family"))
    best = resolve.top(resolve.diversify(pool, ["family"], ["price", "pid"], "brand"), ["family"], ["price", "pid"], 7).select("family", F.col("brand").alias("alt"), "rank")
    rest = rows.join(curated, "pid", "left_anti").join(products(spark, sf_dir).select("pid", "brand"), "pid").withColumn("family", F.coalesce("family", "hint_family"))
    # seven brands of a family, so six others are among them
    found = rest.join(best, "family").where("alt <> brand")
    return curated.unionByName(resolve.top(found.drop("rank"), ["pid"], ["alt"], 6).select("pid", F.lit(3).alias("tier"), F.col("rank").alias("place"), "alt"))


_SCAN = sql("product", f"""+{_CTES}, c AS (SELECT pid, b.e AS entry, 1 AS tier FROM picked UNION ALL SELECT pid, b.e, 2 FROM tagged WHERE pid NOT IN (SELECT pid FROM picked)),
    a AS (SELECT pid, tier, place, 'Brand ' || (entry + place) AS alt FROM c, range(1, 4) t(place)),
    pool AS (SELECT pid, brand, price, {_KINDS!r}[list_position({_NOUNS!r}, string_split(name, ' ')[-1])] AS family FROM product),
    f AS (SELECT family, brand AS alt, row_number() OVER (PARTITION BY family ORDER BY price, pid) AS r FROM (SELECT *, row_number() OVER (PARTITION BY family, brand ORDER BY price, pid) AS k FROM pool) WHERE k = 1)
    SELECT * FROM a UNION ALL SELECT * FROM (SELECT s.pid, 3 AS tier, row_number() OVER (PARTITION BY s.pid ORDER BY alt) AS place, alt FROM scan s JOIN product p USING (pid) JOIN f ON f.family = coalesce(s.family, s.hint_family) AND r <= 7 AND alt <> p.brand WHERE s.pid NOT IN (SELECT pid FROM c)) WHERE place <= 6""")


def alternatives_for_category(spark, sf_dir):
    """Distinct answers of all entries of a picked category, with the first entry that offers each."""
    asked = products(spark, sf_dir).select(F.element_at(F.split("name", " "), -1).alias("category")).distinct()
    hits = pairings.by_category(asked, entries(spark, sf_dir)).join(_answers(spark, sf_dir), "entry")
    return hits.groupBy("category", "alt").agg(F.min_by("entry", "ord").alias("entry"), F.count(F.lit(1)).alias("n"))


_CATEGORY = sql("product", f"""+{_CTES}, h AS (SELECT DISTINCT w AS category, entry FROM (SELECT DISTINCT string_split(name, ' ')[-1] AS w FROM product) JOIN entry ON category = w OR len(list_filter(tags, lambda t: contains(' ' || regexp_replace(t, '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || w || ' '))) > 0)
    SELECT category, 'Brand ' || (entry + place) AS alt, min(entry) AS entry, count(*) AS n FROM h, range(1, 4) t(place) GROUP BY 1, 2""")


def title_brands(spark, sf_dir):
    """The brand that a title names: one, or the longest that holds the others; none where two differ."""
    shown = F.expr("CASE pid % 4 WHEN 0 THEN concat(name, ' ', replace(brand, '#', ' ')) WHEN 1 THEN concat('brand ', pid % 25, ' ', replace(brand, '#', ' '), ' x') WHEN 2 THEN concat(replace(brand, '#', ' '), ' foods') ELSE name END")
    words = entries(spark, sf_dir).select("brand").unionByName(entries(spark, sf_dir).where("entry % 2 = 0").select(F.concat("brand", F.lit(" Foods")).alias("brand")))
    return pairings.brand_in_title(products(spark, sf_dir).select("pid", shown.alias("title")), "pid", "title", words)


_TITLE_BRANDS = sql("product", f"""+{_CTES}, v AS (SELECT 'Brand ' || entry AS brand, 'brand ' || entry AS phrase FROM entry UNION ALL SELECT 'Brand ' || entry || ' Foods', 'brand ' || entry || ' foods' FROM entry WHERE entry % 2 = 0),
    t AS (SELECT pid, lower(replace(CASE pid % 4 WHEN 0 THEN name || ' ' || brand WHEN 1 THEN 'brand ' || (pid % 25) || ' ' || brand || ' x' WHEN 2 THEN brand || ' foods' ELSE name END, '#', ' ')) AS title FROM product),
    h AS (SELECT pid, brand, phrase, row_number() OVER (PARTITION BY pid ORDER BY length(phrase) DESC, phrase) AS r FROM t JOIN v ON contains(' ' || title || ' ', ' ' || phrase || ' '))
    SELECT pid, brand FROM h f WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM h o WHERE o.pid = f.pid AND NOT contains(f.phrase, o.phrase))""")

QUERIES = {f.__name__: f for f in (pairing_by_brand, pairing_pick, pairing_by_tags, pairing_by_category, alternatives_for_scan, alternatives_for_category, title_brands)}
ORACLES = dict(zip(QUERIES, (_BY_BRAND, _PICK, _BY_TAGS, _BY_CATEGORY, _SCAN, _CATEGORY, _TITLE_BRANDS), strict=True))
