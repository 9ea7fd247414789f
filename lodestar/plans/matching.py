"""Brands, stance, taxonomy and alternatives, bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import brands, dedupe, issuer, predicates, rank, resolve
from ..operators.joins import grown
from ..sources.catalogue import flagged_brands, issuers, offers, products, sql, table
from ..sources.shared import stage
from .catalogue import _DENSE, _VERDICT

#: Words that name a family, in order: the first that stands in a title decides (fixed values).
FAMILIES = (("ring", "jewels"), ("widget", "parts"), ("bolt", "fasteners"), ("anvil", "tools"), ("gear", "parts"), ("rod", "parts"), ("plate", "kitchen"), ("gizmo", "toys"))


def family(title):
    """The family of the first rule in order whose word starts a word of the title; null if none does."""
    key = text.key(title)
    return F.coalesce(*(F.when(key.rlike(f"(^| ){word}"), name) for word, name in FAMILIES))


_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '(^| ){w}') THEN '{f}'" for w, f in FAMILIES) + " END"


def family_rules(spark, sf_dir):
    """Products by family of their title."""
    return products(spark, sf_dir).select(family(F.col("title")).alias("family"), "category").groupBy("family", "category").agg(F.count(F.lit(1)).alias("n"))


_RULES = sql("product", f"SELECT {_FAMILY.format('lower(title)')} AS family, category, count(*) AS n FROM product GROUP BY 1, 2")


def _lists(spark, sf_dir):
    """Comma lists of brands: an alias in other letters, a stranger, the product's own brand."""
    brand_list = F.concat_ws(", ", F.concat(F.lit("maker "), F.col("pid") % 7), F.when(F.col("pid") % 2 == 0, F.upper("brand")), F.concat(F.lit("Brand "), F.col("pid") % 26))
    return products(spark, sf_dir).select("pid", brand_list.alias("brands"))


def brand_token_match(spark, sf_dir):
    return brands.token_match(_lists(spark, sf_dir), "pid", "brands", flagged_brands(spark, sf_dir))


_TOKENS = sql("product flag", """+l AS (SELECT pid, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos FROM (SELECT pid, list_filter(['maker ' || (pid % 7), CASE WHEN pid % 2 = 0 THEN upper(brand) END, 'Brand ' || (pid % 26)], lambda x: x IS NOT NULL) AS ts FROM product))
    SELECT pid, alias, brand FROM (SELECT pid, f.alias, f.brand, row_number() OVER (PARTITION BY pid ORDER BY pos, ord, f.alias) AS r FROM l JOIN flag f ON lower(token) = f.alias) WHERE r = 1""")


def brand_phrase_match(spark, sf_dir):
    """Flagged brands that stand in a title."""
    title = F.concat_ws(" ", "name", F.when(F.col("pid") % 2 == 0, F.regexp_replace("brand", "#", " ")), "category")
    rows = products(spark, sf_dir).select("pid", title.alias("title"))
    return brands.phrase_match(rows, "pid", "title", flagged_brands(spark, sf_dir))


_PHRASES = sql("product flag", "SELECT pid, replace(alias, '#', ' ') AS phrase, f.brand, 1 AS n_brands FROM product p JOIN (SELECT * FROM flag WHERE alias LIKE 'brand %') f ON p.brand = f.brand WHERE pid % 2 = 0")


def origin_precedence(spark, sf_dir):
    """Where a brand comes from: a curated list, then valid local codes, then the issuer of its codes."""
    marked = issuer.classify(products(spark, sf_dir), issuers(spark, sf_dir))
    curated = flagged_brands(spark, sf_dir).select(F.col("brand").alias("name"), F.lit("curated").alias("value"))
    local = marked.where("verdict = 'LOCAL'").select(F.col("brand").alias("name"), F.col("issuer").alias("value"))
    other = marked.where("verdict = 'OTHER'").select(F.col("brand").alias("name"), F.col("issuer").alias("value"))
    return brands.precedence([curated, local, other])


_ORIGIN = sql("product issuer flag", f"""+{_DENSE}, m AS (SELECT brand, issuer, {_VERDICT} AS verdict FROM product LEFT JOIN dense ON number = substr(code, 1, 3)::INT),
    u AS (SELECT brand AS name, 'curated' AS value, 0 AS rank FROM flag UNION ALL SELECT brand, issuer, 1 FROM m WHERE verdict = 'LOCAL' UNION ALL SELECT brand, issuer, 2 FROM m WHERE verdict = 'OTHER')
    SELECT name, arg_min(value, (rank, value)) AS value, min(rank) AS rank FROM u GROUP BY 1""")


def stance(spark, sf_dir):
    """Verdict of a product from its code, its brand list and its offers' locality, with the reason."""
    marked = issuer.classify(products(spark, sf_dir), issuers(spark, sf_dir))
    listed = flagged_brands(spark, sf_dir).select("brand").distinct().withColumns({"listed": F.lit(True), "predicate": F.lit("promoted")})
    said = offers(spark, sf_dir).groupBy("pid").agg(dedupe.all_agree("local").alias("all_local"))
    rows = marked.join(listed, "brand", "left").join(said, "pid", "left").withColumns({"quantity": F.lit(None).cast("string"), "tags": F.array().cast("array<string>")})
    homonym = predicates.holds(F.col("predicate"))
    reason = (
        F.when(F.col("verdict") == "FLAGGED", "barcode")
        .when(F.col("listed") & ~homonym, "brand")
        .when((F.col("verdict") == "LOCAL") & F.coalesce("all_local", F.lit(True)), "local")
        .when(F.col("verdict") == "LOCAL", "registered")
    )
    final = F.when(reason.isin("barcode", "brand"), "FLAGGED").when(reason == "registered", "OTHER").otherwise(F.col("verdict"))
    return rows.select("pid", final.alias("stance"), reason.alias("reason"), F.coalesce(F.col("all_local"), F.lit(False)).alias("claimed_local"))


_STANCE = sql("product issuer flag offer", f"""+{_DENSE}, m AS (SELECT p.*, {_VERDICT} AS verdict FROM (SELECT p.*, d.kind, d.stance FROM product p LEFT JOIN dense d ON number = substr(code, 1, 3)::INT) p),
    s AS (SELECT pid, bool_and(local) AS a FROM offer GROUP BY 1), l AS (SELECT DISTINCT brand FROM flag),
    r AS (SELECT pid, verdict, a, CASE WHEN verdict = 'FLAGGED' THEN 'barcode' WHEN brand IN (SELECT brand FROM l) AND category <> 'PROMO' THEN 'brand' WHEN verdict = 'LOCAL' AND coalesce(a, true) THEN 'local' WHEN verdict = 'LOCAL' THEN 'registered' END AS reason FROM m LEFT JOIN s USING (pid))
    SELECT pid, CASE WHEN reason IN ('barcode', 'brand') THEN 'FLAGGED' WHEN reason = 'registered' THEN 'OTHER' ELSE verdict END AS stance, reason, coalesce(a, false) AS claimed_local FROM r""")


def _pool(spark, sf_dir):
    """Products with stance and family, written once, as probes and candidates both come from them."""
    rows = stance(spark, sf_dir).select("pid", "stance").join(products(spark, sf_dir), "pid")
    return stage(rows.select("pid", "stance", "brand", "category", "price", family(F.col("name")).alias("family")), "pool")


def _per_family(rows):
    eligible = rows.where("stance <> 'FLAGGED' AND family IS NOT NULL").select("family", "brand", F.col("pid").alias("alt"), F.col("price").alias("alt_price"), "category")
    return resolve.diversify(eligible, ["family"], ["alt_price", "alt"], "brand")


_ALTS = """a AS (SELECT s.pid, s.stance, p.name, p.brand, p.category, p.price, {family} AS family FROM stance s JOIN product p USING (pid)),
    e AS (SELECT family, brand, pid AS alt, price AS alt_price, category FROM (SELECT *, row_number() OVER (PARTITION BY family, brand ORDER BY price, pid) AS r FROM a WHERE stance <> 'FLAGGED' AND family IS NOT NULL) WHERE r = 1)"""


def family_alternatives(spark, sf_dir):
    """For every flagged product up to six products of its family by other brands, cheapest first, one a brand."""
    rows = _pool(spark, sf_dir)
    probes = rows.where("stance = 'FLAGGED' AND family IS NOT NULL").select("pid", "family", F.col("brand").alias("own"))
    # a family holds one candidate a brand, so the join is a few rows for each probe
    hits = probes.join(_per_family(rows), "family").where("own <> brand")
    return resolve.top(hits, ["pid"], ["alt_price", "alt"]).select("pid", "rank", "alt", "brand", "family")


_ALTERNATIVES = f"WITH stance AS ({_STANCE}), product AS (SELECT * FROM ({sql('product', 'SELECT * FROM product')})), {_ALTS.format(family=_FAMILY.format('p.name'))} SELECT * FROM (SELECT p.pid, row_number() OVER (PARTITION BY p.pid ORDER BY alt_price, alt) AS rank, alt, e.brand, p.family FROM a p JOIN e ON p.family = e.family AND p.brand <> e.brand WHERE p.stance = 'FLAGGED') WHERE rank <= 6"


def tier_resolution(spark, sf_dir):
    """Alternatives by the first tier that has any: same family and shelf, same family, same shelf."""
    rows = _pool(spark, sf_dir)
    probes = rows.where("stance = 'FLAGGED'").select("pid", "family", F.col("category").alias("shelf"), F.col("brand").alias("own"))
    pool = _per_family(rows)
    shelf_best = resolve.diversify(pool, ["category"], ["alt_price", "alt"], "brand")
    near = probes.join(pool, "family").where("own <> brand")
    tiers = near.where("shelf = category").withColumn("tier", F.lit(1)).unionByName(near.withColumn("tier", F.lit(2)))
    tiers = tiers.unionByName(probes.join(shelf_best.drop("family"), F.col("shelf") == F.col("category")).where("own <> brand").withColumn("tier", F.lit(3)))
    best = resolve.top(resolve.first_tier(tiers, "pid"), ["pid"], ["alt_price", "alt"], 3)
    return best.select("pid", "tier", "rank", "alt")


_TIERS = f"""WITH stance AS ({_STANCE}), product AS (SELECT * FROM ({sql('product', 'SELECT * FROM product')})), {_ALTS.format(family=_FAMILY.format('p.name'))},
    sb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, brand ORDER BY alt_price, alt) AS r FROM e) WHERE r = 1),
    t AS (SELECT p.pid, 1 AS tier, alt, alt_price FROM a p JOIN e ON p.family = e.family AND p.brand <> e.brand AND p.category = e.category WHERE stance = 'FLAGGED'
        UNION ALL SELECT p.pid, 2, alt, alt_price FROM a p JOIN e ON p.family = e.family AND p.brand <> e.brand WHERE stance = 'FLAGGED'
        UNION ALL SELECT p.pid, 3, alt, alt_price FROM a p JOIN sb ON p.category = sb.category AND p.brand <> sb.brand WHERE stance = 'FLAGGED'),
    k AS (SELECT *, min(tier) OVER (PARTITION BY pid) AS low FROM t)
    SELECT * FROM (SELECT pid, tier, row_number() OVER (PARTITION BY pid ORDER BY alt_price, alt) AS rank, alt FROM k WHERE tier = low) WHERE rank <= 3"""


def tiered(rows):
    """Candidates (probe, tier, tag, brand, price, pid) of products by every tag of their probe, until eight are found."""
    words = rows.select("pid", "brand", "price", F.col("category").alias("probe"), F.posexplode(F.reverse(F.split("name", " "))).alias("tier", "tag"))
    return resolve.stop_after(resolve.diversify(words, ["probe", "tier", "tag"], ["price", "pid"], "brand"), "probe", "tier", 8)


def tiered_candidates(spark, sf_dir):
    """Shelves as probes with the tags of their own products: brands' cheapest by tag, most specific tag first, until eight are found."""
    return tiered(products(spark, sf_dir)).groupBy("probe", "tier").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("low"), F.max("pid").alias("last"))


_CANDIDATES = sql("product", """+t AS (SELECT category AS probe, pid, brand, price, unnest([string_split(name, ' ')[2], string_split(name, ' ')[1]]) AS tag, unnest([0, 1]) AS tier FROM product),
    d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY probe, tier, tag, brand ORDER BY price, pid) AS r FROM t) WHERE r = 1),
    s AS (SELECT probe, tier, count(*) AS n, min(price) AS low, max(pid) AS last FROM d GROUP BY 1, 2)
    SELECT probe, tier, n, low, last FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY probe ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) WHERE before < 8""")


def overlap(rows):
    """(pid, entry, n_entries): the first other brand that sells a product's name, and how many do.

    A name keeps its two first brands and their number, which is all that any of its products asks for.
    """
    short = rank.first_two(rows, "name", "brand").withColumnRenamed("firsts", "first")
    hits = rows.where("brand IS NOT NULL").join(short, "name").where("n > 1")
    return hits.select("pid", F.when(F.col("brand") == F.col("first")[0], F.col("first")[1]).otherwise(F.col("first")[0]).alias("entry"), (F.col("n") - 1).cast("bigint").alias("n_entries"))


def tag_overlap(spark, sf_dir):
    """Products by the brands whose entries share their name."""
    return overlap(products(spark, sf_dir))


_OVERLAP = sql("product", """+e AS (SELECT DISTINCT brand, name AS tag FROM product)
    SELECT pid, min(e.brand) AS entry, count(*) AS n_entries FROM product p JOIN e ON p.name = e.tag AND p.brand <> e.brand GROUP BY 1""")


def retrieval_topk(spark, sf_dir):
    """Baskets (every order is a query) against the catalogue's names: weighted token overlap, a floor of 0.7 of the best, three hits."""
    vocabulary = products(spark, sf_dir).groupBy("brand", "category").agg(F.max("name").alias("name"))
    keys = vocabulary.select(
        F.concat_ws("/", "brand", "category").alias("entry"),
        F.explode(F.concat(F.transform(F.split("name", " "), lambda w: F.struct(w.alias("token"), F.lit(3).alias("weight"))), F.array(F.struct(F.lower("category").alias("token"), F.lit(1).alias("weight"))))).alias("k"),
    ).select("entry", "k.*")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("pid"))
    said = lines.join(grown(products(spark, sf_dir).select("pid", "name", "category")), "pid").groupBy("o_orderkey").agg(F.max("name").alias("name"), F.min("category").alias("category"))
    asked = said.join(grown(table(spark, sf_dir, "orders").select("o_orderkey")), "o_orderkey", "left_semi")
    return resolve.hits_of(asked, "o_orderkey", ["name", "category"], F.concat(F.split("name", " "), F.array(F.lower("category"))), keys, 0.7, 3).select("o_orderkey", "rank", "entry", "score")


_RETRIEVAL = sql("product", """+v AS (SELECT brand, category, max(name) AS name FROM product GROUP BY 1, 2),
    k AS (SELECT brand || '/' || category AS entry, unnest([string_split(name, ' ')[1], string_split(name, ' ')[2], lower(category)]) AS token, unnest([3, 3, 1]) AS weight FROM v),
    q AS (SELECT l_orderkey AS o_orderkey, max(name) AS name, min(category) AS category FROM lineitem JOIN product ON l_partkey = pid WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1),
    t AS (SELECT DISTINCT o_orderkey, unnest([string_split(name, ' ')[1], string_split(name, ' ')[2], lower(category)]) AS token FROM q),
    s AS (SELECT o_orderkey, entry, sum(weight)::BIGINT AS score FROM t JOIN k USING (token) GROUP BY 1, 2),
    b AS (SELECT *, max(score) OVER (PARTITION BY o_orderkey) AS best FROM s)
    SELECT * FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, entry) AS rank, entry, score FROM b WHERE score >= 0.7 * best) WHERE rank <= 3""")


def flagged_groups(spark, sf_dir):
    """Flagged products by name: listings, brands, cheapest price, and whether any brand is flagged."""
    rows = stance(spark, sf_dir).join(products(spark, sf_dir), "pid")
    return rows.groupBy("name").agg(F.count_if(F.col("stance") == "FLAGGED").alias("n_flagged"), F.count_distinct("brand").alias("n_brands"), F.min("price").alias("low"), F.bool_or(F.col("stance") == "FLAGGED").alias("any_flagged"))


_GROUPS = f"WITH stance AS ({_STANCE}), product AS (SELECT * FROM ({sql('product', 'SELECT * FROM product')})) SELECT name, count(*) FILTER (WHERE stance = 'FLAGGED') AS n_flagged, count(DISTINCT brand) AS n_brands, min(price) AS low, bool_or(stance = 'FLAGGED') AS any_flagged FROM stance JOIN product USING (pid) GROUP BY 1"

QUERIES = {f.__name__: f for f in (family_rules, brand_token_match, brand_phrase_match, origin_precedence, stance, family_alternatives, tier_resolution, tiered_candidates, tag_overlap, retrieval_topk, flagged_groups)}
ORACLES = dict(zip(QUERIES, (_RULES, _TOKENS, _PHRASES, _ORIGIN, _STANCE, _ALTERNATIVES, _TIERS, _CANDIDATES, _OVERLAP, _RETRIEVAL, _GROUPS), strict=True))
QUERIES["tiered_candidates_all"] = tiered_candidates  # its earlier name
ORACLES["tiered_candidates_all"] = _CANDIDATES
