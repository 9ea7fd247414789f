"""Shelf rankings, samples, text filters and keys, bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, sizes, text
from ..functions.hashing import mix32, mix32_sql, text_hash, text_hash_sql
from ..operators import rank, resolve
from ..sources.catalogue import products, sql, table

SEED = 20240101


def unit_price_round_robin(spark, sf_dir):
    """Unit prices in the accepted band, one product a brand and shelf, shelf after shelf, 36 in all."""
    total = sizes.parse_size(F.col("title"))["total"]
    rows = products(spark, sf_dir).withColumn("unit_price", F.round(sizes.unit_price(F.col("price"), total), 2)).where("unit_price BETWEEN 150 AND 4000")
    one = resolve.diversify(rows, ["category"], ["unit_price", "pid"], "brand")
    return rank.round_robin(one, "category", ["unit_price", "pid"], "unit_price", 36).select("pid", "category", "depth", "unit_price")


_ROBIN = sql("product", """+u AS (SELECT *, round(round(price / [9000, 500, 1000, 330, 400, NULL, 500, NULL][(pid % 8)::INT + 1]::DOUBLE * 1000, 4), 2) AS unit_price FROM product),
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, brand ORDER BY unit_price, pid) AS r FROM u WHERE unit_price BETWEEN 150 AND 4000) WHERE r = 1),
    d AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY unit_price, pid) AS depth, min(unit_price) OVER (PARTITION BY category) AS best FROM o)
    SELECT pid, category, depth, unit_price FROM d ORDER BY depth, best, category LIMIT 36""")


def seeded_band_shuffle(spark, sf_dir):
    """The forty dearest products of each shelf in the day's order, the rest as they stand."""
    return rank.shuffle_band(products(spark, sf_dir), "category", -F.col("price"), [F.desc("price"), "pid"], "pid", 40, SEED, F.col("pid")).select("pid", "category", "place")


_BAND = sql("product", f"""+n AS (SELECT pid, category, row_number() OVER (PARTITION BY category ORDER BY price DESC, pid) AS n FROM product)
    SELECT pid, category, row_number() OVER (PARTITION BY category ORDER BY n > 40, CASE WHEN n <= 40 THEN {mix32_sql(str(SEED), 'pid')} END, n) AS place FROM n""")

_SHARES = {"STANDARD": 0.30, "ECONOMY": 0.30, "MEDIUM": 0.14, "PROMO": 0.26}


def stratified_quota(spark, sf_dir):
    """Fifty products in four strata with fixed shares, seeded."""
    return rank.quota(products(spark, sf_dir), "category", _SHARES, "pid", 50, SEED).select("pid", "category", "order_key")


_QUOTA = sql("product", f"""SELECT pid, category, {mix32_sql(str(SEED + 1), 'pid')} AS order_key FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {mix32_sql(str(SEED), 'pid')}, pid) AS n FROM product)
    WHERE n <= CASE category WHEN 'STANDARD' THEN 15 WHEN 'ECONOMY' THEN 15 WHEN 'MEDIUM' THEN 7 WHEN 'PROMO' THEN 13 END""")


def stride_sample(spark, sf_dir):
    return rank.stride(products(spark, sf_dir), "category", "pid", 13).select("pid", "category")


_STRIDE = sql("product", "SELECT pid, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY pid) AS n FROM product) WHERE (n - 1) % 13 = 0")


def firm_diversify(spark, sf_dir):
    """Three products of each brand in seeded order, brands in an order of their own, brand after brand; ``place`` among those of a depth."""
    rows = rank.first_rows(products(spark, sf_dir), ["brand"], [mix32(F.lit(SEED), F.col("pid")), "pid"], 3, "depth")
    firm = text_hash(SEED, F.col("brand"))
    return rank.numbered(rows, ["depth"], firm, [firm, "brand"], "place").select("pid", "brand", "depth", "place")


_FIRMS = sql("product", f"""+d AS (SELECT pid, brand, row_number() OVER (PARTITION BY brand ORDER BY {mix32_sql(str(SEED), 'pid')}, pid) AS depth FROM product)
    SELECT pid, brand, depth, row_number() OVER (PARTITION BY depth ORDER BY {text_hash_sql(SEED, 'brand')}, brand) AS place FROM d WHERE depth <= 3""")


def free_text_filter(spark, sf_dir):
    """Products whose name, brand or category holds the query, by category."""
    wanted = "wid"
    hit = F.lower("name").contains(wanted) | F.lower("brand").contains(wanted) | F.lower("category").contains(wanted)
    return products(spark, sf_dir).where(hit).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("first"))


_FREE = sql("product", """SELECT category, count(*) AS n, min(pid) AS "first" FROM product WHERE contains(lower(name), 'wid') OR contains(lower(brand), 'wid') OR contains(lower(category), 'wid') GROUP BY 1""")


def text_fold_keys(spark, sf_dir):
    """Keys of the whole text of every document: folded, slugged, and as long tokens."""
    return whole_keys(table(spark, sf_dir, "documents"))


_FOLDED = "trim(regexp_replace(translate(strip_accents(lower(text)), 'đłøħıŧßæœðþ', 'dlohitsaodt'), '[^a-z0-9]+', ' ', 'g'))"
_KEYS = f"""WITH f AS (SELECT doc_id, {_FOLDED} AS key FROM documents),
    w AS (SELECT doc_id, w, min(p) AS p FROM (SELECT doc_id, unnest(string_split(key, ' ')) AS w, generate_subscripts(string_split(key, ' '), 1) AS p FROM f) WHERE length(w) >= 4 GROUP BY 1, 2),
    t AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS tokens FROM w GROUP BY 1)
    SELECT doc_id, coalesce(key, '') AS key, replace(coalesce(key, ''), ' ', '-') AS slug, coalesce(n, 0) AS n_tokens, coalesce(tokens, '') AS tokens FROM f LEFT JOIN t USING (doc_id)"""


def whole_keys(documents):
    """doc_id, key, slug, n_tokens, tokens of the whole text of every row; a null text counts as empty."""
    rows = documents.select("doc_id", text.key(F.col("text")).alias("key"), text.tokens(F.col("text"), 4).alias("t"))
    return rows.select("doc_id", "key", F.replace("key", F.lit(" "), F.lit("-")).alias("slug"), F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def page_text(spark, sf_dir):
    """Titles of pages with references decoded, how many links they have, and the longest rule for their path."""
    title = text.decode_entities(F.regexp_extract("html", r"<title>([^<]*)</title>", 1))
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.size(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'))).cast("bigint").alias("n_links"), path.alias("path"))
    # robots rules: the longest that begins the path wins; a tie allows
    rules = (("/", True), ("/en", False), ("/en/2", True), ("/de/1", False))
    allowed = F.coalesce(*(F.when(F.col("path").startswith(p), F.lit(a)) for p, a in sorted(rules, key=lambda r: (-len(r[0]), not r[1]))), F.lit(True))
    return rows.withColumn("allowed", allowed)


_PAGES = r"""WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, len(regexp_extract_all(html, '<a href="([^"]*)"')) AS n_links, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS title, n_links, path,
    CASE WHEN starts_with(path, '/en/2') THEN true WHEN starts_with(path, '/de/1') THEN false WHEN starts_with(path, '/en') THEN false ELSE true END AS allowed FROM p"""


def image_codes(spark, sf_dir):
    """Codes recovered from image file names."""
    url = F.concat(F.lit("https://cdn.example/img/12345678/"), F.col("pid"), F.lit("_"), F.when(F.col("pid") % 3 == 0, F.col("code")).otherwise(F.lit("12345678901")), F.lit("-x.jpg"))
    return products(spark, sf_dir).select("pid", codes.image_code(url).alias("code"))


_IMAGES = sql("product", "SELECT pid, CASE WHEN pid % 3 = 0 THEN code END AS code FROM product")


def nutrient_rows(spark, sf_dir):
    """Wide figures of a line item as ordered rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.nullif("l_tax", F.lit(0.0)).alias("tax"))
    return rows.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["quantity", "discount", "tax"], "figure", "amount").where("amount IS NOT NULL").groupBy("l_partkey", "figure").agg(F.count(F.lit(1)).alias("n"), F.max("amount").alias("most"))


_NUTRIENTS = "SELECT l_partkey, figure, count(*) AS n, max(amount) AS most FROM (SELECT l_partkey, 'quantity' AS figure, l_quantity AS amount FROM lineitem UNION ALL SELECT l_partkey, 'discount', l_discount FROM lineitem UNION ALL SELECT l_partkey, 'tax', nullif(l_tax, 0.0) FROM lineitem) WHERE amount IS NOT NULL GROUP BY 1, 2"

QUERIES = {f.__name__: f for f in (unit_price_round_robin, seeded_band_shuffle, stratified_quota, stride_sample, firm_diversify, free_text_filter, text_fold_keys, page_text, image_codes, nutrient_rows)}
ORACLES = dict(zip(QUERIES, (_ROBIN, _BAND, _QUOTA, _STRIDE, _FIRMS, _FREE, _KEYS, _PAGES, _IMAGES, _NUTRIENTS), strict=True))
QUERIES["text_fold_keys_whole"] = text_fold_keys  # its earlier name
ORACLES["text_fold_keys_whole"] = _KEYS
