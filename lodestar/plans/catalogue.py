"""Codes, price comparison and the catalogue's aggregates, bound to the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import dedupe, gates, issuer
from ..sources.catalogue import issuers, offers, products, sql, table, valid_sql


def comparisons(rows: DataFrame) -> DataFrame:
    """Products that at least two sources price: sources, offers, cheapest price and source, spread."""
    priced = rows.where("price IS NOT NULL")
    best = F.min_by("source", F.struct("price", "source"))
    return (
        priced.groupBy("pid")
        .agg(F.count_distinct("source").alias("n_sources"), F.count(F.lit(1)).alias("n_offers"), F.min("price").alias("low"), F.max("price").alias("high"), best.alias("cheapest"))
        .where("n_sources >= 2")
    )


def code_price_verdict(spark, sf_dir):
    marked = issuer.classify(products(spark, sf_dir), issuers(spark, sf_dir))
    return comparisons(offers(spark, sf_dir)).join(marked, "pid").select("pid", "code", "issuer", "verdict", "n_sources", "n_offers", "low", "high", "cheapest")


_DENSE = "dense AS (SELECT n AS number, issuer, kind, stance FROM issuer, unnest(range(lo, hi + 1)) t(n))"
_VERDICT = """CASE WHEN stance IN ('FLAGGED', 'LOCAL') THEN stance WHEN kind = 'unassigned' THEN 'UNASSIGNED'
    WHEN kind <> 'country' THEN 'NOT_A_COUNTRY' WHEN kind IS NULL THEN 'UNKNOWN' ELSE 'OTHER' END"""
_COMPARED = """compared AS (SELECT pid, count(DISTINCT source) AS n_sources, count(*) AS n_offers, min(price) AS low, max(price) AS high,
    arg_min(source, (price, source)) AS cheapest FROM offer WHERE price IS NOT NULL GROUP BY pid HAVING count(DISTINCT source) >= 2)"""
_CODE_PRICE = sql("product offer issuer", f"+{_DENSE}, {_COMPARED} SELECT p.pid, p.code, d.issuer, {_VERDICT} AS verdict, n_sources, n_offers, low, high, cheapest FROM compared c JOIN product p USING (pid) LEFT JOIN dense d ON d.number = substr(p.code, 1, 3)::INT")


def code_verdict(spark, sf_dir):
    marked = issuer.classify(products(spark, sf_dir), issuers(spark, sf_dir))
    return marked.groupBy("issuer", "kind", "verdict").agg(F.count(F.lit(1)).alias("n_products"), F.count_distinct("prefix").alias("n_prefixes"))


_CODE_VERDICT = sql("product issuer", f"+{_DENSE} SELECT issuer, kind, {_VERDICT} AS verdict, count(*) AS n_products, count(DISTINCT substr(code, 1, 3)) AS n_prefixes FROM product LEFT JOIN dense ON number = substr(code, 1, 3)::INT GROUP BY 1, 2, 3")


def code_check_digit(spark, sf_dir):
    """Every third code is damaged; damaged codes are withdrawn."""
    damaged = F.when(F.col("pid") % 3 == 0, F.concat(F.left("code", F.lit(12)), ((F.right("code", F.lit(1)).cast("int") + 1) % 10).cast("string"))).otherwise(F.col("code"))
    rows = products(spark, sf_dir).select("pid", damaged.alias("read_code"))
    valid = codes.is_valid(F.col("read_code"))
    return rows.select("pid", "read_code", valid.alias("valid"), F.when(valid, F.col("read_code")).alias("code"))


_DAMAGED = "damaged AS (SELECT pid, CASE WHEN pid % 3 = 0 THEN substr(code, 1, 12) || ((substr(code, 13, 1)::INT + 1) % 10)::VARCHAR ELSE code END AS read_code FROM product)"
_CHECK = sql("product", f"+{_DAMAGED} SELECT pid, read_code, {valid_sql('read_code')} AS valid, CASE WHEN {valid_sql('read_code')} THEN read_code END AS code FROM damaged")


def code_lengths(spark, sf_dir):
    """Codes of five lengths made from order keys: normal form, prefix and verdict."""
    raw = F.expr("lpad(cast(o_orderkey * 7919 + 20000000 AS string), element_at(array(8, 12, 13, 14, 10), cast(o_orderkey % 5 AS int) + 1), '4')")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("code"))
    marked = issuer.classify(rows, issuers(spark, sf_dir))
    return marked.select("o_orderkey", "code", codes.normal_form(F.col("code")).alias("normal"), "prefix", "verdict")


_LENGTHS = sql(
    "issuer",
    f"""+{_DENSE}, raw AS (SELECT o_orderkey, [8, 12, 13, 14, 10][(o_orderkey % 5)::INT + 1] AS n, (o_orderkey * 7919 + 20000000)::VARCHAR AS d FROM orders),
    coded AS (SELECT o_orderkey, CASE WHEN length(d) >= n THEN substr(d, 1, n) ELSE repeat('4', (n - length(d))::INT) || d END AS code FROM raw),
    normed AS (SELECT *, CASE length(code) WHEN 14 THEN substr(code, 2) WHEN 12 THEN '0' || code ELSE code END AS normal FROM coded),
    cut AS (SELECT *, CASE WHEN length(code) IN (8, 12, 13, 14) THEN substr(normal, 1, 3) END AS prefix FROM normed)
    SELECT o_orderkey, code, normal, prefix, CASE WHEN prefix IS NULL THEN 'UNKNOWN' WHEN length(code) = 8 AND substr(code, 1, 1) IN ('0', '2') THEN 'NOT_A_COUNTRY' ELSE {_VERDICT} END AS verdict
    FROM cut LEFT JOIN dense ON number = prefix::INT""",
)


def issuer_coverage(spark, sf_dir):
    """Ranges of the issuer table by how many codes use them; prefixes that are not covered once would show as gaps."""
    used = products(spark, sf_dir).select(codes.prefix(F.col("code")).cast("int").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("n_codes"))
    faults = issuer.coverage(issuers(spark, sf_dir)).select("number", F.col("n").alias("n_ranges"))
    return used.join(faults, "number", "left").select("number", "n_codes", F.coalesce("n_ranges", F.lit(1)).cast("bigint").alias("n_ranges"))


_COVERAGE = sql("product issuer", f"+{_DENSE}, hits AS (SELECT number, count(*) AS n FROM dense GROUP BY 1) SELECT number, n_codes, coalesce(n, 0) AS n_ranges FROM (SELECT substr(code, 1, 3)::INT AS number, count(*) AS n_codes FROM product GROUP BY 1) LEFT JOIN hits USING (number)")


def price_comparison(spark, sf_dir):
    return comparisons(offers(spark, sf_dir))


def code_record(spark, sf_dir):
    """One record a product: price range, offers, merged flags (any true; all agree), longest-named brand."""
    rows = offers(spark, sf_dir)
    out = rows.groupBy("pid").agg(
        F.min("price").alias("low"),
        F.max("price").alias("high"),
        F.count(F.lit(1)).alias("n_offers"),
        dedupe.any_true("local").alias("any_local"),
        dedupe.all_agree("local").alias("all_local"),
    )
    return out.join(products(spark, sf_dir).select("pid", "code", "name"), "pid")


_RECORD = sql("product offer", "SELECT pid, code, name, min(o.price) AS low, max(o.price) AS high, count(*) AS n_offers, bool_or(local) AS any_local, bool_and(local) AS all_local FROM offer o JOIN product USING (pid) GROUP BY 1, 2, 3")


def chip_counts(spark, sf_dir):
    """Shelves with at least fifteen products, and their share that is dear."""
    return (
        products(spark, sf_dir)
        .groupBy(F.col("category").alias("shelf"), "brand")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("price") > 1000).alias("n_dear"))
        .where("n >= 15")
    )


_CHIPS = sql("product", "SELECT category AS shelf, brand, count(*) AS n, count(*) FILTER (WHERE price > 1000) AS n_dear FROM product GROUP BY 1, 2 HAVING count(*) >= 15")


def source_counts(spark, sf_dir):
    """Offers by source group: sources 0 to 9 are one platform, others stand alone."""
    group = F.when(F.col("source") < 10, F.lit("platform")).otherwise(F.concat(F.lit("source "), F.col("source").cast("string")))
    return offers(spark, sf_dir).groupBy(group.alias("source_group")).agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("n_priced"))


_SOURCES = sql("offer", "SELECT CASE WHEN source < 10 THEN 'platform' ELSE 'source ' || source END AS source_group, count(*) AS n, count(price) AS n_priced FROM offer GROUP BY 1")


def coverage_profile(spark, sf_dir):
    """How much of each column is there, in counts and percent."""
    rows = offers(spark, sf_dir)
    counted = rows.agg(F.count(F.lit(1)).alias("total"), *(F.count(c).alias(c) for c in ("price", "local", "source")))
    flat = counted.unpivot(["total"], ["price", "local", "source"], "column", "n")
    return flat.select("column", "n", F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("percent"))


_PROFILE = sql("offer", """+t AS (SELECT count(*) AS total, count(price) AS a, count(local) AS b, count(source) AS c FROM offer)
    SELECT 'price' AS "column", a AS n, round(a * 100.0::DOUBLE / total, 2) AS percent FROM t UNION ALL SELECT 'local', b, round(b * 100.0::DOUBLE / total, 2) FROM t UNION ALL SELECT 'source', c, round(c * 100.0::DOUBLE / total, 2) FROM t""")


def price_quantiles(spark, sf_dir):
    """Exact floor-index quantiles of offer prices in each shelf."""
    rows = offers(spark, sf_dir).join(products(spark, sf_dir).select("pid", "category"), "pid").select("category", "price")
    return gates.floor_quantiles(rows, ["category"], "price", [0.1, 0.5, 0.9, 0.99])


_QUANTILES = sql("product offer", """+s AS (SELECT category, list_sort(list(o.price)) AS v FROM offer o JOIN product USING (pid) WHERE o.price IS NOT NULL GROUP BY 1)
    SELECT category, len(v) AS n, v[floor(len(v) * 0.1)::INT + 1] AS q_10, v[floor(len(v) * 0.5)::INT + 1] AS q_50, v[floor(len(v) * 0.9)::INT + 1] AS q_90, v[floor(len(v) * 0.99)::INT + 1] AS q_99 FROM s""")


def price_gates(spark, sf_dir):
    """Pass or fail of the price-distribution and size gates."""
    rows = offers(spark, sf_dir).select(F.lit(1).alias("all"), "price")
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("price") > 2000).alias("dear"), F.count("price").alias("priced"))
    q = gates.floor_quantiles(rows, ["all"], "price", [0.5, 0.9]).join(total.withColumn("all", F.lit(1)), "all")
    share = F.round(F.col("dear") / F.col("priced"), 6)
    return gates.as_rows(
        q,
        [
            gates.gate("median", F.col("q_50").between(300, 20000), F.col("q_50")),
            gates.gate("p90", F.col("q_90") <= 2000, F.col("q_90")),
            gates.gate("share_dear", share <= 0.02, share),
            gates.gate("row_floor", F.col("rows") >= 1000, F.col("rows")),
        ],
    )


_GATES = sql("offer", """+s AS (SELECT list_sort(list(price) FILTER (WHERE price IS NOT NULL)) AS v, count(*) AS n, count(*) FILTER (WHERE price > 2000) AS dear, count(price) AS priced FROM offer),
    f AS (SELECT v[floor(len(v) * 0.5)::INT + 1] AS q50, v[floor(len(v) * 0.9)::INT + 1] AS q90, n, round(dear::DOUBLE / priced, 6) AS share FROM s)
    SELECT 'median' AS gate, q50 BETWEEN 300 AND 20000 AS ok, q50::DOUBLE AS detail FROM f UNION ALL SELECT 'p90', q90 <= 2000, q90 FROM f UNION ALL SELECT 'share_dear', share <= 0.02, share FROM f UNION ALL SELECT 'row_floor', n >= 1000, n FROM f""")


def category_hubs(spark, sf_dir):
    """Shelves with their flagged products, largest brand by count and then name."""
    marked = issuer.classify(products(spark, sf_dir), issuers(spark, sf_dir))
    per = marked.groupBy("category", "brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "FLAGGED").alias("flagged"))
    return per.groupBy("category").agg(F.sum("n").alias("n"), F.sum("flagged").alias("n_flagged"), F.min_by("brand", F.struct(-F.col("n"), "brand")).alias("top_brand")).where("n >= 20")


_HUBS = sql("product issuer", f"+{_DENSE}, per AS (SELECT category, brand, count(*) AS n, count(*) FILTER (WHERE stance = 'FLAGGED') AS flagged FROM product LEFT JOIN dense ON number = substr(code, 1, 3)::INT GROUP BY 1, 2) SELECT category, sum(n)::BIGINT AS n, sum(flagged)::BIGINT AS n_flagged, arg_min(brand, (-n, brand)) AS top_brand FROM per GROUP BY 1 HAVING sum(n) >= 20")


def inverted_index(spark, sf_dir):
    """Tag to distinct products: tags are the words of a name and its category."""
    tags = F.array_union(F.split("name", " "), F.array(F.lower("category")))
    exploded = products(spark, sf_dir).select("pid", "code", F.explode(tags).alias("tag"))
    return exploded.groupBy("tag").agg(F.count_distinct("pid").alias("n"), F.min("code").alias("first_code"), F.max("code").alias("last_code"))


_INDEX = sql("product", "SELECT tag, count(DISTINCT pid) AS n, min(code) AS first_code, max(code) AS last_code FROM (SELECT pid, code, unnest(list_append(string_split(name, ' '), lower(category))) AS tag FROM product) GROUP BY 1")


def local_transfer(spark, sf_dir):
    """Brands proved local by two distinct local codes pass the flag on to their products without one."""
    marked = issuer.classify(products(spark, sf_dir), issuers(spark, sf_dir))
    proof = marked.where("verdict = 'LOCAL'").groupBy("brand").agg(F.count_distinct("code").alias("n"), F.min("code").alias("proof")).where("n >= 2")
    return marked.where("verdict = 'OTHER'").join(proof, "brand").select("pid", "brand", "proof", F.col("n").alias("n_proofs"))


_TRANSFER = sql("product issuer", f"+{_DENSE}, m AS (SELECT *, {_VERDICT} AS verdict FROM (SELECT p.*, d.issuer, d.kind, d.stance FROM product p LEFT JOIN dense d ON number = substr(code, 1, 3)::INT)), proof AS (SELECT brand, count(DISTINCT code) AS n, min(code) AS proof FROM m WHERE verdict = 'LOCAL' GROUP BY 1 HAVING count(DISTINCT code) >= 2) SELECT pid, brand, proof, n AS n_proofs FROM m JOIN proof USING (brand) WHERE verdict = 'OTHER'")


def duplicate_names(spark, sf_dir):
    """Names that more than one code has, and in how many categories."""
    return products(spark, sf_dir).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("category").alias("n_categories")).where("n > 1")


_DUPLICATES = sql("product", "SELECT name, count(*) AS n, count(DISTINCT category) AS n_categories FROM product GROUP BY 1 HAVING count(*) > 1")


def locality_tally(spark, sf_dir):
    """Offers by what is known of their locality, and products with nothing known."""
    rows = offers(spark, sf_dir)
    return rows.groupBy("source").agg(
        F.count_if(F.col("local").eqNullSafe(True)).alias("n_local"), F.count_if(F.col("local").eqNullSafe(False)).alias("n_foreign"), F.count_if(F.col("local").isNull()).alias("n_unknown")
    )


_TALLY = sql("offer", "SELECT source, count(*) FILTER (WHERE local) AS n_local, count(*) FILTER (WHERE NOT local) AS n_foreign, count(*) FILTER (WHERE local IS NULL) AS n_unknown FROM offer GROUP BY 1")


def brand_records(spark, sf_dir):
    """Brands with their categories, price range, and the brands sold beside them in the most products."""
    rows = products(spark, sf_dir)
    return rows.groupBy("brand").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"), F.min("price").alias("low"), F.max("price").alias("high")
    )


_BRANDS = sql("product", "SELECT brand, count(*) AS n, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories, min(price) AS low, max(price) AS high FROM product GROUP BY 1")

QUERIES = {f.__name__: f for f in (code_price_verdict, code_verdict, code_check_digit, code_lengths, issuer_coverage, price_comparison, code_record, chip_counts, source_counts, coverage_profile, price_quantiles, price_gates, category_hubs, inverted_index, local_transfer, duplicate_names, locality_tally, brand_records)}
ORACLES = dict(zip(QUERIES, (_CODE_PRICE, _CODE_VERDICT, _CHECK, _LENGTHS, _COVERAGE, sql("offer", f"+{_COMPARED} SELECT * FROM compared"), _RECORD, _CHIPS, _SOURCES, _PROFILE, _QUANTILES, _GATES, _HUBS, _INDEX, _TRANSFER, _DUPLICATES, _TALLY, _BRANDS), strict=True))
