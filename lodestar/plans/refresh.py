"""Dedupe, upsert, change log, history and sizes, bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, sizes, text
from ..operators import dedupe, issuer, merge
from ..sources.catalogue import issuers, offers, products, sql, table, valid_sql


def dedupe_cheapest(spark, sf_dir):
    """The cheapest offer of each product and the other sources that sell it."""
    best = dedupe.cheapest(offers(spark, sf_dir), ["pid"], "oid")
    return best.select("pid", "price", "source", F.size("also_at").cast("bigint").alias("n_also_at"), F.array_join("also_at", ",").alias("also_at"))


_CHEAPEST = sql("offer", """+w AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY price IS NULL, price, oid) AS r FROM offer),
    s AS (SELECT pid, list_sort(list(DISTINCT source)) AS sellers FROM offer GROUP BY 1)
    SELECT pid, price, source, len(list_filter(sellers, lambda x: x <> source)) AS n_also_at, array_to_string(list_filter(sellers, lambda x: x <> source), ',') AS also_at FROM w JOIN s USING (pid) WHERE r = 1""")


def collapse_same(spark, sf_dir):
    """Products of one name and size become one where at most one brand is known; every other brand is unknown here."""
    brand = F.when(F.col("pid") % 2 == 0, F.col("brand"))
    rows = products(spark, sf_dir).select(
        F.concat_ws(" ", "name", "size").alias("label"), "pid", "price", brand.alias("brand"), F.expr("CASE pid % 3 WHEN 0 THEN true WHEN 1 THEN false END").alias("local")
    )
    return dedupe.collapse(rows, "label", "brand", "pid")


_COLLAPSE = sql("product", """+r AS (SELECT name || ' ' || size AS label, pid, price, CASE WHEN pid % 2 = 0 THEN brand END AS brand, CASE pid % 3 WHEN 0 THEN true WHEN 1 THEN false END AS local FROM product),
    g AS (SELECT label, count(DISTINCT brand) AS n FROM r GROUP BY 1)
    SELECT label, arg_min(pid, (price IS NULL, price, pid)) AS pid, min(price) AS price, max(brand) AS brand, bool_and(local) AS local, count(*) AS n_merged FROM r JOIN g USING (label) WHERE n <= 1 GROUP BY 1
    UNION ALL SELECT label, pid, price, brand, local, 0 FROM r JOIN g USING (label) WHERE n > 1""")


def keep_first_offer(spark, sf_dir):
    """The first offer of each (product, source) by the offers' own order."""
    rows = offers(spark, sf_dir).select("pid", "source", "price", "oid")
    return dedupe.keep_first(rows, ["pid", "source"], ["oid"]).select("pid", "source", "price")


_FIRST = sql("offer", "SELECT pid, source, price FROM (SELECT *, row_number() OVER (PARTITION BY pid, source ORDER BY oid) AS r FROM offer) WHERE r = 1")


def retailer_shadow(spark, sf_dir):
    """Per source one row a product name and code; rows without a code go where the name has one."""
    named = products(spark, sf_dir).select("pid", "name", F.when(F.col("pid") % 4 != 0, F.col("code")).alias("code"))
    rows = offers(spark, sf_dir).join(named, "pid").select("source", "name", "code", "price", F.struct("pid", "oid").alias("ord"), "pid")
    return dedupe.shadowed(rows, "source", "name", "code", "ord").select("source", "name", "code", "price", "pid")


_SHADOW = sql("product offer", """+r AS (SELECT source, name, CASE WHEN pid % 4 <> 0 THEN code END AS code, o.price, pid, oid FROM offer o JOIN product p USING (pid)),
    w AS (SELECT *, row_number() OVER (PARTITION BY source, name, code ORDER BY price IS NULL, price, pid, oid) AS k FROM r),
    c AS (SELECT DISTINCT source, name FROM w WHERE k = 1 AND code IS NOT NULL)
    SELECT source, name, code, price, pid FROM w WHERE k = 1 AND (code IS NOT NULL OR NOT EXISTS (SELECT 1 FROM c WHERE c.source = w.source AND c.name = w.name))""")


def _states(spark, sf_dir):
    """Base: the last early price of each (product, source); incoming: the last late one, some in another currency."""
    rows = offers(spark, sf_dir).select(F.concat_ws(":", "source", "pid").alias("id"), "source", "pid", "price", "at", "oid")
    late = F.col("at") >= F.lit("2000-01-01").cast("timestamp")
    # what follows from source and product is added after the shuffle, and rows stay dealt out by id
    best = F.min_by(F.struct("source", "pid", "price"), F.struct(-F.unix_seconds("at"), "oid")).alias("r")
    shown = [
        "id", F.when(F.col("r.pid") % 3 == 0, F.concat(F.lit("gtin:"), F.col("r.pid").cast("string"))).alias("match_key"), F.col("r.price").alias("price"),
        F.when(F.col("r.pid") % 11 == 0, "XXX").when(F.col("r.pid") % 7 != 0, "EUR").alias("currency"), F.col("r.source").cast("string").alias("name"),
    ]
    pick = lambda df: df.groupBy("id").agg(best).select(*shown)
    return pick(rows.where(~late)).withColumn("currency", F.lit("EUR")), pick(rows.where(late))


_STATE = """r AS (SELECT source || ':' || pid AS id, CASE WHEN pid % 3 = 0 THEN 'gtin:' || pid END AS match_key, price,
        CASE WHEN pid % 11 = 0 THEN 'XXX' WHEN pid % 7 <> 0 THEN 'EUR' END AS currency, source::VARCHAR AS name, at_, oid FROM offer),
    k AS (SELECT *, at_ >= TIMESTAMP '2000-01-01' AS late, row_number() OVER (PARTITION BY id, at_ >= TIMESTAMP '2000-01-01' ORDER BY at_ DESC, oid) AS n FROM r),
    b AS (SELECT * FROM k WHERE n = 1 AND NOT late), i AS (SELECT *, coalesce(currency = 'EUR', true) AS ok FROM k WHERE n = 1 AND late),
    taken AS (SELECT DISTINCT match_key FROM b WHERE match_key IS NOT NULL),
    j AS (SELECT coalesce(b.id, i.id) AS id, b.id IS NOT NULL AS inb, i.id IS NOT NULL AS ini, i.ok, b.price AS bp, i.price AS ip, b.name AS bn, i.name AS nn, b.match_key AS bm, i.match_key AS im,
        i.match_key IN (SELECT match_key FROM taken) AS tk FROM b FULL JOIN i ON b.id = i.id),
    m AS (SELECT *, CASE WHEN NOT ini THEN 'kept' WHEN NOT ok THEN CASE WHEN inb THEN 'refused_currency' ELSE 'skipped_currency' END
        WHEN NOT inb THEN CASE WHEN tk THEN 'skipped_duplicate' ELSE 'imported' END
        WHEN ip IS NULL AND bp IS NOT NULL THEN 'kept_old_price' WHEN bp IS DISTINCT FROM ip THEN 'refreshed' ELSE 'unchanged' END AS outcome FROM j)"""


def catalogue_merge(spark, sf_dir):
    return merge.upsert(*_states(spark, sf_dir))


_MERGE = sql("offer", f"+{_STATE} SELECT id, outcome, CASE WHEN outcome IN ('refreshed', 'imported') THEN ip ELSE bp END AS price, bp AS old_price, coalesce(bn, CASE WHEN outcome IN ('refreshed', 'imported') THEN nn END) AS name, coalesce(bm, CASE WHEN outcome IN ('refreshed', 'imported') THEN im END) AS match_key FROM m")


def _listings(spark, sf_dir):
    """Base and re-read of the same listings with all fields; some codes missing or wrong, some fields blank or other."""
    base, late = _states(spark, sf_dir)
    n = F.length("id") + F.substring_index("id", ":", -1).cast("bigint")
    other = lambda k: n % k == 0

    def full(df, fresh: bool):
        pid = F.substring_index("id", ":", -1).cast("bigint")
        code = codes.with_check_digit(F.lpad(pid.cast("string"), 12, "3"))
        barcode = F.when(pid % 4 == 1, code).when(pid % 4 == 2, F.lit("123")) if fresh else F.when(pid % 4 == 3, code).when(pid % 8 == 1, F.lit(""))
        text_of = lambda f, k: F.concat(F.lit(f), F.when(other(k) & F.lit(fresh), F.lit(" new")).otherwise(F.lit("")))
        return df.select(
            "id", "price", "currency", "match_key", text_of("name", 5).alias("name"), text_of("shelf", 7).alias("category"), F.when(~other(3), F.lit("note")).alias("price_note"),
            F.when(other(2) & F.lit(fresh), F.lit("")).otherwise(F.lit("image")).alias("image"), text_of("url", 11).alias("url"), F.when(other(4) if fresh else ~other(4), F.lit("1 kg")).alias("quantity"), F.lit("title").alias("quantity_source"),
            F.substring_index("id", ":", 1).alias("source"), F.lit("label").alias("source_label"), barcode.alias("barcode"), F.lit("shop" if fresh else None).cast("string").alias("barcode_source"),
            F.lit(fresh).alias("local"), F.lit("seen").alias("local_evidence"), F.lit("B" if fresh else "A").alias("brand"), F.lit("own").alias("brand_source"), F.col("id").alias("ord"),
        )

    return full(base, False), full(late, True)


def catalogue_upsert(spark, sf_dir):
    """Listings read again: nine fields refreshed, the others frozen, codes gained, new rows once a key."""
    merged = merge.full_upsert(*_listings(spark, sf_dir), "ord")
    shown = ["name", "category", "price", "currency", "price_note", "image", "url", "quantity", "barcode", "barcode_source", "local", "brand"]
    return merged.select("id", "outcome", F.array_join("changed", ",").alias("changed"), "price_missing", *shown)


def _full_sql() -> str:
    pid = "string_split(id, ':')[2]::BIGINT"
    n = f"(length(id) + {pid})"
    body = f"lpad(({pid})::VARCHAR, 12, '3')"
    check = f"((10 - list_sum(list_transform(range(1, 13), lambda i: substr({body}, i, 1)::INT * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10)::INT::VARCHAR"
    side = lambda fresh: f"""SELECT id, price, {"currency" if fresh else "'EUR' AS currency"}, match_key, 'name' || {f"CASE WHEN {n} % 5 = 0 THEN ' new' ELSE '' END" if fresh else "''"} AS name,
        'shelf' || {f"CASE WHEN {n} % 7 = 0 THEN ' new' ELSE '' END" if fresh else "''"} AS category, CASE WHEN {n} % 3 <> 0 THEN 'note' END AS price_note,
        {f"CASE WHEN {n} % 2 = 0 THEN '' ELSE 'image' END" if fresh else "'image'"} AS image, 'url' || {f"CASE WHEN {n} % 11 = 0 THEN ' new' ELSE '' END" if fresh else "''"} AS url,
        CASE WHEN {n} % 4 {"=" if fresh else "<>"} 0 THEN '1 kg' END AS quantity,
        {f"CASE {pid} % 4 WHEN 1 THEN {body} || {check} WHEN 2 THEN '123' END" if fresh else f"CASE WHEN {pid} % 4 = 3 THEN {body} || {check} WHEN {pid} % 8 = 1 THEN '' END"} AS barcode FROM k WHERE n = 1 AND {"late" if fresh else "NOT late"}"""  # noqa: E731
    news = lambda f: f"(i.{f} IS NOT NULL AND i.{f}::VARCHAR <> '' AND i.{f} IS DISTINCT FROM b.{f})"
    moved = {f: news(f) for f in ("name", "category", "price", "currency", "price_note", "image", "url", "quantity")}
    gained = "(coalesce(b.barcode, '') = '' AND length(i.barcode) = 13)"
    listed = ", ".join(f"CASE WHEN {c} THEN '{f}' END" for f, c in (moved | {"barcode": gained}).items())
    return f"""+{_STATE.split("b AS (SELECT * FROM k")[0].rstrip().rstrip(',')}, fb AS ({side(False)}), fi AS ({side(True)}),
    lead AS (SELECT min(fi.id) AS id FROM fi WHERE id NOT IN (SELECT id FROM fb) AND coalesce(currency = 'EUR', true) AND match_key IS NOT NULL AND match_key NOT IN (SELECT match_key FROM fb WHERE match_key IS NOT NULL) GROUP BY match_key),
    w AS (SELECT coalesce(b.id, i.id) AS id, b.id IS NOT NULL AND i.id IS NOT NULL AND coalesce(i.currency = 'EUR', true) AS reread, b.id IS NULL AS fresh, i.id IS NULL AS old, coalesce(i.currency = 'EUR', true) AS ok,
        list_filter([{listed}], lambda x: x IS NOT NULL) AS moved, b.price IS NOT NULL AND i.price IS NULL AS missing, i.match_key AS i_key, {gained} AS m_barcode,
        {", ".join(f"{c} AS m_{f}, b.{f} AS b_{f}, i.{f} AS i_{f}" for f, c in moved.items())}, b.barcode AS b_barcode, i.barcode AS i_barcode FROM fb b FULL JOIN fi i ON b.id = i.id),
    x AS (SELECT *, CASE WHEN old THEN 'kept' WHEN NOT ok THEN 'skipped_currency' WHEN fresh THEN CASE WHEN i_key IS NULL OR id IN (SELECT id FROM lead) THEN 'imported' ELSE 'skipped_duplicate' END WHEN len(moved) > 0 THEN 'refreshed' ELSE 'unchanged' END AS outcome FROM w)"""


_UPSERT_ROWS = _full_sql()
_UPSERT = sql("offer", f"""{_UPSERT_ROWS} SELECT id, outcome, CASE WHEN reread THEN array_to_string(moved, ',') ELSE '' END AS changed, reread AND missing AS price_missing,
    {", ".join(f"CASE WHEN outcome = 'imported' OR reread AND m_{f} THEN i_{f} ELSE b_{f} END AS {f}" for f in ("name", "category", "price", "currency", "price_note", "image", "url", "quantity", "barcode"))},
    CASE WHEN outcome = 'imported' OR reread AND m_barcode THEN 'shop' END AS barcode_source,
    CASE WHEN outcome = 'imported' THEN true WHEN NOT fresh THEN false END AS local, CASE WHEN outcome = 'imported' THEN 'B' WHEN NOT fresh THEN 'A' END AS brand FROM x""")


def upsert_counters(spark, sf_dir):
    return merge.upsert_counters(merge.full_upsert(*_listings(spark, sf_dir), "ord"))


_UPSERT_COUNTS = sql("offer", f"""{_UPSERT_ROWS} SELECT counter, count(*) AS n FROM (SELECT 'row:' || outcome AS counter FROM x UNION ALL SELECT 'field:' || unnest(moved) FROM x WHERE reread UNION ALL SELECT 'price:kept_old' FROM x WHERE reread AND missing) GROUP BY 1""")


def merge_change_log(spark, sf_dir):
    return merge.change_log(merge.upsert(*_states(spark, sf_dir))).select("id", "old_price", "price", (F.round("pct", 0) + 0.0).alias("pct"))


_LOG = sql("offer", f"+{_STATE} SELECT id, bp AS old_price, ip AS price, CASE WHEN bp <> 0 THEN round(round((ip - bp) / bp * 100, 1), 0) + 0.0::DOUBLE END AS pct FROM m WHERE outcome = 'refreshed'")


def merge_counters(spark, sf_dir):
    return merge.upsert(*_states(spark, sf_dir)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def catalogue_diff(spark, sf_dir):
    base, incoming = _states(spark, sf_dir)
    return merge.difference(base, incoming).groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.count("p0").alias("n_before"), F.count("p1").alias("n_after"), F.min("id").alias("first_id"))


_DIFF = sql("offer", f"+{_STATE}, d AS (SELECT id, bp, ip, CASE WHEN NOT inb THEN 'added' WHEN NOT ini THEN 'gone' WHEN bp IS DISTINCT FROM ip THEN 'repriced' END AS change FROM j) SELECT change, count(*) AS n, count(bp) AS n_before, count(ip) AS n_after, min(id) AS first_id FROM d WHERE change IS NOT NULL GROUP BY 1")


def source_delta(spark, sf_dir):
    """Rows of each source before and after, sources with none included."""
    rows = offers(spark, sf_dir).withColumn("late", F.col("at") >= F.lit("2000-01-01").cast("timestamp"))
    return rows.groupBy("source").agg(F.count_if(~F.col("late")).alias("n_before"), F.count_if("late").alias("n_after")).withColumn("delta", F.col("n_after") - F.col("n_before"))


_DELTA = sql("offer", "SELECT source, count(*) FILTER (WHERE at_ < TIMESTAMP '2000-01-01') AS n_before, count(*) FILTER (WHERE at_ >= TIMESTAMP '2000-01-01') AS n_after, count(*) FILTER (WHERE at_ >= TIMESTAMP '2000-01-01') - count(*) FILTER (WHERE at_ < TIMESTAMP '2000-01-01') AS delta FROM offer GROUP BY 1")


def price_history(spark, sf_dir):
    """The newest eight prices of each product."""
    points = offers(spark, sf_dir).where("price IS NOT NULL").select(F.col("pid").alias("id"), "at", "price", "oid")
    return merge.history(points, 8, [F.desc("at"), "oid"]).select("id", F.col("n").cast("bigint").alias("n"), F.to_date("at").alias("day"), "price")


_HISTORY = sql("offer", "SELECT pid AS id, n, at_::DATE AS day, price FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY at_ DESC, oid) AS n FROM offer WHERE price IS NOT NULL) WHERE n <= 8")


def price_moves(spark, sf_dir):
    """Up to eight price changes of the five hundred listings that moved last."""
    points = offers(spark, sf_dir).select(F.concat_ws(":", "source", "pid").alias("id"), "at", "price", "oid")
    return merge.moves(points, ["at", "oid"], 8, 500).select("id", "n", F.to_date("at").alias("day"), "before", "price")


_MOVES = sql("offer", """+p AS (SELECT source || ':' || pid AS id, at_, price, oid, lag(price) OVER (PARTITION BY source, pid ORDER BY at_, oid) AS before FROM offer WHERE price IS NOT NULL),
    c AS (SELECT * FROM p WHERE before IS NOT NULL AND before <> price), l AS (SELECT id FROM c GROUP BY 1 ORDER BY max(at_) DESC, id LIMIT 500)
    SELECT id, n, at_::DATE AS day, before, price FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY at_ DESC, oid DESC) AS n FROM c WHERE id IN (SELECT id FROM l)) WHERE n <= 8""")


def recently_moved(spark, sf_dir):
    """The fifty products whose price was seen last, with how many prices each has."""
    seen = offers(spark, sf_dir).where("price IS NOT NULL").groupBy("pid").agg(F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    return seen.orderBy(F.desc("last"), "pid").limit(50).select("pid", F.to_date("last").alias("last"), "n")


_MOVED = sql("offer", """SELECT pid, max(at_)::DATE AS "last", count(*) AS n FROM offer WHERE price IS NOT NULL GROUP BY 1 ORDER BY max(at_) DESC, pid LIMIT 50""")


def backfill_quantity(spark, sf_dir):
    """Missing quantities from titles, with where each came from; tallied by unit."""
    rows = products(spark, sf_dir).select("pid", F.when(F.col("pid") % 5 == 0, F.lit("1 kg")).alias("quantity"), sizes.format_size(sizes.parse_size(F.col("title"))).alias("parsed"))
    return merge.backfill(rows, "quantity", "parsed").select("pid", "quantity", "quantity_from")


_FORMATTED = "CASE (pid % 8)::INT WHEN 0 THEN '6 x 1.5 l' WHEN 1 THEN '500 g' WHEN 2 THEN '1 kg' WHEN 3 THEN '0.33 l' WHEN 4 THEN '4 x 100 g' WHEN 6 THEN '2 x 250 ml' END"
_BACKFILL = sql("product", f"SELECT pid, CASE WHEN pid % 5 = 0 THEN '1 kg' ELSE {_FORMATTED} END AS quantity, CASE WHEN pid % 5 = 0 THEN 'own' WHEN {_FORMATTED} IS NOT NULL THEN 'derived' END AS quantity_from FROM product")


def size_parse(spark, sf_dir):
    """Sizes, piece counts and the by-weight mark read from titles."""
    size = sizes.parse_size(F.col("title"))
    rows = products(spark, sf_dir).select("pid", "title", "price", size.alias("s"))
    return rows.select(
        "pid",
        F.col("s.value").alias("value"),
        F.col("s.unit").alias("unit"),
        F.col("s.count").alias("packs"),
        F.col("s.total").alias("total"),
        sizes.is_sold_by_weight(F.col("title")).alias("by_weight"),
        sizes.piece_count(F.concat("title", F.expr("IF(pid % 4 = 1, ' 10/1', IF(pid % 4 = 2, ' 24 pcs', ''))"))).alias("pieces"),
        F.round(sizes.unit_price(F.col("price"), F.col("s.total")), 2).alias("unit_price"),
    )


_TOTAL = "[9000, 500, 1000, 330, 400, NULL, 500, NULL][(pid % 8)::INT + 1]::DOUBLE"
_SIZE = sql("product", f"""SELECT pid, [1.5, 500, 1, 0.33, 100, NULL, 250, NULL][(pid % 8)::INT + 1]::DOUBLE AS value, ['l', 'g', 'kg', 'l', 'g', NULL, 'ml', NULL][(pid % 8)::INT + 1] AS unit,
    [6, 1, 1, 1, 4, NULL, 2, NULL][(pid % 8)::INT + 1]::INT AS packs, {_TOTAL} AS total, pid % 8 = 7 AS by_weight, CASE pid % 4 WHEN 1 THEN 10 WHEN 2 THEN 24 END AS pieces,
    round(round(price / {_TOTAL} * 1000, 4), 2) AS unit_price FROM product""")


def size_coverage(spark, sf_dir):
    """How many titles of each shelf name a size, by unit."""
    rows = products(spark, sf_dir).select("category", sizes.parse_size(F.col("title"))["unit"].alias("unit"))
    return rows.groupBy("category", "unit").agg(F.count(F.lit(1)).alias("n"))


_SIZE_COVERAGE = sql("product", "SELECT category, ['l', 'g', 'kg', 'l', 'g', NULL, 'ml', NULL][(pid % 8)::INT + 1] AS unit, count(*) AS n FROM product GROUP BY 1, 2")


def code_integrity(spark, sf_dir):
    """Codes that fail their check digit are withdrawn with the locality drawn from them; the rest set the flag, never to false."""
    damaged = F.when(F.col("pid") % 3 == 0, F.concat(F.left("code", F.lit(12)), ((F.right("code", F.lit(1)).cast("int") + 1) % 10).cast("string"))).otherwise(F.col("code"))
    marked = issuer.classify(products(spark, sf_dir).select("pid", damaged.alias("code")), issuers(spark, sf_dir))
    valid = codes.is_valid(F.col("code"))
    return marked.select("pid", F.when(valid, F.col("code")).alias("code"), F.when(valid & (F.col("verdict") == "LOCAL"), True).alias("local"))


_INTEGRITY = sql("product issuer", f"""+d AS (SELECT pid, CASE WHEN pid % 3 = 0 THEN substr(code, 1, 12) || ((substr(code, 13, 1)::INT + 1) % 10)::VARCHAR ELSE code END AS c FROM product)
    SELECT pid, CASE WHEN {valid_sql('c')} THEN c END AS code, CASE WHEN {valid_sql('c')} AND EXISTS (SELECT 1 FROM issuer WHERE stance = 'LOCAL' AND substr(c, 1, 3)::INT BETWEEN lo AND hi) THEN true END AS local FROM d""")


def match_keys(spark, sf_dir):
    """``gtin:`` keys where the code is valid, else ``name:`` slugs of the normal name."""
    rows = products(spark, sf_dir)
    coded = codes.is_valid(F.col("code")) & (F.col("pid") % 2 == 0)
    key = F.when(coded, F.concat(F.lit("gtin:"), "code")).otherwise(F.concat(F.lit("name:"), text.slug(sizes.match_name(F.col("title")))))
    return rows.select(key.alias("match_key")).groupBy("match_key").agg(F.count(F.lit(1)).alias("n"))


_KEYS = sql("product", """SELECT CASE WHEN pid % 2 = 0 THEN 'gtin:' || code ELSE 'name:' || replace(name, ' ', '-') || ['', '-500g', '', '-0-33l', '', '', '', '-kg'][(pid % 8)::INT + 1] END AS match_key, count(*) AS n FROM product GROUP BY 1""")


def unseen_sources(spark, sf_dir):
    """Late (source, status) pairs that the early catalogue does not have."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("pid"), (F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp")).alias("late"))
    return rows.where("late").select("source", "pid").distinct().join(rows.where(~F.col("late")).select("source", "pid"), ["source", "pid"], "left_anti")


_UNSEEN = "SELECT DISTINCT l_suppkey AS source, l_partkey AS pid FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01'"

QUERIES = {f.__name__: f for f in (dedupe_cheapest, collapse_same, keep_first_offer, retailer_shadow, catalogue_merge, merge_change_log, merge_counters, catalogue_diff, source_delta, price_history, recently_moved, backfill_quantity, size_parse, size_coverage, code_integrity, match_keys, unseen_sources, catalogue_upsert, upsert_counters, price_moves)}
ORACLES = dict(zip(QUERIES, (_CHEAPEST, _COLLAPSE, _FIRST, _SHADOW, _MERGE, _LOG, sql("offer", f"+{_STATE} SELECT outcome, count(*) AS n FROM m GROUP BY 1"), _DIFF, _DELTA, _HISTORY, _MOVED, _BACKFILL, _SIZE, _SIZE_COVERAGE, _INTEGRITY, _KEYS, _UNSEEN, _UPSERT, _UPSERT_COUNTS, _MOVES), strict=True))
