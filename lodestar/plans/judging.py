"""Proposals, evaluation of answers, and gates, bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, issuer, merge, proposals, rank
from ..sources.catalogue import issuers, offers, products, sql, table
from .catalogue import _DENSE, _VERDICT
from .matching import _ALTS, _FAMILY, _STANCE, _TIERS, FAMILIES, _pool, tier_resolution


def _proposals(spark, sf_dir):
    """Proposals made of events: some codes malformed, the product's own or flagged; some brands missing, the same or advertisements."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "cast(ts AS timestamp) AS at", "concat('c', user_id % 5) AS client", "concat('u', user_id % 20) AS owner", "IF(event_id % 29 = 0, 'x', cast(40000000 + event_id % 30 AS string)) AS for_code", "'own brand' AS for_brand",
        "CASE event_id % 8 WHEN 0 THEN '12' WHEN 1 THEN cast(40000000 + event_id % 30 AS string) WHEN 2 THEN '99900001' WHEN 3 THEN '50000001' END AS alt_code",
        "CASE event_id % 6 WHEN 0 THEN ' ' WHEN 1 THEN 'Own-Brand' WHEN 2 THEN 'see www.shop.example' ELSE concat('Brand ', event_id % 4) END AS alt_brand",
    )


def _judged(spark, sf_dir):
    return proposals.intake(_proposals(spark, sf_dir), F.col("alt_code").startswith("999"))


def proposal_intake(spark, sf_dir):
    """What becomes of every proposal: a fault, over the rate, a duplicate, no room, or queued."""
    return _judged(spark, sf_dir).select("id", "outcome")


_INTAKE_CTES = """e AS (SELECT event_id AS id, ts, user_id % 5 AS client, user_id % 20 AS owner, event_id % 30 AS product, CASE event_id % 8 WHEN 3 THEN '50000001' ELSE CASE WHEN event_id % 6 > 2 THEN 'brand' || (event_id % 4) END END AS alt,
        CASE WHEN event_id % 29 = 0 THEN 'for_code' WHEN event_id % 8 = 0 THEN 'alt_code' WHEN event_id % 8 > 3 AND event_id % 6 IN (0, 2) THEN 'nothing_named' WHEN event_id % 8 = 1 THEN 'same_product'
        WHEN event_id % 6 = 1 THEN 'same_brand' WHEN event_id % 8 = 2 THEN 'flagged' END AS fault FROM events),
    v AS (SELECT *, row_number() OVER (PARTITION BY client, date_trunc('minute', ts) ORDER BY ts, id) <= 3 AND row_number() OVER (PARTITION BY client, ts::DATE ORDER BY ts, id) <= 20 AS allowed FROM e WHERE fault IS NULL),
    a AS (SELECT * FROM v WHERE allowed),
    r AS (SELECT owner, product, alt, min(ts) AS ts FROM a GROUP BY 1, 2, 3 UNION ALL SELECT r.owner, r.product, r.alt, (SELECT min(a.ts) FROM a WHERE a.owner = r.owner AND a.product = r.product AND a.alt = r.alt AND a.ts >= r.ts + INTERVAL 86400 SECOND) FROM r WHERE r.ts IS NOT NULL),
    f AS (SELECT a.id, row_number() OVER (ORDER BY a.ts DESC, a.id DESC) AS place FROM r JOIN a USING (owner, product, alt, ts)),
    judged AS (SELECT e.id, e.ts, e.owner, e.product, e.alt, coalesce(e.fault, CASE WHEN NOT v.allowed THEN 'rate' WHEN f.id IS NULL THEN 'duplicate' WHEN f.place > 2000 THEN 'full' ELSE 'queued' END) AS outcome FROM e LEFT JOIN v USING (id) LEFT JOIN f ON f.id = e.id)"""
_INTAKE = f"WITH RECURSIVE {_INTAKE_CTES} SELECT id, outcome FROM judged"


def _decided(spark, sf_dir):
    queued = _judged(spark, sf_dir).where("outcome = 'queued'").drop("outcome", "alt_key")
    decisions = queued.where("id % 3 <> 0").selectExpr("id", "at", "IF(id % 5 = 0, 'rejected', 'accepted') AS verdict").unionByName(queued.where("id % 15 = 1").selectExpr("id", "at + INTERVAL 1 DAY AS at", "'rejected' AS verdict"))
    return proposals.decide(queued, decisions)


def proposal_lifecycle(spark, sf_dir):
    """The queue after decisions, and after every fourth owner asked to be forgotten."""
    decided = _decided(spark, sf_dir)
    return proposals.forget(decided, decided.select("owner").distinct().where("cast(substr(owner, 2) AS int) % 4 = 0")).select("id", "owner", "status")


_LIFECYCLE_CTES = _INTAKE_CTES + """, d AS (SELECT id, ts, owner, product, CASE WHEN id % 15 = 1 THEN 'rejected' WHEN id % 3 = 0 THEN 'pending' WHEN id % 5 = 0 THEN 'rejected' ELSE 'accepted' END AS status FROM judged WHERE outcome = 'queued')"""
_LIFECYCLE = f"WITH RECURSIVE {_LIFECYCLE_CTES} SELECT id, CASE WHEN owner % 4 <> 0 THEN 'u' || owner END AS owner, status FROM d WHERE owner % 4 <> 0 OR status = 'accepted'"


def proposal_public(spark, sf_dir):
    """Accepted proposals of owners who agree to publication, by product."""
    decided = _decided(spark, sf_dir)
    consents = decided.selectExpr("owner", "at", "cast(substr(owner, 2) AS int) % 3 = 0 OR id % 2 = 0 AS agrees")
    shown = proposals.published(decided, consents)
    return proposals.public(shown).groupBy("for_code").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


_PUBLIC = f"""WITH RECURSIVE {_LIFECYCLE_CTES}, c AS (SELECT owner FROM d GROUP BY 1 HAVING arg_max(owner % 3 = 0 OR id % 2 = 0, ts))
    SELECT (40000000 + product)::VARCHAR AS for_code, count(*) AS n, min(id) AS "first" FROM d WHERE status = 'accepted' AND owner IN (SELECT owner FROM c) GROUP BY 1"""


def _probes(spark, sf_dir):
    rows = _pool(spark, sf_dir)
    answers = tier_resolution(spark, sf_dir)
    n = answers.groupBy(F.col("pid").alias("probe")).agg(F.count(F.lit(1)).alias("n"))
    probes = rows.where("stance = 'FLAGGED'").select(F.col("pid").alias("probe"), F.when(F.col("pid") % 10 != 0, F.col("family")).alias("family"), F.col("brand").alias("own"), "category")
    probes = probes.join(n, "probe", "left").withColumn("n", F.when(F.col("probe") % 7 == 0, 0).otherwise(F.coalesce("n", F.lit(0))))
    able = rank.first_two(rows.where("stance <> 'FLAGGED'"), "family", "brand").withColumnsRenamed({"firsts": "brands", "n": "n_brands"})
    return evaluate.audit(probes, able), answers.where("pid % 7 <> 0"), rows


def answer_evaluation(spark, sf_dir):
    """Probes of each shelf: answered, answers of the wrong family or the own brand, and empty answers that are lies."""
    probes, answers, rows = _probes(spark, sf_dir)
    alts = answers.join(rows.select(F.col("pid").alias("alt"), F.col("family").alias("alt_family"), F.col("brand").alias("alt_brand")), "alt").select(F.col("pid").alias("probe"), "alt_family", "alt_brand")
    return evaluate.counters(probes, alts, "category")


_EVALUATION = f"""WITH stance AS ({_STANCE}), product AS (SELECT * FROM ({sql('product', 'SELECT * FROM product')})), {_ALTS.format(family=_FAMILY.format('p.name'))}, t AS ({_TIERS}),
    p AS (SELECT a.pid, CASE WHEN pid % 10 <> 0 THEN family END AS family, brand AS own, category, CASE WHEN pid % 7 = 0 THEN 0 ELSE (SELECT count(*) FROM t WHERE t.pid = a.pid) END AS n FROM a WHERE stance = 'FLAGGED'),
    s AS (SELECT family, list(DISTINCT brand) AS b FROM a WHERE stance <> 'FLAGGED' AND family IS NOT NULL GROUP BY 1),
    m AS (SELECT p.*, CASE WHEN n > 0 THEN NULL WHEN p.family IS NULL THEN 'unplaceable' WHEN len(list_filter(coalesce(b, []), lambda x: x <> own)) > 0 THEN 'lie' ELSE 'honest' END AS empty,
        (SELECT count(*) FROM t JOIN a x ON x.pid = t.alt WHERE t.pid = p.pid AND p.pid % 7 <> 0 AND x.family <> p.family) AS wrong, (SELECT count(*) FROM t JOIN a x ON x.pid = t.alt WHERE t.pid = p.pid AND p.pid % 7 <> 0 AND x.brand = p.own) AS self FROM p LEFT JOIN s USING (family))
    SELECT category, count(*) AS n, count(*) FILTER (WHERE n > 0) AS n_answered, sum(n)::BIGINT AS n_answers, sum(wrong)::BIGINT AS n_wrong, sum(self)::BIGINT AS n_self,
    count(*) FILTER (WHERE empty = 'lie') AS n_lie, count(*) FILTER (WHERE empty = 'honest') AS n_honest, count(*) FILTER (WHERE empty = 'unplaceable') AS n_unplaceable FROM m GROUP BY 1"""


def rule_drift(spark, sf_dir):
    """Products that gain, lose or change their family when a rule is dropped and shelves decide for the rest."""
    kinds = F.create_map(*(F.lit(x) for w, k in FAMILIES for x in (w, k)))
    rows = products(spark, sf_dir).select("pid", "category", kinds[F.element_at(F.split("name", " "), -1)].alias("family"))
    after = F.when(F.col("family") == "parts", None).when(F.col("category") == "PROMO", "toys").otherwise(F.col("family"))
    return evaluate.drift(rows.withColumn("family", F.when(F.col("pid") % 9 != 0, F.col("family"))), rows.withColumn("family", after), "pid", "family")


_KIND = "CASE string_split(name, ' ')[-1] " + " ".join(f"WHEN '{w}' THEN '{k}'" for w, k in FAMILIES) + " END"
_DRIFT = sql("product", f"""+v AS (SELECT CASE WHEN pid % 9 <> 0 THEN {_KIND} END AS v0, CASE WHEN {_KIND} = 'parts' THEN NULL WHEN category = 'PROMO' THEN 'toys' ELSE {_KIND} END AS v1 FROM product)
    SELECT CASE WHEN v0 IS NOT DISTINCT FROM v1 THEN 'same' WHEN v0 IS NULL THEN 'gain' WHEN v1 IS NULL THEN 'loss' ELSE 'change' END AS change, count(*) AS n FROM v GROUP BY 1""")


def catalogue_fingerprint(spark, sf_dir):
    """Rows and the sum of prices in cents of each source: what tells two states of the catalogue apart at a glance."""
    return offers(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("price") * 100).cast("bigint")).alias("cents"))


_FINGERPRINT = sql("offer", "SELECT source, count(*) AS n, sum(round(price * 100)::BIGINT)::BIGINT AS cents FROM offer GROUP BY 1")


def run_log(spark, sf_dir):
    """The newest thirty days as runs: events, users, and how many more than the run before."""
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("at")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"))
    return evaluate.run_log(days)


_RUNS = 'SELECT ts::DATE AS "at", count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 30'


def prune_report(spark, sf_dir):
    """Rows that pruning removes, by source."""
    rows = offers(spark, sf_dir).join(products(spark, sf_dir).select("pid", "brand"), "pid")
    return merge.prune(rows, ~F.col("brand").rlike("(?i)#1[0-9]$") & F.col("price").isNotNull(), "source")[1]


_PRUNE = sql("product offer", "SELECT source, count(*) AS n FROM offer o JOIN product p USING (pid) WHERE NOT (NOT regexp_matches(brand, '#1[0-9]$') AND o.price IS NOT NULL) GROUP BY 1")


def ranked_shelves(spark, sf_dir):
    """The first ten products of each shelf: not flagged first, then by price, shelves in their own order."""
    marked = issuer.classify(products(spark, sf_dir), issuers(spark, sf_dir))
    order = {"STANDARD": 1, "ECONOMY": 2, "MEDIUM": 3}
    place = F.coalesce(F.create_map(*(F.lit(x) for kv in order.items() for x in kv))[F.col("category")], F.lit(9))
    rows = marked.select("pid", "category", place.alias("shelf_rank"), (F.col("verdict") == "FLAGGED").alias("flagged"), "price")
    return rank.first_rows(rows, ["category"], ["flagged", "price", "pid"], 10, "place").select("pid", "category", "shelf_rank", "flagged", "place")


_SHELVES = sql("product issuer", f"""+{_DENSE}, m AS (SELECT p.pid, p.category, p.price, {_VERDICT} = 'FLAGGED' AS flagged FROM product p LEFT JOIN dense ON number = substr(code, 1, 3)::INT)
    SELECT pid, category, CASE category WHEN 'STANDARD' THEN 1 WHEN 'ECONOMY' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 9 END AS shelf_rank, flagged, place FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY flagged, price, pid) AS place FROM m) WHERE place <= 10""")


def local_first(spark, sf_dir):
    """Products of a brand in the order of a tier: a local code, a known country, a picture; the first five."""
    marked = issuer.classify(products(spark, sf_dir), issuers(spark, sf_dir))
    keys = [F.col("verdict") != "LOCAL", F.coalesce(F.col("kind") != "country", F.lit(True)), F.col("pid") % 3 == 0, F.col("pid")]
    return rank.first_rows(marked, ["brand"], keys, 5, "place").select("pid", "brand", "place")


_LOCAL = sql("product issuer", f"""+{_DENSE}, m AS (SELECT p.pid, p.brand, d.kind, {_VERDICT} AS verdict FROM product p LEFT JOIN dense d ON number = substr(code, 1, 3)::INT)
    SELECT pid, brand, place FROM (SELECT pid, brand, row_number() OVER (PARTITION BY brand ORDER BY verdict <> 'LOCAL', coalesce(kind <> 'country', true), pid % 3 = 0, pid) AS place FROM m) WHERE place <= 5""")


def shelf_search(spark, sf_dir):
    """Shelf and words together: products of each shelf whose name, brand or shelf holds a word, and how many of them have an alternative."""
    rows = products(spark, sf_dir).where(F.lower(F.concat_ws(" ", "name", "brand", "category")).contains("ring") & F.col("category").isin("STANDARD", "PROMO", "SMALL"))
    answered = tier_resolution(spark, sf_dir).select("pid").distinct().withColumn("hit", F.lit(True))
    return rows.join(answered, "pid", "left").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_matched"), F.count_if(F.col("hit").isNull()).alias("n_gap"))


_SEARCH = f"""WITH t AS ({_TIERS}), q AS ({sql('product', 'SELECT * FROM product')}) SELECT category, count(*) AS n, count(*) FILTER (WHERE pid IN (SELECT pid FROM t)) AS n_matched, count(*) FILTER (WHERE pid NOT IN (SELECT pid FROM t)) AS n_gap
    FROM q WHERE contains(lower(name || ' ' || brand || ' ' || category), 'ring') AND category IN ('STANDARD', 'PROMO', 'SMALL') GROUP BY 1"""

QUERIES = {f.__name__: f for f in (proposal_intake, proposal_lifecycle, proposal_public, answer_evaluation, rule_drift, catalogue_fingerprint, run_log, prune_report, ranked_shelves, local_first, shelf_search)}
ORACLES = dict(zip(QUERIES, (_INTAKE, _LIFECYCLE, _PUBLIC, _EVALUATION, _DRIFT, _FINGERPRINT, _RUNS, _PRUNE, _SHELVES, _LOCAL, _SEARCH), strict=True))
