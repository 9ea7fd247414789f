"""Placing products by evidence, splitting origins, refusing candidates, bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import brands, issuer, taxonomy
from ..sources.catalogue import flagged_brands, issuers, offers, products, sql, table
from .catalogue import _DENSE, _VERDICT
from .matching import FAMILIES

_FAMILY_OF = dict(FAMILIES)
_NARROWER = {"fasteners": "parts"}
_SHELVES = {"STANDARD": ["parts", "tools"], "ECONOMY": ["kitchen"], "MEDIUM": ["fasteners", "parts", "jewels"], "PROMO": ["toys"], "LARGE": ["tools"]}
_NOUNS = [w for w, _ in FAMILIES]


def _placed(spark, sf_dir):
    """Titles with a second noun, beside the first or after "with"; shelf families, families mentioned, lead, witness."""
    other = F.element_at(F.array(*map(F.lit, _NOUNS)), (F.col("pid") % 8 + 1).cast("int"))
    title = F.concat_ws(" ", "name", F.when(F.col("pid") % 4 == 0, F.concat(F.lit("with "), other)).when(F.col("pid") % 5 == 0, other))
    rows = products(spark, sf_dir).select("pid", "category", "brand", title.alias("label"))
    shelves = F.create_map(*(x for k, v in _SHELVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    words = F.split(F.regexp_replace("label", " with .*", ""), " ")
    named = taxonomy.families_of(words, _FAMILY_OF)
    rows = rows.select(
        "pid",
        "category",
        "brand",
        taxonomy.collapse_narrower(F.coalesce(shelves[F.col("category")], F.array().cast("array<string>")), _NARROWER).alias("shelf"),
        taxonomy.collapse_narrower(named, _NARROWER).alias("mentioned"),
        F.get(named, F.lit(0)).alias("first"),
    )
    # a lead that is only the parent of something the title also names is no lead
    lead = F.when(F.array_contains("mentioned", F.col("first")), F.col("first"))
    return rows.withColumn("lead", lead).withColumn("family", taxonomy.witness(F.col("shelf"), F.col("mentioned"), F.col("lead")))


def witnessed_family(spark, sf_dir):
    return _placed(spark, sf_dir).select("pid", "lead", "family", F.size("mentioned").alias("n_mentioned"))


_NOUN_FAMILY = "CASE {w} " + " ".join(f"WHEN '{w}' THEN '{f}'" for w, f in FAMILIES) + " END"
_SHELF_SQL = "CASE category WHEN 'STANDARD' THEN ['parts', 'tools'] WHEN 'ECONOMY' THEN ['kitchen'] WHEN 'MEDIUM' THEN ['fasteners', 'jewels'] WHEN 'PROMO' THEN ['toys'] WHEN 'LARGE' THEN ['tools'] ELSE [] END"
_PLACED = f"""t AS (SELECT pid, category, brand, {_NOUN_FAMILY.format(w="string_split(name, ' ')[2]")} AS f1,
        CASE WHEN pid % 4 <> 0 AND pid % 5 = 0 THEN {_NOUN_FAMILY.format(w=f"{_NOUNS!r}[(pid % 8)::INT + 1]")} END AS f2, {_SHELF_SQL} AS shelf FROM product),
    m AS (SELECT *, CASE WHEN f1 = 'parts' AND f2 = 'fasteners' OR f1 = f2 THEN [f2] WHEN f1 = 'fasteners' AND f2 = 'parts' OR f2 IS NULL THEN [f1] ELSE [f1, f2] END AS mentioned FROM t),
    l AS (SELECT *, CASE WHEN list_contains(mentioned, f1) THEN f1 END AS lead, list_filter(mentioned, lambda x: list_contains(shelf, x)) AS common FROM m),
    placed AS (SELECT *, CASE WHEN len(shelf) = 1 THEN CASE WHEN lead IS NOT NULL THEN CASE WHEN lead = shelf[1] THEN lead END WHEN len(common) > 0 THEN shelf[1] END
        WHEN len(shelf) > 1 THEN CASE WHEN len(common) = 1 THEN common[1] WHEN len(common) = 0 THEN lead END
        ELSE coalesce(lead, CASE WHEN len(mentioned) = 1 THEN mentioned[1] END) END AS family FROM l)"""
_WITNESSED = sql("product", f"+{_PLACED} SELECT pid, lead, family, len(mentioned)::INT AS n_mentioned FROM placed")


def rejection_gate(spark, sf_dir):
    """Neighbouring products as candidates: how many are refused for which reason."""
    rows = _placed(spark, sf_dir).select("pid", "family", "brand")
    candidate = rows.select((F.col("pid") - 1).alias("pid"), F.col("family").alias("alt_family"))
    reason = taxonomy.rejection(F.col("family"), F.col("alt_family"), F.col("pid") % 9 == 0)
    strict = taxonomy.compatible(F.col("family"), F.col("alt_family"), False)
    lenient = taxonomy.compatible(F.col("family"), F.col("alt_family"), True)
    return rows.join(candidate, "pid").groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_if(strict).alias("n_strict"), F.count_if(lenient).alias("n_lenient"))


_REJECTED = sql("product", f"""+{_PLACED} SELECT CASE WHEN a.pid % 9 = 0 THEN 'loose source' WHEN a.family IS NULL THEN 'probe undetermined' WHEN b.family IS NULL THEN 'candidate undetermined' WHEN a.family <> b.family THEN 'different family' ELSE 'accepted' END AS reason,
    count(*) AS n, count(*) FILTER (WHERE a.family = b.family) AS n_strict, count(*) FILTER (WHERE coalesce(a.family = b.family, true)) AS n_lenient FROM placed a JOIN placed b ON b.pid = a.pid + 1 GROUP BY 1""")


def origin_split(spark, sf_dir):
    """Where a product is registered, made and owned, where it diverges, and which to show."""
    marked = issuer.classify(products(spark, sf_dir), issuers(spark, sf_dir))
    main = offers(spark, sf_dir).groupBy("pid").agg(F.min_by("source", "oid").alias("sid"))
    makers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("sid"), F.col("n_name").alias("maker"))
    registered = F.when(F.col("kind") == "country", F.col("issuer"))
    rows = marked.join(main, "pid").join(makers, "sid").select("pid", registered.alias("registered"), F.when(F.col("pid") % 2 == 0, F.col("maker")).alias("made"))
    return rows.select("pid", "registered", "made", F.coalesce(F.col("registered") != F.col("made"), F.lit(False)).alias("divergent"), F.coalesce("made", "registered").alias("shown"))


_SPLIT = sql("product issuer offer", f"""+{_DENSE}, f AS (SELECT pid, arg_min(source, oid) AS sid FROM offer GROUP BY 1),
    r AS (SELECT p.pid, CASE WHEN d.kind = 'country' THEN d.issuer END AS registered, CASE WHEN p.pid % 2 = 0 THEN n_name END AS made FROM product p JOIN f USING (pid) JOIN supplier ON s_suppkey = f.sid JOIN nation ON n_nationkey = s_nationkey LEFT JOIN dense d ON number = substr(p.code, 1, 3)::INT)
    SELECT pid, registered, made, coalesce(registered <> made, false) AS divergent, coalesce(made, registered) AS shown FROM r""")


def trusted(marked, said, listed, codes, nonlocal_):
    """Products (pid, code, name, brand, verdict) that an offer (pid, local) says are local and none denies, less five vetoes:

    issuer, code list, brand list, and the words of a non-local brand side by side in the brand or in the name.
    """
    agreed = said.groupBy("pid").agg(F.bool_and("local").alias("local")).where("local <=> true")
    kept = marked.join(agreed, "pid", "left_semi").where("NOT verdict <=> 'FLAGGED'")
    kept = kept.join(listed, "brand", "left_anti").join(codes, "code", "left_anti")
    return brands.without_words(kept, ["brand", "name"], nonlocal_).select("pid", "brand", "verdict")


_CLAIM = "CASE WHEN (pid + source) % 3 = 0 THEN NULL WHEN pid % 4 = 0 THEN true ELSE (pid + source) % 5 <> 0 END"


def trusted_local(spark, sf_dir):
    """Products whose offers by all sources say local without dissent and that nothing vetoes.

    The table has no claims on which all sources of a product agree, so claims are made of product and source: those of
    every fourth product say yes or nothing, those of the others say no in turn.
    """
    marked = issuer.classify(products(spark, sf_dir), issuers(spark, sf_dir))
    flagged = flagged_brands(spark, sf_dir)
    return trusted(marked, offers(spark, sf_dir).selectExpr("pid", f"{_CLAIM} AS local"), flagged.select("brand").distinct(), marked.where("pid % 97 = 0").select("code"), flagged.select(F.col("alias").alias("phrase")))


_TRUSTED = sql("product issuer offer flag", f"""+{_DENSE}, m AS (SELECT p.pid, p.brand, p.name, {_VERDICT} AS verdict FROM product p LEFT JOIN dense ON number = substr(code, 1, 3)::INT),
    s AS (SELECT pid FROM (SELECT pid, {_CLAIM} AS local FROM offer) GROUP BY 1 HAVING bool_and(local)), f AS (SELECT DISTINCT ' ' || trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')) || ' ' AS phrase FROM flag)
    SELECT pid, brand, verdict FROM m WHERE pid IN (SELECT pid FROM s) AND verdict IS DISTINCT FROM 'FLAGGED' AND brand NOT IN (SELECT brand FROM flag) AND pid % 97 <> 0
    AND NOT EXISTS (SELECT 1 FROM f WHERE contains(' ' || trim(regexp_replace(lower(m.brand), '[^a-z0-9]+', ' ', 'g')) || ' ', phrase) OR contains(' ' || trim(regexp_replace(lower(m.name), '[^a-z0-9]+', ' ', 'g')) || ' ', phrase))""")


def attribute_checklist(spark, sf_dir):
    """Wide tri-state attributes of a nation as rows, in order, with the region as source of the known ones."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    used = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.max("c_acctbal").alias("top"), F.count(F.lit(1)).alias("n"))
    wide = n.join(used, "n_nationkey").select(
        "n_name", "r_name", (F.col("n") > 60).alias("large"), F.when(F.col("n_nationkey") % 3 != 0, F.col("top") > 9900).alias("rich"), F.when(F.col("n_nationkey") % 4 == 1, F.lit(True)).alias("near")
    )
    rows = wide.unpivot(["n_name", "r_name"], ["large", "rich", "near"], "attribute", "value")
    return rows.select("n_name", "attribute", "value", F.when(F.col("value").isNotNull(), F.col("r_name")).alias("source"))


_CHECKLIST = """WITH u AS (SELECT c_nationkey, max(c_acctbal) AS top, count(*) AS n FROM customer GROUP BY 1),
    w AS (SELECT n_name, r_name, n > 60 AS large, CASE WHEN n_nationkey % 3 <> 0 THEN top > 9900 END AS rich, CASE WHEN n_nationkey % 4 = 1 THEN true END AS near FROM nation JOIN region ON n_regionkey = r_regionkey JOIN u ON c_nationkey = n_nationkey),
    r AS (SELECT n_name, r_name, 'large' AS attribute, large AS value FROM w UNION ALL SELECT n_name, r_name, 'rich', rich FROM w UNION ALL SELECT n_name, r_name, 'near', near FROM w)
    SELECT n_name, attribute, value, CASE WHEN value IS NOT NULL THEN r_name END AS source FROM r"""


def preflight_flags(spark, sf_dir):
    """Independent warnings on proposed pairs (a product and the next one), counted by combination."""
    marked = issuer.classify(products(spark, sf_dir), issuers(spark, sf_dir)).join(_placed(spark, sf_dir).select("pid", "family"), "pid")
    listed = flagged_brands(spark, sf_dir).select("brand").distinct().withColumn("listed", F.lit(True))
    rows = marked.join(listed, "brand", "left").select("pid", "brand", "verdict", "family", F.coalesce("listed", F.lit(False)).alias("listed"))
    alt = rows.select((F.col("pid") - 1).alias("pid"), *(F.col(c).alias(f"alt_{c}") for c in ("brand", "verdict", "family", "listed")))
    flags = F.concat_ws(
        "+",
        F.when(F.col("brand") == F.col("alt_brand"), "SELF"),
        F.when(F.col("alt_verdict") == "FLAGGED", "ISSUER"),
        F.when(F.col("alt_listed"), "LIST"),
        F.when(F.col("family").isNull() | F.col("alt_family").isNull(), "UNKNOWN").when(F.col("family") != F.col("alt_family"), "FAMILY"),
        F.when(F.col("alt_verdict") != "LOCAL", "NOT-LOCAL"),
    )
    return rows.join(alt, "pid").groupBy(flags.alias("flags")).agg(F.count(F.lit(1)).alias("n"))


_PREFLIGHT = sql("product issuer flag", f"""+{_DENSE}, {_PLACED}, r AS (SELECT p.pid, p.brand, {_VERDICT} AS verdict, x.family, p.brand IN (SELECT brand FROM flag) AS listed FROM product p LEFT JOIN dense ON number = substr(code, 1, 3)::INT JOIN placed x USING (pid))
    SELECT concat_ws('+', CASE WHEN a.brand = b.brand THEN 'SELF' END, CASE WHEN b.verdict = 'FLAGGED' THEN 'ISSUER' END, CASE WHEN b.listed THEN 'LIST' END,
        CASE WHEN a.family IS NULL OR b.family IS NULL THEN 'UNKNOWN' WHEN a.family <> b.family THEN 'FAMILY' END, CASE WHEN b.verdict <> 'LOCAL' THEN 'NOT-LOCAL' END) AS flags, count(*) AS n
    FROM r a JOIN r b ON b.pid = a.pid + 1 GROUP BY 1""")


def case_tally(spark, sf_dir):
    """Products by shelf: placed, open (unplaced though the title names something), unidentified."""
    rows = _placed(spark, sf_dir)
    return rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("total"), F.count("family").alias("matched"), F.count_if(F.col("family").isNull() & (F.size("mentioned") > 0)).alias("open"), F.count_if(F.col("family").isNull() & (F.size("shelf") == 0)).alias("unidentified")
    )


_CASES = sql("product", f"""+{_PLACED} SELECT category, count(*) AS total, count(family) AS matched, count(*) FILTER (WHERE family IS NULL AND len(mentioned) > 0) AS "open", count(*) FILTER (WHERE family IS NULL AND len(shelf) = 0) AS unidentified FROM placed GROUP BY 1""")


def distinct_alternatives(spark, sf_dir):
    """Brands across three kinds of evidence: the strongest kind, and gaps filled from the others."""
    marked = issuer.classify(products(spark, sf_dir), issuers(spark, sf_dir))
    reported = marked.where("verdict = 'LOCAL'").select("brand", F.lit(0).alias("kind"), F.col("issuer").alias("firm"), F.lit(None).cast("string").alias("code"))
    curated = flagged_brands(spark, sf_dir).select("brand", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("firm"), F.lit(None).cast("string").alias("code"))
    catalogue = products(spark, sf_dir).select("brand", F.lit(2).alias("kind"), F.col("category").alias("firm"), "code")
    rows = reported.unionByName(curated).unionByName(catalogue)
    best = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("kind", c)))
    return rows.groupBy("brand").agg(F.min("kind").alias("kind"), best("firm").alias("firm"), best("code").alias("code"), F.count_distinct("kind").alias("n_kinds"))


_DISTINCT = sql("product issuer flag", f"""+{_DENSE}, u AS (SELECT brand, 0 AS kind, issuer AS firm, NULL AS code FROM (SELECT p.brand, d.issuer, {_VERDICT} AS verdict FROM product p LEFT JOIN dense d ON number = substr(code, 1, 3)::INT) WHERE verdict = 'LOCAL'
    UNION ALL SELECT brand, 1, NULL, NULL FROM flag UNION ALL SELECT brand, 2, category, code FROM product)
    SELECT brand, min(kind) AS kind, arg_min(firm, (kind, firm)) FILTER (WHERE firm IS NOT NULL) AS firm, arg_min(code, (kind, code)) FILTER (WHERE code IS NOT NULL) AS code, count(DISTINCT kind) AS n_kinds FROM u GROUP BY 1""")

QUERIES = {f.__name__: f for f in (witnessed_family, rejection_gate, origin_split, trusted_local, attribute_checklist, preflight_flags, case_tally, distinct_alternatives)}
ORACLES = dict(zip(QUERIES, (_WITNESSED, _REJECTED, _SPLIT, _TRUSTED, _CHECKLIST, _PREFLIGHT, _CASES, _DISTINCT), strict=True))
QUERIES["trusted_local_all"] = trusted_local  # its earlier name
ORACLES["trusted_local_all"] = _TRUSTED
