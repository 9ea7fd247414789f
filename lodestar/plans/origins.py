"""Origins by brand, code and title, bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import key as text_key
from ..operators import issuer, origins
from ..sources.catalogue import issuers, products, sql, table
from .catalogue import _DENSE, _VERDICT


def entries(spark, sf_dir):
    """Two names of every third brand: "Brand 12" and "Brand 12 Foods Company", in order of their numbers."""
    named = table(spark, sf_dir, "part").select(F.col("p_brand").alias("entry")).distinct().withColumn("ord", F.expr("cast(substr(entry, 7) AS int)")).where("ord % 3 <> 0")
    return named.select("entry", "ord", F.explode(F.expr("array(concat('Brand ', ord), concat('Brand ', ord, ' Foods Company'))")).alias("name"))


def _facts(spark, sf_dir):
    """Country and firm of an entry, by its number."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("made_in"))
    own = entries(spark, sf_dir).select("entry", "ord").distinct()
    return own.join(n, F.col("ord") % 25 == F.col("n_nationkey")).select("entry", "made_in", (F.col("ord") % 4 != 0).alias("verified"))


_ENTRIES = """entry AS (SELECT entry, ord, unnest(['brand ' || ord, 'brand ' || ord || ' foods company']) AS name FROM
        (SELECT DISTINCT p_brand AS entry, substr(p_brand, 7)::INT AS ord FROM part) WHERE ord % 3 <> 0),
    fact AS (SELECT DISTINCT entry, n_name AS made_in, ord % 4 <> 0 AS verified FROM entry JOIN nation ON ord % 25 = n_nationkey)"""


def _asked(spark, sf_dir):
    """Brand lists of products: an own brand, a longer form of it, a stranger's with a known one inside, nothing."""
    shown = F.expr("""CASE pid % 5 WHEN 0 THEN brand WHEN 1 THEN concat('Foods Company, ', brand, ' FOODS') WHEN 2 THEN concat('The new ', brand, ' foods company!') WHEN 3 THEN 'Foods Company' END""")
    return products(spark, sf_dir).select("pid", "code", F.regexp_replace(shown, "#", " ").alias("brand"))


_ASKED = """asked AS (SELECT pid, code, lower(CASE pid % 5 WHEN 0 THEN brand WHEN 1 THEN 'Foods Company, ' || brand || ' FOODS' WHEN 2 THEN 'The new ' || brand || ' foods company!' WHEN 3 THEN 'Foods Company' END) AS shown FROM product),
    part_of AS (SELECT pid, trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g')) AS part FROM (SELECT pid, unnest(string_split({shown}, ',')) AS p FROM {asked})),
    hit AS (SELECT pid, entry, ord, name, part = name AS exact FROM part_of JOIN entry ON contains(' ' || part || ' ', ' ' || name || ' ') OR contains(' ' || name || ' ', ' ' || part || ' ') WHERE part <> ''),
    best AS (SELECT pid, arg_min({{'e': entry, 'x': exact}}, (NOT exact, CASE WHEN exact THEN 0 ELSE -length(name) END, ord, name)) AS b FROM hit GROUP BY 1)"""


def longest_brand_origin(spark, sf_dir):
    """The origin entry of a product's brand list: an exact name, else the longest containing or contained one."""
    return origins.brand_entry(_asked(spark, sf_dir), "pid", "brand", entries(spark, sf_dir))


_LONGEST = sql("product", f"+{_ENTRIES}, {_ASKED.format(shown='shown', asked='asked')} SELECT pid, b.e AS entry, b.x AS exact FROM best")


def verified_origins(spark, sf_dir):
    """The same where a code of its own names the brand, with country and whether both are verified."""
    codes = products(spark, sf_dir).where("pid % 7 = 0").select("code", F.expr("concat('Brand ', 1 + pid % 25)").alias("brand"), (F.col("pid") % 2 == 0).alias("verified"))
    return origins.verified_origin(_asked(spark, sf_dir), "pid", entries(spark, sf_dir), _facts(spark, sf_dir), codes)


_OWN = _ASKED.format(shown="shown", asked="(SELECT pid, CASE WHEN pid % 7 = 0 THEN 'brand ' || (1 + pid % 25) ELSE shown END AS shown FROM asked)")
_VERIFIED = sql("product", f"""+{_ENTRIES}, {_OWN} SELECT pid, b.e AS entry, b.x AS exact, made_in, pid % 7 = 0 AS by_code,
    verified AND (pid % 7 <> 0 OR pid % 2 = 0) AS verified FROM best JOIN fact ON fact.entry = b.e""")


def _titles(spark, sf_dir):
    """Titles with no brand, one, a short one that leads or not, or two; a brand column on every ninth."""
    title = F.expr("""concat_ws(' ', IF(pid % 6 = 1, 'Zed', null), name, CASE pid % 6 WHEN 2 THEN 'brand 4' WHEN 3 THEN 'brand 4 brand 14' WHEN 4 THEN 'zed' WHEN 5 THEN concat('brand ', pid % 25, ' foods company') END)""")
    return products(spark, sf_dir).select("pid", F.when(F.col("pid") % 9 == 0, F.regexp_replace("brand", "#", " ")).alias("brand"), title.alias("title"))


def _index(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("iso"))
    known = entries(spark, sf_dir).join(n, (F.col("ord") + F.length("name")) % 25 == F.col("n_nationkey")).select("name", "iso")
    return known.unionByName(n.where("n_nationkey = 7").select(F.lit("Zed").alias("name"), "iso"))


def title_origins(spark, sf_dir):
    """Origin by the brand column, else by brands in the title; conflicts give none."""
    return origins.title_origin(_titles(spark, sf_dir), "pid", _index(spark, sf_dir))


_TITLES = sql("product", f"""+{_ENTRIES}, ix AS (SELECT name, n_name AS iso FROM entry JOIN nation ON (ord + length(name)) % 25 = n_nationkey UNION ALL SELECT 'zed', n_name FROM nation WHERE n_nationkey = 7),
    t AS (SELECT pid, CASE WHEN pid % 9 = 0 THEN lower(replace(brand, '#', ' ')) END AS brand, concat_ws(' ', CASE WHEN pid % 6 = 1 THEN 'zed' END, name, CASE pid % 6 WHEN 2 THEN 'brand 4' WHEN 3 THEN 'brand 4 brand 14' WHEN 4 THEN 'zed' WHEN 5 THEN 'brand ' || (pid % 25) || ' foods company' END) AS title FROM product),
    d AS (SELECT pid, iso, 'brand' AS basis FROM t JOIN ix ON t.brand = ix.name),
    h AS (SELECT pid, name, iso, row_number() OVER (PARTITION BY pid ORDER BY length(name) DESC, name) AS r FROM t JOIN ix ON contains(' ' || title || ' ', ' ' || name || ' ') AND (length(name) >= 6 OR starts_with(title || ' ', name || ' ')) WHERE pid NOT IN (SELECT pid FROM d))
    SELECT * FROM d UNION ALL SELECT pid, iso, 'title' FROM h f WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM h o WHERE o.pid = f.pid AND o.iso <> f.iso AND NOT contains(f.name, o.name))""")


def nation_codes(spark, sf_dir):
    """Two-letter codes of nations named in any letters or by their code, from the names of suppliers' nations."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.expr("concat(left(n_name, 1), right(n_name, 1))").alias("iso"))
    said = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    shown = F.expr("CASE s_suppkey % 3 WHEN 0 THEN concat(' ', initcap(n_name), '.') WHEN 1 THEN lower(concat(left(n_name, 1), right(n_name, 1))) ELSE 'Nowhere' END")
    rows = said.select("s_suppkey", shown.alias("country"))
    keyed = n.select(text_key(F.col("name")).alias("k"), "iso").union(n.select(F.lower("iso"), "iso")).groupBy("k").agg(F.min("iso").alias("iso"))
    return rows.withColumn("k", text_key(F.col("country"))).join(keyed, "k", "left").select("s_suppkey", "iso")


_NATIONS = """WITH n AS (SELECT lower(n_name) AS k, left(n_name, 1) || right(n_name, 1) AS iso FROM nation UNION ALL SELECT lower(left(n_name, 1) || right(n_name, 1)), left(n_name, 1) || right(n_name, 1) FROM nation),
    m AS (SELECT k, min(iso) AS iso FROM n GROUP BY 1)
    SELECT s_suppkey, iso FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN lower(left(n_name, 1) || right(n_name, 1)) ELSE 'nowhere' END AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey) LEFT JOIN m USING (k)"""


def ownership_split(spark, sf_dir):
    """Registered, made and owned by whom, with what to show and which of the three differ."""
    marked = issuer.classify(products(spark, sf_dir), issuers(spark, sf_dir)).select("pid", "verdict", F.when(F.col("kind") == "country", F.col("issuer")).alias("registered"))
    made = verified_origins(spark, sf_dir).select("pid", F.when(F.col("verified"), F.col("made_in")).alias("made"), "entry")
    owner = _facts(spark, sf_dir).select("entry", F.when(F.length("made_in") % 2 == 0, F.upper(F.reverse("made_in"))).alias("owned"))
    rows = marked.join(made, "pid", "left").join(owner, "entry", "left")
    differs = F.concat_ws("+", F.when(F.col("made") != F.col("registered"), "made"), F.when(F.col("owned").isNotNull(), "owned"))
    return rows.select("pid", "registered", "made", "owned", differs.alias("differs"), F.coalesce("made", "registered").alias("shown"))


_OWNED = sql("product issuer", f"""+{_DENSE}, v AS ({_VERIFIED}), f2 AS (SELECT DISTINCT entry, CASE WHEN length(made_in) % 2 = 0 THEN upper(reverse(made_in)) END AS owned FROM v),
    r AS (SELECT p.pid, CASE WHEN d.kind = 'country' THEN d.issuer END AS registered, CASE WHEN v.verified THEN v.made_in END AS made, f2.owned
        FROM product p LEFT JOIN dense d ON number = substr(p.code, 1, 3)::INT LEFT JOIN v USING (pid) LEFT JOIN f2 ON f2.entry = v.entry)
    SELECT pid, registered, made, owned, concat_ws('+', CASE WHEN made <> registered THEN 'made' END, CASE WHEN owned IS NOT NULL THEN 'owned' END) AS differs, coalesce(made, registered) AS shown FROM r""")

QUERIES = {f.__name__: f for f in (longest_brand_origin, verified_origins, title_origins, nation_codes, ownership_split)}
ORACLES = dict(zip(QUERIES, (_LONGEST, _VERIFIED, _TITLES, _NATIONS, _OWNED), strict=True))
