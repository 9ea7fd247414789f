"""Temporal URL filter lists, in DataFrame expressions only.

Method.  A list's dated entries (pattern, category, action, date) become validity intervals: an entry that
adds a pattern holds from its date to the next entry of the same pattern and category.  A pattern is a host,
which matches itself and the hosts under it, or a host and the start of a path ("x.org/ads"), which matches
that host's captures whose path begins with those whole segments.  A capture is judged against the entries
whose interval holds at the time of the fetch.

Scale.  Only distinct (host, fetch date) pairs are matched with host patterns, and only captures of hosts
that have a path pattern with those: they are pre-aggregated before any shuffle, so a host with a third of
all captures counts once a day.  Patterns join by equality of domain suffixes and path prefixes (no range
join over all pairs), and the verdicts return to the captures by equi-joins that adaptive execution can
split.  Nothing is broadcast by hand.

Defined results: a null or malformed URL has a null host and is not blocked; letters of hosts and dots after
them make no difference; an IP address matches itself alone; entries that share a date are taken removal
first; repeated rows and rows with a null id are each judged; empty tables give no verdicts; other columns
stay out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts that the captures of a host are dealt out in where they meet the list of hosts with path patterns.
SALTS = 32
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:\[]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
ADDRESS = r"^([0-9.]+|\[.*)$"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def host_of(url: str) -> str:
    return f"nullif(trim(TRAILING '.' FROM regexp_extract(lower({url}), {_q(HOST)}, 1)), '')"


def path_of(url: str) -> str:
    """SQL: the segments of a path, without empty ones."""
    return f"filter(split(regexp_extract({url}, {_q(PATH)}, 1), '/'), x -> x <> '')"


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, since, until) from dated entries (pattern, category, action, at); until null: still active."""
    host, path = "trim(TRAILING '.' FROM lower(substring_index(pattern, '/', 1)))", "filter(slice(split(pattern, '/'), 2, size(split(pattern, '/'))), x -> x <> '')"
    named = entries.withColumn("pattern", F.expr(f"array_join(concat(array({host}), {path}), '/')"))
    order = Window.partitionBy("pattern", "category").orderBy("at", F.expr("action = 'add'"))
    dated = named.withColumn("until", F.lead("at").over(order))
    return dated.where("action = 'add' AND (until IS NULL OR until > at)").select("pattern", "category", F.col("at").alias("since"), "until")


def _verdicts(keys: DataFrame, names: list[str], patterns: str, active: DataFrame, kind: str) -> DataFrame:
    """Best entry and number of entries for each key, whose candidate patterns are given as SQL."""
    exploded = keys.select(*names, F.explode(F.expr(patterns)).alias("pattern"))
    hits = exploded.join(active, "pattern").where("since <= fetched_on AND (until IS NULL OR fetched_on < until)")
    best = F.min(F.struct((-F.length("pattern")).alias("l"), "category", "pattern"))
    return hits.groupBy(*names).agg(best.alias(f"{kind}_best"), F.count(F.lit(1)).alias(f"{kind}_n"))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, fetched_on, blocked, pattern, category, n_active for captures (page_id, url, fetched_on)."""
    seen = captures.select("page_id", F.expr(host_of("url")).alias("host"), F.expr(path_of("url")).alias("path"), "fetched_on")
    active = intervals(entries)
    hosts, paths = active.where("NOT contains(pattern, '/')"), active.where("contains(pattern, '/')")
    suffixes = f"""IF(host rlike {_q(ADDRESS)}, array(host), transform(sequence(1, greatest(size(split(host, '[.]')) - 1, 1)),
        i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.')))"""
    of_host = _verdicts(seen.where("host IS NOT NULL").select("host", "fetched_on").distinct(), ["host", "fetched_on"], suffixes, hosts, "host")
    # a host with a third of all captures meets the list in many tasks
    listed = paths.select(F.substring_index("pattern", "/", 1).alias("host")).distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = seen.where("host IS NOT NULL AND size(path) > 0").withColumn("salt", F.pmod(F.xxhash64("path", "fetched_on"), F.lit(SALTS)).cast("int"))
    keys = salted.join(listed, ["host", "salt"], "left_semi").select("host", "path", "fetched_on").distinct()
    prefixes = "transform(sequence(1, size(path)), i -> concat(host, '/', array_join(slice(path, 1, i), '/')))"
    of_path = _verdicts(keys, ["host", "path", "fetched_on"], prefixes, paths, "path")
    both = seen.join(of_host, ["host", "fetched_on"], "left").join(of_path, ["host", "path", "fetched_on"], "left")
    n, best = F.coalesce("host_n", F.lit(0)) + F.coalesce("path_n", F.lit(0)), F.least("host_best", "path_best")
    return both.select("page_id", "host", "fetched_on", (n > 0).alias("blocked"), best["pattern"].alias("pattern"), best["category"].alias("category"), n.cast("bigint").alias("n_active"))


# The test tables have no list and no fetch dates; both are derived from the pages themselves.
_DAY = "cast(date_add(DATE'2024-01-01', cast(pmod({0}, 365) AS int)) AS date)"


def _entries(pages: DataFrame) -> DataFrame:
    hosts = pages.select(F.expr(host_of("url")).alias("host"), F.expr(path_of("url")).alias("path")).where("host IS NOT NULL")
    parents = hosts.select(F.expr("array_join(slice(split(host, '[.]'), greatest(size(split(host, '[.]')) - 2, 1), size(split(host, '[.]'))), '.')").alias("host"))
    starts = hosts.where("size(path) > 0").select(F.expr("concat(host, '/', path[0])").alias("host"))
    named = hosts.select("host").union(parents).union(starts).distinct().withColumn("h", F.expr("cast(conv(substr(md5(host), 1, 4), 16, 10) AS int)")).where("h % 3 = 0")
    events = """array(
        named_struct('action', 'add', 'day', h % 200),
        named_struct('action', 'remove', 'day', h % 200 + 30 + h % 90),
        named_struct('action', IF(h % 5 = 0, 'add', 'remove'), 'day', h % 200 + 60 + h % 90))"""
    rows = named.select("host", "h", F.explode(F.expr(events)).alias("e"))
    return rows.select(
        F.col("host").alias("pattern"),
        F.expr("element_at(array('adult', 'spam', 'malware', 'gambling'), h % 4 + 1)").alias("category"),
        F.col("e.action").alias("action"),
        F.expr(_DAY.format("e.day")).alias("at"),
    )


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.expr(_DAY.format("page_id * 37")))
    return judge(captures, _entries(pages))


ORACLE = f"""
WITH seen AS (
    SELECT page_id, nullif(rtrim(regexp_extract(lower(url), '{HOST}', 1), '.'), '') AS host,
           list_filter(string_split(regexp_extract(url, '{PATH}', 1), '/'), lambda x: x <> '') AS path,
           DATE '2024-01-01' + ((page_id * 37) % 365)::INT AS fetched_on FROM pages),
hosts AS (SELECT DISTINCT host FROM seen WHERE host IS NOT NULL),
named AS (
    SELECT host, ('0x' || substr(md5(host), 1, 4))::INT AS h FROM (
        SELECT host FROM hosts
        UNION SELECT array_to_string(string_split(host, '.')[greatest(len(string_split(host, '.')) - 2, 1):], '.') FROM hosts
        UNION SELECT host || '/' || path[1] FROM seen WHERE host IS NOT NULL AND len(path) > 0)),
events AS (
    SELECT host, h, 'add' AS action, h % 200 AS day FROM named WHERE h % 3 = 0
    UNION ALL SELECT host, h, 'remove', h % 200 + 30 + h % 90 FROM named WHERE h % 3 = 0
    UNION ALL SELECT host, h, CASE WHEN h % 5 = 0 THEN 'add' ELSE 'remove' END, h % 200 + 60 + h % 90 FROM named WHERE h % 3 = 0),
dated AS (
    SELECT host AS pattern, ['adult', 'spam', 'malware', 'gambling'][h % 4 + 1] AS category, action,
           DATE '2024-01-01' + (day % 365)::INT AS dated_on FROM events),
spans AS (
    SELECT *, lead(dated_on) OVER (PARTITION BY pattern, category ORDER BY dated_on, action = 'add') AS until FROM dated),
valid AS (SELECT pattern, category, dated_on AS since, until FROM spans WHERE action = 'add' AND (until IS NULL OR until > dated_on)),
tried AS (
    SELECT page_id, host, fetched_on, array_to_string(string_split(host, '.')[i:], '.') AS pattern
    FROM (SELECT *, unnest(CASE WHEN regexp_matches(host, '{ADDRESS}') THEN [1] ELSE range(1, greatest(len(string_split(host, '.')), 2)) END) AS i FROM seen WHERE host IS NOT NULL)
    UNION ALL SELECT page_id, host, fetched_on, host || '/' || array_to_string(path[1:i], '/')
    FROM (SELECT *, unnest(range(1, len(path) + 1)) AS i FROM seen WHERE host IS NOT NULL)),
active AS (
    SELECT s.page_id, v.pattern, v.category,
           row_number() OVER (PARTITION BY s.page_id ORDER BY length(v.pattern) DESC, v.category, v.pattern) AS r,
           count(*) OVER (PARTITION BY s.page_id) AS n
    FROM tried s JOIN valid v ON s.pattern = v.pattern AND v.since <= s.fetched_on AND (v.until IS NULL OR s.fetched_on < v.until))
SELECT s.page_id, s.host, s.fetched_on::DATE AS fetched_on, a.n IS NOT NULL AS blocked, a.pattern, a.category,
       coalesce(a.n, 0)::BIGINT AS n_active
FROM seen s LEFT JOIN (SELECT * FROM active WHERE r = 1) a USING (page_id)"""
