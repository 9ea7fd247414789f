"""The catalogue's tables, read from the star schema; and the same as SQL for DuckDB.

A part is a product, a line item an offer of it by a source, a supplier a store, a nation an issuer of a
range of code prefixes, an event an entry of the public feed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, code, name, brand, category, size, price, title."""
    body = F.expr("concat(lpad(cast((p_partkey * 7919 + 381) % 1000 AS string), 3, '0'), lpad(cast(p_partkey AS string), 9, '0'))")
    title = F.expr(
        """concat(p_name, element_at(array(' 6X1.5L', ' 500Gr', ' 1 KG', ' 0,33L', ' Gr 100 x 4', '', ' 250ml X2', ' kg/PLU.12'),
        cast(p_partkey % 8 AS int) + 1))"""
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pid"),
        codes.with_check_digit(body).alias("code"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("p_size").alias("size"),
        F.round("p_retailprice", 2).alias("price"),
        title.alias("title"),
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, source, price (null for line 7), local (tri-state), oid (a total order), at."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("pid"),
        F.col("l_suppkey").alias("source"),
        F.when(F.col("l_linenumber") != 7, F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100.0).alias("price"),
        F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "N", False).alias("local"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate").alias("oid"),
        F.col("l_shipdate").cast("timestamp").alias("at"),
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, name, chain, city, lat, lng; every 17th store is not on the map."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("sid"),
        F.col("s_name").alias("name"),
        F.expr("concat('chain ', s_suppkey % 12)").alias("chain"),
        F.col("s_nationkey").alias("city"),
        F.expr("IF(s_suppkey % 17 = 0, null, 42.0D + (s_suppkey * 37 % 1000) / 1000.0D)").alias("lat"),
        F.expr("IF(s_suppkey % 17 = 0, null, 20.5D + (s_suppkey * 53 % 1000) / 1000.0D)").alias("lng"),
    )


def issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lo, hi, issuer, kind, stance: every nation issues forty prefixes."""
    return table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") * 40).alias("lo"),
        (F.col("n_nationkey") * 40 + 39).alias("hi"),
        F.col("n_name").alias("issuer"),
        F.expr("CASE n_nationkey % 8 WHEN 7 THEN 'restricted' WHEN 6 THEN 'unassigned' ELSE 'country' END").alias("kind"),
        F.expr("CASE WHEN n_nationkey = 3 THEN 'FLAGGED' WHEN n_nationkey IN (5, 12) THEN 'LOCAL' ELSE 'OTHER' END").alias("stance"),
    )


def flagged_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """brand, alias, ord: every fifth brand, under its own name and without the mark."""
    named = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand")).distinct().withColumn("n", F.expr("cast(substr(brand, 7) AS int)"))
    return named.where("n % 5 = 0").select("brand", F.explode(F.expr("array(lower(brand), concat('brand ', n))")).alias("alias"), F.col("n").alias("ord"))


def _check(body: str) -> str:
    return f"((10 - list_sum(list_transform(range(1, 13), lambda i: substr({body}, i, 1)::INT * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10)::INT::VARCHAR"


def valid_sql(code: str) -> str:
    """DuckDB: whether a string of digits is a valid code."""
    total = f"list_sum(list_transform(range(1, length({code}) + 1), lambda i: substr({code}, (length({code}) - i + 1)::INT, 1)::INT * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END))"
    return f"(length({code}) IN (8, 12, 13, 14) AND {total} % 10 = 0)"


_BODY = "(lpad(((p_partkey * 7919 + 381) % 1000)::VARCHAR, 3, '0') || lpad(p_partkey::VARCHAR, 9, '0'))"
TABLES = {
    "product": f"""SELECT p_partkey AS pid, {_BODY} || {_check(_BODY)} AS code, p_name AS name, p_brand AS brand, p_type AS category,
        p_size AS size, round(p_retailprice, 2) AS price,
        p_name || [' 6X1.5L', ' 500Gr', ' 1 KG', ' 0,33L', ' Gr 100 x 4', '', ' 250ml X2', ' kg/PLU.12'][(p_partkey % 8)::INT + 1] AS title FROM part""",
    "offer": """SELECT l_partkey AS pid, l_suppkey AS source,
        CASE WHEN l_linenumber <> 7 THEN floor(l_extendedprice / l_quantity * 100 + 0.5) / 100.0::DOUBLE END AS price,
        CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS local, l_shipdate AS at_,
        row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS oid FROM lineitem""",
    "store": """SELECT s_suppkey AS sid, s_name AS name, 'chain ' || (s_suppkey % 12) AS chain, s_nationkey AS city,
        CASE WHEN s_suppkey % 17 <> 0 THEN 42.0::DOUBLE + (s_suppkey * 37 % 1000) / 1000.0::DOUBLE END AS lat,
        CASE WHEN s_suppkey % 17 <> 0 THEN 20.5::DOUBLE + (s_suppkey * 53 % 1000) / 1000.0::DOUBLE END AS lng FROM supplier""",
    "issuer": """SELECT n_nationkey * 40 AS lo, n_nationkey * 40 + 39 AS hi, n_name AS issuer,
        CASE n_nationkey % 8 WHEN 7 THEN 'restricted' WHEN 6 THEN 'unassigned' ELSE 'country' END AS kind,
        CASE WHEN n_nationkey = 3 THEN 'FLAGGED' WHEN n_nationkey IN (5, 12) THEN 'LOCAL' ELSE 'OTHER' END AS stance FROM nation""",
    "flag": """SELECT brand, unnest([lower(brand), 'brand ' || n]) AS alias, n AS ord FROM
        (SELECT DISTINCT p_brand AS brand, substr(p_brand, 7)::INT AS n FROM part) WHERE n % 5 = 0""",
}


def sql(names: str, body: str) -> str:
    """``body`` with the named tables above (space separated) defined before it; ``body`` may begin with further ones."""
    ctes = ", ".join(f"{n} AS ({TABLES[n]})" for n in names.split())
    body = body.strip()
    return f"WITH {ctes}{', ' + body[1:] if body.startswith('+') else ' ' + body}"
