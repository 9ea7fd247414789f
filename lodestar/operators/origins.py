"""Where a product comes from: curated names, codes that override them, and brands in titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .brands import lengths_of, word_runs

#: Shorter names are no evidence inside a title, and names below the second bound only where they lead it.
LEAST_NAME, LEAST_ANYWHERE = 3, 6


def _runs(rows: DataFrame, column: str, lengths: list[int]) -> DataFrame:
    return rows.select("*", F.explode(word_runs(column, lengths)).alias("r_")).withColumn("phrase", F.col("r_.phrase")).drop("r_")


def brand_entry(rows: DataFrame, key: str, brand: str, entries: DataFrame) -> DataFrame:
    """(key, entry, exact): the entry of a comma list of brands; ``entries`` has entry, ord, name (one row a name).

    A name that is one of the brands decides, first entry first; else the longest name whose words stand side
    by side in a brand, or that holds a brand so.  Both directions are equi-joins on word runs.
    """
    parts = rows.select(key, F.explode(F.split(F.concat_ws(",", brand), ",")).alias("part")).withColumn("part", text.key(F.col("part"))).where("part <> ''").distinct()
    names = entries.select("entry", "ord", text.key(F.col("name")).alias("name")).where("name <> ''")
    inside = _runs(parts, "part", lengths_of(names.select(F.col("name").alias("phrase")))).join(names, F.col("phrase") == F.col("name"))
    brands = parts.select(F.col("part").alias("phrase")).distinct()
    around = _runs(names, "name", lengths_of(brands)).join(parts, F.col("phrase") == F.col("part"))
    columns = [key, "entry", "ord", "name", (F.col("part") == F.col("name")).alias("exact")]
    hits = inside.select(*columns).unionByName(around.select(*columns))
    order = F.struct(~F.col("exact"), F.when(F.col("exact"), 0).otherwise(-F.length("name")), "ord", "name")
    return hits.groupBy(key).agg(F.min_by(F.struct("entry", "exact"), order).alias("b")).select(key, "b.entry", "b.exact")


def verified_origin(rows: DataFrame, key: str, entries: DataFrame, facts: DataFrame, codes: DataFrame) -> DataFrame:
    """(key, entry, exact, verified, by_code, facts): a code's own brand outranks the brand column.

    ``rows``: key, code, brand; ``facts``: entry, verified and what is known of it; ``codes``: code, brand, verified.
    """
    own = codes.select("code", F.col("brand").alias("code_brand"), F.col("verified").alias("code_verified"), F.lit(True).alias("by_code")).dropDuplicates(["code"])
    known = rows.select(key, F.trim("code").alias("code"), "brand").join(own, "code", "left")
    asked = known.select(key, F.coalesce("code_brand", "brand").alias("brand"), "code_verified", F.coalesce("by_code", F.lit(False)).alias("by_code"))
    found = asked.drop("brand").join(brand_entry(asked, key, "brand", entries), key).join(facts, "entry")
    return found.withColumn("verified", F.col("verified").eqNullSafe(True) & F.coalesce("code_verified", F.lit(True))).drop("code_verified")


def _title_origin(hits: Column) -> Column:
    """The longest name's origin, or null where a name that is no part of it says another."""
    first = F.get(F.array_sort(hits), F.lit(0))
    other = F.exists(hits, lambda h: (h["iso"] != first["iso"]) & ~first["name"].contains(h["name"]))
    return F.when(~other, first)


def title_origin(rows: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """(key, iso, basis) by the brand column, else by names in the title; ``rows``: key, brand, title; ``index``: name, iso.

    Conflicting names in a title give no origin, unless the longest holds the other.
    """
    names = index.select(text.key(F.col("name")).alias("name"), "iso").where("name <> ''").dropDuplicates(["name"])
    direct = rows.select(key, text.key(F.col("brand")).alias("name")).join(names, "name").select(key, "iso", F.lit("brand").alias("basis"))
    rest = rows.select(key, "title").join(direct, key, "left_anti")
    long = names.where(F.length("name") >= LEAST_NAME)
    titles = rest.select(key, F.explode(word_runs("title", lengths_of(long.select(F.col("name").alias("phrase"))))).alias("r_"))
    found = titles.join(long, F.col("r_.phrase") == F.col("name")).where((F.length("name") >= LEAST_ANYWHERE) | (F.col("r_.start") == 0))
    # a title holds no more names than word runs
    hits = found.groupBy(key).agg(F.collect_set(F.struct((-F.length("name")).alias("l"), "name", "iso")).alias("hits"))
    said = hits.select(key, _title_origin(F.col("hits")).alias("o")).where("o IS NOT NULL").select(key, F.col("o.iso").alias("iso"), F.lit("title").alias("basis"))
    return direct.unionByName(said)
