"""Curated pairings: the entry of a scanned product by brand, tags or category, and the answers that follow.

An entry (entry, ord, brand, category, tags, families) says which brands may replace another; ``ord`` is its
place in the curated table, and where several fit, the first does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .brands import lengths_of, word_runs


def category_key(value: Column) -> Column:
    """Lower case, white space and underscores as hyphens."""
    return F.regexp_replace(F.trim(F.lower(value)), r"[\s_]+", "-")


def by_brand(rows: DataFrame, key: str, brands: str, entries: DataFrame) -> DataFrame:
    """Every (key, entry, ord) whose brand holds, or lies in, one of a comma list's brands, by whole words."""
    parts = rows.select(key, F.explode(F.split(brands, ",")).alias("part")).select(key, text.key(F.col("part")).alias("part")).where("part <> ''").distinct()
    named = entries.select("entry", "ord", text.key(F.col("brand")).alias("named")).where("named <> ''")
    run = lambda df, c, lengths: df.select("*", F.explode(word_runs(c, lengths)).alias("r_"))
    inside = run(parts, "part", lengths_of(named.select(F.col("named").alias("phrase")))).join(named, F.col("r_.phrase") == F.col("named"))
    asked = parts.select(F.col("part").alias("phrase")).distinct()
    around = run(named, "named", lengths_of(asked)).join(parts, F.col("r_.phrase") == F.col("part"))
    return inside.select(key, "entry", "ord").unionByName(around.select(key, "entry", "ord")).distinct()


def pick(rows: DataFrame, key: str, entries: DataFrame) -> DataFrame:
    """(key, entry, via) of the one entry of a scan: rows have key, brands, family, hint, hint_family.

    Among entries of the brand: with a family, one that has it, else one without any; without a family, the
    entry whose category the hint names, else one of the hint's family, else one that a long word of the hint
    is in, and without a hint the only entry there is.
    """
    hits = by_brand(rows, key, "brands", entries).join(entries.select("entry", "category", "families"), "entry")
    hits = hits.join(rows.select(key, "family", category_key(F.col("hint")).alias("hint"), "hint_family"), key)
    only = hits.groupBy(key).agg(F.count(F.lit(1)).alias("n_"))
    hits = hits.join(only, key)
    long = F.filter(F.split("hint", "-"), lambda w: F.length(w) > 3)
    category = category_key(F.col("category"))
    via = (
        F.when(F.col("family").isNotNull(), F.when(F.array_contains("families", F.col("family")), "1 family").when(F.size("families") == 0, "2 open"))
        .when(F.col("hint").isNull(), F.when(F.col("n_") == 1, "1 only"))
        .when(category == F.col("hint"), "1 hint")
        .when(F.array_contains("families", F.col("hint_family")), "2 hint family")
        .when(F.exists(long, lambda w: category.contains(w)), "3 hint word")
    )
    ranked = hits.withColumn("via", via).where("via IS NOT NULL")
    return ranked.groupBy(key).agg(F.min_by(F.struct("entry", "via"), F.struct("via", "ord")).alias("b")).select(key, "b.entry", "b.via")


def by_tags(rows: DataFrame, key: str, entries: DataFrame, generic: list[str]) -> DataFrame:
    """(key, entry, via): the first entry of the row's family that shares a tag, else the first of that family alone.

    Rows have key, tags, family; generic tags match nothing.
    """
    matchable = ~F.col("tag").isin(generic) & F.col("tag").isNotNull()
    tags = rows.where("family IS NOT NULL").select(key, "family", F.explode("tags").alias("tag")).where(matchable)
    known = entries.select("entry", "ord", "families", F.explode("tags").alias("tag")).where(matchable)
    shared = tags.join(known, "tag").where(F.get("families", F.lit(0)) == F.col("family")).select(key, "entry", "ord", F.lit("1 tag").alias("via"))
    alone = entries.where("size(families) = 1").select(F.col("families")[0].alias("family"), "entry", "ord")
    first = alone.groupBy("family").agg(F.min_by(F.struct("entry", "ord"), "ord").alias("e")).select("family", "e.entry", "e.ord")
    family = rows.where(F.exists("tags", lambda t: ~t.isin(generic))).join(first, "family").select(key, "entry", "ord", F.lit("2 family").alias("via"))
    hits = shared.unionByName(family)
    return hits.groupBy(key).agg(F.min_by(F.struct("entry", "via"), F.struct("via", "ord")).alias("b")).select(key, "b.entry", "b.via")


def by_category(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Every (category, entry, ord) whose own category it is or one of whose tags has it as whole words."""
    asked = keys.select("category", text.key(F.col("category")).alias("k")).where("k <> ''").distinct()
    own = entries.select("entry", "ord", text.key(F.col("category")).alias("k"))
    tags = entries.select("entry", "ord", F.explode("tags").alias("tag"))
    runs = tags.select("entry", "ord", F.explode(word_runs("tag", lengths_of(asked.select(F.col("k").alias("phrase"))))).alias("r_")).select("entry", "ord", F.col("r_.phrase").alias("k"))
    return asked.join(own.unionByName(runs).distinct(), "k").select("category", "entry", "ord")


def brand_in_title(rows: DataFrame, key: str, title: str, vocabulary: DataFrame) -> DataFrame:
    """(key, brand): the one brand that a title names, or the longest where it holds all the others; else none.

    ``vocabulary`` has brand.
    """
    named = vocabulary.select("brand", text.key(F.col("brand")).alias("phrase")).where("phrase <> ''").dropDuplicates(["phrase"])
    runs = rows.select(key, F.explode(word_runs(title, lengths_of(named))).alias("r_")).select(key, F.col("r_.phrase").alias("phrase"))
    hits = runs.join(named, "phrase").groupBy(key).agg(F.collect_set(F.struct((-F.length("phrase")).alias("l"), "phrase", "brand")).alias("hits"))
    first = F.get(F.array_sort("hits"), F.lit(0))
    return hits.where(F.forall("hits", lambda h: first["phrase"].contains(h["phrase"]))).select(key, first["brand"].alias("brand"))
