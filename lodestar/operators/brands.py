"""Brand and phrase joins: substring tests turned into equi-joins on words and word runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def lengths_of(phrases: DataFrame) -> list[int]:
    """How many words phrases have: word runs of these lengths alone can meet one, so a single long phrase adds one length."""
    return sorted(phrases.agg(F.collect_set(F.size(F.split("phrase", " ")))).first()[0])


def word_runs(title: str, lengths: list[int]):
    """Array of (phrase, start, n) for every run of n words of a column's key, n being one of ``lengths``."""
    words = F.split(text.key(F.col(title)), " ")

    def of_length(n: int):
        return F.transform(words, lambda _, i: F.struct(F.array_join(F.slice(words, i + 1, F.lit(n)), " ").alias("phrase"), i.alias("start"), F.lit(n).alias("n")))

    runs = [of_length(n) for n in lengths or [1]]
    return F.filter(F.concat(*runs), lambda r: F.size(F.split(r["phrase"], " ")) == r["n"])


def phrase_match(rows: DataFrame, key: str, title: str, aliases: DataFrame, lead_below: int = 6) -> DataFrame:
    """The alias that a title holds: longest first, then ``ord``; short aliases must lead the title.

    Titles are exploded into word runs and joined by equality; ``aliases`` has alias, brand, ord.
    """
    named = aliases.select(text.key(F.col("alias")).alias("phrase"), "brand", "ord").where("phrase <> ''")
    runs = rows.select(key, F.explode(word_runs(title, lengths_of(named))).alias("r")).select(key, "r.phrase", "r.start")
    hits = runs.join(named, "phrase").where((F.length("phrase") >= lead_below) | (F.col("start") == 0))
    best = F.min_by(F.struct("phrase", "brand"), F.struct(-F.length("phrase"), "ord", "phrase", "start"))
    return hits.groupBy(key).agg(best.alias("b"), F.count_distinct("brand").alias("n_brands")).select(key, "b.phrase", "b.brand", "n_brands")


def without_words(rows: DataFrame, columns: list[str], phrases: DataFrame) -> DataFrame:
    """``rows`` of which no column holds the words of a phrase side by side; ``phrases`` has phrase."""
    named = phrases.select(text.key(F.col("phrase")).alias("phrase")).where("phrase <> ''").distinct()
    lengths = lengths_of(named)
    for c in columns:
        vetoed = rows.select(c).distinct().select(F.col(c).alias("held"), F.explode(word_runs(c, lengths)).alias("r")).join(named, F.col("r.phrase") == named.phrase, "left_semi")
        rows = rows.join(vetoed.select("held").distinct(), F.col(c) == F.col("held"), "left_anti")
    return rows


def token_match(rows: DataFrame, key: str, brands: str, aliases: DataFrame) -> DataFrame:
    """The first token of a comma list that is an alias, then the alias of smallest ``ord``."""
    tokens = rows.select(key, F.posexplode(F.split(brands, ",")).alias("pos", "token")).withColumn("alias", F.trim(F.lower("token")))
    hits = tokens.join(aliases.select(F.lower("alias").alias("alias"), "brand", "ord"), "alias")
    return hits.groupBy(key).agg(F.min_by(F.struct("alias", "brand"), F.struct("pos", "ord", "alias")).alias("b")).select(key, "b.alias", "b.brand")


def precedence(sources: list[DataFrame]) -> DataFrame:
    """(name, value) of the first source in the list that has the name; ties by value."""
    ranked = [s.select("name", "value", F.lit(i).alias("rank")) for i, s in enumerate(sources)]
    union = ranked[0]
    for r in ranked[1:]:
        union = union.unionByName(r)
    return union.groupBy("name").agg(F.min_by(F.struct("value", "rank"), F.struct("rank", "value")).alias("b")).select("name", "b.value", "b.rank")
