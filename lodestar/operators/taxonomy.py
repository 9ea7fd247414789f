"""Families from evidence: a shelf and a title must agree before a product is placed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .joins import grown, rule_table


def collapse_narrower(families: Column, narrower: dict[str, str]) -> Column:
    """Drops the parent of every narrow family that is there."""
    for narrow, parent in narrower.items():
        families = F.when(F.array_contains(families, narrow), F.array_except(families, F.array(F.lit(parent)))).otherwise(families)
    return families


def families_of(words: Column, family_of: dict[str, str]) -> Column:
    """Distinct families of words, in order of the words."""
    spec = F.create_map(*(F.lit(x) for k, v in family_of.items() for x in (k, v)))
    return F.array_distinct(F.filter(F.transform(words, lambda w: spec[w]), lambda f: f.isNotNull()))


def witness(shelf: Column, mentioned: Column, lead: Column) -> Column:
    """One family that shelf and title allow, or null.

    A shelf of one family needs the title's lead to agree; a shelf of several needs exactly one of them in
    the title, or none and a lead; without a shelf the lead or the only family mentioned decides.
    """
    both = F.array_intersect(shelf, mentioned)
    only = lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0)))
    one = F.when(lead.isNotNull(), F.when(lead == F.get(shelf, F.lit(0)), lead)).when((F.size(mentioned) == 0) | (F.size(both) > 0), F.get(shelf, F.lit(0)))
    several = F.when(F.size(both) > 0, only(both)).otherwise(lead)
    return F.when(F.size(shelf) == 1, one).when(F.size(shelf) > 1, several).otherwise(F.coalesce(lead, only(mentioned)))


def rejection(family: Column, candidate: Column, loose: Column) -> Column:
    """Why a candidate is refused; null if it is accepted."""
    return (
        F.when(loose, "loose source").when(family.isNull(), "probe undetermined").when(candidate.isNull(), "candidate undetermined").when(family != candidate, "different family")
    )


def compatible(a: Column, b: Column, unknown_passes: bool) -> Column:
    """Same family; what an unknown family means is the caller's to say."""
    return F.coalesce(a == b, F.lit(unknown_passes))


def rule_hits(rows: DataFrame, key: str, title: str, rules: DataFrame, traps: list[tuple[str, str]] = ()) -> DataFrame:
    """(key, at, word, family, ord): every rule whose word starts a word of the title, once the traps are rewritten.

    ``rules``: word, family, ord; any number of them, as words meet rules by equality of their first letters,
    at the lengths only that the rules have.
    ``traps``: phrases that look like something else, and what to read instead, in order.
    """
    read = F.concat(F.lit(" "), text.key(F.col(title)), F.lit(" "))
    for phrase, by in traps:
        read = F.replace(read, F.lit(f" {phrase} "), F.lit(f" {by} "))
    words = rows.select(key, F.posexplode(F.filter(F.split(read, " "), lambda w: w != "")).alias("at", "w"))
    lengths = F.coalesce(rules.agg(F.collect_set(F.length("word"))).scalar(), F.array().cast("array<int>"))
    sized = words.withColumn("n_", lengths)
    cut = F.transform(F.filter("n_", lambda n: (n > 0) & (n <= F.length("w"))), lambda n: F.left(F.col("w"), n))
    starts = sized.select(key, "at", F.explode(cut).alias("word"))
    return starts.join(rule_table(rules.select("word", "family", "ord")), "word")


def by_rules(rows: DataFrame, key: str, title: str, rules: DataFrame, traps: list[tuple[str, str]] = (), parents: DataFrame | None = None) -> DataFrame:
    """(key, family, head, families): of the first rule that hits, of the earliest and then longest word, and all, parents of others left out.

    ``parents``: family, parent.
    """
    hits = rule_hits(rows, key, title, rules, traps)
    one = hits.groupBy(key).agg(F.min_by("family", F.struct("ord", "word")).alias("family"), F.min_by("family", F.struct("at", -F.length("word"), "ord")).alias("head"))
    every = hits.select(key, "family").distinct()
    if parents is not None:
        above = every.join(rule_table(parents), "family").select(key, F.col("parent").alias("family")).distinct()
        every = every.join(grown(above), [key, "family"], "left_anti")
    names = every.groupBy(key).agg(F.array_sort(F.collect_set("family")).alias("families"))
    return one.join(grown(names), key)


def tag_families(rows: DataFrame, key: str, tags: str, rules: DataFrame, generic: list[str]) -> DataFrame:
    """(key, family, tag): by the most specific tag that a rule places, generic tags skipped; tags go from general to specific."""
    told = rows.select(key, F.posexplode(tags).alias("depth", "tag")).where(~F.col("tag").isin(generic))
    named = told.withColumn("title", F.regexp_replace("tag", "^[a-z]{2}:", "")).withColumn("id_", F.struct(key, "depth", "tag"))
    hits = rule_hits(named, "id_", "title", rules)
    best = F.min_by(F.struct("family", F.col("id_.tag").alias("tag")), F.struct(-F.col("id_.depth"), "ord", "word"))
    return hits.groupBy(F.col(f"id_.{key}").alias(key)).agg(best.alias("b")).select(key, "b.family", "b.tag")


def shelves(rows: DataFrame, key: str, shelf: str, rules: DataFrame, least: int, other: str = "other") -> DataFrame:
    """(key, label, side): the label of the first rule (word, family = label, ord, side) that hits a shelf's name.

    Shelves that no rule places, and labels with fewer than ``least`` rows, are ``other``.
    """
    hits = rule_hits(rows, key, shelf, rules).join(rule_table(rules.select("word", "ord", "side")), ["word", "ord"])
    told = hits.groupBy(key).agg(F.min_by(F.struct(F.col("family").alias("label"), "side"), F.struct("ord", "word")).alias("b"))
    placed = rows.select(key).join(grown(told), key, "left").select(key, "b.label", "b.side")
    sizes = placed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & F.col("label").isNotNull()).select("label", F.lit(True).alias("large"))
    return placed.join(sizes, "label", "left").select(key, F.when(F.col("large"), F.col("label")).otherwise(other).alias("label"), F.when(F.col("large"), F.col("side")).alias("side"))


def agrees_with_shelf(family: Column, shelves_of: Column, shelf: Column) -> Column:
    """A family's shelves, where it has any, hold the product's; an unknown shelf or family passes."""
    return F.coalesce(F.array_contains(shelves_of, shelf), F.lit(True)) | family.isNull() | shelf.isNull()
