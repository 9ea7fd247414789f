"""The one alternative shown beside a shelf row: by brand, by the exact kind of thing, or by family; and live answers after curated ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairings import pick
from .rank import first_rows
from .taxonomy import rule_hits


def by_fields(rows: DataFrame, key: str, fields: list[str], rules: DataFrame) -> DataFrame:
    """(key, family): what the first rule says of the first field that any rule hits.

    Flavours and the like stand in names, so a shelf comes before a name: whoever lists ``fields`` orders them.
    ``rules``: word, family, ord; a word hits where it starts one of the field's.
    """
    shown = rows.select(F.explode(F.array(*(F.struct(F.col(key), F.lit(i).alias("place"), F.col(f).alias("said")) for i, f in enumerate(fields)))).alias("f_"))
    asked = shown.where("f_.said IS NOT NULL").select(F.struct(f"f_.{key}", "f_.place").alias("id_"), F.col("f_.said").alias("said"))
    hits = rule_hits(asked, "id_", "said", rules)
    return hits.groupBy(F.col(f"id_.{key}").alias(key)).agg(F.min_by("family", F.struct("id_.place", "ord", "word", "family")).alias("family"))


def _first_entry(entries: DataFrame, by: str) -> DataFrame:
    return entries.groupBy(by).agg(F.min_by("entry", F.struct("ord", "entry")).alias("entry"))


def inline_alternative(rows: DataFrame, key: str, entries: DataFrame, kind_rules: DataFrame, kind_tags: DataFrame, family_rules: DataFrame) -> DataFrame:
    """(key, entry, via) of rows that have an answer.

    ``rows``: key, brands, category, brand_category (what the brand is listed for), name, hint_family (the category's).
    ``entries``: entry, ord, brand, category, tags, families, only those with alternatives.  ``kind_rules``: word,
    family (the kind), ord; ``kind_tags``: kind, tag; ``family_rules``: word, family, ord.

    The brand's entry answers first.  Then the first entry with a tag of the row's kind, and where the kind is known
    nothing else may: milk is answered with milk or not at all.  A row of unknown kind gets the first entry of the
    family that its category and name say.  Repeated keys, null fields and keys without any hit give no further row.
    """
    asked = rows.select(key, "brands", F.lit(None).cast("string").alias("family"), F.col("category").alias("hint"), "hint_family")
    brand = pick(asked, key, entries).select(key, "entry", F.lit(1).alias("lane"), F.lit("brand").alias("via"))
    kinds = by_fields(rows, key, ["category", "brand_category", "name"], kind_rules).withColumnRenamed("family", "kind")
    tagged = _first_entry(kind_tags.join(entries.select("entry", "ord", F.explode("tags").alias("tag")), "tag"), "kind")
    kind = kinds.join(tagged, "kind").select(key, "entry", F.lit(2).alias("lane"), F.concat(F.lit("kind:"), "kind").alias("via"))
    open_ = rows.join(kinds.select(key), key, "left_anti").withColumn("all_", F.concat_ws(" ", "category", "name"))
    named = by_fields(open_, key, ["all_"], family_rules)
    family = named.join(_first_entry(entries.select("entry", "ord", F.explode("families").alias("family")), "family"), "family").select(key, "entry", F.lit(3).alias("lane"), F.lit("family").alias("via"))
    lanes = brand.unionByName(kind).unionByName(family)
    return lanes.groupBy(key).agg(F.min_by(F.struct("entry", "via"), "lane").alias("b")).select(key, "b.entry", "b.via")


def merge_live(static: DataFrame, live: DataFrame, order: list[str], most: int = 6) -> DataFrame:
    """(probe, code, live, place): curated answers (probe, code, place) in their order, then live ones that add a code.

    ``live``: probe, code, brand, own (the probe's brand), eligible, and the columns of ``order``, which rank them.
    Live rows without a code, of the probe's own brand or not eligible are left out; of equal codes the first stays.
    """
    ranks = [f"o{i}" for i in range(len(order))]
    shown = static.select("probe", "code", F.lit(False).alias("live"), F.col("place").cast("double").alias("s_"), *(F.lit(None).alias(r) for r in ranks))
    fit = live.where((F.coalesce("code", F.lit("")) != "") & F.coalesce("eligible", F.lit(False)) & ~F.coalesce(F.col("brand") == F.col("own"), F.lit(False)))
    more = fit.select("probe", "code", F.lit(True).alias("live"), F.lit(None).cast("double").alias("s_"), *(F.col(c).alias(r) for c, r in zip(order, ranks, strict=True)))
    by = ["live", "s_", *ranks]
    one = shown.unionByName(more).groupBy("probe", "code").agg(F.min(F.struct(*by)).alias("b")).select("probe", "code", "b.*")
    return first_rows(one, ["probe"], [*by, "code"], most, "place").select("probe", "code", "live", "place")
