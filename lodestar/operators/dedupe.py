"""Removing repeated listings without losing what they know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key by a total order; one partial aggregate, no sort."""
    best = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(key)]).agg(best.alias("r")).select("r.*")


def price_order(price: str = "price") -> list[Column]:
    """Cheapest first, missing prices last."""
    return [F.col(price).isNull(), F.col(price)]


def cheapest(rows: DataFrame, key: list[str], order: str, label: str = "source") -> DataFrame:
    """The cheapest row of each key, with the other sellers' labels in ``also_at``, sorted."""
    best = F.min_by(F.struct(*rows.columns), F.struct(*price_order(), F.col(order)))
    kept = rows.groupBy(*key).agg(best.alias("r"), F.collect_set(label).alias("sellers"))
    return kept.select("r.*", F.sort_array(F.array_except("sellers", F.array(F.col(f"r.{label}")))).alias("also_at"))


def all_agree(flag: str) -> Column:
    """Three-valued merge: true only if every opinion is true, null without opinions."""
    return F.bool_and(F.col(flag))


def any_true(flag: str) -> Column:
    return F.bool_or(F.col(flag))


def collapse(rows: DataFrame, name: str, brand: str, order: str) -> DataFrame:
    """Rows of one name become one if they have at most one brand; else they stay as they are.

    Adds ``n_merged`` (0 for a refused row); the flag ``local`` is merged without optimism.
    """
    brands = rows.groupBy(name).agg(F.count_distinct(brand).alias("n_brands"))
    marked = rows.join(brands, name)
    one = marked.where("n_brands <= 1").groupBy(name)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(order)))
    best = F.min_by(F.struct("pid", "price"), F.struct(*price_order(), F.col(order)))
    merged = one.agg(best.alias("r"), first(brand).alias(brand), all_agree("local").alias("local"), F.count(F.lit(1)).alias("n_merged"))
    kept = marked.where("n_brands > 1").select(name, "pid", "price", brand, "local", F.lit(0).cast("bigint").alias("n_merged"))
    return merged.select(name, "r.pid", "r.price", brand, "local", "n_merged").unionByName(kept)


def shadowed(rows: DataFrame, retailer: str, name: str, code: str, order: str) -> DataFrame:
    """One row for each (retailer, name, code), cheapest first; rows without a code go where a coded twin exists.

    The cheapest are a partial aggregate; only one row a code is left when twins meet.
    """
    best = F.min_by(F.struct(*rows.columns), F.struct(*price_order(), F.col(order)))
    one = rows.groupBy(F.col(retailer).alias("r_"), F.col(name).alias("n_"), F.col(code).alias("c_")).agg(best.alias("best"))
    coded = F.bool_or(F.col("c_").isNotNull()).over(Window.partitionBy("r_", "n_"))
    return one.withColumn("coded", coded).where("c_ IS NOT NULL OR NOT coded").select("best.*")
