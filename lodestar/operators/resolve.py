"""Answers in tiers: the first tier with a candidate answers a probe, ranked and cut to a few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import match, rule_table

ANSWERS = 6


def top(rows: DataFrame, probe: list[str], order: list, most: int = ANSWERS) -> DataFrame:
    """The first ``most`` rows of each probe, with ``rank`` from 1."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*probe).orderBy(*order)))
    return ranked.where(F.col("rank") <= most)


def hits_of(probes: DataFrame, probe: str, say: list[str], tokens: Column, keys: DataFrame, floor: float, most: int) -> DataFrame:
    """(probe, rank, entry, score): the first entries of each probe by weight of shared tokens, down to ``floor`` of its best.

    ``keys``: entry, token, weight.  ``tokens`` follow from the columns ``say``; probes that say the same ask once, so
    pairs of a probe and an entry are made for what is said and not for every probe.
    """
    asked = probes.select(*say).distinct().withColumn("ask", F.struct(*say))
    words = asked.select("ask", F.explode(F.array_distinct(tokens)).alias("token"))
    scored = words.join(keys, "token").groupBy("ask", "entry").agg(F.sum("weight").alias("score"))
    best = scored.groupBy("ask").agg(F.max("score").alias("best"))
    near = scored.join(best, "ask").where(F.col("score") >= floor * F.col("best"))
    first = top(near, ["ask"], [F.desc("score"), "entry"], most)
    return match(probes, rule_table(first.select(*(F.col(f"ask.{c}").alias(c) for c in say), "rank", "entry", "score")), say).select(probe, "rank", "entry", "score")


def first_tier(rows: DataFrame, probe: str, tier: str = "tier") -> DataFrame:
    """Only the rows of each probe's lowest tier."""
    low = rows.groupBy(probe).agg(F.min(tier).alias("low_"))
    return rows.join(low, probe).where(F.col(tier) == F.col("low_")).drop("low_")


def stop_after(rows: DataFrame, probe: str, tier: str, enough: int) -> DataFrame:
    """Tiers in order until ``enough`` candidates are there; the tier that reaches it is kept whole."""
    sizes = rows.groupBy(probe, tier).agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(probe).orderBy(tier).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = sizes.withColumn("before_", before).where(F.col("before_") < enough).select(probe, tier)
    return rows.join(wanted, [probe, tier])


def diversify(rows: DataFrame, group: list[str], order: list, per: str) -> DataFrame:
    """At most one row of each ``per`` in a group, its first in ``order``; rows whose ``per`` is blank all stay."""
    blank = F.trim(F.coalesce(F.col(per).cast("string"), F.lit(""))) == ""
    return top(rows.where(~blank), [*group, per], order, 1).drop("rank").unionByName(rows.where(blank))
