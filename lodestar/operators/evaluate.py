"""Judging answers: counters over probes, audits of empty answers, and gates on what a refresh would publish."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gates


def audit(probes: DataFrame, supply: DataFrame) -> DataFrame:
    """``probes`` (probe, family, own, n) with ``empty``: of those without an answer, whether there was one to give.

    ``supply``: family, n_brands that could answer, and ``brands`` of them, two at most.  An empty answer is a lie
    where another brand could answer, honest where none could, unplaceable without a family.
    """
    known = probes.join(supply.select("family", "n_brands", "brands"), "family", "left")
    others = F.coalesce(F.col("n_brands"), F.lit(0)) - F.when(F.array_contains("brands", F.col("own")) | (F.col("n_brands") > 2), 1).otherwise(0)
    empty = F.when(F.col("n") > 0, None).when(F.col("family").isNull(), "unplaceable").when(others > 0, "lie").otherwise("honest")
    return known.withColumn("empty", empty).drop("n_brands", "brands")


def counters(probes: DataFrame, answers: DataFrame, by: str) -> DataFrame:
    """For each value of ``by``: probes, answered ones, answers, those of another family, of the probe's own brand, and empty answers by kind.

    ``answers``: probe, alt_family, alt_brand, one row an answer.
    """
    judged = answers.join(probes.select("probe", "family", "own"), "probe").groupBy("probe").agg(
        F.count_if(F.coalesce(F.col("family") != F.col("alt_family"), F.lit(False))).alias("wrong"), F.count_if(F.col("alt_brand") == F.col("own")).alias("self")
    )
    both = probes.join(judged, "probe", "left")
    kinds = [F.count_if(F.col("empty") == k).alias(f"n_{k}") for k in ("lie", "honest", "unplaceable")]
    return both.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n") > 0).alias("n_answered"), F.sum("n").alias("n_answers"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("n_wrong"), F.coalesce(F.sum("self"), F.lit(0)).alias("n_self"), *kinds)


def drift(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """How many rows gain, lose, change or keep a value between two states of the rules."""
    both = before.select(key, F.col(value).alias("v0")).join(after.select(key, F.col(value).alias("v1")), key, "full")
    change = F.when(F.col("v0").eqNullSafe(F.col("v1")), "same").when(F.col("v0").isNull(), "gain").when(F.col("v1").isNull(), "loss").otherwise("change")
    return both.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row that is equal for equal tables, whatever their order: rows, and a sum of row hashes."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")).alias("hash"))


def answer_gates(counted: DataFrame) -> DataFrame:
    """(gate, ok, detail) of ``counters``: no set has an answer of another family, none an empty answer that is a lie, and there are sets at all."""
    worst = counted.agg(F.count(F.lit(1)).alias("sets"), F.max("n_wrong").alias("wrong"), F.sum("n_lie").alias("lies"))
    return gates.as_rows(worst, [gates.gate("sets", F.col("sets") > 0, F.col("sets")), gates.gate("wrong_family", F.col("wrong") == 0, F.col("wrong")), gates.gate("lies", F.col("lies") == 0, F.col("lies"))])


def run_log(log: DataFrame, most: int = 30) -> DataFrame:
    """The newest runs (at, ...), newest first."""
    return log.orderBy(F.desc("at")).limit(most)
