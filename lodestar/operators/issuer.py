"""Which organisation issued a code: a range join made an equi-join over the dense prefix space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes

PREFIXES = 1000


def dense(ranges: DataFrame) -> DataFrame:
    """One row a prefix (at most 1000): the first range that covers it wins, by ``lo``, then ``hi``."""
    rows = ranges.withColumn("number", F.explode(F.sequence("lo", "hi"))).where(F.col("number") < PREFIXES)
    best = rows.groupBy("number").agg(F.min_by(F.struct("issuer", "kind", "stance"), F.struct("lo", "hi")).alias("r"))
    return best.select(F.lpad(F.col("number").cast("string"), 3, "0").alias("prefix"), "r.*")


def classify(rows: DataFrame, ranges: DataFrame, code: str = "code") -> DataFrame:
    """``rows`` with prefix, issuer, kind, verdict.  The prefix table has a fixed bound, so it is broadcast."""
    marked = rows.withColumn("prefix", codes.prefix(F.col(code)))
    joined = marked.join(F.broadcast(dense(ranges)), "prefix", "left")
    verdict = (
        F.when(F.col("prefix").isNull(), "UNKNOWN")
        .when(codes.is_restricted_short(F.col(code)), "NOT_A_COUNTRY")
        .when(F.col("stance").isin("FLAGGED", "LOCAL"), F.col("stance"))
        .when(F.col("kind") == "unassigned", "UNASSIGNED")
        .when(F.col("kind") != "country", "NOT_A_COUNTRY")
        .when(F.col("kind").isNull(), "UNKNOWN")
        .otherwise("OTHER")
    )
    return joined.withColumn("verdict", verdict).drop("stance")


def coverage(ranges: DataFrame) -> DataFrame:
    """Prefixes that no range or more than one range covers."""
    hits = ranges.withColumn("number", F.explode(F.sequence("lo", "hi"))).groupBy("number").agg(F.count(F.lit(1)).alias("n"))
    every = ranges.sparkSession.range(PREFIXES).select(F.col("id").cast("int").alias("number"))
    return every.join(hits, "number", "left").select("number", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")
