"""A stored queue of proposals: what waits is a published table, what was decided lies in partitions by verdict and batch.

A move writes the decided rows first, replacing the partitions of its own batch only, and then publishes what still
waits.  A move that dies in between has decided rows that still wait too; readers and the next move leave them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from . import published

VERDICTS = ("accepted", "rejected")


def decided(spark: SparkSession, path: str) -> DataFrame:
    """Decided rows with ``status`` and ``batch``; none before the first move."""
    columns = published.read(spark, f"{path}/pending").schema
    full = columns.add("status", StringType()).add("batch", LongType())
    files, at = published._open(spark, f"{path}/decided")
    return spark.read.schema(full).parquet(f"{path}/decided") if files.exists(at) else spark.createDataFrame([], full)


def waiting(spark: SparkSession, path: str) -> DataFrame:
    return published.read(spark, f"{path}/pending").join(decided(spark, path).select("id"), "id", "left_anti")


def append(rows: DataFrame, path: str) -> None:
    """Rows with an ``id`` that is neither waiting nor decided come in; of equal ids one, whichever the engine meets."""
    spark = rows.sparkSession
    if not published.versions(spark, f"{path}/pending"):
        published.publish(rows.dropDuplicates(["id"]), f"{path}/pending")
        return
    known = waiting(spark, path)
    fresh = rows.dropDuplicates(["id"]).join(known.select("id").unionByName(decided(spark, path).select("id")), "id", "left_anti")
    published.publish(known.unionByName(fresh), f"{path}/pending")


def move(decisions: DataFrame, path: str, batch: int) -> None:
    """Move what waits by the last word of ``decisions`` (id, at, verdict); other verdicts than ``VERDICTS`` leave it waiting.

    The same decisions under the same batch number change nothing the second time.
    """
    spark = decisions.sparkSession
    last = decisions.groupBy("id").agg(F.max_by("verdict", F.struct("at", "verdict")).alias("status")).where(F.col("status").isin(*VERDICTS))
    pending = published.read(spark, f"{path}/pending")
    others = decided(spark, path).where(F.col("batch") != batch).select("id")
    moved = pending.join(others, "id", "left_anti").join(last, "id").withColumn("batch", F.lit(batch).cast("bigint"))
    moved.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("status", "batch").parquet(f"{path}/decided")
    published.publish(waiting(spark, path), f"{path}/pending")
