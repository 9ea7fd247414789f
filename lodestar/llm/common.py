"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: The ASCII white space that separates words, as a Java/Python character class body.
SPACE = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_batches(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``rows`` rows, so that Python holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sample_texts(docs: DataFrame, most: int, by: str | None = None, values: list | None = None) -> DataFrame:
    """At most ``most`` distinct non-null texts (of each value of ``by``): those of least 64-bit hash.

    A text is in or out by itself, whatever ids its rows have and however many there are.  Approximate counts
    of distinct texts (to 2 %) set the share of the hash range that is looked at, at twice what is wanted; a
    rank then sets the bound.  ``values``: those of ``by`` that are sampled; the caller bounds how many there are.
    """
    text = F.col("text").cast("string")
    rows = docs.where("text IS NOT NULL").select(*([by] if by else []), text.alias("text"), F.xxhash64(text).alias("h_"))
    distinct = F.approx_count_distinct("h_", 0.02).alias("n")
    # the hash as a number from 0 to 1
    place = (F.col("h_").cast("double") + 2.0**63) / 2.0**64
    if not by:
        near = rows.where(place * F.lit(rows.agg(distinct).first()["n"]) <= 2 * most).dropDuplicates(["h_"])
        return near.orderBy("h_").limit(most)
    rows = rows.where(F.col(by).isin(values))
    sizes = rows.groupBy(by).agg(distinct).collect()
    if not sizes:
        return rows
    size = F.create_map(*(F.lit(x) for r in sizes for x in (r[by], r["n"])))[F.col(by)]
    near = rows.where(place * size <= 2 * most).dropDuplicates([by, "h_"])
    rank = F.row_number().over(Window.partitionBy(by).orderBy("h_"))
    return near.withColumn("r_", rank).where(F.col("r_") <= most).select(by, "text", "h_")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint); root is the smallest node reachable.

    Alternates large-star and small-star steps until the edge set is a set of stars.  Each step is a
    partial aggregate and an equi-join; the edges are written between rounds, and the round before goes.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        after = stage(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(e)
        e = after
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == now:
            roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
            return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
