"""Mixing sources to target weights by weighted fair queueing, in DataFrame expressions only.

Method.  Sources share a budget of words by weight; a source's target stops at ``MOST`` times its size, and the
excess is shared again by weight until no target is above.  The documents of a source queue in a seeded shuffled
order, all of them once before any a second time.  A document's virtual finish time is the number of words its
source has sent up to its end, divided by the source's target: a source that has sent just its target is at time 1.
The queues are merged by sorting on that time over ranges, and cut where the next document would pass the budget.

Scale.  Words are counted once; after that only ids, sizes and keys move.  A source is dealt out in 4096 buckets of
its shuffled order, whose sums give every bucket's start, so that a source with a third of all documents is ordered
in 4096 tasks.  The merged queue is range-partitioned and written; the ranges' sums say where the budget ends, and
only the range that holds the end is looked at document by document.  Sources are numbered by ranges as well, and
sharing again takes one aggregate over sources a round, of which the driver sees three numbers.

Defined results: a null text has size 0; null is a source of its own, after all others, and the empty string is
another; documents without words are never taken; rows with equal ids or equal in everything are each a document
(of rows equal in id and text any may be the one that is taken once more); rows with a null id are shuffled by their
text; if no source has a word all targets are 0; an empty table gives an empty result; other columns stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, stage

WEIGHTS = (5, 2, 1)
#: Words of the mix for each word of the sources.
SHARE = 1.5
#: Times that a document may be taken.
MOST = 2
SEED = 13
#: Hex digits of a document's key that name its bucket.
BUCKET_DIGITS = 3

_TRIM = " \t\n\x0b\x0c\r"


def words(text: str) -> str:
    """SQL: the number of words of a text."""
    return f"CASE WHEN coalesce(btrim({text}, '{_TRIM}'), '') = '' THEN 0L ELSE cast(size(split(btrim({text}, '{_TRIM}'), '[\\\\x20\\\\x09-\\\\x0D]+')) AS bigint) END"


def measured(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(row, doc_id, source, size, key, bucket) of every document; ``key`` sets the shuffled order."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.col("text")), F.lit(""))
    key = F.left(F.md5(F.concat(F.lit(f"{seed}:"), name)), F.lit(16))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.expr(words("text")).alias("size"), key.alias("key"))
    return rows.withColumn("bucket", F.left("key", F.lit(BUCKET_DIGITS)))


def in_ranges(rows: DataFrame, order: list[Column], value: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` sorted over ranges (``range_``) and, for each range, the sum of ``value`` in it and before it.

    There are as many ranges as shuffle partitions, however many rows.
    """
    sorted_ = stage(rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "mixing-ranges")
    sums = sorted_.groupBy("range_").agg(F.sum(value).alias("in_range_"))
    return sorted_, sums.withColumn("before_", F.sum("in_range_").over(Window.orderBy("range_")) - F.col("in_range_"))


def weighted(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources`` with ``weight``: the weights in turn, by code point of the source, null last."""
    order = [F.col("source").asc_nulls_last()]
    sorted_, ranges = in_ranges(sources.withColumn("one_", F.lit(1)), order, "one_")
    place = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1 + F.col("before_")
    turn = F.pmod(place, F.lit(len(weights))).cast("int") + 1
    return sorted_.join(ranges, "range_").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn)).select(*sources.columns, "weight")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, float]:
    """(source, source_size, target) of (source, source_size), and the budget that the targets add up to."""
    if share > most:
        raise ValueError("the budget is larger than what the sources may give")
    ranked = stage(weighted(sources, weights), "mixing-sources")
    budget = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, above = 0.0, -1
    while True:
        full = F.lit(most) * F.col("source_size") < F.lit(level) * F.col("weight")
        found = ranked.agg(F.count_if(full), F.sum(F.when(full, most * F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if found[0] == above or not found[2]:
            break
        above, level = found[0], (budget - found[1]) / found[2]
    target = F.least(most * F.col("source_size").cast("double"), F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target")), budget


def queue(rows: DataFrame, given: DataFrame, most: int = MOST) -> DataFrame:
    """``rows`` (of :func:`measured`) with source_size, target and ``sent``: the words of its source up to its end."""
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    starts = sums.withColumn("before", before).join(given.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "words")
    starts = starts.withColumnsRenamed({"source": "of", "bucket": "in"})
    placed = rows.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in"))).drop("of", "in")
    own = Window.partitionBy("source", "bucket").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("sent", F.col("before") + F.sum("size").over(own)).drop("before", "bucket")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document of ``docs``."""
    rows = stage(measured(docs, seed), "mixing-sized")
    given, budget = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    placed = stage(queue(rows, given, most), "mixing-queue")
    turns = F.explode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda t: ((t * F.col("source_size") + F.col("sent")) / F.col("target")).alias("finish")))
    waiting = placed.where("size > 0 AND target > 0").select("row", "source", "key", "size", turns.alias("finish"))
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("key")]
    sorted_, ranges = in_ranges(waiting, order, "size")
    last = ranges.where(F.col("before_") + F.col("in_range_") > budget).orderBy("range_").select("range_", "before_").first()
    taken = sorted_
    if last:
        spent = F.sum("size").over(Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + last["before_"]
        partly = sorted_.where(F.col("range_") == last["range_"]).withColumn("spent", spent).where(F.col("spent") <= budget).drop("spent")
        taken = sorted_.where(F.col("range_") < last["range_"]).unionByName(partly)
    sums = taken.groupBy("row").agg(F.sum("size").alias("taken"))
    whole = placed.join(sums, "row", "left")
    return whole.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def op13_fair_mix(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


#: Targets by the source from which on no target is above, and one running total over all documents twice.
ORACLE = rf"""
WITH sized AS (
    SELECT row_number() OVER () AS row, doc_id, source,
           len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
           substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 't' || text, '')), 1, 16) AS key FROM documents),
sources AS (
    SELECT *, [{", ".join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)})::INT + 1] AS weight
    FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
steps AS (
    SELECT {MOST} * source_size AS most, weight, {SHARE} * (sum(source_size) OVER ())::DOUBLE AS budget,
           coalesce(sum({MOST} * source_size) OVER w, 0)::DOUBLE AS full_words, (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS open_weight,
           row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS i
    FROM sources WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT (budget - full_words) / open_weight AS level, budget, i FROM steps WHERE most >= (budget - full_words) / open_weight * weight ORDER BY i LIMIT 1),
given AS (SELECT source, source_size, least({MOST} * source_size::DOUBLE, level * weight) AS target, budget FROM sources, levels),
sent AS (
    SELECT s.*, g.source_size, g.target, g.budget, sum(size) OVER (PARTITION BY s.source ORDER BY key, size, doc_id ROWS UNBOUNDED PRECEDING) AS sent
    FROM sized s JOIN given g ON s.source IS NOT DISTINCT FROM g.source),
waiting AS (
    SELECT row, source, key, size, budget, (t * source_size + sent)::DOUBLE / target AS finish FROM sent, (SELECT unnest(range({MOST})) AS t)
    WHERE size > 0 AND target > 0),
spent AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, key ROWS UNBOUNDED PRECEDING) AS spent FROM waiting),
taken AS (SELECT row, sum(size)::BIGINT AS taken FROM spent WHERE spent <= budget GROUP BY row)
SELECT s.doc_id, s.source, s.size, s.source_size, s.target, coalesce(t.taken, 0)::BIGINT AS taken FROM sent s LEFT JOIN taken t USING (row)"""
