"""The public feed: validation, rate limits, windowed dedupe, histories."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def first_fault(*checks: tuple[str, Column]) -> Column:
    """The name of the first check that does not hold, in order; null if all do."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks))


def entry_fault(code: Column, owner: Column, note: Column) -> Column:
    return first_fault(
        ("code", code.rlike("^[0-9]{8,14}$")),
        ("owner", owner.rlike("^[a-z0-9]{4,40}$")),
        ("note", ~(text.looks_like_spam(note) | text.looks_like_coordinates(note)) & (F.length(note) <= 80)),
    )


def rate_limited(rows: DataFrame, client: str, at: str, order: list, per_minute: int, per_day: int) -> DataFrame:
    """``rows`` with ``allowed``: at most so many in each fixed minute and day of a client, counted before any refusal."""
    minute, day = F.date_trunc("minute", F.col(at)), F.to_date(at)
    n_minute = F.row_number().over(Window.partitionBy(client, minute).orderBy(at, *order))
    n_day = F.row_number().over(Window.partitionBy(client, day).orderBy(at, *order))
    return rows.withColumn("allowed", (n_minute <= per_minute) & (n_day <= per_day))


def throttled(rows: DataFrame, client: str, at: str, seconds: int, most: int) -> DataFrame:
    """``rows`` with how many the client sent in the ``seconds`` up to each, and whether that is too many.

    A client's time is cut in spans of ``seconds``; each row counts in its own span and the next, which is all that a
    row there can look back to.  So a busy client is spread over its spans.  Rows without a time look at each other.
    """
    step, micros = seconds * 1_000_000, F.unix_micros(at)
    own = F.floor(micros / step)
    spread = rows.withColumn("span_", F.explode(F.when(own.isNull(), F.array(own)).otherwise(F.array(own, own + 1)))).withColumns({"own_": F.col("span_").eqNullSafe(own), "t_": micros})
    window = Window.partitionBy(client, "span_").orderBy("t_").rangeBetween(-step, 0)
    counted = spread.withColumn("recent", F.count(F.lit(1)).over(window)).where("own_").drop("span_", "own_", "t_")
    return counted.withColumn("throttled", F.col("recent") > most)


def anchored_dedupe(rows: DataFrame, key: list[str], at: str, order: str, seconds: int) -> DataFrame:
    """Only rows that open a window: a key's first row, and the first that is ``seconds`` or more after the last kept one.

    Rows are sorted by key and time, which spills, and read in batches; only the last kept time is carried,
    so no group is collected.  No window is anchored at a row that was dropped.
    """
    step = seconds * 1_000_000
    moved = rows.select(*key, F.col(order), F.unix_micros(at).alias("t_"))
    kept = moved.select(*key, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            *names, times = (batch.column(k).to_pylist() for k in (*key, "t_"))
            opens = []
            for *k, t in zip(*names, times, strict=True):
                first = k != now or t is not None and last is not None and t - last >= step
                if first:
                    now, last = k, t
                opens.append(first)
            yield batch.select([*key, order]).filter(pa.array(opens, pa.bool_()))

    return moved.repartition(*key).sortWithinPartitions(*key, "t_", order).mapInArrow(run, kept.schema)


def state(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """Upsert by key: times seen, first and last time."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("times"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def pseudonym(owner: Column, salt: Column) -> Column:
    """Six hexadecimal digits that name an owner within a month."""
    return F.substr(F.sha2(F.concat_ws(":", owner, salt), 256), F.lit(1), F.lit(6))
