"""Sinks of micro-batches that a replayed batch does not change: each batch is published under its own number."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import keep_first
from ..operators.rank import first_rows
from ..sources import published


@dataclasses.dataclass(frozen=True)
class Folded:
    """Keeps ``combine`` of all batches' ``partial`` rows, for ``foreachBatch``.

    A batch writes only what it adds.  After ``every`` batches the parts are folded into a base under the last number,
    so that readers never meet more than twice that many parts; parts go when the base before covers them too.
    """

    path: str
    partial: Callable[[DataFrame], DataFrame]
    combine: Callable[[DataFrame], DataFrame]
    every: int = 16

    def _base(self, spark: SparkSession) -> list[int]:
        return published.versions(spark, f"{self.path}/base")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base, parts = self._base(spark), published.versions(spark, f"{self.path}/parts")
        if number in parts or base and number <= base[-1]:
            return
        published.publish(self.partial(batch), f"{self.path}/parts", version=number, keep=None)
        if number - (base[-1] if base else -1) >= self.every:
            published.publish(self.read(spark), f"{self.path}/base", version=number)
            if base:
                published.delete(spark, f"{self.path}/parts", [n for n in parts if n <= base[-1]])

    def read(self, spark: SparkSession) -> DataFrame:
        base = self._base(spark)
        parts = [n for n in published.versions(spark, f"{self.path}/parts") if not base or n > base[-1]]
        tables = [published.read(spark, f"{self.path}/{kind}", n) for kind, n in (("base", base[-1:]), ("parts", parts)) if n]
        if not tables:
            raise published.NotPublished(f"no batch in {self.path}")
        return self.combine(tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1]))


def newest(path: str, at: str, id_: str, most: int = 500, every: int = 16) -> Folded:
    """The newest rows, as many as the list may hold; ties of time by the greater id."""
    top = lambda rows: rows.orderBy(F.desc(at), F.desc(id_)).limit(most)
    return Folded(path, top, top, every)


def history(path: str, device: str, code: str, at: str, every: int = 16) -> Folded:
    """Each device's codes: times seen, first and last time."""
    first = lambda rows: rows.groupBy(device, code).agg(F.count(F.lit(1)).alias("times"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    both = lambda rows: rows.groupBy(device, code).agg(F.sum("times").alias("times"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    return Folded(path, first, both, every)


def capped(rows: DataFrame, device: str, code: str, most: int = 500) -> DataFrame:
    """What a device shows of its history: the codes it met last."""
    return first_rows(rows, [device], [F.desc("last_at"), code], most, "place").drop("place")


def enriched(items: DataFrame, pool: DataFrame) -> DataFrame:
    """Items (code, name, brand, ...) filled from the pool (code, name, brand, image, quantity): what the item says stays,
    and an item whose code the pool lacks stays as it is.

    Photo and quantity are the pool's alone where the code is known, and null elsewhere.  Of rows with one code the
    pool's least (name, brand, image, quantity) counts.
    """
    known = keep_first(pool.select("code", "name", "brand", "image", "quantity"), ["code"], ["name", "brand", "image", "quantity"])
    known = known.select("code", F.col("name").alias("name_"), F.col("brand").alias("brand_"), "image", "quantity", F.lit(True).alias("known_"))
    said = lambda c: F.when(F.col("known_"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"{c}_"))).otherwise(F.col(c))
    return items.join(known, "code", "left").withColumns({"name": said("name"), "brand": said("brand")}).drop("name_", "brand_", "known_")


def enriching(path: str, pool: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: every batch meets the version of the pool that is published when it runs."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number not in published.versions(spark, path):
            published.publish(enriched(batch, published.read(spark, pool)), path, version=number, keep=None)

    return write
