"""Distribution gates: exact floor-index quantiles and pass/fail rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import match
from .rank import in_ranges


def floor_quantiles(rows: DataFrame, group: list[str], value: str, at: list[float]) -> DataFrame:
    """For each group the value at index floor(n * f) of its sorted values, as q_<percent>, and n.

    Exact in two levels.  Equal values are counted first; a group's distinct values are dealt out in ranges,
    and sums over ranges say in which range a quantile lies; running sums are taken inside that range only.
    So no task sees a whole group, however many values it has.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("v_")).agg(F.count(F.lit(1)).alias("c_"))
    marked = in_ranges(counted, group, F.col("v_"))
    sums = marked.groupBy(*group, "range_").agg(F.sum("c_").alias("s_"))
    per = Window.partitionBy(*group)
    sums = sums.withColumn("before_", F.sum("s_").over(per.orderBy("range_")) - F.col("s_")).withColumn("n", F.sum("s_").over(per))
    index = lambda f: F.least(F.floor(F.col("n") * f), F.col("n") - 1)
    wanted = sums.select("*", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), index(f).alias("i")) for f in at))).alias("w_"))
    wanted = wanted.where("before_ <= w_.i AND w_.i < before_ + s_").select(*group, "range_", "n", "before_", "w_.f", "w_.i")
    near = match(marked, wanted, [*group, "range_"])
    upto = F.sum("c_").over(Window.partitionBy(*group, "range_", "f").orderBy("v_")) + F.col("before_")
    found = near.withColumn("upto_", upto).where("upto_ > i").groupBy(*group, "n", "f").agg(F.min("v_").alias("v_"))
    return found.groupBy(*group, "n").agg(*(F.max(F.when(F.col("f") == f, F.col("v_"))).alias(f"q_{round(100 * f)}") for f in at))


def gate(name: str, ok: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("gate"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.cast("double").alias("detail"))


def as_rows(figures: DataFrame, gates: list[Column]) -> DataFrame:
    return figures.select(F.explode(F.array(*gates)).alias("g")).select("g.*")
