"""Rankings: row numbers in ranges, round robin over groups, seeded bands, quota and stride samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import mix32
from .joins import match

#: Ranges that a group's rows are dealt out in.
RANGES = 64


def _cuts(number: Column) -> Column:
    return F.percentile_approx(number, [k / RANGES for k in range(1, RANGES)], 1000)


def _number(by: Column) -> Column:
    return F.coalesce(by.cast("double"), F.lit(float("inf")))


def in_ranges(rows: DataFrame, group: list[str], by: Column, then: Column | None = None) -> DataFrame:
    """``rows`` with ``range_``: ascending ranges of a number inside each group, of about equal size.

    Rows of equal ``by`` share a range.  ``then``, the number that orders those, deals them out as well: a value that is
    the end of a range, as every value of many rows is, has ranges of its own.
    """
    number = _number(by)
    cuts = rows.groupBy(*group).agg(_cuts(number).alias("cuts_"))
    marked = match(rows, cuts, group).withColumn("range_", F.size(F.filter("cuts_", lambda x: x < number)))
    if then is None:
        return marked.drop("cuts_")
    marked = marked.withColumn("tie_", F.coalesce(number == F.get("cuts_", F.col("range_")), F.lit(False))).drop("cuts_")
    inner = marked.where("tie_").groupBy(*group, "range_").agg(_cuts(_number(then)).alias("ties_"))
    place = F.when(F.col("tie_"), 1 + F.size(F.filter("ties_", lambda x: x < _number(then)))).otherwise(0)
    both = match(marked, inner, [*group, "range_"], "left").withColumn("range_", F.col("range_") * (RANGES + 1) + place)
    return both.drop("tie_", "ties_")


def numbered(rows: DataFrame, group: list[str], by: Column, order: list, name: str, then: Column | None = None) -> DataFrame:
    """``rows`` with their place in their group, from 1, by a total ``order`` that begins with the number ``by``.

    A group is numbered range by range, after the sizes of the ranges before, so no task sorts a whole group.
    Rows with equal ``by`` share a range unless ``then``, the number that comes second in ``order``, is given.
    """
    marked = in_ranges(rows, group, by, then)
    sizes = marked.groupBy(*group, "range_").agg(F.count(F.lit(1)).alias("n_"))
    before = sizes.withColumn("before_", F.sum("n_").over(Window.partitionBy(*group).orderBy("range_")) - F.col("n_")).drop("n_")
    place = F.row_number().over(Window.partitionBy(*group, "range_").orderBy(*order)) + F.col("before_")
    return match(marked, before, [*group, "range_"]).withColumn(name, place).drop("range_", "before_")


def first_rows(rows: DataFrame, group: list[str], order: list, most: int, name: str) -> DataFrame:
    """The first ``most`` rows of each group with their place; every task drops what can't be among them before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= most)


def round_robin(rows: DataFrame, group: str, order: list, score: str, most: int) -> DataFrame:
    """Rows by depth in their group, groups at equal depth by their best score; the first ``most``.

    Only the first ``most`` rows of a group can be taken, so no more than those are ordered together.
    """
    deep = first_rows(rows, [group], order, most, "depth")
    return deep.withColumn("best_", F.min(score).over(Window.partitionBy(group))).orderBy("depth", "best_", group).limit(most).drop("best_")


def first_two(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, firsts, n): the two first values of each group, in order, and how many different ones there are; nulls do not count."""
    pairs = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.lit(1).alias("one_"))
    sizes = pairs.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    two = first_rows(pairs, [group], [value], 2, "n_").groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("firsts"))
    return two.join(sizes, group)


def shuffle_band(rows: DataFrame, group: str, by: Column, order: list, key: str, band: int, seed: int, then: Column | None = None) -> DataFrame:
    """``place`` in each group: the first ``band`` rows by ``order`` in seeded order, the rest as they stand; ``then`` as in :func:`numbered`."""
    placed = numbered(rows, [group], by, order, "place", then)
    shuffled = F.row_number().over(Window.partitionBy(group).orderBy(mix32(F.lit(seed), F.col(key)), "place"))
    return placed.where(F.col("place") <= band).withColumn("place", shuffled).unionByName(placed.where(F.col("place") > band))


def quota(rows: DataFrame, stratum: str, shares: dict[str, float], key: str, limit: int, seed: int) -> DataFrame:
    """A seeded sample of max(1, round(limit * share)) rows of each stratum, in one seeded order."""
    sizes = {k: max(1, round(limit * v)) for k, v in shares.items()}
    wanted = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, n)))
    taken = first_rows(rows.where(F.col(stratum).isin(*sizes)), [stratum], [mix32(F.lit(seed), F.col(key)), key], max(sizes.values()), "n_")
    return taken.where(F.col("n_") <= wanted[F.col(stratum)]).drop("n_").withColumn("order_key", mix32(F.lit(seed + 1), F.col(key)))


def stride(rows: DataFrame, group: str, by: str, step: int) -> DataFrame:
    """Every ``step``-th row of each group by a unique number, from its first."""
    return numbered(rows, [group], F.col(by), [by], "n_").where((F.col("n_") - 1) % step == 0).drop("n_")


def top_sample(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """A simple random sample of ``most`` rows without replacement, the same for the same seed."""
    return rows.orderBy(mix32(F.lit(seed), F.col(key)), key).limit(most)


def page(rows: DataFrame, order: list, number: int, size: int, ceiling: int) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows, within the first ``ceiling`` rows."""
    first = min(number * size, ceiling)
    return rows.orderBy(*order).limit(min(first + size, ceiling)).offset(first)
