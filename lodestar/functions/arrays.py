"""Values that are worked out once, and running sums over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, rule) -> Column:
    """``rule`` of a value that is worked out one time, however often the rule names it."""
    return F.get(F.transform(F.array(value), lambda x: rule(x)), F.lit(0))


def running_sum(values: Column) -> Column:
    """Sums up to each place, in rounds of doubled reach: no array grows element by element."""

    def rounds(v: Column) -> Column:
        step = lambda acc, k: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.pow(F.lit(2), k).cast("int")), F.lit(0)))
        return F.when(F.size(v) < 2, v).otherwise(F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int")), v, step))

    return once(values, rounds)
