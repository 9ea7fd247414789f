"""Joins on keys that may be null, and joins of two tables that both grow."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grown(rows: DataFrame) -> DataFrame:
    """``rows`` for a join in which both sides grow with the input: never broadcast.

    Sizes are guessed from compressed files and shuffles, so a million narrow rows pass for a small table, are
    collected by the driver and sent to every executor.
    """
    return rows.hint("merge")


def rule_table(rules: DataFrame) -> DataFrame:
    """``rules`` for a join with rows that grow: each task builds its share of the rules, and the rows only pass by.

    Without that, rows whose guessed size is below that of the rules are collected and broadcast in their stead.
    """
    return rules.hint("shuffle_hash")


def match(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null equals null; the key columns of ``left`` are kept."""
    named = right.withColumnsRenamed({c: f"{c}_of_right" for c in on})
    same = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"{c}_of_right")) for c in on), F.lit(True))
    return left.join(named, same, how).drop(*(f"{c}_of_right" for c in on))
