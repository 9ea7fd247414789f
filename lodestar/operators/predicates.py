"""Predicates by name, so that tables of rules say which one applies to what.

A predicate is a Column over a product's name, quantity, category and tags.  A rule table names it; ``holds`` turns
the name in each row into the predicate's value by one CASE over all that are registered.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

PREDICATES: dict[str, Callable[[], Column]] = {}


def predicate(name: str) -> Callable[[Callable[[], Column]], Callable[[], Column]]:
    """Registers a predicate under the name that rule tables use."""

    def keep(rule: Callable[[], Column]) -> Callable[[], Column]:
        PREDICATES[name] = rule
        return rule

    return keep


#: Sizes of liquids and of what is weighed, words of what is no drink, and words of drinks' shelves.
LIQUID = r"\b[0-9]+([.,][0-9]+)?\s*(l|lt|ltr|ml)\b"
WEIGHED = r"\b[0-9]+([.,][0-9]+)?\s*(g|gr|gram|kg)\b"
NO_DRINK = r"cake|biskot|biscuit|keks|napolitank|kolac|sandwich|snack|wafer|vafel|munchmallow|button|\btops\b|brownie|cokollat|chocolat|bombon|karamel"
DRINK_SHELF = r"\bpije\b|\bpijet\b|leng|juice|drink|beverage|\bsok\b|soda|nektar|nectar|smoothie|lemonade"


@predicate("drink")
def drink() -> Column:
    """Positive evidence of a drink: a liquid's size or a drinks' shelf; words of sweets and weighed sizes speak first."""
    name, size = text.fold(F.col("name")), text.fold(F.col("quantity"))
    shelf = text.fold(F.concat_ws(" ", "category", "tags"))
    veto = name.rlike(NO_DRINK) | name.rlike(WEIGHED) | (~size.rlike(LIQUID) & size.rlike(WEIGHED))
    return ((F.trim(name) != "") | (F.trim(size) != "")) & ~veto & (name.rlike(LIQUID) | size.rlike(LIQUID) | shelf.rlike(DRINK_SHELF))


@predicate("weighed")
def weighed() -> Column:
    """The name says a weight."""
    return text.fold(F.col("name")).rlike(WEIGHED)


@predicate("promoted")
def promoted() -> Column:
    """The product stands on the shelf of promotions."""
    return F.lower("category") == "promo"


def holds(name: Column) -> Column:
    """Whether the predicate that ``name`` names holds for the row; an unknown name or answer is no."""
    cases = functools.reduce(lambda c, k: c.when(name == k, PREDICATES[k]()), sorted(PREDICATES), F.when(F.lit(False), F.lit(False)))
    return F.coalesce(cases, F.lit(False))


def standing(hits: DataFrame, products: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, reason, token, brand, homonym, stands) of brand hits: one does not stand where a rule says that its alias is another's.

    ``hits``: key, reason, token (what was read), brand (of the list); ``rules``: alias, brand, predicate.  A hit by
    barcode always stands.  Rules join hits by alias and brand; every other condition is a predicate in the table.
    """
    named = rules.select(text.key(F.col("alias")).alias("alias_"), F.col("brand").alias("of_"), "predicate").distinct()
    read = hits.withColumn("token_", text.key(F.col("token")))
    met = read.where("reason <> 'barcode'").join(named, (F.col("token_") == F.col("alias_")) & (F.col("brand") == F.col("of_")))
    columns = [key, "reason", "token", "brand"]
    other = met.select(*columns, "alias_", "predicate").join(products.drop("brand"), key).where(holds(F.col("predicate")))
    told = other.groupBy(*columns).agg(F.min("predicate").alias("homonym"))
    return hits.join(told, columns, "left").select(*columns, "homonym", F.col("homonym").isNull().alias("stands"))
