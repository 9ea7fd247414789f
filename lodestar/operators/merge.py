"""Catalogue refresh: upsert with a change log, difference of two states, price history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import is_valid
from .joins import grown


def upsert(base: DataFrame, incoming: DataFrame, reference: str = "EUR") -> DataFrame:
    """One row an id with ``outcome``; both sides have id, match_key, price, currency, name and unique ids.

    An id match is a re-read: price and currency are refreshed, a missing new price keeps the old one, and
    everything else is frozen.  A new id whose match key the base has is skipped; other new ids are added.
    """
    ok = incoming.withColumn("ok", F.coalesce(F.col("currency") == reference, F.lit(True)))
    b = base.select("id", F.struct(*[c for c in base.columns if c != "id"]).alias("b"))
    i = ok.select("id", F.struct(*[c for c in ok.columns if c != "id"]).alias("i"))
    taken = base.where("match_key IS NOT NULL").select("match_key").distinct().withColumn("taken", F.lit(True))
    # rows without a key get one of their own, which nothing matches, so they do not meet in one task
    key = F.coalesce(F.concat(F.lit("key:"), "i.match_key"), F.concat(F.lit("id:"), "id"))
    both = b.join(i, "id", "full").join(taken, key == F.concat(F.lit("key:"), taken.match_key), "left")
    moved = ~F.col("b.price").eqNullSafe(F.col("i.price"))
    outcome = (
        F.when(F.col("i").isNull(), "kept")
        .when(~F.col("i.ok"), F.when(F.col("b").isNull(), "skipped_currency").otherwise("refused_currency"))
        .when(F.col("b").isNull(), F.when(F.col("taken"), "skipped_duplicate").otherwise("imported"))
        .when(F.col("i.price").isNull() & F.col("b.price").isNotNull(), "kept_old_price")
        .when(moved, "refreshed")
        .otherwise("unchanged")
    )
    new = F.col("outcome").isin("refreshed", "imported")
    return both.withColumn("outcome", outcome).select(
        "id",
        "outcome",
        F.when(new, F.col("i.price")).otherwise(F.col("b.price")).alias("price"),
        F.col("b.price").alias("old_price"),
        F.coalesce("b.name", F.when(new, F.col("i.name"))).alias("name"),
        F.coalesce("b.match_key", F.when(new, F.col("i.match_key"))).alias("match_key"),
    )


#: Fields that a re-read of the same listing may update, and fields that no merge rewrites (fixed values).
VOLATILE = ("name", "category", "price", "currency", "price_note", "image", "url", "quantity", "quantity_source")
FROZEN = ("source", "source_label", "match_key", "barcode", "barcode_source", "local", "local_evidence", "brand", "brand_source")


def full_upsert(base: DataFrame, incoming: DataFrame, order: str, reference: str = "EUR", refresh: bool = True) -> DataFrame:
    """Every row of ``base`` and ``incoming`` with ``outcome`` and the names of its ``changed`` fields.

    Both sides have id and all fields of ``VOLATILE`` and ``FROZEN``; ids of ``base`` are unique, of rows of
    ``incoming`` with one id the first by ``order`` counts.  Another currency than the reference is refused.  An id
    match is the same listing read again: volatile fields take what is new, a blank is no news, and a missing
    code may be filled by a valid one.  A new id is imported unless its match key is taken, by ``base`` or by a
    row before it.  Where a row is skipped, its fields are null.
    """
    fields = [*VOLATILE, *FROZEN]
    first = incoming.where("id IS NOT NULL").groupBy("id").agg(F.min_by(F.struct(*fields, order), order).alias("i"))
    ok = F.coalesce(F.col("i.currency") == reference, F.lit(True))
    # the rows of both sides are dealt out by id once; only ids and keys of new rows move again
    fresh = first.where(ok & F.col("i.match_key").isNotNull()).join(grown(base.select("id")), "id", "left_anti")
    taken = base.select("match_key").where("match_key IS NOT NULL").distinct()
    # among new rows of one key the first comes in
    leads = fresh.groupBy(F.col("i.match_key").alias("match_key")).agg(F.min(F.struct(F.col(f"i.{order}").alias("o"), "id")).alias("l"))
    free = leads.join(grown(taken), "match_key", "left_anti").select(F.col("l.id").alias("id"), F.lit(True).alias("lead"))
    both = base.select("id", F.struct(*fields).alias("b")).join(grown(first.join(grown(free), "id", "left")), "id", "full")
    news = lambda f: F.col(f"i.{f}").isNotNull() & (F.col(f"i.{f}").cast("string") != "")
    moved = {f: news(f) & ~F.col(f"i.{f}").eqNullSafe(F.col(f"b.{f}")) for f in VOLATILE}
    gained = (F.coalesce("b.barcode", F.lit("")) == "") & F.coalesce(is_valid(F.col("i.barcode")), F.lit(False))
    moved |= {"barcode": gained, "barcode_source": gained & news("barcode_source")}
    reread = F.col("b").isNotNull() & F.col("i").isNotNull() & ok & F.lit(refresh)
    changed = F.when(reread, F.array_compact(F.array(*(F.when(c, F.lit(f)) for f, c in moved.items() if f != "barcode_source")))).otherwise(F.array().cast("array<string>"))
    outcome = (
        F.when(F.col("i").isNull(), "kept")
        .when(~ok, "skipped_currency")
        .when(F.col("b").isNull(), F.when(F.col("i.match_key").isNull() | F.col("lead"), "imported").otherwise("skipped_duplicate"))
        .when(~F.lit(refresh), "skipped_same")
        .when(F.size("changed") > 0, "refreshed")
        .otherwise("unchanged")
    )
    rows = both.withColumn("changed", changed).withColumn("outcome", outcome).withColumn("imported", F.col("outcome") == "imported")
    value = lambda f: F.when(F.col("imported"), F.col(f"i.{f}")).when(reread & moved.get(f, F.lit(False)), F.col(f"i.{f}")).otherwise(F.col(f"b.{f}"))
    missing = reread & F.col("b.price").isNotNull() & F.col("i.price").isNull()
    return rows.select("id", "outcome", "changed", missing.alias("price_missing"), F.col("b.price").alias("old_price"), *(value(f).alias(f) for f in fields))


def upsert_counters(merged: DataFrame) -> DataFrame:
    """(counter, n): rows by outcome, fields by name that moved, and prices that were missing and kept."""
    names = F.concat(F.array(F.concat(F.lit("row:"), "outcome")), F.transform("changed", lambda f: F.concat(F.lit("field:"), f)), F.when(F.col("price_missing"), F.array(F.lit("price:kept_old"))).otherwise(F.array().cast("array<string>")))
    return merged.select(F.explode(names).alias("counter")).groupBy("counter").agg(F.count(F.lit(1)).alias("n"))


def prune(rows: DataFrame, keep: Column, label: str) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and (label, n) of those that go."""
    kept = F.coalesce(keep, F.lit(False))
    return rows.where(kept), rows.where(~kept).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def change_log(merged: DataFrame) -> DataFrame:
    """id, old_price, price, pct of every price that moved."""
    pct = F.round((F.col("price") - F.col("old_price")) / F.col("old_price") * 100, 1)
    return merged.where("outcome = 'refreshed'").select("id", "old_price", "price", F.when(F.col("old_price") != 0, pct).alias("pct"))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, change ('added', 'gone', 'repriced') of every id that is not the same in both (id, price)."""
    b, a = before.select("id", F.col("price").alias("p0"), F.lit(1).alias("in0")), after.select("id", F.col("price").alias("p1"), F.lit(1).alias("in1"))
    change = F.when(F.col("in0").isNull(), "added").when(F.col("in1").isNull(), "gone").when(~F.col("p0").eqNullSafe(F.col("p1")), "repriced")
    return b.join(a, "id", "full").withColumn("change", change).where("change IS NOT NULL").select("id", "change", "p0", "p1")


def history(points: DataFrame, most: int, order: list) -> DataFrame:
    """The newest ``most`` points (id, at, price) of each id."""
    return points.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("n") <= most)


def moves(points: DataFrame, order: list, most: int, ids: int) -> DataFrame:
    """The newest ``most`` price changes (id, at, price, before) of the ``ids`` that moved last; re-reads of one price are none.

    Points of an id are put in ``order``; the newest change of every id picks the ids.
    """
    steps = points.where("price IS NOT NULL").withColumn("before", F.lag("price").over(Window.partitionBy("id").orderBy(*order)))
    changed = steps.where("before IS NOT NULL AND before <> price")
    last = changed.groupBy("id").agg(F.max("at").alias("last_")).orderBy(F.desc("last_"), "id").limit(ids).drop("last_")
    newest = [c.desc() if not isinstance(c, str) else F.desc(c) for c in order]
    return changed.join(last, "id", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(*newest))).where(F.col("n") <= most)


def backfill(rows: DataFrame, column: str, source: str) -> DataFrame:
    """Missing values of ``column`` from ``source``, with where each came from."""
    label = F.when(F.col(column).isNotNull(), "own").when(F.col(source).isNotNull(), "derived")
    return rows.withColumn(f"{column}_from", label).withColumn(column, F.coalesce(column, source))
