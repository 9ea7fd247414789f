"""Proposed alternatives: validation, intake with limits, decisions, and what the public sees of them.

A proposal has id, at, client, owner, for_code, for_brand, alt_code, alt_brand, seen_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.forms import chain_key
from .events import anchored_dedupe, first_fault, rate_limited

#: Limits of the intake (fixed values): a minute, a day, seconds between equal proposals, and waiting ones.
PER_MINUTE, PER_DAY, SAME_SECONDS, QUEUE = 3, 20, 86_400, 2000
_CODE = "^[0-9]{8,14}$"


def _said(value: Column) -> Column:
    """A text that is more than white space and no advertisement, else null."""
    plain = text.clean(value, 60)
    return F.when((plain != "") & ~text.looks_like_spam(plain), plain)


def proposal_fault(flagged: Column) -> Column:
    """Why a proposal is refused, by the first rule that fails; null if it stands.  ``flagged``: the alternative's code is a flagged issuer's."""
    given, brand = F.coalesce(F.col("alt_code"), F.lit("")) != "", _said(F.col("alt_brand"))
    other = chain_key(brand) != chain_key(_said(F.col("for_brand")))
    return first_fault(
        ("for_code", F.col("for_code").rlike(_CODE)),
        ("alt_code", ~given | F.col("alt_code").rlike(_CODE)),
        ("nothing_named", given | brand.isNotNull()),
        ("same_product", ~given | (F.col("alt_code") != F.col("for_code"))),
        ("same_brand", F.coalesce(other, F.lit(True))),
        ("flagged", ~given | ~F.coalesce(flagged, F.lit(False))),
    )


def seen_at(value: Column) -> Column:
    """Where it was seen; null for advertisements and coordinates."""
    said = _said(value)
    return F.when(~text.looks_like_coordinates(said), said)


def intake(rows: DataFrame, flagged: Column) -> DataFrame:
    """``rows`` with ``outcome``: a fault, ``rate``, ``duplicate``, ``full`` or ``queued``.

    Every valid proposal counts for its client's limits; among those within them the first of each (owner, code,
    alternative) in a day stays; of these the newest ``QUEUE`` wait.
    """
    judged = rows.withColumn("fault", proposal_fault(flagged))
    alt = F.coalesce(F.nullif("alt_code", F.lit("")), chain_key(F.col("alt_brand")))
    valid = rate_limited(judged.where("fault IS NULL"), "client", "at", ["id"], PER_MINUTE, PER_DAY).withColumn("alt_key", alt)
    first = anchored_dedupe(valid.where("allowed"), ["owner", "for_code", "alt_key"], "at", "id", SAME_SECONDS).select("id")
    waiting = valid.select("id", "at").join(first, "id").orderBy(F.desc("at"), F.desc("id")).limit(QUEUE).select("id", F.lit(True).alias("waits"))
    status = valid.select("id", "allowed").join(first.withColumn("first", F.lit(True)), "id", "left").join(waiting, "id", "left")
    outcome = F.when(F.col("fault").isNotNull(), F.col("fault")).when(~F.col("allowed"), "rate").when(F.col("first").isNull(), "duplicate").when(F.col("waits").isNull(), "full").otherwise("queued")
    return judged.join(status, "id", "left").withColumn("outcome", outcome).drop("fault", "allowed", "first", "waits")


def decide(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """``queue`` with ``status``: what the last decision on each id says (id, at, verdict), else pending."""
    last = decisions.groupBy("id").agg(F.max_by("verdict", F.struct("at", "verdict")).alias("verdict"))
    known = F.col("verdict").isin("accepted", "rejected")
    return queue.join(last, "id", "left").withColumn("status", F.when(known, F.col("verdict")).otherwise("pending")).drop("verdict")


def forget(queue: DataFrame, owners: DataFrame) -> DataFrame:
    """``queue`` after owners asked to be forgotten: what waits or was rejected goes, what was accepted stays without them."""
    gone = owners.select("owner").distinct().withColumn("gone", F.lit(True))
    marked = queue.join(gone, "owner", "left").where("gone IS NULL OR status = 'accepted'")
    return marked.withColumn("owner", F.when(F.col("gone").isNull(), F.col("owner"))).drop("gone").select(queue.columns)


def public(queue: DataFrame, code: str | None = None) -> DataFrame:
    """What anyone may read: accepted proposals, of one product if asked, without their owners."""
    rows = queue.where("status = 'accepted'").select("id", "for_code", "alt_code", "alt_brand")
    return rows if code is None else rows.where(F.col("for_code") == code)


def published(rows: DataFrame, consents: DataFrame) -> DataFrame:
    """Rows of owners whose last word on publication (owner, at, agrees) is yes."""
    last = consents.groupBy("owner").agg(F.max_by("agrees", F.struct("at", "agrees")).alias("agrees"))
    return rows.join(last.where("agrees"), "owner", "left_semi")
