"""How the filters of a corpus interact, audited by wide packed counters.

Method.  A document's fate under every order of the filters depends only on the set of filters that it fails: its
mask.  Every mask (with the document's labels) is mapped to one big integer of 64-bit fields, six for each of the
(order, step) pairs of all orders (600 pairs for five filters): kept, removed, redundant, unique_fails, good_lost
and toxic_lost.  The integer of a part is the sum of its documents' integers; a field can't run over into the next,
as a count of documents is below 2^63.  The sum is unpacked once for each part.

Scale.  Texts are read for their masks and digests and never move; a digest's smallest id is a partial aggregate,
and the rows that meet it join by (id, digest), so that a text with a third of all rows is no hot key.  Documents
are counted by (part, mask, labels) before any integer is touched, so a part is at most 128 rows, each multiplied
by its count.

Defined results: a null text is the empty text; a null source and an empty one are both part ''; a row with a null
id is never a copy of a smaller id, and nothing is a copy of it; rows that share an id are judged each; of several
labels of an id any that says good (or toxic) counts, and labels without a document nothing; an empty table gives no
rows; other columns stay out.
"""

from __future__ import annotations

import functools
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
BITS = 64
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
SYMBOLS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The filters of the audit in the order of their mask bits; E is judged over the table, the others in the text.
FILTERS = "ABCDE"

_TRIM = " \t\n\x0b\x0c\r"
_SPLIT = "'[\\\\x20\\\\x09-\\\\x0D]+'"


@functools.cache
def orders(filters: str) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


@functools.cache
def outcome(filters: str, mask: int, good: bool, toxic: bool) -> int:
    """The packed fields of one document that fails the filters of ``mask``: FIELDS of each step of each order."""
    packed, at = 0, 0
    for order in orders(filters):
        gone = False
        for letter in order:
            fails = bool(mask >> filters.index(letter) & 1)
            removed = fails and not gone
            redundant = fails and gone
            gone = gone or fails
            for value in (not gone, removed, redundant, fails and mask.bit_count() == 1, removed and good, removed and toxic):
                packed |= int(value) << BITS * at
                at += 1
    return packed


def unpack(packed: int, filters: str) -> np.ndarray:
    """(orders * filters, FIELDS) counts of a summed integer."""
    steps = len(orders(filters)) * len(filters)
    return np.frombuffer(packed.to_bytes(BITS // 8 * steps * len(FIELDS), "little"), dtype="<i8").reshape(steps, len(FIELDS))


def text_faults(text: Column, words: Column) -> dict[str, Column]:
    """The failure conditions that a text shows by itself."""
    capitals = (F.length(text) - F.length(F.translate(text, CAPITALS, ""))).cast("bigint")
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("bigint") < MIN_DISTINCT_PERCENT * F.size(words).cast("bigint"),
        "C": 100 * capitals > MAX_CAPITAL_PERCENT * F.length(text).cast("bigint"),
        "D": text.rlike(SYMBOLS),
    }


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every document; bit i of the mask is set if it fails filter i of FILTERS."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text_"),
    )
    words = F.expr(f"CASE WHEN btrim(text_, '{_TRIM}') = '' THEN array() ELSE split(btrim(text_, '{_TRIM}'), {_SPLIT}) END")
    split = rows.withColumns({"words_": words, "digest": F.unhex(F.sha2("text_", 256))})
    bit = lambda letter, fails: F.when(fails, 1 << FILTERS.index(letter)).otherwise(0)
    own = functools.reduce(lambda a, b: a + b, (bit(letter, fails) for letter, fails in text_faults(F.col("text_"), F.col("words_")).items()))
    judged = split.select("doc_id", "part", "digest", own.alias("mask"))
    first = split.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("low")).select(F.col("digest").alias("of"), "low")
    # without an id no row is a copy; such rows get keys that no first row has, and different ones
    known = F.col("doc_id").isNotNull()
    keyed = judged.withColumns({"known_": known, "key_": F.coalesce("doc_id", F.xxhash64("digest"))})
    found = keyed.join(first, keyed.known_ & (keyed.key_ == first.low) & (keyed.digest == first.of), "left")
    return found.select("doc_id", "part", (F.col("mask") + bit("E", known & F.col("of").isNull())).alias("mask"))


def counted(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by part, mask and labels."""
    says = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False))).alias(name)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("id_")).agg(says("quality"), says("toxic"))
    keyed = masked.withColumn("key_", F.coalesce("doc_id", F.xxhash64("part", "mask", F.monotonically_increasing_id())))
    rows = keyed.join(known, (keyed.key_ == known.id_) & keyed.doc_id.isNotNull(), "left")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    return rows.groupBy("part", "mask", flag("quality").alias("good"), flag("toxic").alias("toxic")).agg(F.count(F.lit(1)).alias("n"))


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from (part, mask, good, toxic, n)."""

    def unpacked(table: pa.Table) -> pa.Table:
        total = sum(n * outcome(filters, m, g, t) for m, g, t, n in zip(*(table.column(c).to_pylist() for c in ("mask", "good", "toxic", "n")), strict=True))
        cells = unpack(total, filters)
        letters = np.array([[filters.index(x) for x in o] for o in orders(filters)]).ravel()
        shapley = np.zeros(len(filters), np.int64)
        np.add.at(shapley, letters, cells[:, FIELDS.index("removed")])
        steps = len(filters)
        columns = {
            "part": pa.array([table.column("part")[0].as_py()] * len(cells)),
            "filter_order": pa.array(np.repeat(orders(filters), steps)),
            "step": pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(orders(filters)))),
            **{name: pa.array(cells[:, i]) for i, name in enumerate(FIELDS)},
            "shapley": pa.array(shapley[letters]),
        }
        return pa.table(columns)

    schema = "part string, filter_order string, step int, " + ", ".join(f"{f} bigint" for f in FIELDS) + ", shapley bigint"
    return counts.groupBy("part").applyInArrow(unpacked, schema)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(counted(masks(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/labels.parquet")))


_FAILS = lambda letter: f"(mask >> position({letter} IN '{FILTERS}') - 1) & 1 = 1"
#: Every mask met with every order and step.
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY text) AS low FROM t),
masks AS (
    SELECT doc_id, part,
           (len(ws) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(ws)) < {MIN_DISTINCT_PERCENT} * len(ws))::INT
           + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {MAX_CAPITAL_PERCENT} * length(text))::INT
           + 8 * regexp_matches(text, '{SYMBOLS}')::INT + 16 * coalesce(doc_id > low, false)::INT AS mask FROM split),
known AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
counts AS (
    SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
    FROM masks LEFT JOIN known USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(string_split('{"|".join(FILTERS)}', '|')) AS x),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
    JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter FROM orders, (SELECT unnest(range(1, {len(FILTERS) + 1}))::INT AS step)),
fates AS (
    SELECT m.mask, s.*, {_FAILS("letter")} AS fails,
           len(list_filter(string_split(filter_order, '')[1:step - 1], lambda y: {_FAILS("y")})) > 0 AS gone
    FROM (SELECT DISTINCT mask FROM counts) m, steps s),
cells AS (
    SELECT part, filter_order, step, letter, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN fails AND bit_count(mask) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
    FROM counts JOIN fates USING (mask) GROUP BY ALL)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM cells"""
