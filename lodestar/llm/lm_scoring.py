"""Stupid-backoff scores of every document against the rest of the corpus, by joins of hashed count tables.

Method.  Texts are exploded into n-grams (words and bigrams, by 64-bit hash); the rows (gram, block, n) are
partitioned by the n-gram's hash and give the corpus count of each; counts are joined back to the exploded
n-grams and scores are summed per document.  A word is scored by relative bigram frequency, or, where no
other document has the bigram, by ``BACKOFF`` times its unigram frequency; a document's own n-grams are
taken out of the counts first, as every bigram would else be known.  Rows of one block and one partition
travel as arrays of n-grams and of counts, which take a third less room than single rows.

Scale.  N-grams are pre-aggregated before they move: texts lie in blocks of about ``BLOCK_WORDS`` words,
chosen by the text's hash, and a block has one row for each distinct n-gram, so a bigram that a third of all
documents hold moves once a block.  Only counts that other blocks add to travel back.  Copies of a text are
one text with a number from the first shuffle on, so a group of copies lies nowhere as a whole.  Partitions
of blocks and of n-grams grow in number with the corpus, not in size.  Nothing depends on the order in which
the input is read, and no count table is broadcast or collected.

Defined results: null and wordless texts have no words and score 0; null and repeated ids are kept as they
are, each row with the score of its text; an empty table gives an empty result; only ``doc_id`` and ``text``
are read.  N-grams are told apart by 64-bit hashes, texts by 128-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, text_batches
from .ngrams import Grams, TableHashes

BACKOFF = 0.4
BLOCK_WORDS = 2_000_000
#: Partitions of n-grams for each block, and partitions of blocks at least.
SHARDS_A_BLOCK, LEAST_PARTITIONS = 4, 16
#: Texts that a task remembers having sent; it forgets all of them at this number.
MEMORY = 500_000


def _once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, h1, h2, copies, text): a text, compressed, the first time it is met, and how often it came again, without its text."""
    names, again, block_of = ["block", "h1", "h2", "copies", "text"], {}, {}
    press = zstandard.ZstdCompressor(level=3).compress

    def rest() -> pa.RecordBatch:
        found = [(block_of[k], *k, n) for k, n in again.items() if n]
        columns = zip(*found, strict=True) if found else [[]] * 4
        out = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.nulls(len(found), pa.binary())], names)
        again.clear()
        block_of.clear()
        return out

    for batch in text_batches(batches):
        fresh = []
        for b, *key in zip(*(batch.column(c).to_pylist() for c in ("block", "h1", "h2")), strict=True):
            key = tuple(key)
            fresh.append(key not in again)
            again[key] = again.get(key, -1) + 1
            block_of[key] = b
        kept = batch.filter(pa.array(fresh, pa.bool_()))
        pressed = pa.array([press(t.encode("utf-8", "surrogatepass")) for t in kept.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in names[:3]), pa.array([1] * len(kept), pa.int64()), pressed], names)
        if len(again) > MEMORY:
            yield rest()
    yield rest()


def _texts(table: pa.Table) -> tuple[list[tuple[int, int]], np.ndarray, Grams]:
    """Keys, copies and n-grams of a block's texts, in order of their keys."""
    copies: dict[tuple[int, int], int] = {}
    texts: dict[tuple[int, int], bytes] = {}
    for *key, n, text in zip(*(table.column(c).to_pylist() for c in ("h1", "h2", "copies", "text")), strict=True):
        key = tuple(key)
        copies[key] = copies.get(key, 0) + n
        if text is not None:
            texts[key] = text
    keys, words, expand = sorted(texts), TableHashes(), zstandard.ZstdDecompressor().decompress
    hashes = [words.of(expand(texts.pop(k)).decode("utf-8", "surrogatepass")) for k in keys]
    sizes, joined = np.array([len(h) for h in hashes], np.int64), np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    del hashes, words
    return keys, np.array([copies[k] for k in keys], np.int64), Grams(sizes, joined)


def _counted(g: Grams, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a block's words and bigrams, copies counted each."""
    weight = np.repeat(copies, g.sizes)
    return (np.bincount(at, weight[where], n).astype(np.int64) for at, where, n in ((g.at, slice(None), len(g.words)), (g.pair_at, g.second, len(g.bigrams))))


def _explode(shards: int):
    """(shard, block, gram, n) of the distinct words and bigrams of a block, as arrays by the n-gram's shard."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, copies, g = _texts(table)
        n = np.concatenate([*_counted(g, copies)])
        grams = np.concatenate([g.words, g.bigrams])
        shard = (grams % np.uint64(shards)).astype(np.int32)
        # equal counts side by side take little room
        order = np.argsort(np.minimum(n, 32767).astype(np.int16), kind="stable")
        order = order[np.argsort(shard[order], kind="stable")]
        named, start = np.unique(shard[order], return_index=True)
        ends = pa.array(np.r_[start, len(order)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (grams.view(np.int64), n)]
        return pa.table([pa.array(named.astype(np.int64)), pa.array(np.full(len(named), key[0].as_py(), np.int64)), *lists], ["shard", "block", "gram", "n"])

    return run


def _add(own: np.ndarray, grams: np.ndarray, asked: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``own`` counts of ``grams``, replaced by the corpus's where it has others."""
    if not len(grams) or not len(asked):
        return own
    order = np.argsort(grams)
    at = np.minimum(np.searchsorted(grams, asked, sorter=order), len(grams) - 1)
    hit = grams[order[at]] == asked
    own = own.copy()
    own[order[at[hit]]] = total[hit]
    return own


def text_scores(g: Grams, unigrams: np.ndarray, bigrams: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(log score, words that backed off) of each text, from corpus counts of the words and bigrams."""
    rest = unigrams[g.at] - g.of_doc(g.doc, g.at)
    logs = np.log(np.maximum(rest, 1) / total)
    second, doc = g.second, g.doc[g.second]
    others = bigrams[g.pair_at] - g.of_doc(doc, g.pair_at)
    seen = others > 0
    logs[second[~seen]] += np.log(BACKOFF)
    logs[second[seen]] = np.log(others[seen] / rest[second[seen] - 1])
    return np.bincount(g.doc, logs, len(g.sizes)), np.bincount(doc[~seen], minlength=len(g.sizes))


def _score(words: int):
    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        keys, copies, g = _texts(texts)
        del texts
        asked, total = (pa.concat_arrays([x.flatten() for x in counts.column(c).chunks]).to_numpy() if len(counts) else np.zeros(0, np.int64) for c in ("gram", "total"))
        unigrams, bigrams = (_add(own, grams, asked.view(np.uint64), total) for own, grams in zip(_counted(g, copies), (g.words, g.bigrams), strict=True))
        logs, backed = text_scores(g, unigrams, bigrams, words)
        mean = np.where(g.sizes > 0, logs / np.maximum(g.sizes, 1), 0.0)
        h1, h2 = (pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))
        columns = [h1, h2, pa.array(g.sizes), pa.array(backed.astype(np.int64)), pa.array(np.round(logs, 3) + 0.0), pa.array(np.round(mean, 6) + 0.0)]
        return pa.table(columns, ["h1", "h2", "n_words", "n_backoff", "log_score", "mean_log_score"])

    return run


def n_words() -> Column:
    """Words of the column ``text``, which is not null."""
    # an empty part comes before white space at the start and after white space at the end, and nowhere else
    blank = F.lit(" \t\n\v\f\r")
    ends = F.contains(blank, F.substring("text", 1, 1)).cast("int") + F.contains(blank, F.substring("text", -1, 1)).cast("int")
    return F.when(F.col("text") != "", F.size(F.split("text", "[\\x20\\x09-\\x0D]+")) - ends).otherwise(0)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_backoff, log_score, mean_log_score of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("second"), "text")})
    total = rows.agg(F.sum(n_words())).first()[0] or 0
    blocks = total // BLOCK_WORDS + 1
    parts = max(LEAST_PARTITIONS, 2 * blocks)
    shards = SHARDS_A_BLOCK * blocks
    placed = rows.select(F.pmod("h1", F.lit(blocks)).alias("block"), "h1", "h2", "text")
    texts = placed.mapInArrow(_once, "block bigint, h1 bigint, h2 bigint, copies bigint, text binary").repartition(parts, "block")
    packed = texts.groupBy("block").applyInArrow(_explode(shards), "shard bigint, block bigint, gram array<bigint>, n array<bigint>")
    # an n-gram has one shard, so what is partitioned by shard is partitioned by n-gram
    grams = packed.repartition(shards, "shard").select("shard", "block", F.inline(F.arrays_zip("gram", "n")))
    counts = grams.withColumn("total", F.sum("n").over(Window.partitionBy("gram", "shard"))).where("total > n")
    answers = counts.sortWithinPartitions("total").groupBy("shard", "block").agg(F.collect_list(F.struct("gram", "total")).alias("c")).select("block", F.col("c.gram").alias("gram"), F.col("c.total").alias("total"))
    scored = texts.groupBy("block").cogroup(answers.repartition(parts, "block").groupBy("block")).applyInArrow(
        _score(max(total, 1)), "h1 bigint, h2 bigint, n_words bigint, n_backoff bigint, log_score double, mean_log_score double"
    )
    return rows.select("doc_id", "h1", "h2").join(scored, ["h1", "h2"]).select("doc_id", "n_words", "n_backoff", "log_score", "mean_log_score")


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))


ORACLE = rf"""
WITH words AS (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)),
pairs AS (SELECT a.doc_id, b.p, a.w AS v, b.w FROM words a JOIN words b ON a.doc_id = b.doc_id AND b.p = a.p + 1),
total AS (SELECT count(*) AS n FROM words),
c1 AS (SELECT w, count(*) AS n FROM words GROUP BY w),
d1 AS (SELECT doc_id, w, count(*) AS n FROM words GROUP BY doc_id, w),
c2 AS (SELECT v, w, count(*) AS n FROM pairs GROUP BY v, w),
d2 AS (SELECT doc_id, v, w, count(*) AS n FROM pairs GROUP BY doc_id, v, w),
r1 AS (SELECT d1.doc_id, d1.w, c1.n - d1.n AS n FROM d1 JOIN c1 USING (w)),
r2 AS (SELECT d2.doc_id, d2.v, d2.w, c2.n - d2.n AS n FROM d2 JOIN c2 USING (v, w)),
scored AS (
    SELECT x.doc_id, x.p,
           CASE WHEN r2.n > 0 THEN ln(r2.n / rv.n)
                ELSE ln(greatest(rw.n, 1) / total.n) + CASE WHEN y.p IS NULL THEN 0 ELSE ln({BACKOFF}) END END AS s,
           y.p IS NOT NULL AND r2.n = 0 AS backed
    FROM words x JOIN r1 rw ON rw.doc_id = x.doc_id AND rw.w = x.w CROSS JOIN total
    LEFT JOIN pairs y ON y.doc_id = x.doc_id AND y.p = x.p
    LEFT JOIN r2 ON r2.doc_id = y.doc_id AND r2.v = y.v AND r2.w = y.w
    LEFT JOIN r1 rv ON rv.doc_id = y.doc_id AND rv.w = y.v)
SELECT d.doc_id, count(s.p) AS n_words, count(*) FILTER (WHERE s.backed) AS n_backoff,
       round(coalesce(sum(s.s), 0), 3) AS log_score, round(coalesce(avg(s.s), 0), 6) AS mean_log_score
FROM documents d LEFT JOIN scored s USING (doc_id) GROUP BY d.doc_id"""
