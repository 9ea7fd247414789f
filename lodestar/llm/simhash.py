"""SimHash near-duplicates by a binary-trie self-join.

Method.  Every document gets a 64-bit fingerprint.  Distinct fingerprints are put in four binary
tries, one for each 16-bit quarter led to the top.  Two fingerprints that differ in at most three bits
agree in at least one quarter, so in one of the tries they share their node of depth 16.  From there
pairs of nodes are walked down together: bits that differ along the two paths are added up, and a pair
of subtrees is left as soon as the budget is exceeded.  Spark deals out the depth-16 nodes in order; a task
walks one after the other and holds no more than a few.  A node of more than ``HOT_NODE`` keys is left to
its grandchildren: of the other 48 bits one twelve agree, so its keys go to four tries of depth 28, again
one for each twelve led to the top.  A task returns a spanning forest of the links it found, never all
pairs of a group, and the forests are joined by star contraction over fingerprints.

Defined results: a null or wordless text has fingerprint 0, which links like any other; repeated rows
each get a row; rows with a null id link like others, so they may join two groups, and a group of null ids
alone has a null component; an empty table gives an empty result; only ``doc_id`` and ``text`` are read, so
other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, documents, free_name, stage, text_batches

SEED = 42
MAX_BITS = 3
QUARTERS = 4
#: Keys of a depth-16 node that are walked as one; beyond, depth-28 nodes are walked.
HOT_NODE = 1 << 20
#: Keys that a task gathers before it walks the nodes that are complete.
GATHERED = 1 << 18
#: Node pairs that a task holds at once; more are put aside and walked later.
FRONTIER = 1 << 20


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[2:], strict=False)] if len(words) > 2 else [digest(joined, SEED)]
    h = np.array(hashes, dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches):
        found = np.fromiter((fingerprint(t) for t in batch.column("text").to_pylist()), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(found.view(np.int64))], ["doc_id", "h", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp): h is the text's hash, fp the fingerprint as a signed bigint."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id bigint, h bigint, fp bigint")


def _hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of a[i] and b[i] for every i; parent[i] is the smallest index of i's set."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        ra, rb = ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def trie_links(keys: np.ndarray, depth: int, budget: int, frontier: int = FRONTIER) -> np.ndarray:
    """parent[i] for sorted distinct ``keys`` (uint64): sets of keys that links of <= ``budget`` bits join.

    Only keys that agree in their first ``depth`` bits are compared.
    """
    n = len(keys)
    parent = np.arange(n)
    if n < 2:
        return parent
    tops = keys >> np.uint64(64 - depth) if depth else np.zeros(n, np.uint64)
    lo = np.flatnonzero(np.r_[True, tops[1:] != tops[:-1]])
    hi = np.r_[lo[1:], n]
    deep = hi - lo > 1
    lo, hi = lo[deep], hi[deep]
    ones: dict[int, np.ndarray] = {}

    def middle(start: np.ndarray, end: np.ndarray, bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.r_[0, np.cumsum(((keys >> np.uint64(63 - bit)) & np.uint64(1)).astype(np.int64))]
        return end - (ones[bit][end] - ones[bit][start])

    empty = np.zeros(0, np.int64)
    work = [(depth, lo, hi, (empty,) * 5)]
    while work:
        bit, lo, hi, (al, ah, bl, bh, d) = work.pop()
        if len(lo) + len(al) > frontier and max(len(lo), len(al)) > 1:
            for part in (slice(None, None, 2), slice(1, None, 2)):
                work.append((bit, lo[part], hi[part], tuple(x[part] for x in (al, ah, bl, bh, d))))
            continue
        # pairs of single keys are decided at once
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            i, j = al[single], bl[single]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            parent = _hook(parent, i[near], j[near])
            al, ah, bl, bh, d = (x[~single] for x in (al, ah, bl, bh, d))
        if bit == 64 or not (len(lo) or len(al)):
            continue
        mid, am, bm = middle(lo, hi, bit), middle(al, ah, bit), middle(bl, bh, bit)
        nodes_lo, nodes_hi = np.r_[lo, mid], np.r_[mid, hi]
        deep = nodes_hi - nodes_lo > 1
        pairs = [
            np.r_[lo, al, am, al, am],
            np.r_[mid, am, ah, am, ah],
            np.r_[mid, bl, bm, bm, bl],
            np.r_[hi, bm, bh, bh, bm],
            np.r_[np.ones(len(lo), np.int64), d, d, d + 1, d + 1],
        ]
        alive = (pairs[1] > pairs[0]) & (pairs[3] > pairs[2]) & (pairs[4] <= budget)
        work.append((bit + 1, nodes_lo[deep], nodes_hi[deep], tuple(x[alive] for x in pairs)))
        if bit - depth > 1:
            ones.pop(bit - 2, None)
    return parent


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b: fingerprints) among the (lane, node, key, fp) rows of a task, which lie node by node."""

    def walked(lane: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in np.split(np.arange(len(lane)), np.flatnonzero(np.diff(lane)) + 1):
            if len(at):
                order = at[np.argsort(key[at], kind="stable")]
                parent = trie_links(key[order], _depth(int(lane[order[0]])), MAX_BITS)
                linked = parent != np.arange(len(parent))
                if linked.any():
                    yield pa.RecordBatch.from_arrays([pa.array(fp[order[linked]]), pa.array(fp[order[parent[linked]]])], ["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("lane", "node", "key", "fp")))
        if sum(len(h[0]) for h in held) >= GATHERED:
            lane, node, key, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            last = np.flatnonzero((lane != lane[-1]) | (node != node[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            yield from walked(lane[:cut], key[:cut].view(np.uint64), fp[:cut])
            held = [(lane[cut:], node[cut:], key[cut:], fp[cut:])]
    if held:
        lane, _, key, fp = (np.concatenate(c) for c in zip(*held, strict=True))
        yield from walked(lane, key.view(np.uint64), fp)


WIDTH, PART = 64 // QUARTERS, 12


def _depth(lane: int) -> int:
    """Lanes 0, 5, 10, ... are the quarters' tries; the four after each are those of its hot nodes."""
    return WIDTH if lane % 5 == 0 else WIDTH + PART


def fingerprint_links(distinct: DataFrame, hot: int = HOT_NODE) -> DataFrame:
    """(a, b) links that join the near fingerprints of ``distinct`` (fp), as a spanning forest per node."""
    turned = [F.col("fp") if q == 0 else F.shiftleft("fp", WIDTH * q).bitwiseOR(F.shiftrightunsigned("fp", 64 - WIDTH * q)) for q in range(QUARTERS)]
    node = F.shiftrightunsigned("key", 64 - WIDTH).alias("node")
    rows = distinct.select(F.posexplode(F.array(*turned)).alias("quarter", "key"), "fp").select((5 * F.col("quarter")).alias("lane"), node, "key", "fp")
    crowded = rows.groupBy("lane", "node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("lane", "node", F.lit(True).alias("hot"))
    rows = rows.join(crowded, ["lane", "node"], "left")
    low = F.lit((1 << 64 - WIDTH) - 1)
    rest = F.col("key").bitwiseAND(low)
    lanes = []
    for j in range(4):
        around = rest if j == 0 else F.shiftleft(rest, PART * j).bitwiseOR(F.shiftrightunsigned(rest, 64 - WIDTH - PART * j)).bitwiseAND(low)
        key = F.col("key").bitwiseAND(F.lit(-1 - ((1 << 64 - WIDTH) - 1))).bitwiseOR(around)
        lanes.append(F.struct((F.col("lane") + 1 + j).alias("lane"), F.shiftrightunsigned(key, 64 - WIDTH - PART).alias("node"), key.alias("key")))
    whole = F.array(F.struct("lane", "node", "key"))
    placed = rows.select(F.explode(F.when(F.col("hot"), F.array(*lanes)).otherwise(whole)).alias("x"), "fp").select("x.*", "fp")
    return placed.repartition("lane", "node").sortWithinPartitions("lane", "node").mapInArrow(_walk, "a bigint, b bigint")


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, fp) of every row, and (fp, root) of every fingerprint."""
    found = stage(fingerprints(docs), "simhash")
    distinct = stage(found.select("fp").distinct(), "simhash-distinct")
    roots = connected_components(fingerprint_links(distinct))
    return found, distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id (smallest doc_id reachable over links)."""
    found, named = _components(docs)
    ids = found.groupBy("fp").agg(F.min("doc_id").alias("low")).join(named, "fp")
    lowest = ids.groupBy("root").agg(F.min("low").alias("component_id"))
    groups = ids.join(lowest, "root").select("fp", "component_id")
    return found.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: of smallest id, then of smallest text hash; null ids come last.

    Different texts that share an id are judged each by itself.  Of rows that agree in id and text, one stays.
    """
    found, named = _components(docs)
    rows = found.groupBy("doc_id", "h", "fp").agg(F.count(F.lit(1)).alias("n")).join(named, "fp")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "n")).alias("b"))
    chosen = stage(first.select(F.col("b.doc_id").alias("id_"), F.col("b.h").alias("of_"), F.col("b.n").alias("n_")), "simhash-kept")
    hidden = free_name(docs, "text_hash_")
    marked = docs.withColumn(hidden, F.xxhash64(F.col("text").cast("string")))
    same = lambda c: F.col("doc_id").cast("bigint").eqNullSafe(c["id_"]) & (F.col(hidden) == c["of_"])
    once, more = chosen.where("n_ = 1"), chosen.where("n_ > 1")
    repeated = marked.join(more, same(more), "left_semi").dropDuplicates(["doc_id", hidden])
    return marked.join(once, same(once), "left_semi").unionByName(repeated).select(docs.columns)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
