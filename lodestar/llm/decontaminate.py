"""Benchmark decontamination by latent semantic retrieval.

Method.  Benchmark items are the query set.  TF-IDF passages (windows of words, over the words that occur
in items) of all documents, together with the items themselves, form a sparse matrix; a distributed
randomised SVD of it gives a latent space.  An item longer than ``LONG`` words is indexed as
passages of about a window, so that a window of a copy is near one of them however long the item is.  Every
passage of every document is compared with every item's by the cosine of its TF-IDF vector and the item's
in the latent space.  Candidates are checked by the longest common subsequence of words between the item
and stretches of the text as long as the item: a long one is a copy, a middling one counts as a paraphrase
only if the item's answer (its last sentence) is there as well.  Items of few weighted terms, which a cosine
can't tell apart, match where their words stand side by side; such matches have a null cosine.

Scale.  The index is fitted on all passages of all distinct texts, so that a text's copies don't make its
words common.  Of each only the numbers of the items' words are moved, once, to find copies, and written.
Items are taken in groups of at most ``GROUP_PASSAGES`` passages (or one longer item), each of
blocks of ``ITEM_BLOCK`` passages with a space of their own, so what a task holds is bounded whatever the
number of items; one pass over the documents looks a whole group up.  Documents are scanned where they lie:
nothing of their text is shuffled.  The SVD moves partial products of ``terms x rank`` numbers from one task
for each ``FIT_PASSAGES`` passages (``FIT_TASKS`` at least).  All passages of all documents are searched.

Defined results: null and empty texts match nothing; items without a word match nothing; repeated rows and
rows with a null or repeated id are each searched under the id they have; empty tables give an empty result;
only ``doc_id``, ``text``, ``item_id`` are read, and ``remove`` keeps every column of the documents that stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, stage, text_batches

WINDOW, STRIDE = 40, 8
#: An item of at most so many words is one passage.
LONG = 60
RANK, OVERSAMPLE, POWER = 256, 32, 1
FIT_PASSAGES, FIT_TASKS = 1 << 20, 4
#: A task sums products of terms in one square where that has at most so many cells (256 MB).
GRAM_CELLS = 1 << 25
ITEM_BLOCK, GROUP_PASSAGES = 256, 2048
#: A word in more than this share of the passages has no weight, unless it is one of an item's rarest.
COMMON, KEPT_RAREST = 0.02, 8
MIN_TERMS = 3
#: An item with fewer weighted terms matches as a phrase too.
PHRASE_TERMS = 2 * MIN_TERMS
MIN_COSINE = 0.25
COPY, PARAPHRASE, ANSWER = 0.6, 0.45, 0.8
SEED = 7

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACED = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


def words(text: str | None) -> list[bytes]:
    """Lower-case words as UTF-8, without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


def answer(text: str | None) -> list[bytes]:
    """The words of an item's last sentence, or its last five where that is shorter than three."""
    parts = [w for s in (text or "").replace("!", ".").replace("?", ".").split(".") if (w := words(s))]
    return [] if not parts else parts[-1] if len(parts[-1]) >= 3 else words(text)[-5:]


def common_subsequence(item: list, text: list) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's positions."""
    where: dict = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in text:
        if m := where.get(w):
            x = row & m
            row = ((row + x) | (row - x)) & full
    return len(item) - row.bit_count()


@dataclass
class Block:
    """The latent space of some of the items' passages."""

    local: np.ndarray  # of each term of the vocabulary, its place here or -1; one more -1 for unknown words
    weights: np.ndarray  # of each term that has a place here
    owners: np.ndarray  # the item of each passage
    scores: np.ndarray  # terms x passages: what an occurrence of a term adds to the cosine's numerator, passages normed


@dataclass
class Index:
    """What a task needs to search for a group of items."""

    ids: list[int]
    items: list[list[bytes]]
    answers: list[list[bytes]]
    vocabulary: dict[bytes, int]
    blocks: list[Block]
    phrases: dict[bytes, list[int]]  # items that match as phrases, by their rarest word


def item_passages(ws: list) -> list[list]:
    """The words of an item in even parts of about a window, or in one where it is not long."""
    n = 1 if len(ws) <= LONG else round(len(ws) / WINDOW)
    return [ws[k * len(ws) // n : (k + 1) * len(ws) // n] for k in range(n)]


def _passages(vocabulary: dict[bytes, int]):
    """(h, passages): the terms of the non-overlapping windows of each text; empty ones too, as they count as passages."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            texts = [words(text) for text in batch.column("text").to_pylist()]
            sizes = np.array([len(ws) for ws in texts], np.int64)
            ids = np.concatenate([np.empty(0, np.int32), *(np.fromiter(map(vocabulary.get, ws, repeat(-1)), np.int32, len(ws)) for ws in texts)])
            first = np.r_[0, np.cumsum(-(-sizes // WINDOW))]
            place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            passage = np.repeat(first[:-1], sizes) + place // WINDOW
            known = ids >= 0
            ends = np.r_[0, np.cumsum(np.bincount(passage[known], minlength=first[-1]))]
            terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[known], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), terms)], ["h", "passages"])

    return run


def _normed(row: np.ndarray, term: np.ndarray, n: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, value) of ``n`` TF-IDF rows, each of length 1, from their terms as they come."""
    key, tf = np.unique(row * len(weights) + term, return_counts=True)
    row, term = key // len(weights), key % len(weights)
    value = tf * weights[term]
    norm = np.sqrt(np.bincount(row, value * value, n))
    return row, term, value / np.maximum(norm[row], 1e-12)


def _sparse(rows: list[list[int]], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`_normed` of rows that are lists."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return _normed(row, np.array([i for r in rows for i in r], np.int64), len(rows), weights)


def _summed_by(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` added up by ``index``, which need not be sorted."""
    out = np.zeros((n, values.shape[1]))
    if len(index):
        order = np.argsort(index, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(index[order]) > 0])
        out[index[order[starts]]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def _product(row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, x: np.ndarray) -> np.ndarray:
    """A' (A x) for a sparse matrix A of ``n`` rows."""
    y = _summed_by(row, value[:, None] * x[term], n)
    return _summed_by(term, value[:, None] * y[row], len(x))


def _add_squares(cells: np.ndarray, width: int, row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> None:
    """Add A'A, ``width`` cells a row, for a sparse matrix A of ``n`` rows in order: rows of as many terms at once."""
    size = np.bincount(row, minlength=n)
    first = np.cumsum(size) - size
    for c in np.unique(size[size > 0]).tolist():
        at = first[size == c][:, None] + np.arange(c)
        t, v = term[at], value[at]
        np.add.at(cells, (t[:, :, None] * width + t[:, None, :]).ravel(), (v[:, :, None] * v[:, None, :]).ravel())


def _gram_of(local: np.ndarray, weights: np.ndarray, x: np.ndarray, block: int = 1024):
    """A' (A x) for the TF-IDF matrix A of a task's passages, in blocks of terms; empty ones are left out.

    A task adds up A'A while it reads, and multiplies once; where that would be too large, it multiplies batch by batch.
    """
    held = np.flatnonzero(local >= 0)
    weighted = np.zeros(len(local), bool)
    weighted[held] = weights[local[held]] > 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(x)
        cells = np.zeros(len(x) ** 2 if len(x) ** 2 <= GRAM_CELLS else 0)
        for batch in text_batches(batches, 4096):
            lists = batch.column("terms")
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            term = lists.flatten().to_numpy(zero_copy_only=False)
            row, term = row[weighted[term]], local[term[weighted[term]]]
            full = np.bincount(row, minlength=len(lists))[row] >= MIN_TERMS
            matrix = _normed(row[full], term[full], len(lists), weights)
            if len(cells):
                _add_squares(cells, len(x), *matrix, len(lists))
            else:
                total += _product(*matrix, len(lists), x)
        if len(cells):
            total = cells.reshape(len(x), len(x)) @ x
        for b in range(0, len(x), block):
            if total[b : b + block].any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([total[b : b + block].tobytes()])], ["block", "part"])

    return run


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[b] = total.get(b, 0) + np.frombuffer(raw)
    for b, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([x.tobytes()])], ["block", "part"])


def latent_basis(passages: DataFrame, local: np.ndarray, own: list[list[int]], weights: np.ndarray, rank: int, balance: float) -> np.ndarray:
    """Right singular vectors (terms x rank) of the TF-IDF matrix of ``passages`` (by ``local`` terms) and the rows ``own``.

    The rows ``own`` count ``balance`` times, so that the space keeps them apart however many passages there are.
    """
    schema = "block int, part binary"

    def gram(x: np.ndarray) -> np.ndarray:
        out = balance * _product(*_sparse(own, weights), len(own), x) if own else np.zeros_like(x)
        parts = passages.mapInArrow(_gram_of(local, weights, x), schema).repartition(FIT_TASKS, "block").mapInArrow(_summed, schema)
        for r in parts.collect():
            part = np.frombuffer(r["part"]).reshape(-1, x.shape[1])
            out[r["block"] : r["block"] + len(part)] += part
        return out

    width = min(rank + OVERSAMPLE, len(weights))
    q = np.linalg.qr(gram(np.random.default_rng(SEED).standard_normal((len(weights), width))))[0]
    for _ in range(POWER):
        q = np.linalg.qr(gram(q))[0]
    value, vector = np.linalg.eigh(q.T @ gram(q))
    return q @ vector[:, np.argsort(-value)[:rank]]


def fitted_on(docs: DataFrame) -> DataFrame:
    """(text) of all documents that the index is fitted on: all that have one."""
    return docs.where("text IS NOT NULL").select(F.col("text").cast("string").alias("text"))


sample = fitted_on  # its earlier name


def fit(texts: DataFrame, items: list[tuple[int, str]]) -> Index:
    """The index of a group of items; document frequencies and the latent spaces come from all passages of the distinct ``texts`` (text)."""
    pairs = [(i, w, answer(t)) for i, t in items if (w := words(t))]
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws, _ in pairs for w in ws))}
    told = texts.select("text", F.xxhash64("text").alias("h")).mapInArrow(_passages(vocabulary), "h bigint, passages array<array<int>>")
    passages = written = stage(told.dropDuplicates(["h"]).select(F.explode("passages").alias("terms")), "passages")
    df = np.zeros(len(vocabulary))
    for r in passages.select(F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    n = passages.count()
    passages = passages.coalesce(max(FIT_TASKS, n // FIT_PASSAGES))
    parts = [(j, [vocabulary[w] for w in part]) for j, (_, ws, _) in enumerate(pairs) for part in item_passages(ws)]
    blocks, heavy = [], np.zeros(len(pairs), np.int64)
    for at in range(0, len(parts), ITEM_BLOCK):
        block, terms = _block(passages, parts[at : at + ITEM_BLOCK], df, n)
        blocks.append(block)
        np.add.at(heavy, block.owners, terms)
    discard(written)
    phrases: dict[bytes, list[int]] = {}
    for j in np.flatnonzero(heavy < PHRASE_TERMS).tolist():
        phrases.setdefault(min(pairs[j][1], key=lambda w: (df[vocabulary[w]], w)), []).append(j)
    return Index([i for i, _, _ in pairs], [w for _, w, _ in pairs], [a for _, _, a in pairs], vocabulary, blocks, phrases)


def _block(passages: DataFrame, parts: list[tuple[int, list[int]]], df: np.ndarray, n: int) -> tuple[Block, list[int]]:
    """The latent space of some passages (item, terms), and how many weighted terms each has."""
    terms = sorted({k for _, ids in parts for k in ids})
    local = np.full(len(df) + 1, -1, np.int64)
    local[terms] = np.arange(len(terms))
    own, df = [local[ids].tolist() for _, ids in parts], df[terms]
    rare = set()
    for ids in own:
        rare.update(sorted(dict.fromkeys(ids), key=lambda k: (df[k], k))[:KEPT_RAREST])
    idf = np.log((n + 1) / (df + 1)) + 1e-3
    weights = np.where((df <= COMMON * n) | np.isin(np.arange(len(df)), list(rare)), idf, 0.0)
    kept = [[k for k in ids if weights[k] > 0] for ids in own]
    basis = latent_basis(passages, local, own, weights, min(RANK, len(terms)), max(1.0, n / len(own)))
    row, term, value = _sparse(kept, weights)
    latent = _summed_by(row, value[:, None] * basis[term], len(own))
    latent /= np.maximum(np.linalg.norm(latent, axis=1), 1e-6)[:, None]
    scores = ((weights[:, None] * basis) @ latent.T).astype(np.float32)
    return Block(local, weights, np.array([j for j, _ in parts], np.int64), scores), [len(k) for k in kept]


def _verified(index: Index, j: int, text: list[bytes], at: int) -> tuple[float, bool]:
    """Best (share of item j found in order, answer found) around the window that starts at ``at``."""
    item = index.items[j]
    size = len(item) + len(item) // 4
    best, found = 0, False
    near = set(text[max(0, at - size) : at + WINDOW + size])
    if sum(w in near for w in item) < PARAPHRASE * len(item):  # no stretch can have enough of the item
        return 0.0, False
    for s in range(max(0, at - size), min(len(text), at + WINDOW), max(4, len(item) // 4)):
        stretch = text[s : s + size]
        n = common_subsequence(item, stretch)
        if n > best:
            reply = index.answers[j]
            best, found = n, common_subsequence(reply, text[s : s + size + len(reply)]) >= ANSWER * len(reply)
    return best / len(item), found


def _candidates(block: Block, ids: np.ndarray, n_words: int) -> Iterator[tuple[int, int, float]]:
    """(item, start of the window, cosine) of the windows near a passage; of near windows of one item the best."""
    ids = block.local[ids]
    weight = np.where(ids >= 0, block.weights[ids], 0.0) if len(block.weights) else np.zeros(len(ids))
    heavy = weight > 0
    if heavy.sum() < MIN_TERMS:
        return
    starts = np.arange(0, n_words, STRIDE)
    ends = np.minimum(starts + WINDOW, n_words)
    run = np.r_[0, np.cumsum(heavy)]
    norm = np.r_[0.0, np.cumsum(weight * weight)]
    full = run[ends] - run[starts] >= MIN_TERMS
    starts, ends = starts[full], ends[full]
    terms = ids[heavy]
    for part in range(0, len(starts), 256):  # bounds what a very long text takes
        s, e = starts[part : part + 256], ends[part : part + 256]
        lo, hi = run[s], run[e]
        sums = np.zeros((hi[-1] - lo[0] + 1, len(block.owners)), np.float32)
        np.cumsum(block.scores[terms[lo[0] : hi[-1]]], axis=0, out=sums[1:])
        shares = sums[hi - lo[0]] - sums[lo - lo[0]]
        # the norm as if no word came twice is at most the true one, which only near windows need
        near = shares / np.sqrt(np.maximum(norm[e] - norm[s], 1e-9))[:, None] >= MIN_COSINE
        true = np.array([np.sqrt(((np.bincount(terms[a:b]) * block.weights[: terms[a:b].max() + 1]) ** 2).sum()) if any_ else np.inf for a, b, any_ in zip(lo, hi, near.any(axis=1), strict=True)])
        cosine = shares / true[:, None]
        w, passage = np.nonzero(cosine >= MIN_COSINE)
        j, close = block.owners[passage], cosine[w, passage]
        # of windows of one item that start within a window's length of each other, the best stands for all
        spot = j * (n_words // WINDOW + 1) + s[w] // WINDOW
        order = np.lexsort((-close, spot))
        best = order[np.r_[True, spot[order][1:] != spot[order][:-1]]] if len(order) else order
        yield from zip(j[best].tolist(), s[w[best]].tolist(), close[best].tolist(), strict=True)


def matches(index: Index, text: str | None) -> list[tuple[int, float | None, float, bool]]:
    """(item, cosine, share of the item found in order, answer found) for the items that ``text`` holds."""
    ws = words(text)
    if not ws or not index.ids:
        return []
    get, unknown = index.vocabulary.get, len(index.vocabulary)
    ids = np.fromiter((get(w, unknown) for w in ws), np.int64, len(ws))
    out: dict[int, tuple[float | None, float, bool]] = {}
    for block in index.blocks:
        for j, at, c in _candidates(block, ids, len(ws)):
            got = out.get(j)
            if got and got[1] == 1.0:
                continue
            share, replied = _verified(index, j, ws, at)
            if (share >= COPY or share >= PARAPHRASE and replied) and (not got or share > got[1]):
                out[j] = (c, share, replied)
    if index.phrases:
        for at, w in enumerate(ws):
            for j in index.phrases.get(w, ()):
                item = index.items[j]
                if j not in out and ws[max(0, at - item.index(w)) :][: len(item)] == item:
                    out[j] = (None, 1.0, True)
    return [(index.ids[j], *v) for j, v in sorted(out.items())]


def _groups(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in groups, never more than one of them on the driver."""
    group: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).distinct().orderBy("item_id", "text").toLocalIterator():
        n = len(item_passages(words(r[1])))
        if group and size + n > GROUP_PASSAGES:
            yield group
            group, size = [], 0
        group.append((r[0], r[1]))
        size += n
    if group:
        yield group


def _indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """The broadcast index of each group of items, all fitted on all ``docs``."""
    for items in _groups(benchmark):
        yield docs.sparkSession.sparkContext.broadcast(fit(fitted_on(docs), items))


def _found(index):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            rows = [
                (d, i, None if c is None else round(c, 4), round(s, 4), a)
                for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                for i, c, s, a in matches(index.value, t)
            ]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "cosine", "lcs_share", "answer_found"]
            )

    return run


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_found for every document that holds an item."""
    schema = "doc_id bigint, item_id bigint, cosine double, lcs_share double, answer_found boolean"
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in _indexes(texts, benchmark):
        found = texts.mapInArrow(_found(index), schema)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _clean(index):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            yield batch.filter(pa.array([not matches(index.value, t) for t in batch.column("text").to_pylist()], pa.bool_()))

    return run


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    kept = docs
    for index in _indexes(docs, benchmark):
        kept = kept.mapInArrow(_clean(index), docs.schema)
    return kept


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
