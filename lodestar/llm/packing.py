"""Pattern packing of tokenised documents into sequences, by non-negative least squares.

Method.  Documents become token ids; a document longer than a sequence is cut into full pieces and a
rest.  The histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus holds) is
rounded up to coarse bins.  All patterns of up to four bins that fill a sequence are enumerated, and a
non-negative least-squares fit finds how often each is to repeat so that together they use the
histogram up.  Repeats are rounded down and made concrete with true lengths, and gaps are topped up with
the longest documents that fit; what is left fills new sequences, longest first.  The result is a plan: entries of a few lengths
with a repeat count.  Spark ranks the pieces of each length, and a piece finds its sequence and offset
from its rank.  Only the histogram and the plan reach the driver.

Defined results: a null or empty text is the single token that ends documents; repeated rows and rows with
a null or repeated id are each packed; an empty table packs to nothing; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import functools
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, stage, text_batches

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Chunks that a Python worker remembers; it forgets all of them at this number.
MEMORY = 600_000
#: Bins of the coarse histogram; a pattern has at most so many documents.
BINS, PATTERN_DOCS = 64, 4
#: Ranks of one length are counted in this many parts at least, and one more for each so many pieces.
PARTS, PIECES_A_PART = 16, 2_000_000

#: Outside these, white space, letters or letter case may be seen differently: such texts go to the library as they are.
_RARE = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff\u0100-\u017f]|<\\|")
#: The tokenizer's own split into pieces, for lower-cased text without rare characters (fixed values).
_LETTERS = "a-z\xdf-\xf6\xf8-\xff\u0100-\u017f"
_SPLIT = re.compile(f"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\s0-9{_LETTERS}]+")
_END = "\x01"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, as byte by letter."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkTokenizer:
    """Ids of texts as little-endian bytes, remembering the ids of white-space-separated chunks.

    The tokenizer drops white space and never joins tokens over it, so a text's ids are its chunks' ids.
    Unknown chunks go through a byte-pair encoder made from the same vocabulary, in which the end of a
    word is a byte of its own that rare texts alone could hold; rare texts go to the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        letters, end = byte_letters(), _END.encode()
        special = set(self._tokenizer.get_added_tokens_decoder())
        ranks, ends = {}, []
        for token, i in self._tokenizer.get_vocab(with_added_tokens=True).items():
            if i in special:
                continue
            last = token.endswith("</w>")
            key = bytes(letters[c] for c in token.removesuffix("</w>"))
            if last:
                ends.append(i)
            elif key == end:
                continue
            ranks[key + end * last] = i
        ranks[end] = 1 << 20
        self._encoder = tiktoken.Encoding("chunks", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})
        self._ends = np.zeros(max(ranks.values()) + 1, bool)
        self._ends[ends] = True
        self._known: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> None:
        split = [None if c.isalpha() else _SPLIT.findall(c) for c in chunks]
        joined = _END.join([c if ws is None else _END.join(ws) for c, ws in zip(chunks, split, strict=True)]) + _END
        ids = self._encoder.encode_to_numpy(joined, disallowed_special=()).astype("<u4")
        words = np.cumsum([1 if ws is None else len(ws) for ws in split])
        cuts = (4 * np.flatnonzero(self._ends[ids])[words - 1] + 4).tolist()
        raw = ids.tobytes()
        self._known.update(zip(chunks, [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))

    def ids(self, text: str) -> bytes:
        if _RARE.search(text):
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        known = self._known
        chunks = text.lower().split()
        found = list(map(known.get, chunks))
        if None in found:
            new = {c for c, f in zip(chunks, found, strict=True) if f is None}
            if len(known) + len(new) > MEMORY:
                known.clear()
                new = set(chunks)
            self._learn(list(new))
            found = map(known.get, chunks)
        return b"".join(found)


@functools.cache
def _tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def _pieces(path: str, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in text_batches(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = tokenizer.ids(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(
        _pieces(path, capacity), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with least |a x - b|, by the active-set method."""
    x = np.zeros(a.shape[1])
    used = np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[used] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        used[best] = True
        while True:
            z = np.zeros_like(x)
            z[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            low = used & (z <= 0)
            if not low.any():
                x = z
                break
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            used &= x > 1e-12
            x[~used] = 0
            if not used.any():
                break
    return x


def patterns(bins: int = BINS, docs: int = PATTERN_DOCS) -> np.ndarray:
    """All multisets of up to ``docs`` bins (1..bins) that fill ``bins``: a (bins, patterns) count matrix."""
    found = []
    for n in range(docs):
        for head in combinations_with_replacement(range(1, bins + 1), n):
            last = bins - sum(head)
            if last >= (head[-1] if head else 1):
                found.append((*head, last))
    out = np.zeros((bins, len(found)))
    for j, p in enumerate(found):
        for b in p:
            out[b - 1, j] += 1
    return out


class _Stock:
    """Counts of lengths with a fast 'longest length of at most x that is left'."""

    def __init__(self, counts: dict[int, int]):
        self.counts = dict(counts)
        self.lengths = sorted(k for k, v in counts.items() if v > 0)

    def longest(self, most: int, least: int = 1) -> int:
        at = bisect_right(self.lengths, most)
        return self.lengths[at - 1] if at and self.lengths[at - 1] >= least else 0

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.lengths[bisect_right(self.lengths, length) - 1]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths, repeats) entries that use the histogram up; the lengths of an entry sum to <= capacity."""
    stock = _Stock(histogram)
    entries: list[tuple[list[int], int]] = []
    if full := histogram.get(capacity, 0):
        stock.take(capacity, full)
        entries.append(([capacity], full))
    bins = min(BINS, capacity)
    width = -(-capacity // bins)
    coarse = np.zeros(bins)
    for length, n in stock.counts.items():
        coarse[-(-length // width) - 1] += n
    shapes = patterns(bins)
    repeats = np.floor(nnls(shapes, coarse) + 1e-6).astype(np.int64) if coarse.sum() else np.zeros(shapes.shape[1], np.int64)
    wanted = [[int(b) + 1 for b in np.flatnonzero(shape)[::-1] for _ in range(int(shape[b]))] for shape in shapes.T]
    # patterns of the longest documents first, so that short ones remain to fill gaps
    for j in sorted(np.flatnonzero(repeats).tolist(), key=lambda j: wanted[j], reverse=True):
        left = int(repeats[j])
        while left > 0:
            room, chosen = capacity, []
            for k, b in enumerate(wanted[j]):
                last = k == len(wanted[j]) - 1
                pick = stock.longest(room if last else min(room, b * width), 1 if last else (b - 1) * width + 1)
                if not pick or stock.counts[pick] <= chosen.count(pick):
                    break
                chosen.append(pick)
                room -= pick
            if len(chosen) < len(wanted[j]):
                break
            while (pick := stock.longest(room)) and stock.counts[pick] > chosen.count(pick):
                chosen.append(pick)
                room -= pick
            n = min([left, *(stock.counts[x] // chosen.count(x) for x in set(chosen))])
            for x in set(chosen):
                stock.take(x, n * chosen.count(x))
            entries.append((chosen, n))
            left -= n
    # the rest: a new sequence for the longest that is left, filled with the longest that fit
    work: list[tuple[list[int], int]] = []
    while work or stock.lengths:
        lengths, n = work.pop() if work else ([], 1 << 62)
        fit = stock.longest(capacity - sum(lengths))
        if not fit:
            entries.append((lengths, n))
            continue
        if not lengths:
            n = stock.counts[fit]
        m = min(n, stock.counts[fit])
        stock.take(fit, m)
        if m < n and lengths:
            work.append((lengths, n - m))
        work.append(([*lengths, fit], m))
    return entries


def _places(entries: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, sequence of that rank, and offset, by rank."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for lengths, n in entries:
        at = 0
        for length in lengths:
            first = given.get(length, 0)
            found.setdefault(length, []).append((first, sequence, at))
            given[length] = first + n
            at += length
        sequence += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in found.items()}


def _assign(places):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                first, start, at = places[int(length[rows[0]])]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                sequence[rows] = start[k] + rank[rows] - first[k]
                offset[rows] = at[k]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and its place there."""
    pieces = stage(token_pieces(docs, path, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = _places(plan(counts, capacity))
    parts = max(PARTS, sum(counts.values()) // PIECES_A_PART)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    before = (
        pieces.groupBy("length", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
        .drop("n")
    )
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece"))
    ranked = pieces.withColumn("within", within).join(before, ["length", "part"])
    return ranked.withColumn("rank", F.col("before") + F.col("within") - 1).mapInArrow(
        _assign(places),
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
