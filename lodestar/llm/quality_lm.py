"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model of trusted text.

Method.  Trusted documents (labelled good and not toxic) give bigram counts, each text once; counts, context
totals and continuation counts, dealt out by hash, give the discounted probabilities, context weights and
continuation probabilities of the model, which score every word of every document.  A document is kept if its
perplexity is at most the threshold of its language: the quantile over the n trusted documents of the language
that the model has not seen, drawn towards the quantile over those of all languages as the mean of logarithms
with weights n and ``POOLED``.  The rule is the same at every size; a language without such documents takes the
quantile over all languages.

Scale.  The model is learned from all trusted texts but those held out, and is nowhere whole (``learned``).
Texts lie in blocks of about ``BLOCK_BYTES``, by language and the text's hash.  A block asks each shard for its
distinct bigrams, with its own trusted counts; the shard adds them up and answers.  What sums over bigrams a word
needs is added up in the same way by shards of words: a bigram is counted for its words by the first block that
has it.  Counts of counts travel with these rows.  Blocks and shards grow in number with the corpus, not in
size; only the book of short names, of bounded size, is collected and broadcast.  ``train`` and ``perplexities`` are the model held in memory, for
trusted texts few enough for that; both give the same perplexities.

Defined results: a null or wordless text has null perplexity and is not kept; repeated rows are each
scored, in the language of their row; rows that share an id are trusted together if the id is; a null id
stays null and is never trusted; a null language is a language of its own; where no trusted document with
words is unseen there is nothing to judge by: the threshold is null and every document with words is kept;
empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, stage, text_batches
from .ngrams import Grams, TableHashes, WordHashes, bigram_hash

#: Bytes of the texts of a block, and partitions of blocks at least.
BLOCK_BYTES, LEAST_PARTITIONS = 13_000_000, 16
#: Words with short names (two are 36 bits), languages with blocks of their own, bytes of texts that a task bundles at once.
BOOK, MOST_LANGUAGES, BUNDLED_BYTES = 262144, 64, 64_000_000
#: Texts that a task remembers having sent; it forgets all of them at this number.
MEMORY = 500_000
#: One trusted document in so many, and always the first by hash, is left out of the model, for thresholds.
HELD_OUT = 5
QUANTILE = 0.99
#: How many documents of a language the quantile over all languages counts for.
POOLED = 20


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Grams]]:
    words = WordHashes()
    for batch in text_batches(batches):
        found = [words.of(t) for t in batch.column("text").to_pylist()]
        if found:
            yield batch, Grams(np.array([len(h) for h in found], np.int64), np.concatenate(found))


def _bigrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, g in _hashed(batches):
        n = np.bincount(g.pair_at, minlength=len(g.pairs))
        v, w = (g.words[x].view(np.int64) for x in np.divmod(g.pairs, max(len(g.words), 1)))
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(w), pa.array(n)], ["v", "w", "n"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more; plain halves where counts of counts are missing."""
    if not (n1 and n2 and n3):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return [min(max(d, 0.1), k) for d, k in zip(found, (0.9, 1.9, 2.9), strict=True)]


def _discount(d: list[float], c: str) -> str:
    return f"CASE WHEN {c} = 1 THEN {d[0]!r}D WHEN {c} = 2 THEN {d[1]!r}D ELSE {d[2]!r}D END"


def _spectrum(df: DataFrame, c: str) -> tuple[list[float], int, int]:
    """(discounts, rows, sum) of a count column."""
    r = df.agg(*(F.count_if(F.col(c) == k).alias(f"n{k}") for k in (1, 2, 3, 4)), F.count(F.lit(1)).alias("rows"), F.sum(c).alias("total")).first()
    return discounts(r["n1"], r["n2"], r["n3"], r["n4"]), r["rows"], r["total"] or 0


def train(trusted: DataFrame) -> dict[str, np.ndarray | float]:
    """The model's sorted tables: bigram shares, context weights, continuation probabilities."""
    counts = stage(trusted.select(F.col("text").cast("string").alias("text")).mapInArrow(_bigrams, "v bigint, w bigint, n bigint").groupBy("v", "w").agg(F.sum("n").alias("c")), "bigrams")
    d, _, _ = _spectrum(counts, "c")
    mass = F.expr(_discount(d, "c"))
    contexts = counts.groupBy("v").agg(F.sum("c").alias("total"), (F.sum(mass) / F.sum("c")).alias("weight"))
    follows = counts.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    e, n_words, n_types = _spectrum(follows, "n")
    shares = counts.join(contexts, "v").select("v", "w", ((F.col("c") - mass) / F.col("total")).alias("share")).toArrow()
    spread = follows.agg(F.sum(F.expr(_discount(e, "n")))).first()[0] or 0.0
    floor = (spread / n_types if n_types else 1.0) / (n_words + 1)
    lower = follows.select("w", ((F.col("n") - F.expr(_discount(e, "n"))) / F.lit(max(n_types, 1)) + F.lit(floor)).alias("p")).toArrow()
    weights = contexts.select("v", "weight").toArrow()

    def table(key: np.ndarray, value) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        return key[order], np.asarray(value, np.float64)[order]

    def column(t: pa.Table, name: str) -> np.ndarray:
        return t.column(name).to_numpy().view(np.uint64) if len(t) else np.zeros(0, np.uint64)

    pairs = bigram_hash(column(shares, "v"), column(shares, "w"))
    return {
        "bigram": table(pairs, shares.column("share")),
        "context": table(column(weights, "v"), weights.column("weight")),
        "word": table(column(lower, "w"), lower.column("p")),
        "floor": float(floor),
    }


def _look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, otherwise: float) -> np.ndarray:
    names, values = table
    if not len(names):
        return np.full(len(keys), otherwise)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return np.where(names[at] == keys, values[at], otherwise)


def log_probabilities(model: dict, g: Grams) -> np.ndarray:
    """Sum of the log-probabilities of each text's words."""
    return _log_sums(g, _look_up(model["word"], g.words, model["floor"]), _look_up(model["context"], g.words, 1.0), _look_up(model["bigram"], g.bigrams, 0.0))


def _log_sums(g: Grams, lower: np.ndarray, weight: np.ndarray, share: np.ndarray) -> np.ndarray:
    """From continuation probabilities and context weights of the words, and shares of the bigrams."""
    p = lower[g.at]
    p[g.second] = share[g.pair_at] + weight[g.at[g.second - 1]] * p[g.second]
    return np.bincount(g.doc, np.log(p), len(g.sizes))


def perplexities(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang, n_words, perplexity of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, g in _hashed(batches):
            with np.errstate(divide="ignore", invalid="ignore"):
                found = np.round(np.exp(-log_probabilities(shared.value, g) / g.sizes), 4)
            columns = [batch.column("doc_id"), batch.column("lang"), pa.array(g.sizes), pa.array(found, mask=g.sizes == 0)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "n_words", "perplexity"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang string, n_words bigint, perplexity double")


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers, compressed by place: the lowest bytes of all, then the next, so that small ones take little room."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _named(g: Grams, book: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Names of the words and bigrams, and which have short ones: a place in the book, or two, else the 64-bit hash."""
    at = np.searchsorted(book, g.words)
    short = book[np.minimum(at, len(book) - 1)] == g.words if len(book) else np.zeros(len(at), bool)
    v, w = np.divmod(g.pairs, max(len(g.words), 1))
    both = short[v] & short[w]
    return [(np.where(short, at.astype(np.uint64), g.words), short), (np.where(both, (at[v] * BOOK + at[w]).astype(np.uint64), g.bigrams), both)]


def _dealt(names: np.ndarray, short: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the n-grams by shard (``shards`` for hashes, then as many for short names) and name, and where in it each shard begins and ends."""
    shard = (names % np.uint64(shards)).astype(np.int32) + shards * short.astype(np.int32)
    order = np.argsort(names)
    order = order[np.argsort(shard[order], kind="stable")]
    return order, np.searchsorted(shard[order], np.arange(2 * shards + 1))


def _asks(block: int, names: np.ndarray, short: np.ndarray, counts: np.ndarray, shards: int, spectrum: list[int]) -> pa.Table:
    """(shard, block, gram, n, spectrum), a row for every shard: n-grams in order, their counts (a line for each kind)."""
    order, cuts = _dealt(names, short, shards)
    names = names[order] // np.uint64(shards)
    rows = [(s, block, _pack(np.diff(names[a:b], prepend=np.uint64(0))), _pack(counts[:, order[a:b]].ravel()), spectrum) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ASKED.types, strict=True)], _ASKED)


def _answered(table: pa.Table, order: np.ndarray, kinds: int) -> np.ndarray:
    """The shards' answers to ``_asks``, a line for each kind, in the order of the n-grams."""
    out = np.zeros((kinds, len(order)), np.int64)
    found = sorted(zip(table.column("shard").to_pylist(), table.column("n").to_pylist(), strict=True))
    out[:, order] = np.concatenate([_unpack(n, np.int64).reshape(kinds, -1) for _, n in found], axis=1)
    return out


def _sums(table: pa.Table, kinds: int) -> tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What blocks ask of a shard: blocks, n-grams of each, counts by n-gram and block, their order, the n-gram of each, sums."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("block", "gram", "n")), strict=True))
    grams = [np.cumsum(_unpack(g, np.uint64), dtype=np.uint64) for _, g, _ in rows]
    n = np.concatenate([_unpack(x, np.int64).reshape(kinds, -1) for *_, x in rows], axis=1)
    sizes = [len(g) for g in grams]
    grams = np.concatenate(grams)
    order = np.argsort(grams, kind="stable")
    fresh = np.diff(grams[order], prepend=np.uint64(0)) > 0
    fresh[:1] = True
    start = np.flatnonzero(fresh)
    return [b for b, *_ in rows], sizes, n, order, np.cumsum(fresh) - 1, np.add.reduceat(n[:, order], start, axis=1) if len(start) else n


def _replies(blocks: list[int], sizes: list[int], found: np.ndarray, kind: str, spectrum: list[int]) -> pa.Table:
    ends = np.cumsum(sizes)
    rows = [(b, kind, _pack(found[:, e - k : e].ravel()), spectrum) for b, k, e in zip(blocks, sizes, ends, strict=True)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _REPLY.types, strict=True)], _REPLY)


_ASKED = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("gram", pa.binary()), ("n", pa.binary()), ("spectrum", pa.list_(pa.int64()))])
_REPLY = pa.schema([("block", pa.int64()), ("kind", pa.string()), ("n", pa.binary()), ("spectrum", pa.list_(pa.int64()))])
_ASKED_DDL = "shard bigint, block bigint, gram binary, n binary, spectrum array<bigint>"
_REPLY_DDL = "block bigint, kind string, n binary, spectrum array<bigint>, shard bigint"


def _of_counts(c: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4, and how many there are."""
    return [*(int((c == k).sum()) for k in (1, 2, 3, 4)), len(c)]


def _ask_bigrams(shards: int, book: Broadcast):
    """The bigrams of a block's texts, and how often its trusted texts have each."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, trusted, g = _block_texts(table)
        n = np.bincount(g.pair_at, trusted[g.doc[g.second]], len(g.bigrams)).astype(np.int64)
        return _asks(key[0].as_py(), *_named(g, book.value)[1], n[None], shards, [])

    return run


def _count_bigrams(key: tuple, table: pa.Table) -> pa.Table:
    """Twice the count of each bigram in all trusted texts, and one more in the first block whose trusted texts have it."""
    blocks, sizes, n, order, which, total = _sums(table, 1)
    has = np.flatnonzero(n[0, order] > 0)
    owner = has[np.diff(which[has], prepend=-1) > 0]
    found = 2 * total[0, which]
    found[owner] += 1
    out = np.zeros_like(n)
    out[0, order] = found
    return _replies(blocks, sizes, out, "bigram", []).append_column("shard", pa.array([key[0].as_py()] * len(blocks), pa.int64()))


def _ask_words(shards: int, word_shards: int, book: Broadcast):
    """The words of a block's texts, with sums over the bigrams that the block is the first to have.

    As a context: sum of counts, bigrams of count 1, 2 and more; as a second word: bigrams.
    """

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        *_, g = _block_texts(texts)
        named, pairs = _named(g, book.value)
        found = _answered(replies, _dealt(*pairs, shards)[0], 1)[0]
        mine = (found & 1) == 1
        c, (v, w), words = found[mine] >> 1, np.divmod(g.pairs[mine], max(len(g.words), 1)), len(g.words)
        tally = [np.bincount(v, c, words), *(np.bincount(v[x], minlength=words) for x in (c == 1, c == 2, c > 2)), np.bincount(w, minlength=words)]
        return _asks(texts.column("block")[0].as_py(), *named, np.array(tally).astype(np.int64), word_shards, _of_counts(c))

    return run


def _count_words(key: tuple, table: pa.Table) -> pa.Table:
    """Sums over all blocks; counts of bigrams' counts (every block asks every shard), and of this shard's words' bigrams."""
    blocks, sizes, n, order, which, total = _sums(table, 5)
    n[:, order] = total[:, which]
    spectrum = np.sum(np.array(table.column("spectrum").to_pylist(), np.int64), axis=0).tolist() + _of_counts(total[4][total[4] > 0])
    return _replies(blocks, sizes, n, "word", spectrum).append_column("shard", pa.array([key[0].as_py()] * len(blocks), pa.int64()))


def _block_perplexities(shards: int, word_shards: int, book: Broadcast):
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        keys, _, g = _block_texts(texts)
        if len(keys):
            kind, (named, pairs) = replies.column("kind").to_pylist(), _named(g, book.value)
            of_words = replies.filter(pa.array([k == "word" for k in kind]))
            count = _answered(replies.filter(pa.array([k == "bigram" for k in kind])), _dealt(*pairs, shards)[0], 1)[0] >> 1
            total, *after, before = _answered(of_words, _dealt(*named, word_shards)[0], 5)
            spectra = np.array(of_words.column("spectrum").to_pylist(), np.int64)
            n_types, (e1, e2, _, _, n_words) = int(spectra[0, 4]), spectra[:, 5:].sum(axis=0).tolist()
            d, e = discounts(*spectra[0, :4].tolist()), discounts(*spectra[:, 5:9].sum(axis=0).tolist())
            spread = e[0] * e1 + e[1] * e2 + e[2] * (n_words - e1 - e2)
            floor = (spread / n_types if n_types else 1.0) / (n_words + 1)
            lower = (before - np.array([0.0, *e])[np.minimum(before, 3)]) / max(n_types, 1) + floor
            weight = np.where(total > 0, np.tensordot(d, after, 1) / np.maximum(total, 1), 1.0)
            v = g.pairs // max(len(g.words), 1)
            share = (count - np.array([0.0, *d])[np.minimum(count, 3)]) / np.maximum(total[v], 1)
            logs = _log_sums(g, lower, weight, share)
        else:
            logs = np.zeros(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            found = np.round(np.exp(-logs / g.sizes), 4)
        h1, h2 = (pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))
        block = pa.array([texts.column("block")[0].as_py()] * len(keys), pa.int64())
        return pa.table([block, h1, h2, pa.array(g.sizes), pa.array(found, mask=g.sizes == 0)], ["block", "h1", "h2", "n_words", "perplexity"])

    return run


def _bundles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, h1, h2, size, text): a task's texts, each but once, of a block together, as they take less room so."""
    press, known, held, room = zstandard.ZstdCompressor(level=10).compress, set(), {}, 0

    def bundles() -> pa.RecordBatch:
        rows = [(block, *zip(*((h1, h2, len(t)) for h1, h2, t in found), strict=True), press(b"".join(t for *_, t in found))) for block, found in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BUNDLE.types, strict=True)], schema=_BUNDLE)

    for batch in text_batches(batches):
        for block, h1, h2, text in zip(*(batch.column(c).to_pylist() for c in ("block", "h1", "h2", "text")), strict=True):
            if (block, h1, h2) not in known:
                known.add((block, h1, h2))
                held.setdefault(block, []).append((h1, h2, text.encode("utf-8", "surrogatepass")))
                room += len(held[block][-1][2])
        if room > BUNDLED_BYTES:
            yield bundles()
            room = 0
        if len(known) > MEMORY:
            known.clear()
    if held:
        yield bundles()


_BUNDLE = pa.schema([("block", pa.int64()), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int64())), ("size", pa.list_(pa.int64())), ("text", pa.binary())])
_BUNDLE_DDL = "block bigint, h1 array<bigint>, h2 array<bigint>, size array<bigint>, text binary"


def _block_texts(table: pa.Table) -> tuple[list[tuple[int, int]], np.ndarray, Grams]:
    """Keys of a block's texts, in order; which are trusted; and the n-grams of them all.  Rows without text mark trusted ones."""
    hashes, words, marks = {}, TableHashes(), set()
    for h1, h2, size, text in zip(*(table.column(c) for c in ("h1", "h2", "size", "text")), strict=True):
        keys, text = list(zip(h1.as_py(), h2.as_py(), strict=True)), text.as_py()
        if text is None:
            marks.update(keys)
            continue
        text, at = zstandard.decompress(text), 0
        for key, n in zip(keys, size.as_py(), strict=True):
            if key not in hashes:
                hashes[key] = words.of(text[at : at + n].decode("utf-8", "surrogatepass"))
            at += n
    keys = sorted(hashes)
    sizes = np.array([len(hashes[k]) for k in keys], np.int64)
    joined = np.concatenate([hashes.pop(k) for k in keys]) if keys else np.zeros(0, np.uint64)
    return keys, np.array([k in marks for k in keys], bool), Grams(sizes, joined)


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = TableHashes()
    for batch in text_batches(batches):
        found = [words.of(t) for t in batch.column("text").to_pylist()]
        w, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["w", "n"])


def _blocks(rows: DataFrame) -> tuple[Column, int]:
    """The block of each row, and how many there are: blocks of one language where it fills some, as its texts share n-grams."""
    size = F.sum(F.octet_length("text")).alias("size")
    total = rows.agg(size).first()[0] or 0
    # at most ``MOST_LANGUAGES`` rows
    own = [r for r in rows.groupBy("lang").agg(size).where("lang IS NOT NULL").orderBy(F.desc("size"), "lang").limit(MOST_LANGUAGES).collect() if r["size"] > BLOCK_BYTES]
    n = (total - sum(r["size"] for r in own)) // BLOCK_BYTES + 1
    block = F.pmod("h1", F.lit(n))
    for r in own:
        mine = round(r["size"] / BLOCK_BYTES)
        block = F.when(F.col("lang") == r["lang"], F.pmod("h1", F.lit(mine)) + n).otherwise(block)
        n += mine
    return F.coalesce(block, F.pmod("h1", F.lit(1))).cast("bigint"), n


def learned(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, perplexity of every document, under the model of all documents ``ids``; a text counts once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("second"), "text")})
    block, blocks = _blocks(rows)
    rows = rows.withColumn("block", block)
    # odd numbers of shards deal short names evenly
    shards, word_shards, parts = blocks // 4 * 2 + 1, blocks // 16 * 2 + 1, max(LEAST_PARTITIONS, 2 * blocks)
    # the book is made of about one block's worth of texts; it sets how n-grams are written, not what is counted
    some = rows.where(F.pmod("h2", F.lit(blocks)) == 0).select("text").mapInArrow(_word_counts, "w bigint, n bigint")
    book = some.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(BOOK).select("w").toArrow().column("w").to_numpy()
    book = docs.sparkSession.sparkContext.broadcast(np.sort(book.view(np.uint64)))
    marks = rows.select("doc_id", "block", "h1", "h2").join(ids.hint("merge"), "doc_id", "left_semi").groupBy("h1", "h2").agg(F.min("block").alias("block"))
    marks = marks.select("block", F.array("h1").alias("h1"), F.array("h2").alias("h2"), F.array(F.lit(0).cast("bigint")).alias("size"), F.lit(None).cast("binary").alias("text"))
    texts = rows.select("block", "h1", "h2", "text").mapInArrow(_bundles, _BUNDLE_DDL).union(marks).repartition(parts, "block")
    asked = texts.groupBy("block").applyInArrow(_ask_bigrams(shards, book), _ASKED_DDL).repartition(2 * shards, "shard")
    bigrams = asked.groupBy("shard").applyInArrow(_count_bigrams, _REPLY_DDL).repartition(parts, "block")
    asked = texts.groupBy("block").cogroup(bigrams.groupBy("block")).applyInArrow(_ask_words(shards, word_shards, book), _ASKED_DDL).repartition(2 * word_shards, "shard")
    words = asked.groupBy("shard").applyInArrow(_count_words, _REPLY_DDL).repartition(parts, "block")
    replies = bigrams.union(words)
    scored = texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_block_perplexities(shards, word_shards, book), "block bigint, h1 bigint, h2 bigint, n_words bigint, perplexity double")
    return rows.select("doc_id", "lang", "block", "h1", "h2").join(scored.hint("merge"), ["block", "h1", "h2"]).select("doc_id", "lang", "n_words", "perplexity")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold, kept of every document."""
    place = F.xxhash64("doc_id")
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    first = F.lit(good.agg(F.min_by("doc_id", place)).first()[0])
    good = stage(good.withColumn("seen", (F.pmod(place, F.lit(HELD_OUT)) != 0) & (F.col("doc_id") != first)), "trusted")
    scored = stage(learned(docs, good.where("seen").select("doc_id")), "perplexities")
    unseen = scored.join(good.where("NOT seen").select("doc_id", F.lit(True).alias("unseen")), "doc_id", "left")
    of_trusted = F.percentile_approx(F.when(F.col("unseen"), F.col("perplexity")), QUANTILE, 10000)
    pooled = F.lit(unseen.agg(of_trusted).first()[0]).cast("double")
    limits = unseen.groupBy("lang").agg(F.count_if(F.col("unseen") & F.col("perplexity").isNotNull()).alias("n"), of_trusted.alias("own"))
    drawn = F.exp((F.col("n") * F.log(F.coalesce("own", pooled)) + POOLED * F.log(pooled)) / (F.col("n") + POOLED))
    limits = limits.select(F.col("lang").alias("of"), F.round(drawn, 4).alias("threshold"))
    accepted = F.col("perplexity") <= F.coalesce("threshold", "perplexity")
    return scored.join(limits, scored.lang.eqNullSafe(limits.of), "left").select(
        "doc_id", "lang", "n_words", "perplexity", "threshold", F.coalesce(accepted, F.lit(False)).alias("kept")
    )


def op2_kneser_ney_quality(spark, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
