"""Word-piece counts by a linear longest-match automaton.

Method.  The pieces of a public vocabulary (as bytes, without the mark for word ends) form a trie.  Every
node has a failure link and the number of tokens that following it pops, worked out once; greedy
longest-match segmentation of a word then takes one pass over its bytes and builds no pieces.  Counts of
words already seen by a worker are remembered, up to a bound.

Every byte is a piece by itself in the given vocabularies, so every word can be segmented; with a vocabulary
where one can't be, the query fails with an error.  Words are runs of characters other than
ASCII white space; texts are lower-cased first.  Documents are counted where they lie, without a shuffle.

Defined results: a null or empty text has no words and no tokens; repeated rows and rows with a null or
repeated id are each counted; an empty
table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, text_batches
from .packing import TOKENIZER, byte_letters

#: Words that a Python worker remembers; it forgets all of them at this number.
MEMORY = 600_000


def vocabulary(path: str) -> set[bytes]:
    """The pieces of a byte-level vocabulary file as bytes."""
    from tokenizers import Tokenizer

    tokenizer, letters = Tokenizer.from_file(path), byte_letters()
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    return {bytes(letters[c] for c in t.removesuffix("</w>")) for t in tokenizer.get_vocab() if t not in special} - {b""}


class Automaton:
    """Trie with failure links and the tokens each link pops."""

    def __init__(self, pieces: Iterable[bytes]):
        self.child: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for b in piece:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    ends.append(False)
                node = self.child[node][b]
            ends[node] = True
        self.link, self.pops = [-1] * len(ends), [0] * len(ends)
        level = [0]
        while level:
            below = []
            for node in level:
                for b, v in self.child[node].items():
                    below.append(v)
                    if ends[v]:  # the path is a piece: pop it and start anew
                        self.link[v], self.pops[v] = 0, 1
                        continue
                    at, popped = self.link[node], self.pops[node]
                    while at >= 0 and b not in self.child[at]:
                        popped += self.pops[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[v], self.pops[v] = self.child[at][b], popped
            level = below

    def count(self, word: bytes) -> int:
        """Pieces of ``word`` under greedy longest match; -1 if it can't be segmented."""
        child, link, pops = self.child, self.link, self.pops
        node = total = 0
        for b in word:
            while (after := child[node].get(b)) is None:
                if link[node] < 0:
                    return -1
                total += pops[node]
                node = link[node]
            node = after
        while node:
            if link[node] < 0:
                return -1
            total += pops[node]
            node = link[node]
        return total


@functools.cache
def _automaton(path: str) -> tuple[Automaton, dict[bytes, int]]:
    return Automaton(vocabulary(path)), {}


def _counts(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _automaton(path)
        for batch in text_batches(batches):
            n_words, n_tokens = [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").lower().encode("utf-8", "surrogatepass").split()
                found = list(map(known.get, words))
                if None in found:
                    new = {w for w, f in zip(words, found, strict=True) if f is None}
                    if len(known) + len(new) > MEMORY:
                        known.clear()
                        new = set(words)
                    for w in new:
                        known[w] = automaton.count(w)
                        if known[w] < 0:
                            raise ValueError(f"{path} has no pieces for {w!r}")
                    found = [known[w] for w in words]
                n_words.append(len(words))
                n_tokens.append(sum(found))
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counts(path), "doc_id bigint, n_words bigint, n_tokens bigint")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
