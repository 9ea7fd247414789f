"""Words and bigrams of batches of texts as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words that a Python worker remembers the hash of; it forgets all of them at this number.
MEMORY = 600_000
#: Bytes of a word that have numbers of their own (fixed value).
LONG = 64
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class WordHashes:
    """Hashes of the words of texts; words are lower-cased runs of characters other than ASCII white space."""

    def __init__(self):
        self._known: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        words, known = (text or "").lower().encode("utf-8", "surrogatepass").split(), self._known
        found = list(map(known.get, words))
        if None in found:
            new = set(words)
            if len(known) + len(new) > MEMORY:
                known.clear()
            known.update((w, xxhash.xxh64_intdigest(w)) for w in new)
            found = [known[w] for w in words]
        return np.array(found, np.uint64)


class TableHashes:
    """Other hashes of the same words, for texts of which each is read but once; no word is remembered.

    Tabulation hashing: the exclusive or of a fixed random number for each byte and its place.  Words longer
    than ``LONG`` bytes are hashed as a whole.
    """

    def __init__(self):
        cells = (xxhash.xxh64_intdigest(bytes([at, byte])) for at in range(LONG) for byte in range(256))
        self._cells = np.fromiter(cells, np.uint64, LONG * 256)
        self._solid = np.array([chr(byte) not in " \t\n\v\f\r" for byte in range(256)])

    def of(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
        solid = self._solid[data]
        edges = np.flatnonzero(np.diff(np.r_[False, solid, False]))
        start, size = edges[::2], edges[1::2] - edges[::2]
        if not len(start):
            return np.zeros(0, np.uint64)
        first = np.cumsum(size) - size
        place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
        found = np.bitwise_xor.reduceat(self._cells[np.minimum(place, LONG - 1) * 256 + data[solid]], first)
        for i in np.flatnonzero(size > LONG):
            found[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]].tobytes())
        return found


def bigram_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A bigram's hash from its words' hashes (uint64)."""
    h = (first * _MULTIPLY ^ (first >> np.uint64(31))) + second
    return (h ^ (h >> np.uint64(29))) * _MULTIPLY


class Grams:
    """Distinct words and bigrams of several texts, and where their words have them.

    ``sizes``: words of each text; ``hashes``: all words' hashes in order.
    """

    def __init__(self, sizes: np.ndarray, hashes: np.ndarray):
        self.sizes = sizes
        self.words, at = np.unique(hashes, return_inverse=True)
        self.at = at.astype(np.int32)
        del at
        first = np.zeros(len(hashes), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        self.second = np.flatnonzero(~first).astype(np.int32)  # positions that end a bigram
        n = max(len(self.words), 1)
        pair = self.at[self.second - 1].astype(np.int64)
        pair *= n
        pair += self.at[self.second]
        self.pairs, at = np.unique(pair, return_inverse=True)
        self.pair_at = at.astype(np.int32)
        del at, pair
        a, b = np.divmod(self.pairs, n)
        self.bigrams = bigram_hash(self.words[a], self.words[b])
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    def of_doc(self, doc: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """For each position, how often its text has its n-gram; ``doc``: the text of each position, in order."""
        out = np.zeros(len(gram), np.int64)
        cuts = np.r_[0, np.flatnonzero(np.diff(doc)) + 1, len(doc)]
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            _, where, counts = np.unique(gram[s:e], return_inverse=True, return_counts=True)
            out[s:e] = counts[where]
        return out
