"""Hashes of words."""

import time

import numpy as np

from lodestar.llm import lm_scoring, ngrams


def test_table_hashes_tell_the_same_words_apart_as_the_split():
    texts = ["", None, " ", "a", " b a\x1cc\x85   A \t", "x" * 64 + " " + "x" * 65 + " " + "x" * 66, "\ud800 q Ä ä", "ab ba aa b a", "\x00 \x00\x00 a\x00"]
    hashes, known = ngrams.TableHashes(), {}
    for t in texts:
        words = (t or "").lower().encode("utf-8", "surrogatepass").split()
        found = hashes.of(t).tolist()
        assert len(found) == len(words)
        for w, h in zip(words, found):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_hashing_words_costs_less_than_remembering_them():
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 10**7, 800))) for _ in range(300)]
    seconds = []
    for kind in (ngrams.WordHashes, lm_scoring.TableHashes):
        hashes, began = kind(), time.process_time()
        for t in texts:
            hashes.of(t)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 0.8 * seconds[0]


def test_the_count_of_words_is_that_of_the_split(spark):
    texts = ["", None, " ", "  ", "a", " a", "a ", " a b ", "\t\n", "\x0b a\x0c", "a\x85b c", "ä   b"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("coalesce(text, '') AS text").coalesce(1)
    got = [r[0] for r in rows.select(lm_scoring.n_words()).collect()]
    assert got == [len((t or "").encode().split()) for t in texts]
