"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Method.  Lower-cased texts become counts of hashed character 1- to 3-grams, weighted by TF-IDF.  A
multinomial logistic regression is trained by follow-the-regularised-leader with an elastic-net penalty,
which keeps it sparse, and its scores are calibrated by one temperature, fitted on a part of the sample
that training leaves out.  The classifier is fitted on a bounded sample of labelled rows: the languages of
most rows (``MOST_LANGUAGES``; a dirty column may hold any number of values, which are never predicted) and
``FIT_ROWS_PER_LANGUAGE`` distinct texts of each, by the text's hash, as long as the languages' shares of
``FIT_TERMS`` n-gram counts last: that bounds what the driver holds, however long the texts.  Every whole text of the table is
predicted, where it lies, without a shuffle.

Defined results: a null text and one without a letter (Unicode category L) are ``und`` with score 0, as is
every text where there is nothing to learn from; repeated rows are each predicted; a null id stays null,
is not held out and takes no part in training; an empty table gives an empty result; training reads only
``text`` and ``lang`` (and ``doc_id`` for the folds), prediction only ``text``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, sample_texts, stage, text_batches

BITS, ORDERS = 16, 3
FIT_ROWS_PER_LANGUAGE = 500
MOST_LANGUAGES = 200
#: Distinct n-grams of all texts of the sample, dealt equally among its languages.
FIT_TERMS = 12_000_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: One row in so many of the sample fits the temperature alone.
CALIBRATION = 5
UNKNOWN = "und"
_MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def ngrams(text: str) -> np.ndarray:
    """Hashed character n-grams of a text, in order of length."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(min(ORDERS, len(c))):
        h = (h[: len(c) - n] + c[n:]) * np.uint32(_MIX[n])
        out.append(h >> np.uint32(32 - BITS))
        h = h ^ (h >> np.uint32(15))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches):
        rows = [np.unique(ngrams(t), return_counts=True) for t in batch.column("text").to_pylist()]
        terms = pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32()))
        counts = pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h_"), terms, counts], ["lang", "h_", "terms", "counts"])


def sample(docs: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, terms, counts) of at most FIT_ROWS_PER_LANGUAGE texts of each language, held-out rows excluded."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND crc32(cast(doc_id AS string)) % 4 <> 2").select(F.col("lang").cast("string").alias("lang"), "text")
    largest = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not largest:
        return []
    languages = [r["lang"] for r in largest]
    chosen = sample_texts(known, FIT_ROWS_PER_LANGUAGE, "lang", languages)
    counted = stage(chosen.mapInArrow(_counted, "lang string, h_ bigint, terms array<int>, counts array<int>"), "language-sample")
    upto = F.sum(F.size("terms")).over(Window.partitionBy("lang").orderBy("h_"))
    within = counted.select("lang", "h_", (upto - F.size("terms")).alias("before")).where(F.col("before") < FIT_TERMS // len(languages))
    rows = counted.join(within, ["lang", "h_"], "left_semi").where("size(terms) > 0").select("lang", "terms", "counts").toArrow().combine_chunks()
    found = []
    for batch in rows.to_batches():
        terms, counts = (batch.column(c) for c in ("terms", "counts"))
        cuts = terms.offsets.to_numpy()
        t, c = terms.values.to_numpy(), counts.values.to_numpy()
        found += [(lang, t[s:e], c[s:e]) for lang, s, e in zip(batch.column("lang").to_pylist(), cuts[:-1], cuts[1:], strict=True)]
    return sorted(found, key=lambda r: (int(r[1].astype(np.int64) @ r[2]), len(r[1]), r[0]))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 1) -> tuple[list[str], np.ndarray]:
    """(languages, weights by hashed n-gram and language): a text's mean weight is its calibrated score."""
    languages = sorted({r[0] for r in rows})
    df = np.zeros(1 << BITS)
    for _, t, _ in rows:
        df[t] += 1
    idf = np.log((len(rows) + 1) / (df + 1)) + 1
    data = [(languages.index(lang), t, (c / c.sum() * idf[t])) for lang, t, c in rows]
    data = [(y, t, v / np.sqrt(v @ v) , np.sqrt(v @ v)) for y, t, v in data]
    scale = 1 / np.mean([s for *_, s in data])  # mean weights stand in for each text's own norm
    data = [(y, t, v * s * scale) for y, t, v, s in data]
    order = np.random.default_rng(seed).permutation(len(data))
    held = [data[i] for i in order[::CALIBRATION]] if len(data) >= 2 * CALIBRATION else data
    fit = [data[i] for k, i in enumerate(order) if k % CALIBRATION] if len(data) >= 2 * CALIBRATION else data
    z, n = np.zeros((1 << BITS, len(languages))), np.zeros((1 << BITS, len(languages)))

    def weights(zt: np.ndarray, nt: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zt) <= L1, 0.0, -(zt - np.sign(zt) * L1) / ((BETA + np.sqrt(nt)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for y, t, v in fit:
            w = weights(z[t], n[t])
            miss = _softmax(v @ w)
            miss[y] -= 1
            g = v[:, None] * miss
            grown = n[t] + g * g
            z[t] += g - (np.sqrt(grown) - np.sqrt(n[t])) / ALPHA * w
            n[t] = grown
    w = weights(z, n)
    scores = np.array([v @ w[t] for _, t, v in held])
    truth = np.array([y for y, *_ in held])
    losses = [
        (-np.log(_softmax(scores / temperature)[np.arange(len(truth)), truth] + 1e-12).mean(), temperature)
        for temperature in np.exp(np.linspace(np.log(0.02), np.log(5), 60))
    ]
    return languages, (idf[:, None] * scale * w / min(losses)[1]).astype(np.float32)


def predict(languages: list[str], weights: np.ndarray, text: str | None) -> tuple[str, float]:
    if not text or not languages or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    total, at, grams = np.zeros(len(languages)), 0, ngrams(text)
    for at in range(0, len(grams), 1 << 18):
        total += weights[grams[at : at + (1 << 18)]].sum(axis=0)
    p = _softmax(total / len(grams))
    best = int(p.argmax())
    return languages[best], float(p[best])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    # at most MOST_LANGUAGES weights for each of 65,536 n-grams
    model = docs.sparkSession.sparkContext.broadcast(train(found) if (found := sample(docs)) else ([], np.zeros((1 << BITS, 0), np.float32)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            got = [predict(*model.value, t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.expr("coalesce(crc32(cast(doc_id AS string)) % 4 = 2, false)").alias("held_out")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
