"""Centroid clustering (Lloyd's rounds on integer vectors) with bounds that geometry tightens.

Method.  Every vector keeps an upper bound of the distance to its own centroid and a lower bound of the distance to
all others.  When centroids move, the upper bound grows by the own centroid's drift.  The lower bound shrinks by
less than the largest drift: the vectors of a cluster lie in a sphere round its old centroid, and in the plane of that
centre, another centroid p and its new place q, no point of the sphere sees the way from p to q under an angle
smaller than (angle to the centre) - asin(radius / distance), so the distance to that centroid falls by at most
drift * cos(that angle); where the other centroid moves away the bound even rises.  Vectors whose upper bound stays
under the lower one (or under half the way to the next centroid) keep their cluster; for the rest the own distance
is worked out, and if that does not decide, all distances are, in exact integers.

Scale.  A round is one pass over the vectors, which are written with their bounds for the next one, so that lost
executors cost one task.  Tasks send k rows each of what changed: counts, sums and the radius of each cluster.  The
driver sees k centroids and no vector but the first k.  The files of the round before are deleted.

Defined results: vectors that are null, of another length, or with a null or non-finite component stay out;
components are floor(1024 x); vectors that share an id are each kept, a null id counts as the empty string where the
first centroids are drawn, and equal hashes go by components; with fewer vectors than centroids there are as many centroids as
vectors; a centroid without vectors stays; an empty table gives an empty result; a component of 131072 or more in
size raises ArithmeticError, as squared distances would not fit in 64 bits; other columns stay out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage

DIM = 64
K = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
#: Largest component: the difference of two is below 2^28, its square below 2^56, and 64 of those fit in 63 bits.
LARGEST = 1 << 27
#: Vectors that a task measures at once.
BLOCK = 4096
#: Share of a bound that rounding may take, far above what eleven rounds of doubles lose.
SLACK = 1e-9
ANGLE_SLACK = 1e-6

STATE = "vec_id bigint, x array<int>, cluster int, upper double, lower double, part int, n bigint, sums array<bigint>, radius double, scanned bigint"


def integers(table: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, x) of the vectors that count, as integers."""
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = rows.where((F.size("v") == dim) & finite)
    fits = F.forall("v", lambda x: F.abs(x) * SCALE < LARGEST)
    whole = F.transform("v", lambda x: F.floor(x * F.lit(float(SCALE))).cast("int"))
    return rows.select("vec_id", F.when(fits, whole).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))).alias("x"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors of smallest sha256 of ``seed:vec_id``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    chosen = vectors.select(F.sha2(name, 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in chosen], dtype=np.int64)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, how much nearer any other centroid may have come to any vector of its sphere."""
    k = len(old)
    out = np.full(k, -math.inf)
    for a in range(k):
        for j in range(k):
            if j == a:
                continue
            moved, aside = (new[j] - old[j]).astype(float), (old[a] - old[j]).astype(float)
            drift, away = math.sqrt(moved @ moved), math.sqrt(aside @ aside)
            fall = drift
            reach = radius[a] * (1 + SLACK)
            if drift and away > reach:
                to_centre = math.acos(max(-1.0, min(1.0, moved @ aside / (drift * away))))
                fall = drift * math.cos(max(0.0, to_centre - math.asin(reach / away) - ANGLE_SLACK))
            out[a] = max(out[a], fall)
    return out


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to each centroid."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray, radius: np.ndarray):
    """(cluster, upper, lower, scanned) after the centroids moved from ``old`` to ``new``; cluster -1: not yet known."""
    known = np.flatnonzero(cluster >= 0)
    upper, lower, cluster = upper.copy(), lower.copy(), cluster.copy()
    own = cluster[known]
    gaps = np.sqrt(squares(new, new).astype(float))
    np.fill_diagonal(gaps, math.inf)
    half = gaps.min(axis=1) / 2
    upper[known] = (upper[known] + np.sqrt(((new - old) ** 2).sum(axis=1).astype(float))[own]) * (1 + SLACK)
    lower[known] -= loosening(old, new, radius)[own]
    floor = np.maximum(lower[known], half[own])
    open_ = known[upper[known] >= floor * (1 - SLACK)]
    exact = np.sqrt(((x[open_] - new[cluster[open_]]) ** 2).sum(axis=1).astype(float))
    upper[open_] = exact * (1 + SLACK)
    floor = np.maximum(lower[open_], half[cluster[open_]])
    ambiguous = np.r_[open_[upper[open_] >= floor * (1 - SLACK)], np.flatnonzero(cluster < 0)]
    for at in range(0, len(ambiguous), BLOCK):
        i = ambiguous[at : at + BLOCK]
        d = squares(x[i], new)
        best = d.argmin(axis=1)
        row = np.arange(len(i))
        cluster[i], upper[i] = best, np.sqrt(d[row, best].astype(float)) * (1 + SLACK)
        d = d.astype(float)
        d[row, best] = math.inf
        lower[i] = np.sqrt(d.min(axis=1)) * (1 - SLACK)
    return cluster, upper, lower, len(ambiguous)


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, dim).astype(np.int64)


def _round(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass: rows with their new state, and for each task k rows of changed counts, sums and radii."""
    k, dim = new.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, far, scanned = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros(k), 0
        for batch in batches:
            x = _vectors(batch, dim)
            before = batch.column("cluster").to_numpy(zero_copy_only=False)
            bounds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("upper", "lower"))
            cluster, upper, lower, seen = assign(x, before, *bounds, old, new, radius)
            scanned += seen
            np.maximum.at(far, cluster, upper)
            moved = np.flatnonzero(cluster != before)
            np.add.at(n, cluster[moved], 1)
            np.add.at(sums, cluster[moved], x[moved])
            left = moved[before[moved] >= 0]
            np.subtract.at(n, before[left], 1)
            np.subtract.at(sums, before[left], x[left])
            none = pa.nulls(batch.num_rows)
            rows = [batch.column("vec_id"), batch.column("x"), pa.array(cluster), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays([*rows, *(none.cast(t) for t in (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.int64()))], names)
        empty = pa.nulls(k)
        head = [empty.cast(t) for t in (pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.float64(), pa.float64())]
        told = [pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array(list(sums), pa.list_(pa.int64())), pa.array(far)]
        yield pa.RecordBatch.from_arrays([*head, *told, pa.array(np.r_[scanned, np.zeros(k - 1, np.int64)])], names)

    names = [f.split()[0] for f in STATE.split(", ")]
    return run


def cluster_vectors(vectors: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, x, cluster) after ``rounds`` rounds and a last assignment, the centroids, and vectors scanned a round."""
    k, dim = centroids.shape
    start = vectors.select("vec_id", "x", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    state, old, radius = start, centroids, np.zeros(k)
    n, sums, scans = [0] * k, [[0] * dim for _ in range(k)], []
    for turn in range(rounds + 1):
        after = stage(state.mapInArrow(_round(old, centroids, radius), STATE), "centroids")
        if turn:
            discard(state)
        state = after.where("part IS NULL").select("vec_id", "x", "cluster", "upper", "lower")
        told = after.where("part IS NOT NULL").groupBy("part").agg(
            F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dim))).alias("sums"), F.max("radius").alias("radius"), F.sum("scanned").alias("scanned")
        )
        scans.append(0)
        for r in told.collect():
            n[r.part] += r.n
            sums[r.part] = [a + b for a, b in zip(sums[r.part], r.sums, strict=True)]
            radius[r.part] = r.radius
            scans[-1] += r.scanned
        if turn < rounds:
            old, centroids = centroids, np.array([[s // n[c] for s in sums[c]] if n[c] else list(centroids[c]) for c in range(k)], dtype=np.int64)
    return state.select("vec_id", "x", "cluster"), centroids, scans


def _distances(centroids: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            d = ((_vectors(batch, centroids.shape[1]) - centroids[cluster]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(d)], ["vec_id", "cluster", "distance"])

    return run


def clusters(table: DataFrame, k: int = K, dim: int = DIM, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that counts."""
    vectors = stage(integers(table, dim), "centroids-vectors")
    first = first_centroids(vectors, k, seed)
    if not len(first):
        schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return table.sparkSession.createDataFrame([], schema)
    found, centroids, _ = cluster_vectors(vectors, first, rounds)
    measured = found.mapInArrow(_distances(centroids), "vec_id bigint, cluster int, distance bigint")
    total = {r.cluster: int(r.d) for r in measured.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    inertia = of([F.lit(total.get(c, 0)).cast("bigint") for c in range(len(centroids))])
    return measured.select(
        "vec_id", "cluster", "distance", inertia.alias("cluster_inertia"), F.lit(sum(total.values())).cast("bigint").alias("inertia"), of(names).alias("centroid_sha256")
    )


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """Plain rounds: every vector against every centroid, ten times and once more."""
    steps = []
    for r in range(ROUNDS + 1):
        distance = f"list_sum(list_transform(range(1, {DIM + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT"
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT rid, cluster, {distance} AS d FROM v, c{r} c) GROUP BY rid)")
        steps.append(
            f"""c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
            SELECT cluster, list(floor_ ORDER BY i) AS x FROM (
                SELECT cluster, i, ((sum(val) - ((sum(val) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_
                FROM (SELECT cluster, unnest(range(1, {DIM + 1})) AS i, unnest(x) AS val FROM a{r} JOIN v USING (rid)) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster))"""
        )
    steps.pop()
    return f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIM}),
c0 AS MATERIALIZED (
    SELECT (row_number() OVER (ORDER BY h, x) - 1)::INT AS cluster, x FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT {K})),
{", ".join(steps)}
SELECT vec_id, cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c{ROUNDS}.x, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (rid) JOIN c{ROUNDS} USING (cluster)"""


ORACLE = _oracle()
