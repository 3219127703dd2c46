"""Centroid clustering with annulus search, in whole numbers.

Centroids are sorted by norm. A vector's distance to the centroids next to it in norm bounds the distance to its nearest one, and by the triangle
inequality that one's norm lies within this bound of the vector's own: a binary search finds the centroids in the annulus, and only these are compared,
exactly. The annulus is a little wider than the bound, so centroids on its edge are compared too and ties go to the smaller number.
Workers send one row of sums a centroid; what the driver holds are the centroids.

Kept are vectors of ``dims`` components, none null, not finite or beyond 2 ** 21 (whose squared distances a long cannot hold).
Rows that repeat an id are vectors each; a null id is a vector too, and starts no cluster before one with an id. Vectors with one start hash are
taken in order of their components. With fewer vectors than centroids each is one; a table without vectors gives no
rows. Sums of distances beyond a long are null. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.shared import staged

LARGEST = 2.0**21


@dataclass(frozen=True)
class Clustering:
    """k centroids of dims whole components floor(scale * x), after so many rounds. pairs: comparisons that a worker lays out at once."""

    k: int = 16
    dims: int = 64
    scale: int = 64
    rounds: int = 3
    seed: int = 1
    pairs: int = 1 << 16


def whole_vectors(table: DataFrame, how: Clustering, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v of the vectors that are kept, their components as whole numbers."""
    kind = dict(table.select(F.col(vec_id).alias("vec_id")).dtypes)["vec_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), how.dims), False)
            batch = batch.filter(right)
            x = batch.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, how.dims)
            kept = (np.abs(x) <= LARGEST).all(axis=1)  # false for what is not a number
            v = np.floor(how.scale * x[kept]).astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * how.dims, pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept)), lists], ["vec_id", "v"])

    return table.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v")).mapInArrow(run, f"vec_id {kind}, v array<int>")


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def annulus(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the centroids by norm, and for each vector the first and the end of the places there that can be its nearest."""
    norms = np.sqrt((centroids * centroids).sum(axis=1).astype(float))
    order = np.argsort(norms, kind="stable")
    norms = norms[order]
    own = np.sqrt((v * v).sum(axis=1).astype(float))
    above = np.searchsorted(norms, own)
    near = [((v - centroids[order[np.clip(above - k, 0, len(norms) - 1)]]) ** 2).sum(axis=1) for k in (0, 1)]
    bound = np.sqrt(np.minimum(*near).astype(float))
    slack = 1e-9 * (own + bound) + 1e-6
    return order, np.searchsorted(norms, own - bound - slack), np.searchsorted(norms, own + bound + slack, "right")


def nearest_centroids(v: np.ndarray, centroids: np.ndarray, pairs: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid, ties to the smaller number."""
    order, first, end = annulus(v, centroids)
    many = end - first
    upto = np.cumsum(many)
    number, distance = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
    at = 0
    while at < len(v):
        before = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, before + pairs, "right")))
        m = many[at:stop]
        starts = np.cumsum(m) - m
        row = np.repeat(np.arange(at, stop), m)
        which = order[np.arange(len(row)) - np.repeat(starts, m) + first[row]]
        d = ((v[row] - centroids[which]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(d, starts)
        distance[at:stop] = least
        number[at:stop] = np.minimum.reduceat(np.where(d == np.repeat(least, m), which, len(order)), starts)
        at = stop
    return number, distance


def summed(vectors: DataFrame, centroids: np.ndarray, how: Clustering) -> dict[int, tuple[int, list[int]]]:
    """Of each centroid that is nearest to some vector, how many these are and their sums by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            v = matrix(batch.column(0), how.dims)
            number, _ = nearest_centroids(v, centroids, how.pairs)
            n += np.bincount(number, minlength=len(centroids))
            for c in np.unique(number):
                sums[c] += v[number == c].sum(axis=0)
        had = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(had), pa.array(n[had]), pa.array(sums[had].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = vectors.select("v").mapInArrow(run, "cluster long, n long, sums array<long>")
    every = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(how.dims)]).alias("sums"))
    return {r["cluster"]: (r["n"], r["sums"]) for r in every.collect()}  # at most k rows


def first_centroids(vectors: DataFrame, how: Clustering) -> np.ndarray:
    """The k vectors of the smallest hashes of seed and id."""
    turn = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["v"] for r in vectors.select(turn.alias("turn"), "v").orderBy(F.col("turn").asc_nulls_last(), "v").limit(how.k).collect()], np.int64).reshape(-1, how.dims)


def assigned(vectors: DataFrame, centroids: np.ndarray, how: Clustering) -> DataFrame:
    """vec_id, cluster, distance of vectors (vec_id, v)."""
    kind = dict(vectors.dtypes)["vec_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = nearest_centroids(matrix(batch.column(1), how.dims), centroids, how.pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def clustered(table: DataFrame, how: Clustering = Clustering()) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of the vectors of a table (vec_id, embedding), stored, and the centroids they are nearest to."""
    vectors = staged(whole_vectors(table, how), "vectors")
    centroids = first_centroids(vectors, how)
    for _ in range(how.rounds if len(centroids) else 0):
        for c, (n, sums) in summed(vectors, centroids, how).items():
            centroids[c] = [s // n for s in sums]
    return staged(assigned(vectors, centroids, how), "assigned"), centroids


def clusters(table: DataFrame, how: Clustering = Clustering()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector."""
    out, centroids = clustered(table, how)
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    named = table.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d"))
    every = sums.agg(F.sum("d").alias("all")).first()["all"]
    totals = sums.withColumn("all", F.lit(every).cast("decimal(38,0)")).join(named, "cluster").select("cluster", F.col("d").try_cast("long").alias("cluster_inertia"), F.col("all").try_cast("long").alias("inertia"), "centroid_sha256")
    return out.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
