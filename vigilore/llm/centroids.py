"""Centroid clustering of integer vectors by scalar lookup tables.

Components become ``floor(scale * x)``.  In every round a task tabulates, for each
dimension, the squared difference of every integer that occurs there to every
centroid; the distances of its vectors are gathers from these tables and their sums.
A task returns sums and counts for at most ``k`` clusters, so ``k * dim`` rows reach
the driver in a round whatever the number of vectors; the new centroids (exact floor
of sum by count) go out with the next round.

Defined cases: vectors that are null, have another length than ``dim`` or hold null or
non-finite components take no part; nor do those with an integer beyond ``MOST``, whose
distances a long cannot hold.  A zero vector takes part.  The first centroids are the
vectors with the smallest SHA-256 of ``<seed>:<id>``; equal ids go by their components,
null ids come last.  Fewer vectors than ``k`` make fewer centroids.  Equal distances go to
the smaller cluster; a cluster without vectors keeps its centroid.  Repeated rows are
vectors of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize

CLUSTERS = 40
ROUNDS = 5
DIM = 64
SCALE = 256
SEED = 2
#: Largest size of an integer component: 64 squared differences of twice this fit into a long.
MOST = 1 << 27
BATCH = 4096


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of every row of ``x`` to every centroid, gathered from one table a dimension."""
    out = np.zeros((len(x), len(centroids)), np.int64)
    for d in range(x.shape[1]):
        values, at = np.unique(x[:, d], return_inverse=True)
        table = (values[:, None] - centroids[None, :, d]) ** 2
        out += table[at]
    return out


def _vectors(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            b = batch.slice(start, BATCH)
            yield b.column(0), b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _sums(centroids: np.ndarray):
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for _, x in _vectors(batches, dim):
            nearest = squared_distances(x, centroids).argmin(1)
            order = np.argsort(nearest, kind="stable")
            met, first = np.unique(nearest[order], return_index=True)
            totals[met] += np.add.reduceat(x[order], first)
            counts += np.bincount(nearest, minlength=k)
        own = np.flatnonzero(counts)
        columns = [np.repeat(own, dim), np.tile(np.arange(dim), len(own)), totals[own].reshape(-1), np.repeat(counts[own], dim)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["cluster", "d", "total", "n"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _vectors(batches, centroids.shape[1]):
            apart = squared_distances(x, centroids)
            nearest = apart.argmin(1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(nearest, pa.int32()), pa.array(apart[np.arange(len(x)), nearest], pa.int64())], names=["id", "cluster", "distance"])

    return run


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """(id, v) with ``v`` an array of ``dim`` integers, of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) <= MOST))
    return vectors.where(fine).select(F.col(id_col).alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("int")).alias("v"))


def first_centroids(whole: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of their ids; at most ``k`` rows come to the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = whole.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid) of every vector that takes part."""
    spark = vectors.sparkSession
    whole = materialize(integer_vectors(vectors, id_col, vector_col, dim, scale), "integer-vectors")
    centroids = first_centroids(whole, k, seed)
    if not len(centroids):
        centroids = np.zeros((1, dim), np.int64)  # no vector is there to be assigned to it
    for _ in range(rounds):
        sums = whole.mapInArrow(_sums(centroids), "cluster int, d int, total long, n long")
        moved = centroids.copy()
        for r in sums.groupBy("cluster", "d").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            moved[r.cluster, r.d] = r.total // r.n
        if (moved == centroids).all():
            break
        centroids = moved
    kind = whole.schema["id"].dataType.simpleString()
    assigned = materialize(whole.mapInArrow(_assign(centroids), f"id {kind}, cluster int, distance long"), "assigned")
    inertia = {r.cluster: r.d for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    # One row a cluster, at most k: safe to broadcast.
    rows = [(i, inertia.get(i, 0), sum(inertia.values()), digest(c), c.tolist()) for i, c in enumerate(centroids)]
    of = F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"))
    return assigned.join(of, "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
