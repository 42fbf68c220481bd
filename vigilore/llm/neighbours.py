"""Approximate nearest neighbours by cross-polytope hashing.

Each table rotates the unit vectors with three rounds of random signs and a fast
Hadamard transform and files them under the nearest signed axis (2 * dim buckets).
A query looks into the buckets of its ``probes`` nearest signed axes in every
table; all vectors found are ranked exactly on the original vectors in double
precision.  Buckets are cut into blocks of bounded size on both sides, so a bucket
with a third of all vectors is compared block by block and a task returns at most
``k`` rows for a query, never its candidates.

A query that finds fewer than ``ENOUGH * k`` vectors looks into all buckets of one
table, hence at every vector, with the same blocks: small tables are searched exactly.

Hashing sees angles, the ranking inner products; with unequal lengths the probes are
wide enough all the same (see the README for the recall measured).

Defined cases: vectors that are null, zero, or hold null or non-finite components
take no part, neither do vectors whose length is not ``dim`` (by default the most
common length of the table); equal scores go to the smaller id; fewer than ``k``
candidates are all returned; repeated ids are one candidate (the best score) and one
query (the best of its vectors); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize

TABLES = 16
PROBES = 12
ENOUGH = 3
SEED = 20
INDEX_BLOCK = 8192
QUERY_BLOCK = 1024


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x


def signed_axes(vectors: np.ndarray, table: int, probes: int, seed: int = SEED) -> np.ndarray:
    """The ``probes`` nearest signed axes of each row, nearest first."""
    n, dim = vectors.shape
    d = 1 << max(0, (dim - 1).bit_length())
    x = np.zeros((n, d))
    x[:, :dim] = vectors / np.abs(vectors).max(1, keepdims=True)  # first, so that squares stay finite
    x[:, :dim] /= np.linalg.norm(x, axis=1, keepdims=True)
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, d))
    for s in signs:
        x = _hadamard(x * s)
    both = np.concatenate([x, -x], 1)
    if probes == 1:
        return both.argmax(1)[:, None]
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def _hash(tables: int, probes: int, dim: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 2048):
                b = batch.slice(part, 2048)
                ids = b.column(0).to_numpy()
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                blob = np.array([v.tobytes() for v in x], object)
                for t in range(tables):
                    axes = signed_axes(x, t, probes, seed)
                    p = axes.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x) * p, t, np.int32)), pa.array(axes.reshape(-1).astype(np.int32)), pa.array(np.repeat(ids, p)), pa.array(np.repeat(blob, p), pa.binary())], names=["tab", "bucket", "id", "vec"])

    return run


def _rank(k: int, dim: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if index.num_rows and queries.num_rows:
            ids, asked = index["id"].to_numpy(), queries["id"].to_numpy()
            x = np.frombuffer(b"".join(index["vec"].to_pylist()), np.float64).reshape(-1, dim)
            q = np.frombuffer(b"".join(queries["vec"].to_pylist()), np.float64).reshape(-1, dim)
            near = q @ x.T
            # Blocked products may differ from row sums by so much.
            slack = 1e-12 * dim * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
            near[asked[:, None] == ids[None, :]] = -np.inf
            for i in range(len(q)):
                s = near[i]
                # What is close to the k-th is summed again row by row.
                least = -np.inf if len(s) <= k else np.partition(s, len(s) - k)[len(s) - k] - slack[i]
                c = np.flatnonzero((s >= least) & (s > -np.inf))
                exact = (x[c] * q[i]).sum(1)
                c_ids = ids[c]
                best = np.lexsort((c_ids, -exact))[:k]
                out.append((np.full(len(best), asked[i]), c_ids[best], exact[best]))
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _meet(index: DataFrame, probe: DataFrame, k: int, dim: int) -> DataFrame:
    """(query_id, vec_id, score): the ``k`` best of every query in every block of the buckets that it looks into."""
    # At most tables * 2 * dim rows by construction, whatever the input: safe to broadcast.
    blocks = lambda df, size, name: df.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = F.broadcast(blocks(index, INDEX_BLOCK, "ni").join(blocks(probe, QUERY_BLOCK, "nq"), ["tab", "bucket"]))
    salt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(sizes, ["tab", "bucket"]).select("tab", "bucket", "id", "vec", salt("ni").alias("bi"), all_of("nq").alias("bq"))
    right = probe.join(sizes, ["tab", "bucket"]).select("tab", "bucket", "id", "vec", salt("nq").alias("bq"), all_of("ni").alias("bi"))
    by = ["tab", "bucket", "bi", "bq"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_rank(k, dim), "query_id long, vec_id long, score double")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame, dim: int | None = None, k: int = 20, tables: int = TABLES, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, itself excluded."""
    schema = "tab int, bucket int, id long, vec binary"
    own, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    if dim is None:  # one row
        common = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        dim = common["d"] if common else 1
    own, asked = own.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    found = materialize(_meet(own.mapInArrow(_hash(tables, 1, dim, seed), schema), asked.mapInArrow(_hash(tables, probes, dim, seed), schema), k, dim), "neighbours")
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= ENOUGH * k).select(F.col("query_id").alias("id"))
    few = materialize(asked.join(enough, "id", "left_anti"), "few-found")
    if not few.isEmpty():
        all_ = _meet(own.mapInArrow(_hash(1, 1, dim, seed), schema), few.mapInArrow(_hash(1, 2 << (dim - 1).bit_length(), dim, seed), schema), k, dim)
        found = found.unionByName(all_).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
