"""Centroid clustering of quantised vectors, exact in integers.

1. A vector's components become integers, floor(scale * x). The first
   centroids are the vectors whose keys come first by a hash.
2. A round gives every vector the nearest centroid by
   |x|^2 - 2 x.c + |c|^2, the middle term as one matrix product for a block of
   vectors, in float64. The product is exact while every sum it can form stays
   below 2^53; a bound from the block's and the centroids' magnitudes is
   checked for each block, and blocks beyond it are computed in 64-bit
   integers or, beyond those, in Python's.
3. A task sums its vectors by cluster, as exact integers; tree aggregation of an RDD with a row for
   each task combines the sums; each centroid becomes the floored mean. The
   driver holds the centroids and their sums, whatever the input.

Defined results: a null vector, one of another length and one with a null or
non-finite component are left out; ties of distance go to the smaller number
of cluster; a centroid without vectors stays as it is; with fewer vectors than
clusters there are as many clusters as vectors; rows that repeat a key count
one by one (ordered by vector where the first centroids are chosen, a null key
as an empty one); a distance or sum beyond a long is null; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectrum.llm.common import written

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Vectors of a block.
BLOCK = 4096
EXACT_DOUBLE, EXACT_LONG = 1 << 53, 1 << 63

Centroids = list[list[int]]


def whole(vector: str, dims: int) -> Column:
    """Whether a vector has all its components, each a finite number."""
    finite = lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) == dims) & F.forall(vector, finite)


def quantised(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x), as float64 that hold integers."""
    return np.floor(np.asarray(column.flatten()).astype(np.float64).reshape(-1, dims) * scale)


def _integers(x: np.ndarray) -> np.ndarray:
    """Whole float64 values as Python integers."""
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def distances(x: np.ndarray, centroids: Centroids) -> np.ndarray:
    """Squared distances of rows x to all centroids: int64, or Python integers
    where 64 bits do not hold them."""
    largest = int(np.abs(x).max(initial=0)) + max((abs(v) for c in centroids for v in c), default=0)
    bound = x.shape[1] * largest**2  # no part of the sum is beyond it
    if bound < EXACT_DOUBLE:
        c = np.array(centroids, np.float64)
        return ((x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    if 4 * bound < EXACT_LONG:
        y, c = x.astype(np.int64), np.array(centroids, np.int64)
    else:
        y, c = _integers(x), np.array(centroids, object).reshape(len(centroids), -1)
    return (y * y).sum(1)[:, None] - 2 * (y @ c.T) + (c * c).sum(1)[None, :]


def nearest(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smallest of equals) and distance."""
    all_of = distances(x, centroids)
    cluster = all_of.argmin(1) if len(all_of) else np.zeros(0, np.int64)
    return cluster, all_of[np.arange(len(x)), cluster]


def cluster_sums(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Exact sums of the rows of each cluster, as Python integers."""
    bound = len(x) * (int(np.abs(x).max(initial=0)) + 1)
    if bound < EXACT_DOUBLE:
        return ((cluster[None, :] == np.arange(k)[:, None]).astype(np.float64) @ x).astype(np.int64).astype(object)
    out = np.zeros((k, x.shape[1]), object)
    np.add.at(out, cluster, _integers(x))
    return out


def _blocks(batches: Iterator[pa.RecordBatch], at: int, dims: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for row in range(0, len(batch), BLOCK):
            part = batch.slice(row, BLOCK)
            yield part, quantised(part.column(at), dims, scale)


def _first_centroids(rows: DataFrame, clusters: int, scale: int, dims: int, seed: int) -> Centroids:
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    found = rows.orderBy(name, "id", "v").limit(clusters).toArrow()
    return [[int(v) for v in row] for row in quantised(found.column("v").combine_chunks(), dims, scale).tolist()] if len(found) else []


def _round(rows: DataFrame, centroids: Centroids, scale: int) -> Centroids:
    """The centroids after one assignment of all rows."""
    k, dims = len(centroids), len(centroids[0])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for _, x in _blocks(batches, 0, dims, scale):
            cluster, _ = nearest(x, centroids)
            sums += cluster_sums(x, cluster, k)
            counts += np.bincount(cluster, minlength=k)
        yield pa.RecordBatch.from_pydict({"part": [pickle.dumps((sums.tolist(), counts.tolist()))]})

    def add(total: tuple | None, more: tuple | None) -> tuple | None:
        if total is None or more is None:
            return more if total is None else total
        (a, m), (b, n) = total, more
        return [[x + y for x, y in zip(p, q, strict=True)] for p, q in zip(a, b, strict=True)], [x + y for x, y in zip(m, n, strict=True)]

    parts = rows.select("v").mapInArrow(summed, "part binary").rdd.map(lambda row: pickle.loads(bytes(row[0])))
    total = parts.treeAggregate(None, add, add, depth=2)
    if total is None:
        return centroids
    return [[s // n for s in row] if n else old for row, n, old in zip(*total, centroids, strict=True)]


def digest(centroid: list[int]) -> str:
    return sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, Centroids]:
    """(key, cluster, distance) of every whole vector, and the final centroids."""
    rows = vectors.where(whole(vector, dims)).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    schema = rows.select("id").schema.add("cluster", "integer").add("distance", "long")
    centroids = _first_centroids(rows, clusters, scale, dims, seed)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", key), []
    for _ in range(rounds):
        centroids = _round(rows, centroids, scale)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 1, dims, scale):
            of, distance = nearest(x, centroids)
            fits = [d if d < EXACT_LONG else None for d in distance.tolist()] if distance.dtype == object else distance
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(of.astype(np.int32)), pa.array(fits, pa.int64())], names=schema.names)

    return rows.mapInArrow(assigned, schema).withColumnRenamed("id", key), centroids


def report(vectors: DataFrame, key: str = "vec_id", **options: object) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of
    every whole vector; options: those of ``cluster``."""
    found, centroids = cluster(vectors, key, **options)
    found = written(found, "clusters")
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = dict(found.groupBy("cluster").agg(total.alias("sum")).collect())  # a row for each cluster
    long = lambda x: None if x is None or x >= EXACT_LONG else x
    exact = {c: None if s is None else int(s) for c, s in sums.items()}
    inertia = None if None in exact.values() else sum(exact.values())
    rows = [(c, long(exact.get(c, 0)), long(inertia), digest(v)) for c, v in enumerate(centroids)]
    about = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
