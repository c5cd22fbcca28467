"""Centroid clustering whose nearest centroids are found by the threshold algorithm.

For each dimension the centroids stand in a list sorted by their value. A vector enters each list at its own value and walks outward, to the nearer side first, one
centroid a step in every list. A centroid met for the first time gets its exact distance. No centroid that hasn't been met can be nearer than the sum of the squared
steps at which the lists stand; so the walk ends when this sum strictly exceeds the best exact distance (strictly, so that a tie with a smaller number isn't missed), or when all have been met.

A round sends the centroids to the tasks (``k`` vectors), which return one sum per centroid; no vector is moved. Defined cases: vectors that are null, have other than
``dims`` components, or hold a null or non-finite one are left out; repeated rows count each; rows without an id come last in the order of first centroids; ties of that order go by the vector; with fewer
vectors than ``k`` there are as many centroids; an empty table gives an empty result. Columns besides id and vector play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import rows_of, takes_part, whole

FAR = 1 << 29


class SortedLists:
    """Each dimension's centroids by value, with a stop at either end."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k, dims = centroids.shape
        order = np.argsort(centroids, axis=0, kind="stable")
        self.numbers = np.zeros((dims, k + 2), np.int64)
        self.numbers[:, 1:-1] = order.T
        self.values = np.full((dims, k + 2), FAR, np.int64)
        self.values[:, 0] = -FAR
        self.values[:, 1:-1] = np.take_along_axis(centroids, order, 0).T

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``x`` the nearest centroid's number (the smallest of those as near) and the squared distance."""
        n, dims = x.shape
        k, every = len(self.centroids), np.arange(dims)
        above = np.stack([np.searchsorted(self.values[d], x[:, d]) for d in range(dims)], 1)
        below = above - 1
        met = np.zeros((n, k), bool)
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k, np.int64)
        walking = np.arange(n)
        while len(walking):
            own, lo, hi = x[walking], below[walking], above[walking]
            down, up = own - self.values[every, lo], self.values[every, hi] - own
            lower = down <= up
            frontier = (np.where(lower, down, up) ** 2).sum(1)
            there = np.zeros((len(walking), k), bool)
            there[np.arange(len(walking))[:, None], self.numbers[every, np.where(lower, lo, hi)]] = True
            there &= ~met[walking]
            met[walking] |= there
            row, c = np.nonzero(there)
            far = np.full((len(walking), k), np.iinfo(np.int64).max)
            far[row, c] = ((own[row] - self.centroids[c]) ** 2).sum(1)
            first = far.argmin(1)
            found = far[np.arange(len(walking)), first]
            better = (found < best[walking]) | ((found == best[walking]) & (first < number[walking]))
            best[walking[better]], number[walking[better]] = found[better], first[better]
            below[walking], above[walking] = lo - lower, hi + ~lower
            walking = walking[(frontier <= best[walking]) & ~met[walking].all(1)]
        return number, best


def _pieces(batches: Iterator[pa.RecordBatch], column: str, dims: int, rows: int = 512) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            yield part, rows_of(part.column(column), dims)


def _sums(lists: SortedLists):
    k, dims = lists.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x in _pieces(batches, "x", dims):
            number, _ = lists.nearest(x)
            np.add.at(count, number, 1)
            np.add.at(total, number, x)
        some = np.flatnonzero(count)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assigned(lists: SortedLists):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _pieces(batches, "x", lists.centroids.shape[1]):
            number, distance = lists.nearest(x)
            yield pa.record_batch([part.column("id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` rows of (id, x) with the smallest sha256 of seed and id, in that order."""
    rank = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    rows = vectors.select(rank.alias("rank"), "x").orderBy(F.col("rank").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floored means of their vectors; those without vectors stay. A row for each centroid and dimension goes to the driver."""
    sums = vectors.select("x").mapInArrow(_sums(SortedLists(centroids)), "cluster int, n bigint, sums array<bigint>")
    means = sums.select("cluster", "n", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(30,0)")).alias("s"))
    out = centroids.copy()
    for r in means.collect():
        out[r.cluster, r.d] = int(r.s) // r.n
    return out


def clustered(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5, seed: str = "2:") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that takes part."""
    id_type = df.schema[id_col].dataType.simpleString()
    vectors = stored(df.where(takes_part(F.col(vector_col), dims)).select(F.col(id_col).alias("id"), whole(F.col(vector_col)).alias("x")), "vectors")
    centroids = first_centroids(vectors, k, seed)
    schema = f"id {id_type}, cluster int, distance bigint"
    if not len(centroids):
        none = df.sparkSession.createDataFrame([], f"{schema}, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
        return none.withColumnRenamed("id", id_col)
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    placed = stored(vectors.mapInArrow(_assigned(SortedLists(centroids)), schema), "placed")
    inertia = {r.cluster: r.s for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sorted(inertia.items())]
    facts = df.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
