"""Exact k-means over integer vectors: bounds, two remembered centroids, and a shrinking search ball."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.session import stage_once

DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
#: Greatest magnitude of a scaled component: 64 squared differences then stay below 2**62.
LARGEST = 1 << 27
#: Bounds are square roots in floating point, widened by far more than their rounding error.
WIDEN = 1 + 2.0**-40

STATE = "vec_id BIGINT, v ARRAY<INT>, near INT, second INT, upper DOUBLE, lower DOUBLE"


def scaled(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors with exactly ``dimensions`` finite components, each component floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    kept = vectors.select("vec_id", x.alias("x")).filter((F.size("x") == dimensions) & F.forall("x", finite))
    whole = lambda e: F.when(
        F.abs(e * scale) >= LARGEST, F.raise_error(F.lit(f"a component beyond {LARGEST // scale} has no distance that a long can hold")).cast("double"),
    ).otherwise(F.floor(e * scale).cast("double"))
    return kept.select("vec_id", F.transform("x", whole).cast("array<int>").alias("v"))


def first_centroids(vectors: DataFrame, k: int, order: Column) -> np.ndarray:
    """The first ``k`` vectors in ``order``, ties by their components; at most k rows come to the driver."""
    seeds = vectors.select("v", order.alias("place")).filter("place IS NOT NULL").orderBy("place", "v").limit(k).collect()
    return np.array([r.v for r in seeds], dtype=np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def between(centroids: np.ndarray) -> np.ndarray:
    """Distances of all centroids from one another, never rounded up."""
    d = centroids[:, None, :] - centroids[None, :, :]
    return np.sqrt(np.einsum("ijk,ijk->ij", d, d).astype(np.float64)) / WIDEN


class Search:
    """Nearest centroids of many vectors against one set of centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.k = len(centroids)
        self.apart = between(centroids)
        self.order = np.argsort(self.apart + np.diag(np.full(self.k, -1.0)), axis=1, kind="stable")  # itself first
        away = self.apart + np.diag(np.full(self.k, np.inf))
        self.half = away.min(axis=1) / 2 if self.k > 1 else np.full(self.k, np.inf)

    def settled(self, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Whether the bounds prove that no other centroid is as near as the assigned one."""
        return upper < np.maximum(lower, self.half[near])

    def assign(self, v: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """Assignment, second nearest and bounds of every vector; equal distances go to the smaller number."""
        near, second, upper, lower = near.copy(), second.copy(), upper.copy(), lower.copy()
        if self.k == 1:
            return np.zeros_like(near), np.zeros_like(second), upper, lower
        open_ = np.flatnonzero(~self.settled(near, upper, lower))
        if len(open_):  # the bound from above made tight may be enough
            upper[open_] = np.sqrt(squared(v[open_], self.centroids[near[open_]]).astype(np.float64)) * WIDEN
            open_ = open_[~self.settled(near[open_], upper[open_], lower[open_])]
        if not len(open_):
            return near, second, upper, lower
        w, a, b = v[open_], near[open_], second[open_]
        to_a, to_b = squared(w, self.centroids[a]), squared(w, self.centroids[b])
        closer = (to_b < to_a) | ((to_b == to_a) & (b < a))
        a, b = np.where(closer, b, a), np.where(closer, a, b)
        to_a, to_b = np.where(closer, to_b, to_a), np.where(closer, to_a, to_b)
        start, reach = a.copy(), np.sqrt(to_a.astype(np.float64)) * WIDEN
        left = np.arange(len(open_))
        for place in range(1, self.k):
            # Who is nearer than the second lies within the two distances of the start; the ball shrinks with the second.
            c = self.order[start[left], place]
            inside = self.apart[start[left], c] <= reach[left] + np.sqrt(to_b[left].astype(np.float64)) * WIDEN
            left, c = left[inside], c[inside]
            if not len(left):
                break
            at, c = (lambda fresh: (left[fresh], c[fresh]))((c != a[left]) & (c != b[left]))
            d = squared(w[at], self.centroids[c])
            first = (d < to_a[at]) | ((d == to_a[at]) & (c < a[at]))
            then = ~first & ((d < to_b[at]) | ((d == to_b[at]) & (c < b[at])))
            won, rest = at[first], at[then]
            b[won], to_b[won] = a[won], to_a[won]
            a[won], to_a[won] = c[first], d[first]
            b[rest], to_b[rest] = c[then], d[then]
        near[open_], second[open_] = a, b
        upper[open_] = np.sqrt(to_a.astype(np.float64)) * WIDEN
        lower[open_] = np.sqrt(to_b.astype(np.float64)) / WIDEN
        return near, second, upper, lower


def loosen(near: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after the centroids moved by ``moved``: up by the own move, down by the greatest move of another."""
    if len(moved) == 1:
        return upper + moved[near], lower
    most, order = moved.max(), np.argsort(moved)
    others = np.where(near == order[-1], moved[order[-2]], most)
    return (upper + moved[near]) * WIDEN, np.maximum(lower - others, 0.0) / WIDEN


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _assign(vectors: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """One pass over all vectors; ``before`` are the centroids that the stored bounds hold for, None at the start."""
    moved = None
    if before is not None:
        d = centroids - before
        moved = np.sqrt(np.einsum("ij,ij->i", d, d).astype(np.float64)) * WIDEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), centroids.shape[1])
            n = len(v)
            if moved is None:
                near, second = np.zeros(n, np.int32), np.full(n, min(1, len(centroids) - 1), np.int32)
                upper, lower = np.full(n, np.inf), np.zeros(n)
            else:
                near, second, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("near", "second", "upper", "lower"))
                upper, lower = loosen(near, upper, lower, moved)
            near, second, upper, lower = search.assign(v, near, second, upper, lower)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(near, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower)],
                ["vec_id", "v", "near", "second", "upper", "lower"],
            )

    return vectors.mapInArrow(run, STATE)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact componentwise floor of every cluster's mean; a cluster without vectors stays. One row per cluster is collected."""
    width = centroids.shape[1]
    # Below 2**36 vectors even the greatest components sum to a long; partial sums shrink to a row per cluster before the shuffle.
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(width)]
    out = centroids.copy()
    for row in state.groupBy("near").agg(F.count("*").alias("n"), *sums).collect():
        out[row.near] = [row[f"s{i}"] // row.n for i in range(width)]
    return out


def _distances(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("near").to_numpy(zero_copy_only=False)
            d = squared(_matrix(batch.column("v"), centroids.shape[1]), centroids[near])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("near"), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    return state.mapInArrow(run, "vec_id BIGINT, cluster INT, distance BIGINT")


def cluster(spark: SparkSession, vectors: DataFrame, seed_order: Column, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """Lloyd's algorithm, exactly, on ``floor(64 * x)`` of every vector (Shallot's search).

    Takes ``vec_id`` and ``embedding``; other columns are not read, so their names cannot clash. Returns
    (vec_id, cluster, distance, cluster_inertia, inertia, centroid): the squared distance, its sums over the cluster and
    over all, and the components of the final centroid. Vectors that do not have exactly ``dimensions`` non-null finite
    components are left out. Centroids start as the ``k`` vectors that come first in ``seed_order`` (null: never), equal
    places by components; repeated rows count as often as they stand, so equal centroids can start and the smaller number
    gets all their vectors. Fewer vectors than ``k`` give as many centroids; no kept vector, or none with a place, gives
    no rows. A null ``vec_id`` is kept. A component of 2**21 or more in magnitude is an error, as distances must fit a long.

    Each vector keeps its nearest and second nearest centroid and bounds on both distances. While the bounds prove the
    assignment nothing is computed; else the exact integer distances of the two remembered centroids are, the search starts
    from the closer one, and its neighbours are compared in order of their distance to it until they leave the ball, whose
    radius shrinks with every better second. No vector is shuffled: a round is one pass that writes vectors and bounds to
    the shared folder, and a sum with one row per cluster and task.
    """
    vectors = stage_once(scaled(vectors, dimensions), "vectors")
    centroids = first_centroids(vectors, k, seed_order)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id BIGINT, cluster INT, distance BIGINT, cluster_inertia BIGINT, inertia BIGINT, centroid ARRAY<BIGINT>")
    before, state = None, vectors
    for _ in range(rounds):
        state = stage_once(_assign(state, centroids, before), "assigned")
        before, centroids = centroids, _means(state, centroids)
    found = stage_once(_distances(_assign(state, centroids, before), centroids), "distances")
    totals = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    rows = [(c, totals[c], sum(totals.values()), [int(x) for x in centroids[c]]) for c in sorted(totals)]
    # At most k rows.
    about = spark.createDataFrame(rows, T.StructType.fromDDL("cluster INT, cluster_inertia BIGINT, inertia BIGINT, centroid ARRAY<BIGINT>"))
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
