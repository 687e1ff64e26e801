"""Centroid clustering in whole numbers, by exponion search.

A vector keeps an upper bound of the distance to its centroid and a lower bound of that to any other. While the first
stays under the second, or under half the way to the nearest other centroid, nothing is searched. Else only centroids
inside a ball around its own are: those within twice its distance and the way to the nearest other, read off a list
sorted by distance. Bounds are rounded outwards and the radius is inclusive, so ties are met and go to the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged_at

CLUSTERS, ROUNDS, SIZE, SCALE = 40, 5, 64, 256
#: Components from which on squared distances need not fit a long.
LARGEST = 1 << 27
#: Share by which bounds are rounded outwards, far above what a square root loses.
SLACK = 1e-9
#: Vectors that are compared at once.
ROWS = 4_096


def whole_vectors(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """Vectors of ``size`` finite components as floor(scale * x). One too large for distances in a long stops the job."""
    rows = table.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("x"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.where((F.size("x") == size) & F.forall("x", finite))
    small = lambda x: F.abs(x * scale) < LARGEST
    return rows.select("id", F.transform("x", lambda x: F.when(small(x), F.floor(x * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for squared distances in 64 bits")).cast("int"))).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int, salt: str) -> np.ndarray:
    """The vectors of the smallest hashes of their ids, at most ``clusters`` rows; of one id, the smaller vector first."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64)


class Centroids:
    """Centroids with their distances to each other, sorted for each, and how far they moved from those before."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at = at
        k = len(at)
        apart = np.sqrt(((at[:, None, :] - at[None, :, :]) ** 2).sum(axis=2).astype(np.float64)) * (1 - SLACK)  # at least so far apart
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.sorted = np.take_along_axis(apart, self.order, axis=1)
        np.fill_diagonal(apart, np.inf)
        self.nearest = apart.min(axis=1) if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if before is None else np.sqrt(((at - before) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
        ranked = np.sort(self.moved)[::-1]
        self.others = np.where(np.arange(k) == self.moved.argmax(), ranked[1] if k > 1 else 0.0, ranked[0])  # farthest that another moved


def exact(x: np.ndarray, centroids: Centroids, cluster: np.ndarray) -> np.ndarray:
    """Squared distances to a centroid each."""
    gap = x - centroids.at[cluster]
    return np.einsum("ij,ij->i", gap, gap)


def nearest_of(x: np.ndarray, centroids: Centroids, lists: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector the nearest of the first ``counts`` centroids of its list, and the two least squared distances.

    Ties go to the smaller number, whatever the order of the list. Of one centroid the second distance is the largest long.
    """
    n, most = len(x), np.iinfo(np.int64).max
    cluster, best, second = np.full(n, len(centroids.at)), np.full(n, most), np.full(n, most)
    for j in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > j)
        c = lists[live, j]
        d = exact(x[live], centroids, c)
        wins = (d < best[live]) | ((d == best[live]) & (c < cluster[live]))
        second[live] = np.where(wins, best[live], np.minimum(second[live], d))
        best[live[wins]], cluster[live[wins]] = d[wins], c[wins]
    return cluster, best, second


def bounds_of(best: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.sqrt(best.astype(np.float64)) * (1 + SLACK), np.sqrt(second.astype(np.float64)) * (1 - SLACK)


def search(x: np.ndarray, centroids: Centroids, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroids and bounds after the centroids moved. ``cluster`` is -1 where nothing is known yet."""
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    new = np.flatnonzero(cluster < 0)
    k = len(centroids.at)
    if len(new):
        cluster[new], best, second = nearest_of(x[new], centroids, np.broadcast_to(np.arange(k), (len(new), k)), np.full(len(new), k))
        upper[new], lower[new] = bounds_of(best, second)
    old = np.setdiff1d(np.arange(len(x)), new)
    upper[old] = (upper[old] + centroids.moved[cluster[old]]) * (1 + SLACK)
    lower[old] = np.maximum(0, (lower[old] - centroids.others[cluster[old]]) * (1 - SLACK))
    safe = lambda rows: upper[rows] < np.maximum(lower[rows], centroids.nearest[cluster[rows]] / 2)
    open_ = old[~safe(old)]
    upper[open_] = np.sqrt(exact(x[open_], centroids, cluster[open_]).astype(np.float64)) * (1 + SLACK)
    open_ = open_[~safe(open_)]
    if len(open_):
        own = cluster[open_]
        radius = (2 * upper[open_] + np.where(np.isfinite(centroids.nearest[own]), centroids.nearest[own] * (1 + 4 * SLACK), 0)) * (1 + SLACK)
        counts = np.zeros(len(open_), np.int64)
        for c in np.unique(own):
            rows = own == c
            counts[rows] = np.searchsorted(centroids.sorted[c], radius[rows], side="right")
        cluster[open_], best, second = nearest_of(x[open_], centroids, centroids.order[own], counts)
        upper[open_], lower[open_] = bounds_of(best, second)
    return cluster, upper, lower


def assigned(state: DataFrame, centroids: Centroids, known: bool) -> DataFrame:
    """``state`` (id, v and, once ``known``, cluster, upper, lower) with clusters and bounds for these centroids."""
    kind = state.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n = batch.num_rows
                x = batch.column(1).flatten().to_numpy().reshape(n, -1).astype(np.int64)
                if known:
                    cluster, upper, lower = (batch.column(i).to_numpy() for i in (2, 3, 4))
                else:
                    cluster, upper, lower = np.full(n, -1), np.zeros(n), np.zeros(n)
                cluster, upper, lower = search(x, centroids, cluster.astype(np.int64), upper, lower)
                columns = [batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(exact(x, centroids, cluster))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "v", "cluster", "upper", "lower", "distance"])

    return state.mapInArrow(run, f"id {kind}, v array<int>, cluster int, upper double, lower double, distance bigint")


def moved(state: DataFrame, centroids: Centroids) -> Centroids:
    """Each centroid at the exact floor of its vectors' mean, or where it was without any: a row a cluster comes back."""
    size = centroids.at.shape[1]
    at = centroids.at.copy()
    for row in state.groupBy("cluster").agg(F.count(F.lit(1)), *[F.sum(F.col("v")[i].cast("bigint")) for i in range(size)]).collect():
        cluster, n, *sums = row
        at[cluster] = [s // n for s in sums]
    return Centroids(at, centroids.at)


def cluster(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = "2:") -> DataFrame:
    """Each kept vector's cluster, squared distance, inertia of its cluster and of all, and its centroid's digest.

    Kept are vectors of ``size`` finite components; a null vector or component drops the row. Centroids begin as the
    vectors of the smallest ids' hashes (a null id is empty; of fewer vectors than ``clusters``, all). Repeated rows are
    vectors each. An empty table gives no rows. A round reads the table of the one before, which is then dropped.
    """
    kind = table.schema[id_col].dataType.simpleString()
    state, path = staged_at(whole_vectors(table, id_col=id_col, vector_col=vector_col, size=size, scale=scale))
    spark, first = table.sparkSession, first_centroids(state, clusters, salt)
    if not len(first):
        return spark.createDataFrame([], f"{id_col} {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    at = Centroids(first)
    for i in range(rounds + 1):
        (state, written), old = staged_at(assigned(state, at, i > 0)), path
        drop_staged(spark, old)
        path = written
        at = moved(state, at) if i < rounds else at
    sums = {r["cluster"]: r["inertia"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.at.tolist()]
    about = spark.createDataFrame([(c, s, sum(sums.values()), digests[c]) for c, s in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    found = state.select(F.col("id").alias(id_col), "cluster", "distance")
    return found.join(F.broadcast(about), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a cluster, `clusters` at most
