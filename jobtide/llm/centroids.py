"""Centroid clustering of integer vectors; the nearest centroid is found by Orchard's search.

Each centroid has a list of the others, nearest first. A vector starts at some centroid and walks that centroid's list;
whenever it finds a closer one it goes on with that one's list. The walk ends at a list entry strictly beyond
twice the current distance: by the triangle inequality no later entry can be closer, nor as close under a smaller number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import stored

WIDE = 2.0**26  # larger components could take a squared distance out of a long


class Centroids:
    """At most a few thousand integer vectors with their sorted neighbour lists."""

    def __init__(self, points: np.ndarray):
        self.points = np.asarray(points, np.int64)
        gap = np.square(self.points[:, None, :] - self.points[None, :, :]).sum(axis=2)
        # The first entry of a list is the centroid itself and is skipped by the walk.
        np.fill_diagonal(gap, -1)
        self.lists = np.argsort(gap, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gap, self.lists, axis=1)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of the nearest centroid of each row, ties to the smaller number, and how many distances were
        worked out. All rows take a step at a time."""
        n, k = len(rows), len(self.points)
        here = np.zeros(n, np.int64)
        dist = np.square(rows - self.points[0]).sum(axis=1) if n else np.zeros(0, np.int64)
        made, seen = n, np.zeros((n, k), bool)
        seen[:, 0] = True
        place = np.ones(n, np.int64)
        active = np.arange(n) if k > 1 else np.zeros(0, np.int64)
        while len(active):
            at, p = here[active], place[active]
            # Strictly beyond twice the distance, in squares.
            beyond = self.gaps[at, p] > 4 * dist[active]
            active, at, p = active[~beyond], at[~beyond], p[~beyond]
            other = self.lists[at, p]
            place[active] += 1
            fresh = ~seen[active, other]
            asked, other = active[fresh], other[fresh]
            if len(asked):
                seen[asked, other] = True
                found = np.square(rows[asked] - self.points[other]).sum(axis=1)
                made += len(asked)
                closer = (found < dist[asked]) | ((found == dist[asked]) & (other < here[asked]))
                moved = asked[closer]
                here[moved], dist[moved], place[moved] = other[closer], found[closer], 1
            active = active[place[active] < k]
        return here, dist, made


def _vectors(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _assigned(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    size = centroids.points.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here, dist, _ = centroids.nearest(_vectors(batch, size))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(here, pa.int32()), pa.array(dist)], ["id", "cluster", "distance"])

    return vectors.select("id", "vector").mapInArrow(assign, "id long, cluster int, distance long")


def _moved(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """Each centroid at the componentwise floor of the mean of its vectors; one without vectors stays."""
    size = centroids.points.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One row per centroid and batch; components are below 2**26, so a batch's sums fit a long.
        for batch in batches:
            rows = _vectors(batch, size)
            here, _, _ = centroids.nearest(rows)
            own, counts = np.unique(here, return_counts=True)
            order = np.argsort(here, kind="stable")
            totals = np.add.reduceat(rows[order], np.cumsum(counts) - counts, axis=0) if len(own) else np.zeros((0, size), np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * size, pa.int32()), pa.array(totals.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(counts, pa.int64()), flat], ["cluster", "n", "total"])

    parts = vectors.select("vector").mapInArrow(sums, "cluster int, n long, total array<long>")
    # Sums of all rows may leave a long.
    totals = [F.sum(F.get("total", F.lit(i)).cast("decimal(20,0)")).alias(f"t{i}") for i in range(size)]
    points = centroids.points.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():  # one row per centroid
        points[row["cluster"]] = [int(row[f"t{i}"]) // row["n"] for i in range(size)]
    return Centroids(points)


def centroid_clusters(
    rows: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: str = "1:", id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of every vector with exactly ``size`` components, none null or non-finite.

    Each component x becomes floor(scale * x). The first centroids are the ``k`` vectors with the smallest lowercase-hex sha256 of ``seed`` and the
    id, in this order (of equal hashes the smaller vector; null ids last; all vectors, if fewer than ``k``). Each of ``rounds`` rounds assigns all vectors to the nearest
    centroid by squared Euclidean distance, ties to the smaller number, and moves every centroid that has vectors to the componentwise exact
    floor(sum / count). A last pass gives the cluster, the squared distance, the sum of distances over the cluster and over all, and the
    final centroid. All arithmetic is in integers; a component of 2**26 or more after scaling is an error, as distances would leave a long.

    Rows that share an id are vectors of their own. A table without such vectors gives no rows. Only the ``k`` centroids and, per round, their sums
    go through the driver; ``k`` is a parameter of at most a few thousand. Equal vectors, however many, meet in no task.
    """
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.size("v") == size)
    kept = kept.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    scaled = F.transform("v", lambda x: F.floor(x * scale))
    wide = F.exists("v", lambda x: F.abs(x * scale) >= WIDE)
    checked = F.when(wide, F.raise_error(F.lit(f"a component reaches 2**26 after scaling by {scale}")).cast("array<long>")).otherwise(scaled)
    vectors = stored(kept.select("id", checked.alias("vector")))
    digest = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = vectors.orderBy(digest.asc_nulls_last(), "vector").limit(k).collect()
    out = T.StructType.fromDDL("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    if not first:
        return rows.sparkSession.createDataFrame([], out)
    centroids = Centroids(np.array([r["vector"] for r in first], np.int64).reshape(len(first), size))
    for _ in range(rounds):
        centroids = _moved(vectors, centroids)
    assigned = stored(_assigned(vectors, centroids))
    own = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # one row per centroid
    total = sum(r["cluster_inertia"] for r in own)
    known = [(r["cluster"], r["cluster_inertia"], total, centroids.points[r["cluster"]].tolist()) for r in own]
    per_cluster = rows.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return assigned.join(F.broadcast(per_cluster), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
