"""Clustering around centroids (Lloyd's rounds) whose nearest-centroid searches are Orchard's.

Every centroid has a list of all others, nearest first. A vector starts at some centroid and walks its
list; at a centroid that is closer it jumps to that one's list; what it has met is marked and not
measured again. It stops at the first centroid strictly farther than twice its distance from the one
whose list it walks: by the triangle inequality no later one can be closer, nor as close.

Vectors and centroids are integers, so distances, sums and means are exact and results don't depend on
how the rows are dealt. Each round is one pass over the stored vectors: a task gives a row of sums
for each centroid, whatever its number of vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import scratch, short_batches, staged

#: Components are scaled by this before they are floored.
SCALE = 1024
#: Integer components of at most this size have squared distances that a long holds (64 components).
LARGEST = 1 << 27
#: Vectors times centroids whose marks a task holds at once.
MARKS = 1 << 24
#: Centroids that may be asked for: their table of distances is on the driver and in each task.
MOST_CENTROIDS = 4096


def lattice_vectors(table: DataFrame, dimensions: int, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): vectors of exactly ``dimensions`` components, none null or non-finite, as integers floor(scale * x)."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") == dimensions)).where(~odd)
    # Beyond LARGEST the value only has to be seen to be too large.
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(F.greatest(F.least(scale * x, F.lit(2.0**40)), F.lit(-(2.0**40))))).alias("x"))


class Centroids:
    """Integer centroids with Orchard's lists."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.int64)
        k = len(points)
        self.between = np.stack([((self.points - p) ** 2).sum(axis=1) for p in self.points])
        # By distance, then number: itself comes first or beside one that equals it.
        self.lists = np.stack([np.lexsort((np.arange(k), self.between[c])) for c in range(k)])
        spread = self.points.max(axis=0) - self.points.min(axis=0)
        self.axis = int(spread.argmax())
        self.order = np.argsort(self.points[:, self.axis], kind="stable")
        self.along = self.points[self.order, self.axis]

    def _starts(self, x: np.ndarray) -> np.ndarray:
        """A centroid near each vector on the axis along which centroids spread most."""
        right = np.clip(np.searchsorted(self.along, x[:, self.axis]), 0, len(self.along) - 1)
        left = np.maximum(right - 1, 0)
        nearer = np.abs(self.along[left] - x[:, self.axis]) <= np.abs(self.along[right] - x[:, self.axis])
        return self.order[np.where(nearer, left, right)]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The number of the nearest centroid of each vector (the smaller on ties), the squared distance,
        and how many distances were measured."""
        step = max(1, MARKS // len(self.points))
        parts = [self._walk(x[i : i + step]) for i in range(0, len(x), step)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), sum(p[2] for p in parts)

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        n, k = len(x), len(self.points)
        at = self._starts(x)
        best = ((x - self.points[at]) ** 2).sum(axis=1)
        met = np.zeros((n, k), bool)
        met[np.arange(n), at] = True
        place = np.zeros(n, np.int64)  # in the list of ``at``
        walking, measured = np.arange(n), n
        while len(walking):
            candidate = self.lists[at[walking], place[walking]]
            # The lists' distances are squares: twice the distance is four times the square.
            going = self.between[at[walking], candidate] <= 4 * best[walking]
            walking, candidate = walking[going], candidate[going]
            place[walking] += 1
            new = ~met[walking, candidate]
            rows, found = walking[new], candidate[new]
            met[rows, found] = True
            measured += len(rows)
            far = ((x[rows] - self.points[found]) ** 2).sum(axis=1)
            closer = (far < best[rows]) | ((far == best[rows]) & (found < at[rows]))
            rows = rows[closer]
            at[rows], best[rows], place[rows] = found[closer], far[closer], 0
            walking = walking[place[walking] < k]
        return at, best, measured


def _rows(column) -> np.ndarray:
    """An Arrow column of lists of equal length as a matrix."""
    n = len(column)
    return np.asarray(column.flatten(), np.int64).reshape(n, -1) if n else np.zeros((0, 1), np.int64)


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of seed and vec_id, in that order; equal ids by their
    components. Vectors without an id don't start a cluster."""
    chosen = vectors.where("vec_id is not null").select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h"), "x").orderBy("h", "x").limit(k)
    return np.array([r["x"] for r in chosen.collect()], np.int64)  # k rows


def _moved(vectors: DataFrame, centroids: Centroids) -> np.ndarray:
    """The centroids' next places: the floor of the mean of each one's vectors; those without stay."""
    k = len(centroids.points)

    def run(batches):
        sums, counts = np.zeros_like(centroids.points), np.zeros(k, np.int64)
        for batch in batches:
            x = _rows(batch.column(0))
            if len(x):
                cluster, _, _ = centroids.nearest(x)
                np.add.at(sums, cluster, x)
                counts += np.bincount(cluster, minlength=k)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(counts[own]), pa.array(list(sums[own]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = vectors.select("x").mapInArrow(run, "cluster long, n long, sums array<long>")
    wide = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    total = wide.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    points = centroids.points.copy()
    for r in total.collect():  # k rows for each component
        points[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return points


def fit(vectors: DataFrame, k: int, rounds: int, seed: str) -> Centroids | None:
    """Centroids after ``rounds`` rounds over ``vectors`` (vec_id, x; stored); None if there are none.

    Fewer than ``k`` vectors give as many centroids. Equal centroids are kept apart: the smaller
    number takes the vectors, the other stays empty where it is.
    """
    if not 0 < k <= MOST_CENTROIDS:
        raise ValueError(f"the number of centroids must be from 1 to {MOST_CENTROIDS}")
    points = first_centroids(vectors, k, seed)
    if not len(points):
        return None
    for _ in range(rounds):
        points = _moved(vectors, Centroids(points))
    return Centroids(points)


def assign(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """(vec_id, cluster, distance): each vector's nearest centroid and the squared distance."""

    def run(batches):
        for batch in batches:
            cluster, distance, _ = centroids.nearest(_rows(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "x").mapInArrow(run, "vec_id long, cluster int, distance long")


def digest(point: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in point).encode()).hexdigest()


def _by_cluster(values: dict[int, object], kind: str) -> Column:
    table = F.create_map(*(x for c, v in sorted(values.items()) for x in (F.lit(c), F.lit(v).cast(kind))))
    return F.element_at(table, F.col("cluster"))


def cluster_vectors(table: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, seed: str = "3:") -> DataFrame:
    """A row for each kept vector of ``table`` (vec_id, embedding): vec_id, cluster, distance,
    cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dimensions`` components, none null or non-finite, as integers
    floor(1024 * x). Repeated rows are vectors of their own; a vector without an id is assigned but
    starts no cluster; an empty table gives an empty result; other columns are ignored. Components
    beyond 2 ** 27 have distances that a long can't hold: that is an error, not a dropped vector.
    """
    spark = table.sparkSession
    short_batches(spark)
    vectors = staged(lattice_vectors(table, dimensions), "lattice")
    r = vectors.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("largest"), F.count("vec_id").alias("n")).first()
    if (r["largest"] or 0) > LARGEST:
        raise ValueError(f"a component of {r['largest']} is too large for exact distances (at most {LARGEST})")
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = fit(vectors, k, rounds, seed)
    if centroids is None:
        return spark.createDataFrame([], schema)
    path = scratch(spark, "clusters")
    assign(vectors, centroids).write.parquet(path)
    assigned = spark.read.schema("vec_id long, cluster int, distance long").parquet(path)
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    digests = {c: digest(p) for c, p in enumerate(centroids.points)}
    return assigned.select("vec_id", "cluster", "distance", _by_cluster(sums, "long").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), _by_cluster(digests, "string").alias("centroid_sha256"))
