"""Centroid clustering of integer vectors by sort-means.

Each round orders the other centroids by their distance from each centroid. A vector is compared first
with the centroid it had, then with the others in that one's order, until a centroid lies strictly
beyond twice the vector's distance: by the triangle inequality all later ones are farther away. A
centroid at just twice the distance may still tie and is looked at.

All arithmetic is on whole numbers. Assignments are narrow steps; a round's sums are one native
aggregation with a row a cluster, and only centroids (clusters x size numbers) come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import drop_stored, stored

#: Vectors become floor(SCALE * x). Up to MOST_VALUE every squared distance of 64 components fits a long.
SCALE = 64
MOST_VALUE = float(1 << 21)
LONG_MAX = (1 << 63) - 1
ASSIGNED = "vec_id long, vector array<long>, cluster int, distance long"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole_vectors(embeddings: DataFrame, size: int) -> DataFrame:
    """vec_id and vector (array of long) of the embeddings with ``size`` components, all finite and within MOST_VALUE."""
    x = F.col("embedding").cast("array<double>")
    usable = (F.size(x) == size) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > MOST_VALUE))
    return embeddings.filter(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * SCALE)).alias("vector"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest sha256 of ``seed:vec_id``, in its order; a null id is the empty text, ties go by vector."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "vector").orderBy("key", "vector").limit(clusters).collect()
    return np.array([r["vector"] for r in rows], dtype=np.int64)


def nearest(vectors: np.ndarray, previous: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each vector; ties go to the smaller number."""
    between = np.square(centroids[:, None, :] - centroids[None, :, :]).sum(2)
    cluster = previous.copy()
    distance = np.square(vectors - centroids[previous]).sum(1)
    for c in np.unique(previous):
        rows = np.flatnonzero(previous == c)
        own = distance[rows]
        for other in np.argsort(between[c], kind="stable"):
            if other == c:
                continue
            # between > 4 * own, without the product that could pass a long's range
            live = own > (between[c, other] - 1) // 4
            rows, own = rows[live], own[live]
            if not len(rows):
                break
            d = np.square(vectors[rows] - centroids[other]).sum(1)
            better = (d < distance[rows]) | ((d == distance[rows]) & (other < cluster[rows]))
            distance[rows[better]], cluster[rows[better]] = d[better], other
    return cluster, distance


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Vectors with their nearest centroid: a narrow step. Without a column ``cluster`` the scan begins at centroid 0."""
    size = centroids.shape[1]
    known = vectors if "cluster" in vectors.columns else vectors.withColumn("cluster", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            cluster, distance = nearest(values, batch.column("cluster").to_numpy(zero_copy_only=False), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "vector", "cluster", "distance"])

    return known.select("vec_id", "vector", "cluster").mapInArrow(run, ASSIGNED)


def moved(members: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid at floor(sum / count) of its vectors; an empty one stays."""
    sums = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.element_at("vector", i + 1)) for i in range(centroids.shape[1])]).alias("sums"))
    out = centroids.copy()
    for r in sums.collect():
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out


def cluster_vectors(embeddings: DataFrame, clusters: int = 16, rounds: int = 3, size: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, squared distance, its sum over the cluster and over all, and the sha256 of the final centroid.

    Left out are null vectors, those of another size, and those with a component that is null, NaN,
    infinite or beyond two millions, where distances leave a long. With fewer vectors than clusters each
    is a centroid; an empty table gives an empty result. A null vec_id is kept and hashed as the empty
    text; repeated rows and ids are vectors of their own, equal vectors have equal results; ties go to
    the smaller number; other columns are ignored. An inertia beyond a long is null.
    """
    spark = embeddings.sparkSession
    vectors = stored(whole_vectors(embeddings, size), "vectors")
    centroids = first_centroids(vectors, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    for number in range(rounds + 1):
        before, vectors = vectors, stored(assigned(vectors, centroids), f"assigned-{number}")
        drop_stored(before)
        if number < rounds:
            centroids = moved(vectors, centroids)
    parts = {r["cluster"]: int(r["total"]) for r in vectors.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    long = lambda x: x if x <= LONG_MAX else None
    whole = long(sum(parts.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    facts = spark.createDataFrame([(c, long(n), whole, digest(c)) for c, n in parts.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return vectors.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # one row a cluster
