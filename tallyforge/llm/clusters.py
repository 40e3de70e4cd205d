"""Centroid clustering with block-norm screening.

Vectors are integers. Each is stored with a compressed form, the norms of its segments rounded
down. For a segment of a vector and of a centroid, Cauchy-Schwarz bounds the distance from
below by the difference of the two norms, and by one less if both are rounded. The sum of these
squares over all segments is a lower bound made of a few integers; only centroids whose bound
doesn't exceed the exact distance to the best one so far get an exact integer distance.

Assignment runs where the vectors lie. A round exchanges one row of sums for each task and
centroid, which are added up component by component; k centroids of ``dims`` components are
all that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed

#: Components of a vector, of a segment, the factor before rounding down, centroids and rounds.
DIMS, SEGMENT, SCALE, CENTROIDS, ROUNDS = 64, 8, 64, 16, 3
#: Integers from which on a squared distance need not fit a long.
LIMIT = 1 << 27
#: Vectors whose bounds a task holds at a time.
BLOCK = 4096


def norms(x: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The norm of each segment of the rows of ``x``, rounded down."""
    squares = (x.reshape(len(x), -1, segment) ** 2).sum(2)
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    return root + ((root + 1) * (root + 1) <= squares)


def bounds(compressed: np.ndarray, centroid_norms: np.ndarray) -> np.ndarray:
    """A lower bound of each squared distance between vectors and centroids, by rounded norms alone."""
    gap = np.abs(compressed[:, None, :] - centroid_norms[None, :, :]) - 1
    return (np.maximum(gap, 0) ** 2).sum(2)


def nearest(x: np.ndarray, compressed: np.ndarray, centroids: np.ndarray, centroid_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of each vector (ties: the smaller number), and how many exact distances that took."""
    low = bounds(compressed, centroid_norms)
    cluster = low.argmin(1)
    distance = ((x - centroids[cluster]) ** 2).sum(1)
    first, taken = cluster.copy(), len(x)
    for j in range(len(centroids)):
        at = np.flatnonzero((low[:, j] <= distance) & (first != j))
        exact = ((x[at] - centroids[j]) ** 2).sum(1)
        taken += len(at)
        better = (exact < distance[at]) | ((exact == distance[at]) & (j < cluster[at]))
        cluster[at[better]], distance[at[better]] = j, exact[better]
    return cluster, distance, taken


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def quantised(vectors: DataFrame, id_column: str, vector_column: str, dims: int, scale: int, segment: int) -> DataFrame:
    """(vec_id, x, norms) of the usable vectors: integers floor(scale * component) and the compressed form."""
    bounded_batches(vectors.sparkSession)
    v = vectors[vector_column]
    number: Column = F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    usable = (F.size(v) == dims) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < LIMIT))
    rows = vectors.where(usable).select(vectors[id_column].cast("long").alias("vec_id"), F.transform(number, lambda c: c.cast("int")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = norms(matrix(batch.column(1), dims), segment).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), dims // segment).cast(pa.list_(pa.int32()))], names=["vec_id", "x", "norms"])

    return rows.mapInArrow(run, "vec_id bigint, x array<int>, norms array<int>")


def assigned(kept: DataFrame, centroids: np.ndarray, segment: int) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    dims, centroid_norms = centroids.shape[1], norms(centroids, segment)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                cluster, distance, _ = nearest(matrix(part.column(1), dims), matrix(part.column(2), dims // segment), centroids, centroid_norms)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return kept.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def moved(kept: DataFrame, centroids: np.ndarray, segment: int) -> np.ndarray:
    """The centroids after one round: floors of means, an empty cluster's centroid as it was."""
    dims, centroid_norms = centroids.shape[1], norms(centroids, segment)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                x = matrix(part.column(1), dims)
                cluster, _, _ = nearest(x, matrix(part.column(2), dims // segment), centroids, centroid_norms)
                counts += np.bincount(cluster, minlength=len(centroids))
                np.add.at(sums, cluster, x)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(counts[some], pa.int64()), "sums": pa.array(sums[some].tolist(), pa.list_(pa.int64()))})

    parts = kept.mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("i", "v")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    out = centroids.copy()
    for r in each.collect():  # one row for each component of a centroid
        out[r.cluster, r.i] = r.v // r.n
    return out


def cluster(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, segment: int = SEGMENT) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256, one row for each usable vector.

    Usable vectors have exactly ``dims`` components, none null, NaN or infinite, nor so large
    (2**27 after scaling) that squared distances leave a long; all others are left out. The k
    first centroids are the vectors with the smallest sha256 of "1:<vec_id>"; of rows that
    share a vec_id the one with the smaller components comes first, and rows without one are
    clustered but never start a cluster, so fewer than k rows with an id make fewer clusters
    (none at all: no rows). Repeated rows count and appear each. A distance that ties goes to
    the smaller cluster. Sums beyond a long are null. Other columns aren't read.
    """
    spark = vectors.sparkSession
    kept = checkpointed(quantised(vectors, id_column, vector_column, dims, scale, segment))
    named = kept.where("vec_id is not null").select("x", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("key"))
    start = [r.x for r in named.orderBy("key", "x").limit(k).collect()]
    ddl = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], ddl)
    centroids = np.array(start, np.int64)
    for _ in range(rounds):
        centroids = moved(kept, centroids, segment)
    found = checkpointed(assigned(kept, centroids, segment))
    by_cluster = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    fits = lambda n: int(n) if n < 1 << 63 else None
    rows = [(j, fits(t), fits(sum(by_cluster.values())), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, t in by_cluster.items()]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> str:
    """DuckDB SQL for cluster() over the table embeddings: plain distances to all centroids."""
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dims})""",
        f"""c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS INT) AS j, x AS c FROM kept ORDER BY j LIMIT {k})""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min(d) AS distance, arg_min(j, (d, j)) AS cluster FROM
  (SELECT r, vec_id, x, j, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{i}) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT cluster, list(CAST(floor_mean AS BIGINT) ORDER BY i) AS c FROM
  (SELECT cluster, i, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean FROM (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY cluster, i) GROUP BY cluster)""")
            steps.append(f"c{i + 1} AS (SELECT j, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} m ON m.cluster = j)")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.j = a.cluster"""
