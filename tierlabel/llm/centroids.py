"""Clusters of vectors around integer centroids, assigned by a tournament of bisectors.

For two centroids a and b (a before b) a vector x is nearer to b exactly if ``2 (b - a) . x > |b|^2 - |a|^2``. These normals
and thresholds are integers and are worked out once a round for all pairs of centroids; a vector then needs k - 1 sign tests: the
winner so far meets the next centroid, and a difference of zero leaves the one of the smaller number. Only the winner's
distance is computed, exactly. All arithmetic is on whole numbers, so neither the order of rows nor the partitioning changes anything.

Vectors stay where they are: a round is one pass over a stored table in which each task gives a row of sums per
centroid, so what is shuffled and what the driver holds is k sums, whatever the number of vectors and however uneven the clusters.

Edge cases. Vectors that are null, of another length, or with a null or non-finite component are left out. Rows with equal
vectors are all kept; rows that share an id too. Equal hashes of first centroids (repeated ids) are ordered by the
vector; a null id comes last. With fewer vectors than centroids each vector is one; an empty table gives an empty result. A component of
which the integer exceeds 2^26 in size is an error, because distances might leave 64 bits. Texts do not occur here; extra
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tierlabel.llm.common import store

LARGEST = 1 << 26  # of a component: 64 products of two of them, and their differences, stay within 63 bits


@dataclass(frozen=True)
class Bisectors:
    """Centroids (rows of whole numbers) with the normal and threshold of every pair of them."""

    centroids: np.ndarray
    normals: np.ndarray
    thresholds: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> Bisectors:
        squares = (centroids * centroids).sum(axis=1)
        normals = 2 * (centroids[None, :, :] - centroids[:, None, :])
        return cls(centroids, normals, squares[None, :] - squares[:, None])

    def winners(self, x: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of each row, the smaller number if equal."""
        best = np.zeros(len(x), np.int64)
        for challenger in range(1, len(self.centroids)):
            for holder in np.unique(best):
                rows = np.flatnonzero(best == holder)
                side = x[rows] @ self.normals[holder, challenger] > self.thresholds[holder, challenger]
                best[rows[side]] = challenger
        return best

    def distances(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Squared distances of rows to the centroids of their clusters."""
        apart = x - self.centroids[cluster]
        return (apart * apart).sum(axis=1)

    def digests(self) -> list[str]:
        """Per centroid the SHA-256 of its components as decimal integers joined by commas."""
        return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in self.centroids]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(1).flatten().to_numpy().astype(np.int64).reshape(len(batch), -1)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """``(id, v array<int>)``: each component x as floor(scale * x); rows that are no full finite vector are left out."""
    doubles = vectors.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = doubles.filter(F.coalesce((F.size("v") == dim) & whole, F.lit(False)))
    too_large = F.raise_error(F.lit(f"a component times {scale} exceeds {LARGEST}")).cast("int")

    def floored(x):
        scaled = F.floor(x * F.lit(float(scale)))
        return F.when(F.abs(x * F.lit(float(scale))) <= LARGEST, scaled.cast("int")).otherwise(too_large)

    return kept.select(id_col, F.transform("v", floored).alias("v"))


def first_centroids(vectors: DataFrame, id_col: str, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:id``; Spark keeps k rows a task while it orders them."""
    hashed = vectors.withColumn("__hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256))
    rows = hashed.orderBy(F.asc_nulls_last("__hash"), "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def _sums(vectors: DataFrame, bisectors: Bisectors) -> dict[int, tuple[int, int, list[int]]]:
    """Per non-empty cluster the number of its vectors, the sum of their distances and that of their components."""
    k, dim = bisectors.centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 2), np.int64)
        for batch in batches:
            x = _matrix(batch)
            cluster = bisectors.winners(x)
            distance = bisectors.distances(x, cluster)
            for c in np.unique(cluster):
                own = cluster == c
                total[c] += np.concatenate([[own.sum(), distance[own].sum()], x[own].sum(axis=0)])
        met = np.flatnonzero(total[:, 0])
        place = np.tile(np.arange(dim + 2, dtype=np.int32), len(met))
        columns = [pa.array(np.repeat(met, dim + 2).astype(np.int32)), pa.array(place), pa.array(total[met].ravel())]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "place", "part"])

    parts = vectors.mapInArrow(partial, "cluster int, place int, part long")
    # exact beyond 64 bits
    summed = parts.groupBy("cluster", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    found: dict[int, list[int]] = {}
    for r in summed:
        found.setdefault(r.cluster, [0] * (dim + 2))[r.place] = int(r.total)
    return {c: (v[0], v[1], v[2:]) for c, v in found.items()}


def centroid_clusters(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 8,
    dim: int = 64,
    scale: int = 1024,
    rounds: int = 10,
    seed: int = 3,
) -> tuple[DataFrame, np.ndarray]:
    """Fit centroids in a fixed number of rounds and assign every kept vector.

    Returns ``(id, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string)`` per vector and the
    final centroids. A round replaces each non-empty centroid by the floor of its vectors' mean; empty ones stay.
    The integer vectors are written to the shared folder once and read in each round.
    """
    if not (k >= 1 and dim >= 1 and dim <= 64):
        raise ValueError("k must be at least 1 and dim from 1 to 64")
    whole = store(integer_vectors(vectors, id_col, vector_col, dim, scale), "integer-vectors")
    schema = T.StructType(
        [
            T.StructField(id_col, vectors.schema[id_col].dataType),
            T.StructField("cluster", T.IntegerType()),
            T.StructField("distance", T.LongType()),
            T.StructField("cluster_inertia", T.LongType()),
            T.StructField("inertia", T.LongType()),
            T.StructField("centroid_sha256", T.StringType()),
        ]
    )
    start = first_centroids(whole, id_col, k, seed)
    if not len(start):
        return vectors.sparkSession.createDataFrame([], schema), np.empty((0, dim), np.int64)
    bisectors = Bisectors.of(start)
    for _ in range(rounds):
        moved = bisectors.centroids.copy()
        for c, (n, _, total) in _sums(whole, bisectors).items():
            moved[c] = [t // n for t in total]
        bisectors = Bisectors.of(moved)
    inertias = {c: inertia for c, (_, inertia, _) in _sums(whole, bisectors).items()}
    if (total := sum(inertias.values())) >= 1 << 63:
        raise OverflowError("the sum of all distances exceeds 64 bits")
    by_cluster = np.array([inertias.get(c, 0) for c in range(len(start))], dtype=np.int64)
    digests = pa.array(bisectors.digests())
    arrow = to_arrow_schema(schema)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            cluster = bisectors.winners(x)
            columns = [
                batch.column(0),
                pa.array(cluster.astype(np.int32)),
                pa.array(bisectors.distances(x, cluster)),
                pa.array(by_cluster[cluster]),
                pa.array(np.full(len(x), total, np.int64)),
                digests.take(pa.array(cluster)),
            ]
            yield pa.RecordBatch.from_arrays(columns, arrow.names)

    return whole.mapInArrow(assign, schema), bisectors.centroids
