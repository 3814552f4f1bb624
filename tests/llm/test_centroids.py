import hashlib
import math
import random

import pytest
from pyspark.sql import types as T

from tierlabel.llm.centroids import LARGEST, Bisectors, centroid_clusters

import numpy as np

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        *[T.StructField(c, T.StringType()) for c in ("v", "cluster", "distance", "__hash", "place")],
    ]
)


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA)


def brute_force(rows, k, dim, rounds, seed=3, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [list(v) for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        for c, vs in own.items():
            centroids[c] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, c, d in found:
        inertia[c] = inertia.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in found], key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    dim, k = r.choice([1, 2, 3]), r.choice([1, 4, 8])
    grid = lambda: [r.randint(-3, 3) / 1024 * r.choice([1, 1.5]) for _ in range(dim)]  # noqa: E731  many ties
    rows = [(i, grid()) for i in range(120)]
    rows += [(7, grid()), (7, grid()), (None, grid()), (500, None), (501, [0.0] * (dim + 1)), (502, [None] * dim), (503, [math.nan] * dim), (504, [math.inf] * dim), (505, [])]
    found, _ = centroid_clusters(table(spark, rows).repartition(5), k=k, dim=dim, rounds=5)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_force(rows, k, dim, 5)


def test_zero_favours_the_smaller_number():
    b = Bisectors.of(np.array([[0], [4], [4], [2]]))
    assert b.winners(np.array([[2], [1], [3], [4], [-9]])).tolist() == [3, 0, 1, 1, 0]


def test_largest_components_and_beyond(spark):
    edge = LARGEST / 1024
    rows = [(i, [edge * (-1) ** (i * j) for j in range(64)]) for i in range(6)]
    found, _ = centroid_clusters(table(spark, rows), k=2, rounds=3)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_force(rows, 2, 64, 3)
    with pytest.raises(Exception, match="exceeds"):
        centroid_clusters(table(spark, [(1, [edge * 1.01] * 64)]))


def test_empty_and_few(spark):
    found, centroids = centroid_clusters(table(spark, []))
    assert found.collect() == [] and len(centroids) == 0
    found, centroids = centroid_clusters(table(spark, [(1, [0.5] * 64)]))
    assert [(r.cluster, r.distance) for r in found.collect()] == [(0, 0)] and len(centroids) == 1
