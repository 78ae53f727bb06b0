"""Orchard's search and the clustering, against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from hiretide.llm import orchard as O

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=8, rounds=10, dims=64, steps=1024, seed=3):
    kept = [(i, [math.floor(x * steps) if abs(x) < 2**53 else int(x) * steps for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = {}
    for _, c, d in found:
        per[c] = per.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def long(x):
        return x if x < 1 << 63 else None

    return sorted(((i, c, long(d), long(per[c]), long(sum(per.values())), digest[c]) for i, c, d in found), key=repr)


def run(spark, rows, **options):
    found = O.cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), keep_vector=False, **options)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def vectors(n, dims=64, seed=1):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]) for i in range(n)]


def test_search_finds_the_nearest_and_measures_less():
    rng = np.random.default_rng(3)
    centroids = (rng.normal(size=(60, 3)) * 1000).astype(int).tolist() + [[0, 0, 0], [0, 0, 0], [2, 0, 0]]
    points = np.concatenate([(rng.normal(size=(500, 3)) * 1000).astype(np.int64), [[1, 0, 0], [0, 0, 0], *centroids[:5]]])
    measured = 0
    search = O.Orchard(centroids)
    distance = search._distance

    def counted(vectors, to):
        nonlocal measured
        measured += len(to)
        return distance(vectors, to)

    search._distance = counted
    cluster, best = search.nearest(points)
    for p, c, d in zip(points.tolist(), cluster, best):
        assert (d, c) == min((sum((a - b) ** 2 for a, b in zip(p, q)), j) for j, q in enumerate(centroids))
    assert measured < 0.7 * len(points) * len(centroids)


def test_equals_brute_force(spark):
    rows = vectors(300) + [(5, vectors(1)[0][1])] * 3 + [(None, [0.5] * 64), (901, None), (902, [1.0] * 63), (903, [1.0] * 63 + [None]),
                                                        (904, [1.0] * 63 + [float("nan")]), (905, [float("inf")] * 64), (906, []), (907, [0.0] * 64)]
    assert run(spark, rows) == brute(rows)


def test_equal_distances_and_empty_clusters(spark):
    rows = [(i, [float(i % 3 - 1)] * 2) for i in range(30)]  # three places, eight centroids
    assert run(spark, rows, dimensions=2, steps=1) == brute(rows, dims=2, steps=1)


@pytest.mark.parametrize("size", [1e5, 1e6, 1e20, 1e300])
def test_large_components_are_exact(spark, size):
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-1, 1) * (size if i % 5 == 0 else 1) for _ in range(64)]) for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [1.0])]) == []
    assert run(spark, vectors(3)) == brute(vectors(3))
    docs = spark.createDataFrame([(1, [0.5] * 64, "x", 9)], "vec_id long, embedding array<float>, c0 string, cluster int")
    found = O.cluster_vectors(docs)
    assert found.columns == ["vec_id", "embedding", "c0", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert [tuple(r)[2:5] for r in found.collect()] == [("x", 0, 0)]
