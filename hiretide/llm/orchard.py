"""Centroid clustering with Orchard's search for the nearest centroid.

For each centroid there is a list of all centroids, nearest first.  A vector
starts at some centroid and walks that one's list; whenever it meets a closer
centroid, it jumps to the list of that one.  Centroids met are marked visited
and not measured again.  It stops as soon as the next centroid on the list is
strictly beyond twice the current distance, since by the triangle inequality
neither it nor any later one can be closer, or as close with a smaller number.

Components are integers (a fixed number of steps per unit, rounded down) and all
sums and distances are exact.  A round is one pass over the vectors: tasks
search and sum their vectors by centroid, Spark adds the sums up, the driver
holds the centroids alone.  Sums travel in limbs of 32 bits, which cannot
overflow.  Values too large for 64-bit distances are worked with in Python's
unbounded integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiretide.llm.common import positional, restored, slices
from hiretide.operators.scratch import materialise

CLUSTERS = 8
ROUNDS = 10
DIMENSIONS = 64
STEPS = 1024
SEED = 3
#: Components below this keep the squared distance of 64 components within 63 bits.
_SAFE = 1 << 27
_LIMB = 32


def usable(vectors: pa.ListArray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have the right number of components, none null or not finite, and the components of these."""
    whole = pc.fill_null(pc.equal(pc.list_value_length(vectors), dimensions), False)
    mask = whole.to_numpy(zero_copy_only=False).copy()
    flat = vectors.filter(whole).flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, dimensions)  # null becomes nan
    finite = np.isfinite(values).all(1) if len(values) else np.empty(0, bool)
    mask[mask] = finite
    return mask, values[finite]


def stepped(values: np.ndarray, steps: int) -> np.ndarray:
    """floor(steps * x) of each component, as int64, or as Python integers where one is too large."""
    if not values.size or np.abs(values).max() * steps < _SAFE:
        return np.floor(values * steps).astype(np.int64)
    # a double of 2^53 or more is an integer itself
    flat = [int(x) * steps if abs(x) >= 1 << 53 else math.floor(x * steps) for x in values.ravel().tolist()]
    return np.array(flat, object).reshape(values.shape)


class Orchard:
    """The centroids, with each one's neighbours in order of distance."""

    def __init__(self, centroids: list[list[int]]) -> None:
        small = all(abs(x) < _SAFE for c in centroids for x in c)
        self.centroids = np.array(centroids, np.int64 if small else object)
        k = len(centroids)
        self.between = np.array([[_square(a - b) for b in self.centroids] for a in self.centroids], object).reshape(k, k)
        if small:
            self.between = self.between.astype(np.int64)
        self.lists = np.array([sorted(range(k), key=lambda j: (int(row[j]), j)) for row in self.between], np.int64)
        # where to start: the centroid next to the vector on the axis that spreads the centroids most
        spread = [max(c) - min(c) for c in zip(*centroids)]
        self.axis = spread.index(max(spread)) if spread else 0
        self.along = sorted(range(k), key=lambda j: int(self.centroids[j][self.axis]))

    def _distance(self, vectors: np.ndarray, to: np.ndarray) -> np.ndarray:
        gap = vectors - self.centroids[to]
        return (gap * gap).sum(1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each vector (the smaller of equals) and the squared distance."""
        if vectors.dtype == object and self.centroids.dtype != object:
            return Orchard._wide(self).nearest(vectors)
        n, k = len(vectors), len(self.centroids)
        values = self.centroids[self.along, self.axis]
        here = np.array(self.along)[np.minimum(np.searchsorted(values, vectors[:, self.axis]), k - 1)] if n else np.empty(0, np.int64)
        best = self._distance(vectors, here)
        visited = np.zeros((n, k), bool)
        visited[np.arange(n), here] = True
        place, walking = np.zeros(n, np.int64), np.arange(n)
        while len(walking):
            walking = walking[place[walking] < k]
            met = self.lists[here[walking], place[walking]]
            # squares: beyond twice the distance is beyond four times its square
            far = (self.between[here[walking], met] > 4 * best[walking]).astype(bool)
            walking, met = walking[~far], met[~far]
            place[walking] += 1
            new = ~visited[walking, met]
            rows, met = walking[new], met[new]
            visited[rows, met] = True
            d = self._distance(vectors[rows], met)
            closer = ((d < best[rows]) | ((d == best[rows]) & (met < here[rows]))).astype(bool)
            jump, to = rows[closer], met[closer]
            best[jump], here[jump], place[jump] = d[closer], to, 0
        return here, best

    @staticmethod
    def _wide(of: Orchard) -> Orchard:
        out = Orchard.__new__(Orchard)
        out.__dict__ |= of.__dict__ | {"centroids": of.centroids.astype(object), "between": of.between.astype(object)}
        return out


def _square(gap: np.ndarray) -> int:
    return sum(int(x) * int(x) for x in gap)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(number, part) with value = sum of part * 2^(32 number); the last part carries the sign."""
    at = 0
    while not -(1 << 31) <= value < 1 << 31:
        yield at, value & ((1 << _LIMB) - 1)
        value >>= _LIMB
        at += 1
    yield at, value


def _summed(rows: list, *by: str) -> dict:
    """Whole sums from the sums of limbs."""
    out: dict = {}
    for r in rows:
        key = tuple(r[b] for b in by)
        out[key] = out.get(key, 0) + (int(r["part"]) << (_LIMB * r["limb"]))
    return out


def _first_centroids(vectors: DataFrame, key: str, vector: str, clusters: int, dimensions: int, steps: int, seed: int) -> list[list[int]]:
    """Vectors of the smallest hashes of '<seed>:<key>'; equal hashes by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    chosen = vectors.select(digest.alias("h"), F.col(vector).alias("v")).orderBy("h", "v").limit(clusters).collect()
    if not chosen:
        return []
    values = np.array([r["v"] for r in chosen], np.float64).reshape(-1, dimensions)
    return [[int(x) for x in row] for row in stepped(values, steps)]


def _moved(vectors: DataFrame, vector: str, centroids: list[list[int]], dimensions: int, steps: int) -> list[list[int]]:
    """The centroids after one round: means of the vectors nearest to each, rounded down."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, sums, counts = Orchard(centroids), {}, np.zeros(len(centroids), np.int64)
        for batch in slices(batches):
            _, values = usable(batch.column("v"), dimensions)
            points = stepped(values, steps)
            cluster, _ = search.nearest(points)
            counts += np.bincount(cluster, minlength=len(centroids))
            for c in np.unique(cluster).tolist():
                part = points[cluster == c].sum(0)
                sums[c] = [a + int(b) for a, b in zip(sums.get(c, [0] * dimensions), part)]
        rows = [(c, d, limb, part) for c, total in sums.items() for d, value in enumerate([*total, int(counts[c])]) for limb, part in _limbs(value)]
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["cluster", "d", "limb", "part"])

    parts = vectors.select(F.col(vector).alias("v")).mapInArrow(add, "cluster long, d long, limb long, part long")
    # clusters x components x limbs rows, however many vectors
    total = _summed(parts.groupBy("cluster", "d", "limb").agg(F.sum("part").alias("part")).collect(), "cluster", "d")
    return [
        [total[c, d] // n for d in range(dimensions)] if (n := total.get((c, dimensions), 0)) else old
        for c, old in enumerate(centroids)
    ]


def cluster_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
                    dimensions: int = DIMENSIONS, steps: int = STEPS, seed: int = SEED, keep_vector: bool = True) -> DataFrame:
    """Rows with a usable vector, with ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    Rows whose vector is null, has another number of components or one that is null or not finite are left out; none
    left gives no row.  With fewer vectors than clusters there are so many centroids.  Equal distances go to the
    smaller number, repeated rows each count, a null key hashes as empty text.  A squared distance or sum beyond 63
    bits is null.  Columns named like an output are replaced by it.
    """
    plain, names = positional(rows)
    key_, vector_ = names[key], names[vector]
    finite = F.forall(vector_, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = plain.where((F.size(vector_) == dimensions) & finite)
    centroids = _first_centroids(plain, key_, vector_, clusters, dimensions, steps, seed)
    outputs = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not centroids:
        empty = plain.withColumns({c: F.lit(None).cast("bigint") for c in outputs} | {"cluster": F.lit(None).cast("int"), "centroid_sha256": F.lit(None).cast("string")})
        return restored(empty.limit(0) if keep_vector else empty.limit(0).drop(vector_), names, outputs)
    for _ in range(rounds):
        centroids = _moved(plain, vector_, centroids, dimensions, steps)

    kept = [c for c in plain.columns if keep_vector or c != vector_]
    schema = plain.select(*kept).schema.simpleString()[len("struct<"):-1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        for batch in slices(batches):
            _, values = usable(batch.column(vector_), dimensions)
            cluster, distance = search.nearest(stepped(values, steps))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(cluster, pa.int32()),
                 pa.array([int(x) if x < 1 << 63 else None for x in distance.tolist()], pa.int64()),
                 pa.array([int(x) >> _LIMB if x < 1 << 63 else None for x in distance.tolist()], pa.int64())],
                names=[*kept, "cluster", "distance", "high"])

    found = materialise(plain.mapInArrow(assign, f"{schema}, cluster int, distance bigint, high bigint"), "clusters")
    low = F.col("distance").bitwiseAND(F.lit((1 << _LIMB) - 1))
    sums = {
        r["cluster"]: None if r["lost"] else (int(r["high"] or 0) << _LIMB) + int(r["low"] or 0)
        for r in found.groupBy("cluster").agg(F.sum("high").alias("high"), F.sum(low).alias("low"), F.max(F.col("distance").isNull()).alias("lost")).collect()
    }

    def long(x: int | None):
        return F.lit(x if x is not None and x < 1 << 63 else None).cast("bigint")

    def by_cluster(values: list):
        return F.array(*values)[F.col("cluster")]

    inertia = None if None in sums.values() else sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    out = found.withColumns({
        "cluster_inertia": by_cluster([long(sums.get(c, 0)) for c in range(len(centroids))]),
        "inertia": long(inertia), "centroid_sha256": by_cluster([F.lit(d) for d in digests]),
    })
    return restored(out, names, outputs)
