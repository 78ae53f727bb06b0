"""Embedding near-dedup by product quantisation.

Vectors of one label link when their cosine is at least ``threshold``, which for
unit vectors is a distance of at most r = sqrt(2 - 2 threshold).

* Equal vectors of a label are one class with a count, so copies cost a row each.
* Coarse centroids and one code book per subspace of the residuals are learned
  from a bounded sample (``SAMPLE`` classes); every class is put in the inverted
  list of its nearest centroid and coded.
* A partner in another list lies beyond the plane between the two centroids, so a
  class meets every list whose plane it is within r of, and none is lost.  Of two
  lists one probes the other, so a pair meets once; pairs of one list meet twice.
* In a list, table look-ups give the distance to each coded member.  A member's
  coding error is stored, so what is further than r plus that error cannot link;
  the rest is ranked by its exact cosine in double precision.
* Lists are dealt in chunks of bounded size.  A chunk returns counts and a forest
  of its links, never the pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiretide.llm.common import map_rows
from hiretide.llm.components import connected_components
from hiretide.operators.scratch import materialise

THRESHOLD = 0.93
SAMPLE = 16_384
LIST_ROWS = 800
MAX_LISTS = 1024
SUBSPACES = 8
CODES = 128
ROUNDS = 8
#: Members and probing classes of one list that meet in one task.
CHUNK = 2048
_SLACK = 1e-9
#: Rounding of squared distances between unit vectors and centres, amply.
_ROUNDING = 1e-7


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0)


def k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from k random points; an empty centre stays where it is."""
    if len(x) <= k:
        return x.copy()
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own = squared_distances(x, centres).argmin(1)
        order = np.argsort(own, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0])
        sums = np.add.reduceat(x[order], starts, axis=0)
        centres[own[order][starts]] = sums / np.diff(np.r_[starts, len(x)])[:, None]
    return centres


@dataclass
class Quantiser:
    centres: np.ndarray  # lists x d
    books: list[np.ndarray]  # per subspace, codes x its width
    cuts: list[int]  # where subspaces begin, and the end

    def encode(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Own list, codes, coding error and the lists to probe of unit vectors: all that hold a partner within radius and are not to probe theirs."""
        d = squared_distances(x, self.centres)
        own = d.argmin(1)
        apart = np.sqrt(squared_distances(self.centres, self.centres))
        near = d - d[np.arange(len(x)), own][:, None] <= 2 * apart[own] * radius + _ROUNDING
        place = np.arange(len(self.centres))
        near &= (own[:, None] < place) == ((own[:, None] + place) % 2 == 0)
        near[np.arange(len(x)), own] = True
        residual = x - self.centres[own]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        left = np.zeros(len(x))
        for s, book in enumerate(self.books):
            ds = squared_distances(residual[:, self.cuts[s]:self.cuts[s + 1]], book)
            codes[:, s] = ds.argmin(1)
            left += ds.min(1)
        return own, codes, np.sqrt(left), [np.flatnonzero(row) for row in near]

    def distances(self, queries: np.ndarray, place: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of whole queries to coded members of one list, by table look-up."""
        residual = queries - self.centres[place]
        total = np.zeros((len(queries), len(codes)))
        for s, book in enumerate(self.books):
            total += squared_distances(residual[:, self.cuts[s]:self.cuts[s + 1]], book)[:, codes[:, s]]
        return np.sqrt(total)


def learn(sample: np.ndarray, lists: int) -> Quantiser:
    """Coarse centres, then code books of the residuals."""
    d = sample.shape[1]
    centres = k_means(sample, lists, 0)
    residual = sample - centres[squared_distances(sample, centres).argmin(1)]
    cuts = np.linspace(0, d, min(SUBSPACES, d) + 1).astype(int).tolist()
    books = [k_means(residual[:, a:b], CODES, 1 + s) for s, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return Quantiser(centres, books, cuts)


def unit(raw: list[bytes], d: int) -> np.ndarray:
    """Unit vectors in double precision from float32 or float64 bytes."""
    kind = np.float32 if raw and len(raw[0]) == 4 * d else np.float64
    x = np.frombuffer(b"".join(raw), kind).reshape(-1, d).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _keyed(vectors: DataFrame, vec: str, label: str, key: str) -> DataFrame:
    """Rows with the bytes of a usable vector and a 128-bit key of label and vector; null where it links with nothing."""
    kind = np.float32 if vectors.schema[vec].dataType.elementType.simpleString() == "float" else np.float64

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        raw, keys = [], []
        for v, name in zip(batch.column(vec), batch.column(label).cast(pa.string()).to_pylist()):
            x = None if not v.is_valid or name is None or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(kind)
            usable = x is not None and len(x) and np.isfinite(x).all()
            if usable:
                most = float(np.abs(x).max())
                usable = most > 0
                if usable and not 1e-100 < most < 1e100:  # its squares would over- or underflow; a power of two changes no cosine
                    x = np.ldexp(x, -int(np.frexp(most)[1]))
            raw.append(x.tobytes() if usable else None)
            keys.append(xxhash.xxh3_128_digest(name.encode() + b"\0" + x.tobytes()) if usable else None)
        return {"raw": raw, key: keys, "dim": [len(x) // np.dtype(kind).itemsize if x else None for x in raw]}

    return map_rows(vectors, run, f"raw binary, `{key}` binary, dim int", [vec])


def _linked(classes: DataFrame, dim: int, threshold: float, chunk: int, list_rows: int) -> DataFrame:
    """``(cid, n, root)`` per class and chunk it has links in: how many vectors it links to there, and a member of its part."""
    radius = np.sqrt(max(0.0, 2 - 2 * threshold)) + _SLACK
    total = classes.count()
    lists = int(min(MAX_LISTS, max(1, total // list_rows)))
    # by hash: as many as SAMPLE, give or take its square root
    share = F.pmod(F.xxhash64("cid", "raw"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / max(total, 1))))
    picked = classes.where(share).select("raw").toArrow()
    if not picked.num_rows:
        picked = classes.limit(1).select("raw").toArrow()
    quantiser = learn(unit(picked["raw"].to_pylist(), dim), lists)

    def encode(batch: pa.RecordBatch) -> dict[str, object]:
        own, codes, error, near = quantiser.encode(unit(batch.column("raw").to_pylist(), dim), radius)
        return {"own": own, "codes": [c.tobytes() for c in codes], "error": error, "near": [n.tolist() for n in near]}

    coded = materialise(map_rows(classes.select("cid", "label", "m", "raw"), encode, "own int, codes binary, error double, near array<int>"), "coded")
    probing = coded.select("cid", "label", F.explode("near").alias("place"))
    sizes = (
        coded.groupBy("label", F.col("own").alias("place")).agg(F.count("*").alias("members"))
        .join(probing.groupBy("label", "place").agg(F.count("*").alias("probes")), ["label", "place"])
        .select("label", "place", F.ceil(F.col("members") / chunk).alias("mc"), F.ceil(F.col("probes") / chunk).alias("qc"))
    )
    spread = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "cid"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    members = (
        coded.withColumn("place", F.col("own")).join(sizes, ["label", "place"])
        .withColumn("x", spread("mc", 1)).withColumn("y", every("qc"))
    )
    queries = (
        coded.withColumn("place", F.explode("near")).join(sizes, ["label", "place"])
        .withColumn("x", every("mc")).withColumn("y", spread("qc", 2))
    )
    columns = ["label", "place", "x", "y", "cid", "m", "raw", "own"]
    both = members.select(F.lit(True).alias("member"), *columns, "codes", "error").unionByName(
        queries.select(F.lit(False).alias("member"), *columns), allowMissingColumns=True)

    def meet(table: pa.Table) -> pa.Table:
        member = table["member"].to_numpy(zero_copy_only=False)
        j, i = np.flatnonzero(member), np.flatnonzero(~member)
        cid, m, own = (table[c].to_numpy() for c in ("cid", "m", "own"))
        raw, codes = (table[c].to_pylist() for c in ("raw", "codes"))
        place = int(table["place"][0].as_py())
        if not len(i) or not len(j):
            return pa.table({"cid": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        q, x = unit([raw[k] for k in i], dim), unit([raw[k] for k in j], dim)
        error = table["error"].to_numpy()[j]
        coded_ = np.frombuffer(b"".join(codes[k] for k in j), np.uint8).reshape(len(j), -1)
        a, b = np.nonzero(quantiser.distances(q, place, coded_) <= radius + error[None, :])
        hits = [np.empty((0, 2), np.int64)]
        for at in range(0, len(a), 1 << 18):
            some, other = a[at:at + (1 << 18)], b[at:at + (1 << 18)]
            ok = (np.einsum("ij,ij->i", q[some], x[other]) >= threshold) & (cid[i[some]] != cid[j[other]])
            hits.append(np.stack([i[some[ok]], j[other[ok]]], axis=1))
        i, j = np.concatenate(hits).T
        counts = np.zeros(len(cid), np.int64)
        np.add.at(counts, i, m[j])
        # the other direction is seen in the same list, or nowhere
        across = own[i] != place
        np.add.at(counts, j[across], m[i[across]])
        root = cid.copy()
        while len(i):
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            if np.array_equal(new, root):
                break
            root = new
        some = np.unique(np.concatenate([i, j]))
        return pa.table({"cid": pa.array(cid[some]), "n": pa.array(counts[some]), "root": pa.array(root[some])})

    return both.groupBy("label", "place", "x", "y").applyInArrow(meet, "cid bigint, n bigint, root bigint")


def embedding_links(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, chunk: int = CHUNK, list_rows: int = LIST_ROWS) -> DataFrame:
    """One row per vector: the id, ``n_links``, ``component_id`` and ``kept`` (id equals component_id).

    Vectors without label, null, empty or zero vectors and vectors with null or non-finite components link with
    nothing and are their own component; so do vectors of unlike length among each other.  Repeated rows are
    separate vectors.  component_id is the smallest non-null id reachable.  An empty table gives none.  The number
    of lists does not change the result; where few lists are farther than r, the work grows with the square of a label.
    """
    key = "key"
    rows = materialise(
        _keyed(vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vec).alias("vec")), "vec", "label", key), "vectors"
    )
    classes = rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min("vec_id").alias("first"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("raw").alias("raw"), F.first("dim").alias("dim")
    )
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    parts = [
        _linked(classes.where(F.col("dim") == d["dim"]), d["dim"], threshold, chunk, list_rows)
        for d in classes.select("dim").distinct().orderBy("dim").collect()
    ]
    if not parts:
        return rows.select(F.col("vec_id").alias(vec_id), F.lit(0).cast("bigint").alias("n_links"),
                           F.col("vec_id").cast("bigint").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = materialise(found, "links")
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    component = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    labelled = (
        classes.select(F.col(key).alias("_key"), "cid", "first", "m").join(counts, "cid", "left")
        .join(component, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    )
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = labelled.join(least, "component").select(
        "_key", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id"
    )
    joined = rows.join(by_class, F.col(key) == F.col("_key"), "left")
    component_id = F.when(F.col(key).isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast("bigint")
    return joined.select(
        F.col("vec_id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component_id.alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(False)).alias("kept"),
    )
