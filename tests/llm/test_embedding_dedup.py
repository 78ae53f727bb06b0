import numpy as np
import pytest

from hiretide.llm import embedding_dedup as E
from hiretide.llm import queries

SF = "/root/testdata/sf0.1"


def brute(ids, vectors, labels, threshold=0.93):
    ok = [v is not None and len(v) > 0 and None not in list(v) and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float)) and l is not None for v, l in zip(vectors, labels)]
    root, links = list(range(len(ids))), [0] * len(ids)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    groups = {}
    for i, good in enumerate(ok):
        if good:
            groups.setdefault((labels[i], len(vectors[i])), []).append(i)
    for members in groups.values():
        x = np.array([vectors[i] for i in members], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= threshold
        for a in range(len(members)):
            for b in np.flatnonzero(near[a]):
                if a != b:
                    links[members[a]] += 1
                    p, q = find(members[a]), find(members[b])
                    root[max(p, q)] = min(p, q)
    least = {}
    for i in range(len(ids)):
        least.setdefault(find(i), []).append(ids[i])
    return links, [min(least[find(i)]) for i in range(len(ids))]


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    links, component = brute([r["vec_id"] for r in rows], [r["embedding"] for r in rows], [r["label"] for r in rows])
    got = {r["vec_id"]: r for r in queries.QUERIES["op10_embedding_dedup"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r, n, c in zip(rows, links, component):
        assert (got[r["vec_id"]]["n_links"], got[r["vec_id"]]["component_id"], got[r["vec_id"]]["kept"]) == (n, c, c == r["vec_id"])


@pytest.mark.parametrize("spread", [0.05, 0.36])
def test_recall_with_many_lists(spark, spread):
    """Pairs close together and pairs close to the threshold, over some 60 lists and small chunks."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3000, 48))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=(1500, 48))
    twin = base[:1500] + spread * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    x = np.concatenate([base, twin]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2 if i < 3000 else (i - 3000) % 2) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in E.embedding_links(frame, list_rows=70, chunk=40).collect()}
    links, component = brute([r[0] for r in rows], [np.array(r[1], np.float32) for r in rows], [r[2] for r in rows])
    found = sum(min(got[i]["n_links"], n) for i, n in enumerate(links))
    assert sum(links) > 2000 and found / sum(links) >= (0.99 if spread < 0.1 else 0.9)
    assert all(got[i]["n_links"] <= n for i, n in enumerate(links))
    # links are found from both ends or from none
    single = [i for i, n in enumerate(links) if n == 1]
    for i in single:
        other = component[i] if component[i] != i else next(j for j in single if component[j] == i and j != i)
        assert got[i]["n_links"] == got[other]["n_links"]


@pytest.mark.parametrize("rank", [3, 48])
def test_nothing_is_lost_with_hundreds_of_lists(spark, rank):
    """Vectors that vary in few directions have their links along the borders of the lists."""
    rng = np.random.default_rng(rank)
    x = (rng.normal(size=(2500, rank)) @ np.linalg.qr(rng.normal(size=(48, rank)))[0].T).astype(np.float32)
    x[2000:] = x[:500] + 0.05 * x[500:1000]
    rows = [(i, v.tolist(), int(rng.integers(3))) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in E.embedding_links(frame, list_rows=10, chunk=64).collect()}
    links, component = brute([r[0] for r in rows], list(x), [r[2] for r in rows])
    assert sum(links) > 100
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(len(rows))] == list(zip(links, component))


def test_dense_groups_and_copies(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=16)
    rows = [(i, (centre + 0.01 * rng.normal(size=16)).tolist(), 1) for i in range(300)]
    rows += [(1000 + i, centre.tolist(), 1) for i in range(500)] + [(5000, (-centre).tolist(), 1), (5001, centre.tolist(), 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in E.embedding_links(frame, list_rows=30, chunk=50).collect()}
    assert {got[i]["n_links"] for i in [*range(300), *range(1000, 1500)]} == {799}
    assert {got[i]["component_id"] for i in range(300)} == {0} and got[5000]["n_links"] == got[5001]["n_links"] == 0


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0, "k"), (1, [1.0, 0.0], 0, "k"), (2, [2.0, 0.0], 0, "k"), (3, [1.0, 0.0], None, "k"), (4, None, 0, "k"), (5, [], 0, "k"),
        (6, [0.0, 0.0], 0, "k"), (7, [nan, 1.0], 0, "k"), (8, [inf, 1.0], 0, "k"), (9, [1.0, None], 0, "k"), (10, [1.0, 0.0, 0.0], 0, "k"),
        (11, [1.0, 0.0, 0.0], 0, "k"), (None, [1.0, 0.0], 0, None), (12, [1.0, 0.0], 1, "k"),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, key string")
    got = E.embedding_links(frame).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(tuple(r)[1:])
    assert by[1] == [(3, 1, True)] * 2 and by[2] == [(3, 1, False)] and by[None] == [(3, 1, False)]
    assert all(by[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 8, 9, 12)) and by[10] == [(1, 10, True)] and by[11] == [(1, 10, False)]
    assert E.embedding_links(frame.limit(0)).count() == 0
    assert E.embedding_links(frame.where("vec_id = 6")).collect()[0]["n_links"] == 0


def test_very_large_and_very_small_components_link(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e-200, 1e-200], 1), (3, [5e-324, 5e-324], 1), (4, [1.7e308, 1.6e308], 1), (5, [1.0, 1.0], 1),
            (6, [0.0, 0.0], 1), (7, [1e200, -1e200], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.embedding_links(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (4, 1) for i in range(1, 6)} | {6: (0, 6), 7: (0, 7)}
